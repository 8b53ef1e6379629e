"""Ship this package to the Python workers, so that a cluster's machines need no copy of it."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

from graphloom.sources.working import folder

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put the package into the shared folder and add it to the session's files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    root, data = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.join("graphloom", os.path.relpath(os.path.join(top, name), root)))
    where = f"{folder(spark)}/graphloom-code-{uuid.uuid4().hex}/graphloom.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
    sc.addPyFile(where)
    _done.add(sc.applicationId)
