"""Tables written between steps of a loop, in the folder named by spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; a new local one only where the setting is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it again: lineage ends here, and each round of a loop costs one step.

    Results read these tables lazily, so they stay until ``drop`` or the program's end.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables from ``keep`` that nothing reads any more: those of a loop's earlier rounds."""
    for df in tables:
        path = getattr(df, "_kept_at", None)
        for x in [x for x in _left if x[1] == path]:
            _left.remove(x)
            _delete(*x)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session is going: its owner clears the shared folder
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _left:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
