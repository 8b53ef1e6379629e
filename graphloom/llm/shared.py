"""Working tables in the folder that every executor and the driver share."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.shipping import ship
from graphloom.sources.working import folder

_left: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is over: its owner clears the shared folder
        pass


@atexit.register
def _clear() -> None:
    for spark, path in _left:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


class Tables:
    """Tables written by one operator call: lineage ends at each, so a lost executor costs one step.

    ``drop`` deletes those that later steps no longer read; the rest go when the program ends.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.root, self.paths = spark, folder(spark), {}

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{self.root}/graphloom-{name}-{uuid.uuid4().hex}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*by) if by else w).parquet(path)
        self.paths.setdefault(name, []).append(path)
        _left.append((self.spark, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                _delete(self.spark, path)
                _left[:] = [x for x in _left if x[1] != path]

    def release(self) -> None:
        """Let Spark drop shuffle files of the finished steps, which nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(keys: DataFrame, key: str, bits: int = 1 << 25) -> DataFrame:
    """A hash bitmap of ``keys`` of a fixed size (4 MiB as 1,024 rows), whatever their number.

    It is only a pre-filter in front of an exact join: a crowded bitmap lets more rows through.
    """
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return (
        keys.select(at.alias("_at"))
        .select(F.expr("bitmap_bucket_number(_at)").alias("_bucket"), F.expr("bitmap_bit_position(_at)").alias("_bit"))
        .groupBy("_bucket")
        .agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))
    )


def maybe(df: DataFrame, key: str, bits_of: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """``df`` with ``_maybe``: false where the key is surely not in the bitmap.  The broadcast has a fixed bound: 4 MiB."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return (
        df.withColumn("_at", at)
        .withColumn("_bucket", F.expr("bitmap_bucket_number(_at)"))
        .withColumn("_bit", F.expr("bitmap_bit_position(_at)"))
        .join(F.broadcast(bits_of), "_bucket", "left")
        .withColumn("_maybe", F.expr("coalesce((conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) >> cast(_bit % 8 as int)) % 2 = 1, false)"))
        .drop("_at", "_bucket", "_bit", "_bits")
    )


def maybe_in(df: DataFrame, key: str, bits_of: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in the bitmap."""
    return maybe(df, key, bits_of).where("_maybe").drop("_maybe")


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of ``edges`` (a, b): root is the least id of its component.

    Contraction: every vertex takes its least neighbour as parent, parents are followed
    once, and the edges are rewritten between parents until none is left.  All steps are
    joins and map-side combined aggregates; only an emptiness test reaches the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = tables.write(both.where("a <> b").distinct(), "cc-edges")
    whole = None
    while True:
        par = e.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        par = tables.write(par, "cc-parents")  # plain joins of tables follow: Spark can split the parent of very many
        up = par.select(F.col("a").alias("p"), F.col("p").alias("q"))
        par = tables.write(par.join(up, "p").select("a", F.col("q").alias("p")), "cc-parents")
        if whole is None:
            whole = par.select(F.col("a").alias("id"), F.col("p").alias("root"))
        else:
            step = par.select(F.col("a").alias("root"), "p")
            whole = whole.join(step, "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        whole = tables.write(whole, "cc-roots")
        pa, pb = par.select("a", F.col("p").alias("pa")), par.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        e = tables.write(e.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "cc-edges")
        if e.isEmpty():
            tables.paths.setdefault("cc-result", []).append(tables.paths["cc-roots"].pop())
            tables.drop("cc-edges", "cc-parents", "cc-roots")
            return whole
