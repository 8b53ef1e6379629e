"""Vector search, nearest neighbours and similarity edges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from graphloom.functions.vectors import cosine
from graphloom.shipping import ship
from graphloom.sources.working import keep


def search(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(id, score): the ``k`` nearest of (id, vec) by cosine: one scan and a top-k per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", F.round(cosine(F.col("vec"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def knn(vectors: DataFrame, k: int, least: float = 0.0, block: int | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(id, other, score, rank): of each (id, vec), or of each of ``queries``, the ``k`` nearest others at cosine ``least`` or more.

    Exact in blocks: blocks of unit vectors meet pairwise as matrices, each keeps its best ``k`` a row, and
    the lists are merged.  A task holds two blocks of at most ``block`` rows (some 8 MB each unless given); work is all pairs, memory isn't,
    and either side is moved as often as the other has blocks.
    """
    ship(vectors.sparkSession)

    def parts(df: DataFrame) -> int:
        n, dims = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
        least_parts = 1 if block else min(6, -(-n // 1024))  # so that few rows, too, are several tasks' work
        return max(1, least_parts, -(-n // (block or max(512, min(16384, BLOCK_CELLS // max(1, dims))))))

    asked, vectors = (df.where("id is not null") for df in (vectors if queries is None else queries, vectors))
    held = parts(vectors)
    turns = held if queries is None else parts(asked)
    row = lambda df, at, n: df.select("id", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(at))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = row(asked, "x", turns).withColumn("y", every(held)), row(vectors, "y", held).withColumn("x", every(turns)).select("id", "vec", "y", "x")
    kind = vectors.schema["id"].dataType.simpleString()
    run = _best(k, least)
    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(run, f"id {kind}, other {kind}, score double")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k)


def _units(vecs) -> np.ndarray:
    m = np.zeros((len(vecs), max(map(len, vecs), default=0)))
    for i, x in enumerate(vecs):
        m[i, : len(x)] = x
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


#: Numbers that a block of ``knn`` and a tile of scores hold.
BLOCK_CELLS, TILE_CELLS = 1 << 20, 1 << 21


def _best(k: int, least: float):
    """Of each vector of a block the ``k`` nearest of another block, ties by id: (id, other, score)."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": a["id"][:0], "other": a["id"][:0], "score": []})
        b = b.sort_values("id", kind="stable")
        ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
        x, y = _units(a["vec"].tolist()), _units(b["vec"].tolist())
        width = min(x.shape[1], y.shape[1])
        own = np.searchsorted(ids_b, ids_a, "left"), np.searchsorted(ids_b, ids_a, "right")
        step, out = max(1, TILE_CELLS // len(ids_b)), []
        for at in range(0, len(ids_a), step):
            s = np.round(x[at : at + step, :width] @ y[:, :width].T, 6)
            s[s < least] = -np.inf
            for i in np.flatnonzero(own[0][at : at + step] < own[1][at : at + step]):
                s[i, own[0][at + i] : own[1][at + i]] = -np.inf
            last = np.partition(s, -k, axis=1)[:, -k] if 0 < k < s.shape[1] else np.full(len(s), -np.inf)
            i, j = np.nonzero((s >= last[:, None]) & (s > -np.inf))
            score = s[i, j]
            order = np.lexsort((j, -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
            out.append((ids_a[at + i[first]], ids_b[j[first]], score[first]))
        return pd.DataFrame({c: np.concatenate([o[n] for o in out]) for n, c in enumerate(("id", "other", "score"))})

    return run


#: Vectors that the lists of the index are fitted on, at most, and those of a list that a task holds at a time.
FIT_VECTORS, LIST_BLOCK = 20_000, 2048


def index_knn(vectors: DataFrame, k: int, least: float = 0.0, *, lists: int | None = None, probes: int | None = None, target: float = 0.93, sample: int = FIT_VECTORS, block: int = LIST_BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """As ``knn`` by inverted lists: each (id, vec) is kept in the list of its nearest centroid; each, or each of ``queries``, looks into its ``probes`` nearest.

    Centroids are fitted on a sample (the ``sample`` vectors first by hash); every vector is indexed.  Work falls from all
    pairs to probes / lists of them, and a neighbour in another list is missed.  Without ``probes`` there are as many as find the
    share ``target`` of the neighbours inside the sample: few where vectors cluster, most lists where they don't.  The tests and
    the query knn_recall hold recall at 0.9 or more.  Lists of more than ``block`` vectors are dealt out to several tasks on either side.
    """
    spark = vectors.sparkSession
    ship(spark)
    n = vectors.count()
    few = [r["vec"] for r in vectors.where(F.size("vec") > 0).orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("vec").cast("array<double>").alias("vec")).collect()]
    lists = max(1, min(lists or math.isqrt(n), len(few) // 8 or 1))
    centroids = _means(_units(few), lists) if few else np.zeros((1, 1))
    shipped = spark.sparkContext.broadcast(centroids)
    probes = min(lists, probes or (_probes(_units(few), centroids, k, target) if few else 1))
    schema = StructType([StructField("id", vectors.schema["id"].dataType)]).add("vec", ArrayType(DoubleType())).add("near", ArrayType(IntegerType()))

    def place(most):
        def run(batches):
            c = shipped.value
            for pdf in batches:
                x = _units(pdf["vec"].tolist())
                width = min(x.shape[1], c.shape[1])
                near = np.argsort(-(x[:, :width] @ c[:, :width].T), axis=1, kind="stable")[:, :most]
                yield pdf.assign(near=list(near.astype("int32")))

        return run

    put = lambda df, most, name: keep(df.where("id is not null").select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(place(most), schema), name)
    held = put(vectors, 1, "placed").select("id", "vec", F.get("near", F.lit(0)).alias("list"))
    asked = put(vectors if queries is None else queries, probes, "asked").select("id", "vec", F.explode("near").alias("list"))
    parts = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    plan = parts(held, "h").join(parts(asked, "q"), "list")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    left = asked.join(plan, "list").select("id", "vec", "list", own("q").alias("x"), every("h").alias("y"))
    right = held.join(plan, "list").select(*[F.col(c).alias(c) for c in ("id", "vec", "list")], own("h").alias("y"), every("q").alias("x"))
    kind = vectors.schema["id"].dataType.simpleString()
    return _ranked(left.groupBy("list", "x", "y").cogroup(right.groupBy("list", "x", "y")).applyInPandas(_best(k, least), f"id {kind}, other {kind}, score double"), k)


def _probes(x: np.ndarray, c: np.ndarray, k: int, target: float, asked: int = 500) -> int:
    """The least number of lists that hold the share ``target`` of the ``k`` nearest others of the first ``asked`` vectors."""
    s = x[:asked] @ x.T
    s[np.arange(len(s)), np.arange(len(s))] = -2
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    nearest = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[:asked] @ c.T), axis=1, kind="stable"), axis=1)  # of each list, its turn
    turn = place[np.arange(len(s))[:, None], (x @ c.T).argmax(axis=1)[nearest]]
    return int(np.quantile(turn, target, method="higher")) + 1


def _means(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.arange(k) * len(x) // k].copy()
    for _ in range(turns):
        at = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours (id, other, score) that were found, one as near as the last one counting as well."""
    last = exact.groupBy("id").agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("n"))
    hit = found.join(last, "id").where("score >= last").groupBy("id").agg(F.count(F.lit(1)).alias("hit"))
    return last.join(hit, "id", "left").agg((F.sum(F.least(F.coalesce("hit", F.lit(0)), F.col("n"))) / F.sum("n")).alias("recall"))


def similarity_edges(vectors: DataFrame, k: int = 5, least: float = 0.25) -> DataFrame:
    """(src, dst, type, weight, predicted, provenance): derived edges to the nearest neighbours."""
    return knn(vectors, k, least).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.lit("SIMILAR_TO").alias("type"), F.col("score").alias("weight"), F.lit(True).alias("predicted"), F.lit("cosine-knn").alias("provenance"))


def centroids(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, vec): mean vector of each cluster's members (cluster, id)."""
    x = members.join(vectors, "id").select("cluster", F.posexplode("vec").alias("i", "x"))
    return x.groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("cluster", F.transform("s", lambda y: y["x"]).alias("vec"))
