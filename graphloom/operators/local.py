"""Graph loops in one task, for graphs whose size has been checked to fit it.

Each has a distributed form that gives the same rows and is used beyond the bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.shipping import ship

#: Edges, both directions counted, up to which a graph is solved in one task: some tens of MB there.
EDGES = 1_000_000


def fits(edges: DataFrame, most: int) -> bool:
    """Whether a written edge table has at most ``most`` rows."""
    return most > 0 and edges.count() <= most


def _one(rows: DataFrame, run, ddl: str) -> DataFrame:
    ship(rows.sparkSession)
    return rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, ddl)


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _numbered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted ids, source numbers, target numbers): number order is id order."""
    edge = pdf["dst"].notna().to_numpy()
    ids = np.array(sorted(set(pdf["src"]) | set(pdf.loc[edge, "dst"])), dtype=object)
    index = pd.Index(ids)
    kind = type(ids[0]) if len(ids) else str
    return ids, index.get_indexer(pdf.loc[edge, "src"]), index.get_indexer(pdf.loc[edge, "dst"].map(kind))


def pagerank(ids: DataFrame, shares: DataFrame, damping: float, rounds: int, tolerance: float, every: int) -> DataFrame:
    """(id, pagerank) from ids and transition shares (src, dst, share)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, src, dst = _numbered(pdf)
        share = pdf.loc[pdf["dst"].notna(), "share"].to_numpy(float)
        n = len(names)
        stuck = np.ones(n, bool)
        stuck[src] = False
        rank = np.full(n, 1.0 / n)
        for turn in range(1, rounds + 1):
            new = (1 - damping) / n + damping * (np.bincount(dst, rank[src] * share, n) + rank[stuck].sum() / n)
            change, rank = np.abs(new - rank).sum(), new
            if tolerance and (turn % every == 0 or turn == rounds) and change < tolerance:
                break
        return pd.DataFrame({"id": names, "pagerank": rank})

    none = ids.select(F.col("id").alias("src"), F.lit(None).cast(_kind(ids, "id")).alias("dst"), F.lit(0.0).alias("share"))
    return _one(none.unionByName(shares.select("src", "dst", "share")), run, f"id {_kind(ids, 'id')}, pagerank double")


def components(ids: DataFrame, near: DataFrame) -> DataFrame:
    """(id, component) by least reachable id; ``near`` (src, dst) holds both directions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, src, dst = _numbered(pdf)
        root = np.arange(len(names))
        while True:
            low = root.copy()
            np.minimum.at(low, src, root[dst])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"id": names, "component": names[root]})

    kind = _kind(ids, "id")
    none = ids.select(F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"))
    return _one(none.unionByName(near.select("src", "dst")), run, f"id {kind}, component {kind}")


def _adjacent(pdf: pd.DataFrame) -> dict:
    out: dict = {}
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        out.setdefault(a, []).append(b)
    return out


def distances(near: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(id, depth) within ``most`` hops of the sources."""
    kind = _kind(near, "src")

    def run(start: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        near_of = _adjacent(edges)
        depth = dict.fromkeys(start["id"], 0)
        front = list(depth)
        for d in range(1, most + 1):
            nxt = []
            for u in front:
                for v in near_of.get(u, ()):
                    if v not in depth:
                        depth[v] = d
                        nxt.append(v)
            front = nxt
        return pd.DataFrame({"id": list(depth), "depth": list(depth.values())})

    ship(near.sparkSession)
    a = sources.select(F.col("id").cast(kind).alias("id")).distinct().withColumn("_all", F.lit(1))
    b = near.select("src", "dst").withColumn("_all", F.lit(1))
    return a.groupBy("_all").cogroup(b.groupBy("_all")).applyInPandas(run, f"id {kind}, depth int")


def shortest_paths(near: DataFrame, source: str, most: int) -> DataFrame:
    """(id, hops, path) of every node within ``most`` hops; of several shortest paths the least by ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near_of = _adjacent(pdf)
        path = {source: [source]}
        front = [source]
        for _ in range(most):
            new: dict = {}
            for u in front:
                for v in near_of.get(u, ()):
                    if v not in path:
                        p = [*path[u], v]
                        if v not in new or p < new[v]:
                            new[v] = p
            path.update(new)
            front = list(new)
        return pd.DataFrame({"id": list(path), "hops": [len(p) - 1 for p in path.values()], "path": list(path.values())})

    none = near.sparkSession.createDataFrame([(source, source)], "src string, dst string")
    return _one(none.unionByName(near.select("src", "dst")), run, "id string, hops int, path array<string>")
