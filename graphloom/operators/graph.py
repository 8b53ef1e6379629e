"""Relational graph operators over node and edge frames.

``edges`` have src, dst, type and, where used, weight and predicted; ``A`` below is the undirected
adjacency (src, dst, type, weight).  Id sets are frames with a column ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources import model


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; a null or zero weight counts 1."""
    w = F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    rest = [*(["type"] if "type" in edges.columns else []), w.alias("weight")]
    return edges.select(_ends(), *rest).select("e.src", "e.dst", *(["type"] if "type" in edges.columns else []), "weight")


def _ends():
    """Both directions of an edge in one pass over the edges, which a union would read twice."""
    return F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), F.lit("out").alias("direction")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("in").alias("direction")))).alias("e")


def project(nodes: DataFrame, edges: DataFrame, labels: list[str] | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The node ids of some labels and the non-predicted edges of some types among them."""
    ids = (nodes.where(F.col("label").isin(labels)) if labels else nodes).select("id")
    e = edges.where(F.col("type") != model.PREDICTED)
    e = e.where(F.col("type").isin(types)) if types else e
    return ids, induced(e, ids)


def year_between(year: Column, low: int, high: int) -> Column:
    """A missing or zero year passes neither bound."""
    y = F.nullif(year, F.lit(0))
    return (F.coalesce(y, F.lit(0)) >= low) & (F.coalesce(y, F.lit(9999)) <= high)


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def rel_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def without_provenance(edges: DataFrame, types: list[str]) -> DataFrame:
    """(type, n): edges of some types that don't say where they come from."""
    return rel_counts(edges.where(F.col("type").isin(types) & F.col("provenance").isNull()))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree, weighted): edge ends at each node, parallel edges counted."""
    return adjacency(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degree(edges), "id", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "weighted": F.coalesce("weighted", F.lit(0.0))})


def has_relationship(nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """Nodes with an edge of one of the types, in either direction."""
    e = edges.where(F.col("type").isin(types))
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi")


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other, type, direction) of the given ids."""
    both = edges.select(_ends(), "type").select(F.col("e.src").alias("id"), F.col("e.dst").alias("other"), "type", F.col("e.direction").alias("direction"))
    return both.join(ids.select("id").distinct(), "id", "left_semi")


def neighbour_groups(edges: DataFrame, nodes: DataFrame, ids: DataFrame, keep: int = 40) -> DataFrame:
    """Named neighbours of each id by type: the first ``keep`` by name and id, and how many there are."""
    n = neighbours(edges, ids).join(nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other")
    w = Window.partitionBy("id", "type")
    n = n.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("pos", F.row_number().over(w.orderBy("other_name", "other", "direction")))
    return n.where(F.col("pos") <= keep).select("id", "type", "pos", "other", "other_name", "direction", "total")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    a, b = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(*edges.columns)


def frontier(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): nodes one edge from the set and outside it."""
    a = adjacency(edges).select("src", F.col("dst").alias("id"))
    return a.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select("id").distinct().join(ids, "id", "left_anti")


def cross_edges(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges from a node of ``a`` to one of ``b`` or back, each once, as stored."""
    side = lambda s, d: edges.join(a.select(F.col("id").alias(s)), s, "left_semi").join(b.select(F.col("id").alias(d)), d, "left_semi").select(*edges.columns)
    return side("src", "dst").unionByName(side("dst", "src")).distinct()


def cooccurrence(pairs: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """(a, b, shared, jaccard) of items a < b that share ``least`` groups.

    A pair's groups are met through a self-join on the group, so cost is the sum of squared group sizes.
    """
    p = pairs.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    size = p.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    x = p.select("g", F.col("i").alias("a")).join(p.select("g", F.col("i").alias("b")), "g").where("a < b")
    x = x.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    x = x.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return x.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))


def unrelated(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) without an edge between them in either direction."""
    known = canonical(edges).distinct()
    return pairs.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")}).join(known.toDF("_x", "_y"), ["_x", "_y"], "left_anti").select(*pairs.columns)


def simple(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours without loops: (src, dst) both ways."""
    c = canonical(edges).where("a <> b").distinct().toDF("src", "dst")
    return c.select(_ends()).select("e.src", "e.dst")


def two_hop(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, a common neighbour and no edge."""
    s = simple(edges)
    x = s.select(F.col("src").alias("m"), F.col("dst").alias("a")).join(s.select(F.col("src").alias("m"), F.col("dst").alias("b")), "m").where("a < b").select("a", "b").distinct()
    return unrelated(x, edges)


def bridges(pairs: DataFrame, group: str, item: str, side_a: DataFrame, side_b: DataFrame) -> DataFrame:
    """Groups with an item of each side: (group, n_a, n_b), in one pass over the pairs."""
    a, b = side_a.select(F.col("id").alias(item), F.lit(1).alias("in_a")), side_b.select(F.col("id").alias(item), F.lit(1).alias("in_b"))
    x = pairs.select(group, item).distinct().join(a, item, "left").join(b, item, "left").where("in_a = 1 or in_b = 1")
    return x.groupBy(group).agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b")).where("n_a > 0 and n_b > 0")


def optional_neighbours(nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """Each node with its neighbours over some types as ``other``; a node without any keeps a row with a null."""
    a = adjacency(edges.where(F.col("type").isin(types))).select(F.col("src").alias("id"), F.col("dst").alias("other"))
    return nodes.join(a, "id", "left")


def related(edges: DataFrame, ids: DataFrame, types: list[str]) -> DataFrame:
    """(id, other, best, types): neighbours over some types, folded to one row each."""
    a = adjacency(edges.where(F.col("type").isin(types)))
    a = a.join(ids.select(F.col("id").alias("src")), "src", "left_semi").where("src <> dst")
    return a.groupBy(F.col("src").alias("id"), F.col("dst").alias("other")).agg(F.max("weight").alias("best"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def search(nodes: DataFrame, needle: str, rank: str | None = None, limit: int = 20, labels: list[str] | None = None) -> DataFrame:
    """Ranked case-folded substring search: 2 for the whole name, 1 for a prefix, .2 an occurrence, 5 times the rank."""
    from graphloom.functions.text import occurrences

    q = needle.strip().lower()
    n = nodes.where(F.col("label").isin(labels)) if labels else nodes
    low = F.lower(F.coalesce("name", F.lit("")))
    n = n.where(low.contains(q))
    score = F.when(low == q, 2.0).otherwise(0.0) + F.when(low.startswith(q), 1.0).otherwise(0.0) + 0.2 * occurrences(low, q) + (5 * F.coalesce(F.col(rank), F.lit(0.0)) if rank else F.lit(0.0))
    return n.withColumn("score", F.round(score, 5)).orderBy(F.desc("score"), "id").limit(limit)


def page(df: DataFrame, by: str, *, descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows offset .. offset + limit of an order with the id as tie-break."""
    key = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(key, "id").offset(offset).limit(limit)
