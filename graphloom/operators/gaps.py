"""Opportunity scoring for pairs of concept clusters, as joins over all pairs at once.

Frames: ``members`` (cluster, topic), ``studies`` (paper, topic), ``papers`` (paper, year, community, pagerank,
betweenness), ``links`` (a, b, weight: one row per unordered topic pair), ``vectors`` (id, vec).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine
from graphloom.operators import aggregates as G
from graphloom.sources.working import keep

# The published score model.
WEIGHTS = {"community_separation": 0.30, "semantic_similarity": 0.25, "relationship_sparsity": 0.20, "research_activity": 0.15, "bridge_potential": 0.10}
LABELS = {"community_separation": "Community Separation", "semantic_similarity": "Semantic Similarity", "relationship_sparsity": "Relationship Sparsity", "research_activity": "Research Activity", "bridge_potential": "Bridge Potential"}
RECENT, BRIDGE_RECENT, ENTANGLED, DEFAULT_REFERENCE = 2023, 2024, 0.35, 0.35


def cluster_papers(members: DataFrame, studies: DataFrame) -> DataFrame:
    """(cluster, paper): papers that study at least one topic of a cluster."""
    return studies.join(members, "topic").select("cluster", "paper").distinct()


def pairs(members: DataFrame) -> DataFrame:
    """(a, b) of clusters a < b without a shared topic."""
    c = members.select("cluster").distinct()
    every = c.toDF("a").join(c.toDF("b"), F.col("a") < F.col("b"))
    shared = members.toDF("a", "topic").join(members.toDF("b", "topic"), "topic").where("a < b").select("a", "b").distinct()
    return every.join(shared, ["a", "b"], "left_anti")


def shared_papers(own: DataFrame) -> DataFrame:
    """(a, b, shared) of clusters a < b from (cluster, paper)."""
    return own.toDF("a", "paper").join(own.toDF("b", "paper"), "paper").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def rejections(names: DataFrame, members: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b, reason) of pairs that can't be a gap: nested or equal names, or entangled papers; reason is null for the others.

    ``names`` are (cluster, words array).
    """
    size = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    x = pairs(members).join(names.toDF("a", "wa"), "a").join(names.toDF("b", "wb"), "b")
    x = x.join(size.toDF("a", "na"), "a", "left").join(size.toDF("b", "nb"), "b", "left").join(shared_papers(own), ["a", "b"], "left")
    part = F.try_divide(F.coalesce("shared", F.lit(0)), F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))))
    some = (F.size("wa") > 0) & (F.size("wb") > 0)
    inside = lambda p, q: F.size(F.array_except(p, q)) == 0
    reason = F.when(some & (inside("wa", "wb") & inside("wb", "wa")), "same vocabulary").when(some & (inside("wa", "wb") | inside("wb", "wa")), "nested concepts").when(part >= ENTANGLED, "entangled papers")
    return x.select("a", "b", reason.alias("reason"))


def neighbourhoods(members: DataFrame, links: DataFrame) -> DataFrame:
    """(cluster, topic): topics linked with a cluster's and outside it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return members.select("cluster", F.col("topic").alias("a")).join(both, "a").select("cluster", F.col("b").alias("topic")).distinct().join(members, ["cluster", "topic"], "left_anti")


def similarity(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, similarity, reference): mean cosine between the clusters, and the pair's clamped 90 % order statistic."""
    v = members.join(vectors.select(F.col("id").alias("topic"), F.col("vec").cast("array<double>").alias("vec")), "topic")
    x = pairs(members)
    cross = x.join(v.toDF("t1", "a", "v1"), "a").join(v.toDF("t2", "b", "v2"), "b").select("a", "b", cosine(F.col("v1"), F.col("v2")).alias("c"))
    mean = cross.groupBy("a", "b").agg(F.avg("c").alias("similarity"))
    inner = v.toDF("t1", "k", "v1").join(v.toDF("t2", "k", "v2"), "k").where("t1 < t2").select("k", cosine(F.col("v1"), F.col("v2")).alias("c"))
    # each pair once under either cluster, so that the join is by key
    own = x.select("a", "b", F.explode(F.array("a", "b")).alias("k")).join(inner, "k").select("a", "b", "c")
    ref = G.order_statistic(cross.unionByName(own), "c", 0.9, "a", "b").select("a", "b", F.greatest(F.lit(0.12), F.least(F.lit(0.85), F.col("value"))).alias("reference"))
    return x.join(mean, ["a", "b"], "left").join(ref, ["a", "b"], "left").select("a", "b", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("reference", F.lit(DEFAULT_REFERENCE)).alias("reference"))


def features(members: DataFrame, studies: DataFrame, papers: DataFrame, links: DataFrame, vectors: DataFrame, recent: int = RECENT, bridge_recent: int = BRIDGE_RECENT) -> DataFrame:
    """One row per pair of clusters with the five components and what they are made of."""
    # each is read by many joins below
    members, papers, links = keep(members, "members"), keep(papers, "papers"), keep(links, "links")
    own = keep(cluster_papers(members, studies), "own")
    facts = own.join(papers, "paper")
    x = keep(pairs(members), "pairs")
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    inside = G.density(members.select("cluster", F.col("topic").alias("id")), links).select("cluster", "density")
    m = lambda c, t: members.toDF(c, t)
    each = links.select(F.col("a").alias("t1"), F.col("b").alias("t2"), "weight")
    hit = each.join(m("c1", "t1"), "t1").join(m("c2", "t2"), "t2").where("c1 <> c2")
    cross = hit.groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).agg(F.sum("weight").alias("cross"))
    near = neighbourhoods(members, links)
    n_near = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    met = near.toDF("a", "topic").join(near.toDF("b", "topic"), "topic").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))
    spread = facts.groupBy("cluster", "community").agg(F.count(F.lit(1)).alias("n"))
    apart = G.distribution_overlap(spread, "cluster", "community")
    rank = ranks(papers)
    whole = papers.agg((F.count_if(F.col("year") >= recent) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("scope_recent"))
    per = facts.join(rank, "paper").select("cluster", "paper", "year", "position")
    sums = per.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("year") >= recent).alias("recent"), F.sum("position").alias("pos"))
    common = per.select(F.col("cluster").alias("a"), "paper", "year", "position").join(own.toDF("b", "paper"), "paper").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("bridges"), F.count_if(F.col("year") >= recent).alias("both_recent"), F.sum("position").alias("both_pos"), F.count_if(F.col("year") >= bridge_recent).alias("bridges_recent"), F.count_if((F.col("year") < bridge_recent) & (F.col("year") > 0)).alias("bridges_older"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    x = x.join(size.toDF("a", "ta"), "a").join(size.toDF("b", "tb"), "b").join(inside.toDF("a", "ia"), "a").join(inside.toDF("b", "ib"), "b")
    x = x.join(cross, ["a", "b"], "left").join(n_near.toDF("a", "ka"), "a", "left").join(n_near.toDF("b", "kb"), "b", "left").join(met, ["a", "b"], "left").join(apart, ["a", "b"], "left")
    x = x.join(sums.toDF("a", "na", "ra", "pa"), "a", "left").join(sums.toDF("b", "nb", "rb", "pb"), "b", "left").join(common, ["a", "b"], "left").join(similarity(members, vectors), ["a", "b"]).crossJoin(F.broadcast(whole))  # one row
    union_n = zero("na") + zero("nb") - zero("bridges")
    recent_n = zero("ra") + zero("rb") - zero("both_recent")
    internal = 0.5 * (F.col("ia") + F.col("ib"))
    density = zero("cross") / F.greatest(F.lit(1.0), F.col("ta") * F.col("tb"))
    jac = F.coalesce(F.try_divide(zero("met"), zero("ka") + zero("kb") - zero("met")), F.lit(0.0))
    mean_pos = F.coalesce(F.try_divide(F.coalesce("pa", F.lit(0.0)) + F.coalesce("pb", F.lit(0.0)) - F.coalesce("both_pos", F.lit(0.0)), union_n), F.lit(0.0))
    r = lambda c: F.round(c, 6)
    return x.select(
        "a", "b",
        r(F.coalesce("separation", F.lit(1.0))).alias("community_separation"),
        r(0.6 * F.least(F.lit(1.0), F.col("similarity") / F.col("reference")) + 0.4 * F.least(F.lit(1.0), jac / 0.6)).alias("semantic_similarity"),
        r(1 - F.least(F.lit(1.0), F.when(internal > 0, density / (internal * 0.5)).otherwise(0.0))).alias("relationship_sparsity"),
        r(F.least(F.lit(1.0), F.coalesce(F.try_divide(recent_n, union_n), F.lit(0.0)) / F.greatest(F.lit(0.05), F.col("scope_recent")) * 0.75)).alias("research_activity"),
        r(F.when(union_n > 0, F.least(F.lit(1.0), mean_pos + F.when(zero("bridges") > 0, 0.15).otherwise(0.0))).otherwise(0.0)).alias("bridge_potential"),
        r(zero("cross").cast("double")).alias("cross_edge_weight"), zero("bridges").alias("bridge_papers"), zero("bridges_recent").alias("bridges_recent"), zero("bridges_older").alias("bridges_older"),
        r(jac).alias("neighbourhood_jaccard"), union_n.alias("scoped_papers"), recent_n.alias("recent_papers"),
    )


def ranks(papers: DataFrame) -> DataFrame:
    """(paper, position): mean of the percentile positions by PageRank and by betweenness, ties by id."""
    a = G.percentile_position(papers, "pagerank", "paper").toDF("paper", "p1")
    b = G.percentile_position(papers, "betweenness", "paper").toDF("paper", "p2")
    return a.join(b, "paper").select("paper", (0.5 * (F.col("p1") + F.col("p2"))).alias("position"))


def score(f: DataFrame) -> DataFrame:
    """The features with ``score``: the weighted sum of the components times 100."""
    total = sum((100 * w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    return f.withColumn("score", F.round(total, 2))


def confidence(score_: Column, papers: Column) -> Column:
    return F.when((score_ >= 68) & (papers >= 8), "Medium-High").when((score_ >= 55) & (papers >= 5), "Medium").otherwise("Low")


def trajectory(recent: Column, older: Column) -> Column:
    total = recent + older
    return F.when(total == 0, "no bridges in corpus").when(recent == 0, "persistent gap").when(older == 0, "emerging bridge").when(recent * 2 >= total, "closing gap").otherwise("slowly closing gap")


def score_model_rows() -> list[tuple[str, str, float]]:
    return [(k, LABELS[k], w) for k, w in WEIGHTS.items()]


def evidence(own: DataFrame, papers: DataFrame, of: DataFrame, bridges: int = 3, each: int = 3) -> DataFrame:
    """(a, b, pos, paper, role): of each pair the three first papers of either cluster and three bridges, each paper once."""
    p = own.join(papers.select("paper", "pagerank"), "paper")
    w = Window.partitionBy("cluster").orderBy(F.desc("pagerank"), "paper")
    top = p.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).select("cluster", "paper", "r")
    one = of.join(top.toDF("a", "paper", "r"), "a").select("a", "b", "paper", F.lit(1).alias("k"), "r", F.lit("cluster_a").alias("role"))
    two = of.join(top.toDF("b", "paper", "r"), "b").select("a", "b", "paper", F.lit(2).alias("k"), "r", F.lit("cluster_b").alias("role"))
    both = p.select(F.col("cluster").alias("a"), "paper", "pagerank").join(own.toDF("b", "paper"), "paper").join(of.select("a", "b"), ["a", "b"])
    both = both.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("pagerank"), "paper"))).where(F.col("r") <= bridges).select("a", "b", "paper", F.lit(3).alias("k"), "r", F.lit("bridge").alias("role"))
    x = one.unionByName(two).unionByName(both)
    x = x.withColumn("first", F.row_number().over(Window.partitionBy("a", "b", "paper").orderBy("k", "r"))).where("first = 1")
    return x.select("a", "b", F.row_number().over(Window.partitionBy("a", "b").orderBy("k", "r")).alias("pos"), "paper", "role")
