"""Views that combine operators: analytics of a snapshot, communities, statistics, a dashboard, listings by relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import ellipsis
from graphloom.operators import aggregates as G
from graphloom.operators import algorithms as A
from graphloom.operators import graph as N
from graphloom.sources import model
from graphloom.sources.working import keep

#: Above so many nodes betweenness uses a sample of sources.
EXACT, SAMPLES = 400, 220


def analytics(nodes: DataFrame, edges: DataFrame, *, resolution: float = 1.0) -> DataFrame:
    """(id, pagerank, betweenness, community, degree) of one snapshot, written once; predicted links don't count."""
    ids, e = N.project(nodes, edges)
    e = keep(e, "projection")
    n = ids.count()
    rank, between = A.pagerank(ids, e), A.betweenness(ids, e, samples=SAMPLES if n > EXACT else None)
    own = A.louvain(ids, e, resolution=resolution)
    out = ids.join(rank, "id", "left").join(between, "id", "left").join(own, "id", "left").join(N.degree(e).select("id", "degree"), "id", "left")
    return keep(out.select("id", F.round(F.coalesce("pagerank", F.lit(0.0)), 6).alias("pagerank"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("community", "id").alias("community"), F.coalesce("degree", F.lit(0)).alias("degree")), "metrics")


def with_metrics(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Nodes with their metrics; missing ones are 0, and a missing community null."""
    return nodes.join(metrics, "id", "left").withColumns({"pagerank": F.coalesce("pagerank", F.lit(0.0)), "betweenness": F.coalesce("betweenness", F.lit(0.0)), "degree": F.coalesce("degree", F.lit(0))})


def communities(nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(community nodes, BELONGS_TO edges) of (id, community): those with two papers or three topics, named by three topics."""
    x = nodes.select("id", "label", "name").join(labels, "id")
    size = x.groupBy("community").agg(F.count_if(F.col("label") == "Paper").alias("papers"), F.count_if(F.col("label") == "Topic").alias("topics")).where("papers >= 2 or topics >= 3")
    top = G.top_k(x.where("label = 'Topic'"), 3, ["community"], [F.col("name"), F.col("id")]).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("t"))
    named = size.join(top, "community", "left").withColumn("name", ellipsis(F.coalesce(F.array_join(F.transform("t", lambda y: y["name"]), " · "), F.concat(F.lit("Community "), "community")), 70))
    made = named.select(F.concat(F.lit("community:"), "community").alias("id"), F.lit("Community").alias("label"), "name", "papers", "topics")
    edges = x.where(F.col("label").isin("Paper", "Topic", "Author", "Method")).join(size, "community", "left_semi").select(F.col("id").alias("src"), F.concat(F.lit("community:"), "community").alias("dst"), F.lit("BELONGS_TO").alias("type"), F.lit(1.0).alias("weight"), F.lit(False).alias("predicted"), F.lit("louvain").alias("provenance"))
    return made, edges


def community_profiles(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per community of ``metrics`` (id, community, pagerank): counts of papers, topics and methods, the years' span, mean
    PageRank of the papers, the six first papers and the eight first topics by PageRank, ties by id; ``rank`` 0.. by papers.
    """
    x = nodes.select("id", "label", "name", "year").join(metrics.select("id", "community", "pagerank"), "id").where(F.col("label").isin("Paper", "Topic", "Method"))
    is_ = lambda label: F.col("label") == label
    year = F.when(is_("Paper"), F.nullif("year", F.lit(0)))
    size = x.groupBy("community").agg(
        F.count_if(is_("Paper")).alias("papers"), F.count_if(is_("Topic")).alias("topics"), F.count_if(is_("Method")).alias("methods"), F.min(year).alias("first"), F.max(year).alias("last"),
        F.round(F.coalesce(F.avg(F.when(is_("Paper"), F.coalesce("pagerank", F.lit(0.0)))), F.lit(0.0)), 6).alias("avg_pagerank"),
    )
    best = G.top_k(x.where(F.col("label").isin("Paper", "Topic")), 8, ["community", "label"], [F.desc(F.coalesce("pagerank", F.lit(0.0))), F.col("id")])
    told = F.struct("rank", "id", "name", "year", F.round(F.coalesce("pagerank", F.lit(0.0)), 5).alias("pagerank"))
    top = best.groupBy("community").agg(F.array_sort(F.collect_list(F.when(is_("Paper") & (F.col("rank") <= 6), told))).alias("p"), F.array_sort(F.collect_list(F.when(is_("Topic"), F.struct("rank", "name")))).alias("t"))
    top = top.select("community", F.transform("p", lambda y: F.struct(y["id"].alias("id"), y["name"].alias("title"), y["year"].alias("year"), y["pagerank"].alias("pagerank"))).alias("top_papers"), F.transform("t", lambda y: y["name"]).alias("top_topics"))
    out = size.join(top, "community", "left")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("papers"), "community")) - 1)  # a row a community


def community_members(nodes: DataFrame, labels: DataFrame, community, limit: int = 160) -> DataFrame:
    return nodes.join(labels.where(F.col("community") == community), "id").orderBy("label", "name", "id").limit(limit)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): counts by label and by type, and both totals."""
    a = N.label_counts(nodes).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    b = N.rel_counts(edges).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n")
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    return a.unionByName(b).unionByName(total(nodes, "nodes")).unionByName(total(edges, "edges"))


def dashboard(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, *, since: int = model.RECENT_YEAR) -> dict[str, DataFrame]:
    """Frames of a landing page: statistics, papers by year, growing topics, top papers by either metric, communities."""
    papers = nodes.where("label = 'Paper'")
    studied = edges.where("type = 'STUDIES'").join(papers.select(F.col("id").alias("src"), "year"), "src").select(F.col("dst").alias("topic"), "year")
    m = with_metrics(papers, metrics)
    made, _ = communities(nodes, metrics.select("id", "community"))
    return {
        "statistics": statistics(nodes, edges),
        "years": papers.groupBy("year").agg(F.count(F.lit(1)).alias("n")),
        "emerging": G.emerging(studied, "topic", "year", since),
        "influential": N.page(m, "pagerank", limit=10),
        "bridging": N.page(m, "betweenness", limit=10),
        "communities": made.orderBy(F.desc("papers"), "id").limit(10),
    }


def dashboard_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """(section, name, value) of a dashboard's counts: statistics, papers by year, growing topics, communities."""
    row = lambda section, name, value: [F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value")]
    return (
        frames["statistics"].select(*row("statistics", F.concat_ws(":", "kind", "name"), F.col("n")))
        .unionByName(frames["years"].select(*row("years", F.col("year"), F.col("n"))))
        .unionByName(frames["emerging"].select(*row("emerging", F.col("topic"), F.col("growth"))))
        .unionByName(frames["influential"].select(*row("influential", F.col("id"), F.col("pagerank"))))
        .unionByName(frames["bridging"].select(*row("bridging", F.col("id"), F.col("betweenness"))))
        .unionByName(frames["communities"].select(*row("communities", F.col("id"), F.col("papers"))))
    )


def predicted_links(edges: DataFrame, nodes: DataFrame, topics: DataFrame, limit: int = 20) -> DataFrame:
    """Predicted links that touch a topic of the set, with both names, the heaviest first."""
    ids, named = topics.select("id"), nodes.select("id", "name")
    e = edges.where(F.col("type") == model.PREDICTED)
    hit = e.join(ids, e.src == ids.id, "left_semi").unionByName(e.join(ids, e.dst == ids.id, "left_semi")).dropDuplicates(["src", "dst"])
    return hit.join(named.toDF("src", "src_name"), "src").join(named.toDF("dst", "dst_name"), "dst").orderBy(F.desc("weight"), "src", "dst").limit(limit)


def pair_conflicts(conflicts: DataFrame, papers_a: DataFrame, papers_b: DataFrame, limit: int = 5) -> DataFrame:
    """Conflicts whose papers both lie in two clusters' papers (column paper), the strongest first."""
    every = papers_a.select("paper").unionByName(papers_b.select("paper")).distinct()
    c = conflicts.join(every.toDF("paper_a"), "paper_a", "left_semi").join(every.toDF("paper_b"), "paper_b", "left_semi")
    return c.orderBy(F.desc("score"), "claim_a", "claim_b").limit(limit)


def distinct_clusters(members: DataFrame, names: DataFrame, own: DataFrame, overlap: float = 0.8) -> DataFrame:
    """(cluster) kept of (cluster, granularity, name): of one granularity and name, or with over 80 % of the smaller one's papers
    shared, the larger stays; decided greedily from the largest, ties by cluster.

    Each round keeps the clusters that no larger undecided one stands against and drops those that they stand against.
    """
    from graphloom.operators.gaps import shared_papers

    size = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    c = keep(names.join(size, "cluster").join(members.select("cluster").distinct(), "cluster", "left_semi").select("cluster", "granularity", "name", "n").distinct(), "named")
    side = lambda k: c.select(*[F.col(x).alias(f"{x}_{k}") for x in c.columns])
    same = side("a").join(side("b"), (F.col("granularity_a") == F.col("granularity_b")) & (F.col("name_a") == F.col("name_b"))).where("cluster_a < cluster_b")
    near = shared_papers(own).select(F.col("a").alias("cluster_a"), F.col("b").alias("cluster_b"), "shared").join(side("a"), "cluster_a").join(side("b"), "cluster_b")
    near = near.where((F.col("granularity_a") == F.col("granularity_b")) & (F.col("shared") > overlap * F.least("n_a", "n_b")))
    first = F.col("n_a") >= F.col("n_b")  # cluster_a is the lesser id
    pair = lambda x: x.select(F.when(first, F.col("cluster_a")).otherwise(F.col("cluster_b")).alias("over"), F.when(first, F.col("cluster_b")).otherwise(F.col("cluster_a")).alias("cluster"))
    against = keep(pair(same).unionByName(pair(near)).distinct(), "against")
    left, kept = c.select("cluster"), c.select("cluster").limit(0)
    while not left.isEmpty():
        now = keep(left.join(against.join(left.toDF("over"), "over", "left_semi").select("cluster"), "cluster", "left_anti"), "kept")
        kept = kept.unionByName(now)
        gone = against.join(now.toDF("over"), "over", "left_semi").select("cluster")
        left = keep(left.join(now, "cluster", "left_anti").join(gone, "cluster", "left_anti"), "undecided")
    return kept


def answer_confidence(papers, claims, gap_level) -> F.col:
    """Confidence of an answer from its context's counts, or of its first opportunity."""
    level = F.when(gap_level == "Medium-High", "medium-high").when(gap_level == "Medium", "medium").when(gap_level == "Low", "low").when(gap_level.isNotNull(), "medium")
    return F.coalesce(level, F.when((papers >= 12) & (claims >= 4), "medium-high").when(papers >= 5, "medium").otherwise("low"))


def sliding_counts(calls: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """Calls of the last ``seconds`` at each call, itself included."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(at).cast("timestamp"))).rangeBetween(-seconds, 0)
    return calls.withColumn("recent", F.count(F.lit(1)).over(w))
