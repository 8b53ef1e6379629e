"""Aggregations, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def max_merge(pairs: DataFrame) -> DataFrame:
    """(a, b, weight): greatest weight of each unordered pair of (src, dst, weight)."""
    return pairs.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight"))


def density(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster, n, density): weight inside a cluster over its number of pairs; ``members`` (cluster, id), ``pairs`` (a, b, weight)."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    a, b = members.select(F.col("cluster"), F.col("id").alias("a")), members.select("cluster", F.col("id").alias("b"))
    inside = pairs.join(a, "a").join(b, ["cluster", "b"]).groupBy("cluster").agg(F.sum("weight").alias("w"))
    return size.join(inside, "cluster", "left").select("cluster", "n", F.coalesce(F.try_divide(F.coalesce("w", F.lit(0.0)), F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("density"))


def distribution_overlap(counts: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, separation) of groups a < b: 1 less the shared mass of their value shares; ``counts`` has ``n``."""
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(group))).select(group, value, "p")
    x = share.select(F.col(group).alias("a"), value, F.col("p").alias("pa")).join(share.select(F.col(group).alias("b"), value, F.col("p").alias("pb")), value).where("a < b")
    both = x.groupBy("a", "b").agg(F.sum(F.least("pa", "pb")).alias("s"))
    groups = counts.select(group).distinct()
    every = groups.toDF("a").join(groups.toDF("b"), F.col("a") < F.col("b"))
    return every.join(both, ["a", "b"], "left").select("a", "b", F.round(1 - F.coalesce("s", F.lit(0.0)), 6).alias("separation"))


def order_statistic(df: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """The value at 0-based index int(share * n) of each group's sorted values, by rank; not an interpolated percentile."""
    w = Window.partitionBy(*by)
    at = F.least(F.floor(share * F.col("n")), F.col("n") - 1)
    x = df.where(F.col(value).isNotNull()).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(value)) - 1)
    return x.where(F.col("r") == at).select(*by, "n", F.col(value).alias("value"))


def idf(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + (N + .5) / (df + .5)); ``terms`` is an array column."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(key, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.log(1 + (F.col("n") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))  # n is one row


def coverage(docs: DataFrame, key: str, terms: str, question: list[str]) -> DataFrame:
    """(key, coverage): idf-weighted share of the question's terms that each document has; 0 for no term."""
    spark = docs.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(question)], "term string")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    has = docs.select(key, F.explode(F.array_distinct(terms)).alias("term")).join(F.broadcast(asked), "term")  # a question's words
    df = has.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = asked.join(df, "term", "left").join(F.broadcast(n)).select("term", F.log(1 + (F.col("n") + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5)).alias("w"))
    whole = weight.agg(F.sum("w").alias("whole"))
    got = has.join(weight, "term").groupBy(key).agg(F.sum("w").alias("got"), F.count(F.lit(1)).alias("hits"))
    return docs.select(key).join(got, key, "left").join(F.broadcast(whole)).select(key, F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce(F.try_divide("got", "whole"), F.lit(0.0)), 6).alias("coverage"))


def minmax(df: DataFrame, key: str, value: str) -> DataFrame:
    """Scaled to 0..1 over all rows; 1.0 where all are equal."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.join(F.broadcast(ends)).select(key, F.round(F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0), 6).alias("scaled"))


def gini(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Gini coefficient of the values of each group; 0 for a zero sum."""
    w = Window.partitionBy(*by).orderBy(value)
    x = df.withColumn("i", F.row_number().over(w))
    x = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col("i") * F.col(value)).alias("t"))
    return x.select(*by, "n", F.round(F.coalesce(F.try_divide(2 * F.col("t"), F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n"), F.lit(0.0)), 6).alias("gini"))


def percentile_position(df: DataFrame, value: str, key: str, *by: str) -> DataFrame:
    """Index / (n - 1) in the order of (value, key); equal values differ."""
    w = Window.partitionBy(*by)
    return df.select(*by, key, F.round((F.row_number().over(w.orderBy(value, key)) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1), 6).alias("position"))


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def bucket_rank(df: DataFrame, score: str, relevance: str, key: str, width: float = 2.5) -> DataFrame:
    """Ranked by score in buckets of ``width`` (half to even), then relevance, then key."""
    return df.withColumn("bucket", F.bround(F.col(score) / width, 0)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bucket"), F.desc(relevance), key)))


def emerging(df: DataFrame, topic: str, year: str, since: int, top: int = 10) -> DataFrame:
    """(topic, recent, older, growth): growth = recent / max(1, older), at least two recent."""
    x = df.groupBy(topic).agg(F.count_if(F.col(year) >= since).alias("recent"), F.count_if(F.col(year) < since).alias("older"))
    x = x.where("recent >= 2").withColumn("growth", F.round(F.col("recent") / F.greatest(F.lit(1), F.col("older")), 6))
    return x.orderBy(F.desc("growth"), F.desc("recent"), topic).limit(top)


def timeline(studies: DataFrame, papers: DataFrame, top: int = 12) -> DataFrame:
    """(year, topic, edges): studied-by edges by year of the ``top`` topics with most; ``studies`` (paper, topic), ``papers`` (paper, year)."""
    x = studies.join(papers.select("paper", "year"), "paper").groupBy("year", "topic").agg(F.count(F.lit(1)).alias("edges"))
    most = x.groupBy("topic").agg(F.sum("edges").alias("n")).orderBy(F.desc("n"), "topic").limit(top)
    return x.join(most, "topic", "left_semi").select("year", "topic", "edges")


def timeline_entities(studies: DataFrame, papers: DataFrame) -> DataFrame:
    """(year, papers, edges): papers that study something, and their edges, by year."""
    x = studies.join(papers.select("paper", "year"), "paper").groupBy("year", "paper").agg(F.count(F.lit(1)).alias("k"))
    return x.groupBy("year").agg(F.count(F.lit(1)).alias("papers"), F.sum("k").alias("edges"))


def distinct_counts(df: DataFrame, by: str, **columns: str) -> DataFrame:
    """(by, one count of distinct values for each named column)."""
    return df.groupBy(by).agg(*[F.countDistinct(c).alias(name) for name, c in columns.items()])


def conditional_counts(df: DataFrame, by: str, total: str, **conditions: Column) -> DataFrame:
    """(by, rows, and rows that meet each named condition)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(total), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def recency(papers: DataFrame, by: str, year: str, since: int) -> DataFrame:
    """(by, papers, first, last, recent, share): the span of years and how many are from ``since`` on, share to three digits."""
    recent = F.count_if(F.col(year) >= since)
    return papers.groupBy(by).agg(F.count(F.lit(1)).alias("papers"), F.min(year).alias("first"), F.max(year).alias("last"), recent.alias("recent"), F.round(recent / F.count(F.lit(1)), 3).alias("share"))


def topic_support(rows: DataFrame, cluster: str, topic: str, every: DataFrame, least: int = 3) -> DataFrame:
    """(cluster, topic, local, total): rows of a topic in a cluster, from ``least`` on, and among ``every`` row."""
    local = rows.groupBy(F.col(cluster).alias("cluster"), F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("local")).where(F.col("local") >= least)
    return local.join(every.groupBy(F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("total")), "topic").select("cluster", "topic", "local", "total")


def topic_papers(studies: DataFrame, least: int) -> DataFrame:
    """(topic, papers) of topics that ``least`` distinct papers study."""
    return studies.select("topic", "paper").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("papers")).where(F.col("papers") >= least)


def anchors(df: DataFrame, by: str, name: str, *rank: str) -> DataFrame:
    """(by, anchor): the name of each group's greatest row by ``rank``."""
    return df.groupBy(by).agg(F.max_by(name, F.struct(*rank)).alias("anchor"))


def histogram(df: DataFrame, by: str, bucket: str) -> DataFrame:
    """(by, histogram): counts of each bucket as ``bucket=count`` in order, joined by commas."""
    x = df.groupBy(by, bucket).agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", bucket, F.col("n").cast("string")))), ",").alias("histogram"))
