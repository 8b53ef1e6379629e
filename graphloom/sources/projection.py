"""The driver's tables as a property graph.

Paper = order, Topic = part, Method = part type, Dataset = supplier, Author = customer, Institution = nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))


def _type_slug(c: str):
    return F.concat(F.lit("method:"), F.lower(F.replace(F.col(c), F.lit(" "), F.lit("-"))))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, name, year, field)."""
    none, s = F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("field")
    t = lambda n: table(spark, d, n)
    parts = [
        t("orders").select(_id("paper", "o_orderkey").alias("id"), F.lit("Paper").alias("label"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("field")),
        t("part").select(_id("topic", "p_partkey").alias("id"), F.lit("Topic").alias("label"), F.col("p_name").alias("name"), none, F.col("p_brand").alias("field")),
        t("part").select("p_type").distinct().select(_type_slug("p_type").alias("id"), F.lit("Method").alias("label"), F.col("p_type").alias("name"), none, s),
        t("supplier").select(_id("dataset", "s_suppkey").alias("id"), F.lit("Dataset").alias("label"), F.col("s_name").alias("name"), none, s),
        t("customer").select(_id("author", "c_custkey").alias("id"), F.lit("Author").alias("label"), F.col("c_name").alias("name"), none, F.col("c_mktsegment").alias("field")),
        t("nation").select(_id("institution", "n_nationkey").alias("id"), F.lit("Institution").alias("label"), F.col("n_name").alias("name"), none, s),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, type, weight, predicted, provenance)."""
    t = lambda n: table(spark, d, n)
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    typed = li.join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    make = lambda df, src, dst, rel, w: df.select(src.alias("src"), dst.alias("dst")).distinct().select("src", "dst", F.lit(rel).alias("type"), F.lit(w).alias("weight"), F.lit(False).alias("predicted"), F.lit("tables").alias("provenance"))
    parts = [
        make(li, _id("paper", "l_orderkey"), _id("topic", "l_partkey"), "STUDIES", 1.0),
        make(typed, _id("paper", "l_orderkey"), _type_slug("p_type"), "USES_METHOD", 1.0),
        make(li, _id("paper", "l_orderkey"), _id("dataset", "l_suppkey"), "USES_DATASET", 1.0),
        make(t("orders"), _id("author", "o_custkey"), _id("paper", "o_orderkey"), "AUTHORED", 1.0),
        make(t("customer"), _id("author", "c_custkey"), _id("institution", "c_nationkey"), "AFFILIATED_WITH", 1.0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def studies(spark: SparkSession, d: str) -> DataFrame:
    """(paper, topic) keys of orders and their parts."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("topic")).distinct()


def related_parts(spark: SparkSession, d: str, least: int = 2) -> DataFrame:
    """(src, dst, shared): parts src < dst in ``least`` common orders."""
    s = studies(spark, d)
    x = s.select("paper", F.col("topic").alias("src")).join(s.select("paper", F.col("topic").alias("dst")), "paper").where("src < dst")
    return x.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def trade(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, n): line items from a customer's nation to a supplier's, by name."""
    t = lambda n: table(spark, d, n)
    nation = t("nation").select("n_nationkey", "n_name")
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey").select("c_custkey", F.col("n_name").alias("src"))
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(nation, "n_nationkey").select("l_suppkey", F.col("n_name").alias("dst"))
    x = t("lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey")
    return x.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("cluster"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, paper): the sentences of ``benchmark`` texts."""
    from graphloom.functions.text import sentences

    s = table(spark, d, "benchmark").select("item_id", F.posexplode(sentences(F.col("text"))).alias("pos", "text"))
    return s.select(F.concat_ws(":", F.col("item_id").cast("string"), F.col("pos").cast("string")).alias("id"), "text", F.concat(F.lit("paper:"), F.col("item_id").cast("string")).alias("paper"))
