"""Corpus records: JSON scan, validation, value dictionaries, and the graph built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import ellipsis, slug
from graphloom.sources import model

ARXIV = r"^\d{4}\.\d{4,5}$"


def read_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """papers, citations, claims and the counted vocabularies of a corpus document."""
    doc = spark.read.schema(model.CORPUS).json(path, multiLine=True)
    return {k: doc.select(F.explode(k).alias("x")).select("x.*") for k in ("papers", "citations", "claims", "topics", "methods", "datasets")}


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers from a bare array or a wrapper object with ``papers``."""
    raw = spark.read.text(path, wholetext=True)
    bare, wrapped = F.from_json("value", f"array<{model.PAPER.simpleString()}>"), F.from_json("value", f"papers array<{model.PAPER.simpleString()}>")
    return raw.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped["papers"])).alias("p")).select("p.*")


def year_of(arxiv_id):
    return (2000 + F.floor(F.substring(arxiv_id, 1, 4).cast("int") / 100)).cast("int")


def problems(papers: DataFrame, citations: DataFrame, least: int = 100) -> DataFrame:
    """(kind, id) of each breach: bad or repeated ids, citations of unknown papers, too few rows."""
    ids = papers.select(F.col("arxiv_id").alias("id"))
    bad = ids.where(~F.coalesce(F.col("id").rlike(ARXIV), F.lit(False))).select(F.lit("bad-id").alias("kind"), "id")
    twice = ids.groupBy("id").count().where("count > 1").select(F.lit("repeated-id").alias("kind"), "id")
    ends = citations.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    loose = ends.join(ids, "id", "left_anti").select(F.lit("dangling-citation").alias("kind"), "id")
    few = ids.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select(F.lit("too-few-rows").alias("kind"), F.col("n").cast("string").alias("id"))
    return bad.unionByName(twice).unionByName(loose).unionByName(few)


def dictionary(papers: DataFrame, key: str) -> DataFrame:
    """(id, name, paper_count) of the values of an array column: the first name of each slug, by count and id."""
    each = papers.select("arxiv_id", F.posexplode(key).alias("pos", "name")).withColumn("id", slug(F.col("name")))
    out = each.groupBy("id").agg(F.min_by("name", F.struct("arxiv_id", "pos")).alias("name"), F.countDistinct("arxiv_id").alias("paper_count"))
    return out.orderBy(F.desc("paper_count"), "id")


def profile(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count(F.lit(1)).alias("papers"), F.min("year").alias("first"), F.max("year").alias("last"), F.count_if(F.col("author_status") == "verified").alias("verified"), F.count_if(F.col("corpus_tier") == "classic").alias("classics"))


def field_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("field").agg(F.count(F.lit(1)).alias("paper_count")).orderBy(F.desc("paper_count"), "field")


def write_corpus(papers: DataFrame, path: str) -> None:
    """Records as JSON lines; null fields are left out."""
    papers.write.mode("overwrite").json(path)


def backfill(nodes: DataFrame, counted: DataFrame, label: str) -> DataFrame:
    """Nodes and those of a counted vocabulary (id, name, paper_count) that some paper has and the graph lacks."""
    new = counted.where("paper_count > 0").select(F.concat(F.lit(label.lower() + ":"), "id").alias("id"), F.lit(label).alias("label"), "name")
    return nodes.unionByName(new.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)


def duplicates(nodes: DataFrame) -> DataFrame:
    """(label, id, n) of ids that a label has more than once: a uniqueness constraint as a check."""
    return nodes.groupBy("label", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def observed(edges: DataFrame) -> DataFrame:
    """Stored edges without those that are derived again on load."""
    return edges.where(~F.col("type").isin("SIMILAR_TO", "RELATED_TO"))


def fetch(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Papers of the Atom files under a path, one per id, the ``most`` first by id."""
    return parse_atom(spark.read.text(path, wholetext=True)).orderBy("arxiv_id").limit(most)


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row per id: of each column the first value, by ``order``, that isn't null."""
    cols = [c for c in nodes.columns if c not in ("id", order)]
    return nodes.groupBy("id").agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def merge_edges(edges: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """First edge by ``order`` of each (src, dst, type) whose ends exist; no loops."""
    w = Window.partitionBy("src", "dst", "type").orderBy(order)
    e = edges.where("src <> dst").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", order)
    ids = nodes.select("id")
    return e.join(ids, e.src == ids.id, "left_semi").join(ids, e.dst == ids.id, "left_semi")


def build_graph(corpus: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a corpus: papers, topics (fields too), methods, datasets, authors and claims."""
    papers, s = corpus["papers"], F.lit(None).cast("string")
    pid = F.concat(F.lit("paper:"), "arxiv_id")
    nodes = [papers.select(pid.alias("id"), F.lit("Paper").alias("label"), F.col("title").alias("name"), "year", "field", F.lit(0).alias("o"))]
    edges = []

    def add(values, label, rel, weight, order, from_author=False):
        each = papers.select(pid.alias("paper"), F.explode(values).alias("name")).withColumn("id", F.concat(F.lit(label.lower() + ":"), slug(F.col("name"))))
        nodes.append(each.select("id", F.lit(label).alias("label"), "name", F.lit(None).cast("int").alias("year"), s.alias("field"), F.lit(order).alias("o")))
        a, b = ("id", "paper") if from_author else ("paper", "id")
        edges.append(each.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(rel).alias("type"), F.lit(weight).alias("weight"), F.lit(order).alias("o")))

    add(F.array("field"), "Topic", "STUDIES", 0.6, 1)
    add(F.col("topics"), "Topic", "STUDIES", 1.0, 2)
    add(F.col("methods"), "Method", "USES_METHOD", 1.0, 3)
    add(F.col("datasets"), "Dataset", "USES_DATASET", 1.0, 4)
    add(F.col("authors"), "Author", "AUTHORED", 1.0, 5, from_author=True)
    claims = corpus["claims"].withColumn("cid", F.concat(F.lit("claim:"), "id"))
    nodes.append(claims.select(F.col("cid").alias("id"), F.lit("Claim").alias("label"), ellipsis(F.col("text"), 120).alias("name"), F.lit(None).cast("int").alias("year"), s.alias("field"), F.lit(6).alias("o")))
    edges.append(claims.select(F.concat(F.lit("paper:"), "paper").alias("src"), F.col("cid").alias("dst"), F.lit("MAKES_CLAIM").alias("type"), F.lit(1.0).alias("weight"), F.lit(6).alias("o")))
    edges.append(corpus["citations"].select(F.concat(F.lit("paper:"), "source").alias("src"), F.concat(F.lit("paper:"), "target").alias("dst"), F.lit("CITES").alias("type"), F.lit(1.0).alias("weight"), F.lit(7).alias("o")))
    n, e = nodes[0], edges[0]
    for x in nodes[1:]:
        n = n.unionByName(x)
    for x in edges[1:]:
        e = e.unionByName(x)
    n = merge_nodes(n, "o")
    e = merge_edges(e, n, "o").withColumn("predicted", F.lit(False)).withColumn("provenance", F.lit("corpus"))
    return n, e


def parse_atom(feeds: DataFrame, column: str = "value") -> DataFrame:
    """Papers of Atom feeds: arxiv_id, title, summary, year and authors of each entry, one row per id."""
    entry = F.explode(F.regexp_extract_all(column, F.lit("(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e")
    tidy = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    field = lambda tag: tidy(F.regexp_extract("e", f"(?s)<{tag}>(.*?)</{tag}>", 1))
    x = feeds.select(entry).select(F.regexp_extract("e", r"<id>[^<]*/abs/([^<]+?)(?:v\d+)?</id>", 1).alias("arxiv_id"), field("title").alias("title"), field("summary").alias("summary"), F.regexp_extract("e", r"<published>(\d{4})", 1).try_cast("int").alias("year"), F.transform(F.regexp_extract_all("e", F.lit("(?s)<name>(.*?)</name>"), F.lit(1)), tidy).alias("authors"))
    return x.where("arxiv_id <> ''").groupBy("arxiv_id").agg(*[F.min_by(c, F.struct("title", "summary")).alias(c) for c in ("title", "summary", "year", "authors")])
