"""Exports of a graph: JSON, GraphML, CSV, Cypher statements and Markdown, as rows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_subgraph(nodes: DataFrame, edges: DataFrame, rank: str, limit: int, labels: list[str] | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` first nodes by ``rank`` and the edges among them."""
    n = nodes.where(F.col("label").isin(labels)) if labels else nodes
    n = n.orderBy(F.desc(rank), "id").limit(limit)
    e = edges.where(F.col("type").isin(types)) if types else edges
    ids = n.select("id")
    return n, e.join(ids, e.src == ids.id, "left_semi").join(ids, e.dst == ids.id, "left_semi")


def xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# The attributes of the GraphML export, each declared for nodes and for edges.
GRAPHML_KEYS = {
    "label": "string", "name": "string", "year": "int", "pagerank": "double", "betweenness": "double", "degree": "int",
    "community": "int", "url": "string", "provenance": "string", "weight": "double", "predicted": "boolean",
}


def graphml_head() -> str:
    zero = lambda kind: "" if kind == "string" else ' default="0"'
    keys = "".join(f'<key id="{of}_{k}" for="{of}" attr.name="{k}" attr.type="{kind}"{zero(kind)}/>' for k, kind in GRAPHML_KEYS.items() for of in ("node", "edge"))
    return f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'


def graphml_rows(nodes: DataFrame, edges: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(part, id, line): header, a line per node and edge, footer; ``part`` orders the file.

    ``metrics`` (id, pagerank, betweenness, degree, community) fill the nodes' attributes; unknown ones are 0, a community -1.
    """
    spark = nodes.sparkSession
    data = lambda k, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f'<data key="{k}">'), xml(c.cast("string")), F.lit("</data>"))).otherwise("")
    have = set(metrics.columns) if metrics is not None else set()
    known = nodes.join(metrics.select("id", *[F.col(c).alias(f"m_{c}") for c in ("pagerank", "betweenness", "degree", "community") if c in have]), "id", "left") if have else nodes
    told = lambda c, zero: F.coalesce(F.col(f"m_{c}"), F.lit(zero)) if c in have else F.lit(zero)
    values = [
        ("label", F.col("label")), ("name", F.col("name")), ("year", F.coalesce("year", F.lit(0))), ("pagerank", F.round(told("pagerank", 0.0), 8)), ("betweenness", F.round(told("betweenness", 0.0), 8)),
        ("degree", told("degree", 0)), ("community", told("community", -1)), *([("url", F.col("url"))] if "url" in nodes.columns else []),
    ]
    n = known.select(F.lit(1).alias("part"), "id", F.concat(F.lit('<node id="'), xml(F.col("id")), F.lit('">'), *[data(f"node_{k}", c) for k, c in values], F.lit("</node>")).alias("line"))
    eid = F.concat_ws("|", "src", "type", "dst")
    weight = F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    origin = F.coalesce("provenance", F.lit("graph-construction")) if "provenance" in edges.columns else F.lit("graph-construction")
    guess = F.coalesce("predicted", F.lit(False)) if "predicted" in edges.columns else F.lit(False)
    said = F.concat(*[data(f"edge_{k}", c) for k, c in (("label", F.col("type")), ("weight", weight), ("provenance", origin), ("predicted", guess))])
    e = edges.select(F.lit(2).alias("part"), eid.alias("id"), F.concat(F.lit('<edge id="'), xml(eid), F.lit('" source="'), xml(F.col("src")), F.lit('" target="'), xml(F.col("dst")), F.lit('">'), said, F.lit("</edge>")).alias("line"))
    ends = spark.createDataFrame([(0, "", graphml_head()), (3, "", "</graph></graphml>")], "part int, id string, line string")
    return ends.unionByName(n).unionByName(e)


def cypher_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): one MERGE statement per node and edge."""
    q = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = nodes.select(F.lit(1).alias("part"), "id", F.concat(F.lit("MERGE (n:"), "label", F.lit(" {id: "), q(F.col("id")), F.lit("}) SET n.name = "), q(F.coalesce("name", F.lit(""))), F.lit(";")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "type", "dst").alias("id"), F.concat(F.lit("MATCH (a {id: "), q(F.col("src")), F.lit("}), (b {id: "), q(F.col("dst")), F.lit("}) MERGE (a)-[r:"), "type", F.lit("]->(b) SET r.weight = "), F.coalesce("weight", F.lit(1.0)).cast("string"), F.lit(";")).alias("line"))
    return n.unionByName(e)


def csv_frames(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables for ``write.csv`` (quoted by RFC 4180)."""
    ends = nodes.select("id", "label")
    s, d = ends.toDF("src", "source_type"), ends.toDF("dst", "target_type")
    e = edges.join(s, "src", "left").join(d, "dst", "left")
    return nodes.select("id", "label", "name", "year"), e.select(F.col("src").alias("source"), "source_type", F.col("dst").alias("target"), "target_type", F.col("type").alias("relationship"), "weight", "predicted")


def write_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    n, e = csv_frames(nodes, edges)
    for name, x in (("nodes", n), ("edges", e)):
        x.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")


def write_lines(rows: DataFrame, path: str) -> None:
    """One text file, in order of part and id."""
    rows.orderBy("part", "id").select("line").coalesce(1).write.mode("overwrite").text(path)


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct(*nodes.columns)).alias("json"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws("|", "src", "type", "dst").alias("id"), F.to_json(F.struct(*edges.columns)).alias("json")))


def write_back(path: str, **frames: DataFrame) -> None:
    """Metrics, communities, conflicts and predictions as named Parquet tables; predictions are the 200 first by score."""
    for name, df in frames.items():
        if name == "predictions":
            df = df.orderBy(F.desc("adamic_adar"), F.desc("jaccard"), "a", "b").limit(200)
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key: a new value counts where it isn't null."""
    n = new.select(*[F.col(c).alias(c if c == key else f"_{c}") for c in new.columns])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != key])
