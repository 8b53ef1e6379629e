"""Queries of the concept graph and its clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import concepts as K
from graphloom.operators import graph as N
from graphloom.plans.catalog_graph import related
from graphloom.plans.catalog_text import ASKED, KNN, SAID, _asked, _sql_in, _sql_list, made_docs, MADE_DOCS, resolution, sql_stem, sql_tokens
from graphloom.plans.registry import query, with_
from graphloom.sources import projection as P

T = P.table


def links(s, d):
    return K.related_links(related(s, d).toDF("a", "b", "shared"))


@query(with_("related") + " SELECT src, dst, least(1.0, shared / 6.0)::DOUBLE AS weight FROM related")
def related_links(s, d):
    return links(s, d)


@query(KNN.format(least=0.35) + ", " + with_("related").removeprefix("WITH ") + " SELECT a, b, round(max(w), 4) AS weight FROM (SELECT src AS a, dst AS b, least(1.0, shared / 6.0)::DOUBLE AS w FROM related UNION ALL SELECT least(id, other), greatest(id, other), 0.7 * score FROM r WHERE rank <= 4) WHERE a <> b GROUP BY 1, 2")
def concept_graph(s, d):
    x = K.concept_graph(links(s, d), P.vectors(s, d).select("id", "vec"))
    return x.select("a", "b", F.round("weight", 4).alias("weight"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS g, p_brand AS i FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT i, count(*) AS n FROM p GROUP BY 1),
c AS (SELECT x.i AS a, y.i AS b, count(*) AS k FROM p x JOIN p y ON x.g = y.g AND x.i <> y.i GROUP BY 1, 2), j AS (SELECT a, b, round(k / (na.n + nb.n - k)::DOUBLE, 6) AS jaccard FROM c JOIN n na ON na.i = a JOIN n nb ON nb.i = b)
SELECT a, b, jaccard, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS rank FROM j WHERE jaccard >= 0.4) WHERE rank <= 15""")
def node_similarity(s, d):
    li = T(s, d, "lineitem").join(T(s, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return K.node_similarity(li.select(F.col("l_suppkey").alias("g"), F.col("p_brand").alias("i")), "g", "i").select("a", "b", "jaccard", "rank")


def brand_members(s, d):
    return T(s, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("topic"))


NAMED = with_("studies") + """, m AS (SELECT p_brand AS cluster, p_partkey AS topic, p_name AS name FROM part), own AS (SELECT DISTINCT cluster, paper FROM studies JOIN m USING (topic)), t AS (SELECT cluster, count(*) AS papers FROM own GROUP BY 1), e AS (SELECT topic, count(*) AS every FROM studies GROUP BY 1)"""


@query(NAMED + " SELECT cluster, topic, name, every AS local, round(every / papers::DOUBLE * (0.5 + 0.5 * every / greatest(1, every)::DOUBLE) * ln(2 + every), 6) AS distinctiveness FROM m JOIN t USING (cluster) JOIN e USING (topic) WHERE every >= 3")
def name_scores(s, d):
    return K.name_scores(brand_members(s, d), P.studies(s, d), T(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query()
def cluster_names(s, d):
    return K.cluster_names(name_scores(s, d))


@query()
def clusters(s, d):
    g = related(s, d).where("shared >= 3").toDF("a", "b", "shared").select("a", "b", F.least(F.lit(1.0), F.col("shared") / 6).alias("weight"))
    return K.clusters(g, P.studies(s, d), T(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query(with_("related", "near") + " SELECT -(row_number() OVER (ORDER BY d DESC, topic))::INTEGER AS id, topic, papers FROM (SELECT topic, papers, d FROM (SELECT topic, count(*) AS papers FROM studies GROUP BY 1) JOIN (SELECT src AS topic, count(*) AS d FROM near GROUP BY 1) USING (topic) WHERE papers >= 3 ORDER BY d DESC, topic LIMIT 14)")
def topic_candidates(s, d):
    deg = N.degree(related(s, d)).select(F.col("id").alias("topic"), F.col("degree").alias("value"))
    return K.topic_candidates(P.studies(s, d), deg)


@query(with_("studies") + f""", t AS (SELECT p_partkey AS topic FROM (SELECT p_partkey, name, t FROM (SELECT p_partkey, p_name AS name, list_distinct(list_transform({sql_tokens('p_name')}, lambda x: {sql_stem('x')})) AS t FROM part)) WHERE contains(lower(name), '{ASKED}') OR len(list_filter({_sql_list(_asked)}, lambda x: list_contains(t, x))) / {len(_asked)}.0 + CASE WHEN list_contains(t, 'gear') THEN 0.3 ELSE 0 END >= 0.9)
SELECT DISTINCT paper FROM studies JOIN t USING (topic) JOIN orders ON o_orderkey = paper WHERE year(o_orderdate) BETWEEN 1996 AND 1999""")
def scope(s, d):
    names = T(s, d, "part").select(F.col("p_partkey").alias("topic"), F.col("p_name").alias("name"))
    found = resolution(names, "topic", "name", ASKED, least=0.9)
    papers = T(s, d, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"))
    return K.scope(found, P.studies(s, d), papers, low=1996, high=1999)


RELEVANT = "small hot gear of the widget study"
_relevant = sorted({X.py_stem(t) for t in RELEVANT.split() if t not in X.STOPWORDS and t not in X.QUERY_STOP})


@query(f"""WITH t AS (SELECT p_brand AS cluster, list_transform(list_filter({sql_tokens('p_name')}, lambda x: x NOT IN {_sql_in(X.QUERY_STOP)}), lambda x: {sql_stem('x')}) AS t FROM part), c AS (SELECT cluster, list_distinct(flatten(list(t))) AS t FROM t GROUP BY 1)
SELECT cluster, round(CASE WHEN len(t) > 0 THEN len(list_filter({_sql_list(_relevant)}, lambda x: list_contains(t, x))) / {len(_relevant)}::DOUBLE ELSE 0.2 END, 6) AS relevance FROM c""")
def query_relevance(s, d):
    return K.query_relevance(T(s, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_name").alias("name")), RELEVANT)


QUESTIONS = ["which papers connect {x} and graph memory?", "links between planning and {x}.", "what is linking tools to {x}", "nothing about {x}"]


def made_questions(s, d):
    k = F.col("s_suppkey")
    t = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (k % 4 + 1).cast("int"))
    return T(s, d, "supplier").select(k.alias("q"), F.replace(t, F.lit("{x}"), F.concat(F.lit("case "), k.cast("string"))).alias("text"))


MADE_Q = "qs AS (SELECT s_suppkey AS q, replace((" + _sql_list(QUESTIONS) + ")[(s_suppkey % 4 + 1)::INTEGER], '{x}', 'case ' || s_suppkey) AS text FROM supplier)"


@query("WITH " + MADE_Q + r""" SELECT q, CASE WHEN c <> '' THEN c WHEN b <> '' THEN b ELSE nullif(l, '') END AS a, CASE WHEN c <> '' THEN c2 WHEN b <> '' THEN b2 ELSE nullif(l2, '') END AS b FROM (SELECT q, regexp_extract(text, 'connect(?:s|ing)?\s+(.+?)\s+(?:and|with|to)\s+(.+?)(?:\?|\.|$)', 1) AS c, regexp_extract(text, 'connect(?:s|ing)?\s+(.+?)\s+(?:and|with|to)\s+(.+?)(?:\?|\.|$)', 2) AS c2,
regexp_extract(text, 'between\s+(.+?)\s+and\s+(.+?)(?:\?|\.|$)', 1) AS b, regexp_extract(text, 'between\s+(.+?)\s+and\s+(.+?)(?:\?|\.|$)', 2) AS b2, regexp_extract(text, 'link(?:s|ing)?\s+(.+?)\s+(?:and|to)\s+(.+?)(?:\?|\.|$)', 1) AS l, regexp_extract(text, 'link(?:s|ing)?\s+(.+?)\s+(?:and|to)\s+(.+?)(?:\?|\.|$)', 2) AS l2 FROM qs)""")
def question_areas(s, d):
    return made_questions(s, d).select("q", K.areas(F.col("text")).alias("x")).select("q", "x.a", "x.b")


@query("WITH " + MADE_DOCS + ", a(a, text) AS (VALUES " + ", ".join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in enumerate(SAID)) + f"), q AS (SELECT doc_id AS q, list_distinct({sql_tokens('text')}) AS tq FROM docs), b AS (SELECT a, list_distinct({sql_tokens('text')}) AS ta FROM a)" + " SELECT q, a, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY jaccard DESC, a) AS r FROM (SELECT q, a, round(len(list_intersect(tq, ta)) / (len(tq) + len(ta) - len(list_intersect(tq, ta)))::DOUBLE, 6) AS jaccard FROM q, b) WHERE jaccard >= 0.3) WHERE r = 1")
def answer_match(s, d):
    answers = s.createDataFrame(list(enumerate(SAID)), "a int, text string")
    return K.answer_match(made_docs(s, d).withColumnRenamed("doc_id", "q"), answers, least=0.3)
