"""Queries of the composite plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import claims as C
from graphloom.operators import gaps as O
from graphloom.operators import graph as N
from graphloom.plans import research as R
from graphloom.plans.catalog_algorithms import ENTANGLED, SCORES, gap_frames, gap_vectors
from graphloom.plans.catalog_text import SCORED, _sql_in, _sql_list, made_claims, sql_stem, sql_tokens
from graphloom.plans.registry import query, with_
from graphloom.sources import projection as P

T = P.table
QUESTION = "How do small gears relate to a red widget of economy type?"


def papers(s, d):
    """Parts as papers: name as title, type as summary, brand as taxonomy."""
    return T(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.col("p_brand").alias("taxonomy"), F.col("p_size").alias("year"))




TERMS = R.question_terms(QUESTION)
NOISE = sorted(set(X.QUESTION_NOISE) | set(X.STOPWORDS))


def sql_compounds(text: str) -> str:
    return f"list_distinct(list_filter(list_transform(flatten(list_transform({sql_tokens(text)}, lambda t: list_concat([t], string_split(replace(t, '_', '-'), '-')))), lambda x: {sql_stem('x')}), lambda x: length(x) > 1 AND x NOT IN {_sql_in(NOISE)}))"


RANKED = f"""WITH q AS (SELECT unnest({_sql_list(TERMS)}) AS term), x AS (SELECT p_partkey AS id, p_size AS year, p_name AS title, {sql_compounds('p_name')} AS a, {sql_compounds('p_type')} AS b, {sql_compounds('p_brand')} AS c FROM part),
h AS (SELECT id, year, title, term, list_contains(a, term) AS in_a, list_contains(b, term) AS in_b, list_contains(c, term) AS in_c FROM x, q WHERE list_contains(a, term) OR list_contains(b, term) OR list_contains(c, term)),
w AS (SELECT q.term, ln(1 + (greatest(1, (SELECT count(*) FROM part)) + 0.5) / (count(h.id) + 0.5)) AS w FROM q LEFT JOIN h USING (term) GROUP BY 1), s AS (SELECT id, any_value(year) AS year, any_value(title) AS title, string_agg(term, ',' ORDER BY term) AS matched, round((0.52 * sum(CASE WHEN in_a THEN w ELSE 0 END) + 0.30 * sum(CASE WHEN in_b THEN w ELSE 0 END) + 0.18 * sum(CASE WHEN in_c THEN w ELSE 0 END)) / (SELECT sum(w) FROM w) / 1.05, 4) AS relevance FROM h JOIN w USING (term) GROUP BY 1),
ranked AS (SELECT id, relevance, matched, year FROM s ORDER BY relevance DESC, coalesce(year, 0) DESC, lower(title), id LIMIT 50)"""


@query(RANKED + " SELECT * FROM ranked")
def paper_rank(s, d):
    return R.rank_papers(papers(s, d), QUESTION, limit=50)


@query(RANKED + f" SELECT count(*) AS papers, min(year) AS first, max(year) AS last, {len(TERMS)} AS terms, (SELECT count(DISTINCT t) FROM (SELECT unnest(string_split(matched, ',')) AS t FROM ranked)) AS hit, round((SELECT count(DISTINCT t) FROM (SELECT unnest(string_split(matched, ',')) AS t FROM ranked)) / {len(TERMS)}::DOUBLE, 3) AS coverage FROM ranked")
def paper_coverage(s, d):
    return R.coverage_report(R.rank_papers(papers(s, d), QUESTION, limit=50), QUESTION)


@query("SELECT key, round(n / 2.0, 4)::DOUBLE AS relevance, n >= 2 AS supported FROM (SELECT p_name AS key, CASE WHEN contains(p_name, 'small') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'gear') THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT p_name FROM part))")
def candidate_relevance(s, d):
    c = T(s, d, "part").select(F.col("p_name").alias("key")).distinct().withColumn("labels", F.col("key"))
    return R.candidate_relevance(c, "small gear")


@query("SELECT 'field' AS kind, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'summary_source', o_orderstatus, count(*) FROM orders WHERE o_orderstatus <> '' GROUP BY 2")
def coverage_counts(s, d):
    return R.coverage_counts(T(s, d, "orders").select(F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("summary_source")))


SEEDS = [("dataset:1", 1.0), ("institution:3", 0.5)]
REACHED = with_("nodes", "adj") + """, seeds(id, score) AS (VALUES ('dataset:1', 1.0::DOUBLE), ('institution:3', 0.5::DOUBLE)), reached AS (SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM seeds UNION ALL SELECT dst, 1 FROM adj JOIN seeds ON src = id) GROUP BY 1 ORDER BY 2, 1 LIMIT 90),
rp AS (SELECT r.id, name, coalesce(s.score, 0) AS score, k / 1000::DOUBLE AS pagerank FROM reached r JOIN nodes USING (id) LEFT JOIN seeds s ON s.id = r.id JOIN (SELECT src AS id, count(*) AS k FROM adj GROUP BY 1) g ON g.id = r.id WHERE label = 'Paper'), ordered AS (SELECT *, (row_number() OVER (ORDER BY score + 30 * pagerank DESC, id))::INTEGER AS pos FROM rp)"""


def reached(s, d):
    n, e = P.nodes(s, d), P.edges(s, d).select("src", "dst", "type")
    m = N.degree(e).select("id", (F.col("degree") / 1000).alias("pagerank"), F.lit(None).cast("string").alias("community"))
    return R.retrieval_context(n, e, s.createDataFrame(SEEDS, "id string, score double"), metrics=m)


@query(REACHED + " SELECT id, score, pagerank, pos FROM ordered")
def retrieval_papers(s, d):
    return reached(s, d)["papers"].select("id", "score", "pagerank", "pos")


@query(REACHED + " SELECT pos, 'paper' AS kind, id, name AS title FROM ordered WHERE pos <= 12")
def evidence_list(s, d):
    return R.evidence_list(reached(s, d))


@query("WITH " + SCORED + ", x AS (SELECT claim_a, claim_b, score, contains(lower(a.text || b.text), 'task1 ') OR contains(lower(paper_a), 'task1 ') OR contains(lower(paper_b), 'task1 ') AS m FROM found JOIN claims a ON a.id = claim_a JOIN claims b ON b.id = claim_b) SELECT claim_a, claim_b, score FROM x WHERE m OR NOT (SELECT bool_or(m) FROM x) ORDER BY score DESC, claim_a, claim_b LIMIT 40")
def tool_conflicts(s, d):
    t = R.standard_tools(P.nodes(s, d), P.edges(s, d), conflicts=C.conflicts(C.parse(made_claims(s, d)), texts=True))
    return t.call(s, "find_conflicting_claims", topic="Task1 ", limit=40)["result"].select("claim_a", "claim_b", "score")


@query(REACHED + """, ids AS (SELECT id FROM reached), x AS (SELECT 1 AS k, n.id, '[' || label || '] ' || coalesce(name, '') || ' (' || n.id || ')' AS line FROM ids JOIN nodes n USING (id) UNION ALL SELECT 2, src || '|' || type || '|' || dst, src || ' -' || type || '-> ' || dst FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)),
y AS (SELECT (row_number() OVER w)::INTEGER AS pos, line, sum(length(line) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM x WINDOW w AS (ORDER BY k, id)) SELECT pos, line FROM y WHERE upto <= 9000""")
def retrieval_context(s, d):
    n, e = P.nodes(s, d), P.edges(s, d).select("src", "dst", "type")
    seeds = s.createDataFrame([("dataset:1", 1.0), ("institution:3", 0.5)], "id string, score double")
    return R.context_rows(R.retrieval_context(n, e, seeds))


@query("SELECT key, round(n / 2.0, 4)::DOUBLE AS relevance, score FROM (SELECT p_name AS key, count(*)::DOUBLE AS score, CASE WHEN contains(p_name, 'small') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'gear') THEN 1 ELSE 0 END AS n FROM part GROUP BY 1) WHERE n >= 2 ORDER BY relevance DESC, score DESC, key LIMIT 5")
def investigate(s, d):
    c = T(s, d, "part").groupBy(F.col("p_name").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("score")).withColumn("labels", F.col("key"))
    return R.investigate(papers(s, d), c, "small gear")["candidates"].select("key", "relevance", "score")


LINES = " || chr(10) || ".join(f"printf('| {label} | %.1f |', round(100 * {k}, 1))" for k, label in O.LABELS.items())


@query(SCORES + ENTANGLED + f" SELECT rank::INTEGER AS rank, printf('## %d. %s × %s', rank, a, b) || chr(10) || chr(10) || printf('Score %.1f, confidence %s, %s.', round(score, 1), confidence, trajectory) || chr(10) || chr(10) || '| component | value |' || chr(10) || '| --- | ---: |' || chr(10) || {LINES} || chr(10) || chr(10) || '{R.NOTICE}' AS line FROM ranked")
def report_rows(s, d):
    return R.report_rows(R.find_gaps(*gap_frames(s, d), gap_vectors(s, d), recent=1999, bridge_recent=2000))


@query("WITH " + SCORED + " SELECT claim_a, claim_b, score FROM found WHERE paper_a IN ('p1', 'p3') OR paper_b IN ('p1', 'p3') ORDER BY score DESC, claim_a, claim_b LIMIT 20")
def counter_evidence(s, d):
    ids = s.createDataFrame([("p1",), ("p3",)], "id string")
    return R.counter_evidence(C.conflicts(C.parse(made_claims(s, d))), ids, 20).select("claim_a", "claim_b", "score")


@query(with_("nodes", "edges") + " SELECT paper, n_a, n_b FROM (SELECT src AS paper, count(*) FILTER (contains(lower(name), '1')) AS n_a, count(*) FILTER (contains(lower(name), '2')) AS n_b FROM edges JOIN nodes ON id = dst WHERE type = 'STUDIES' GROUP BY 1) WHERE n_a > 0 AND n_b > 0")
def connecting_papers(s, d):
    return R.connecting(P.nodes(s, d), P.edges(s, d), "1", "2")


@query(with_("nodes") + " SELECT id, name, year FROM nodes WHERE label = 'Paper' AND contains(lower(name), 'order 77') ORDER BY id LIMIT 10")
def tool_search_papers(s, d):
    t = R.standard_tools(P.nodes(s, d), P.edges(s, d))
    r = t.call(s, "search_papers", query="order 77", limit="10")
    return r["result"].select("id", "name", "year")


@query("SELECT s_suppkey AS id, CASE WHEN pr > 0.01 THEN 'top-tier influence' WHEN pr > 0.004 THEN 'notable influence' ELSE 'local influence' END || CASE WHEN bc > 0.01 THEN '; bridge' ELSE '' END AS notes FROM (SELECT s_suppkey, s_suppkey / 5000.0 AS pr, (s_suppkey % 30) / 1000.0 AS bc FROM supplier)")
def metric_notes(s, d):
    return R.explain_metrics(T(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") / 5000).alias("pagerank"), (F.col("s_suppkey") % 30 / 1000).alias("betweenness")))
