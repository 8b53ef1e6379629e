"""Queries of the combined views."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators import graph as N
from graphloom.plans import research as R
from graphloom.plans import views as W
from graphloom.plans.catalog_algorithms import nations, trade_graph
from graphloom.plans.catalog_graph import brands, related
from graphloom.plans.catalog_text import made_claims
from graphloom.plans.registry import query, with_
from graphloom.shipping import ship
from graphloom.sources import corpus
from graphloom.sources import projection as P

T = P.table


@query(with_("nodes", "edges") + " SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges")
def statistics(s, d):
    return W.statistics(P.nodes(s, d), P.edges(s, d))


@query()
def analytics_nations(s, d):
    return W.analytics(nations(s, d), trade_graph(s, d))


@query(with_("nodes") + """, x AS (SELECT id, label, name, field AS c FROM nodes WHERE label IN ('Topic', 'Paper')), z AS (SELECT c, count(*) FILTER (label = 'Paper') AS papers, count(*) FILTER (label = 'Topic') AS topics FROM x GROUP BY 1 HAVING papers >= 2 OR topics >= 3),
t AS (SELECT c, string_agg(name, ' · ' ORDER BY name, id) AS name FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY name, id) AS r FROM x WHERE label = 'Topic') WHERE r <= 3 GROUP BY 1)
SELECT 'community:' || c AS id, CASE WHEN length(n) > 70 THEN n[1:67] || '…' ELSE n END AS name, papers, topics FROM (SELECT z.*, coalesce(t.name, 'Community ' || c) AS n FROM z LEFT JOIN t USING (c))""")
def community_nodes(s, d):
    n = P.nodes(s, d).where("label in ('Topic', 'Paper')")
    return W.communities(n, n.select("id", F.col("field").alias("community")))[0].drop("label")


@query(with_("nodes") + " SELECT id AS src, 'community:' || field AS dst, 'BELONGS_TO' AS type FROM nodes WHERE label IN ('Topic', 'Paper')")
def belongs_to(s, d):
    n = P.nodes(s, d).where("label in ('Topic', 'Paper')")
    return W.communities(n, n.select("id", F.col("field").alias("community")))[1].select("src", "dst", "type")


#: Metrics made from the graph's degrees, with each node's field as its community.
METRICS = with_("nodes", "adj") + ", met AS (SELECT n.id, coalesce(k, 0) / 1000::DOUBLE AS pagerank, length(n.id) / 100::DOUBLE AS betweenness, coalesce(k, 0) AS degree, field AS community FROM nodes n LEFT JOIN (SELECT src AS id, count(*) AS k FROM adj GROUP BY 1) USING (id) WHERE field IS NOT NULL)"


def made_metrics(s, d):
    n = N.with_degree(P.nodes(s, d), P.edges(s, d)).where("field is not null")
    return n.select("id", (F.col("degree") / 1000).alias("pagerank"), (F.length("id") / 100).alias("betweenness"), "degree", F.col("field").alias("community"))


PROFILES = METRICS + """, x AS (SELECT n.id, label, name, year, community, pagerank, row_number() OVER (PARTITION BY community, label ORDER BY pagerank DESC, n.id) AS r FROM nodes n JOIN met ON met.id = n.id WHERE label IN ('Paper', 'Topic', 'Method')),
prof AS (SELECT community, count(*) FILTER (label = 'Paper') AS papers, count(*) FILTER (label = 'Topic') AS topics, count(*) FILTER (label = 'Method') AS methods, min(year) FILTER (label = 'Paper') AS first, max(year) FILTER (label = 'Paper') AS last, round(coalesce(avg(pagerank) FILTER (label = 'Paper'), 0), 6)::DOUBLE AS avg_pagerank,
 coalesce(string_agg(id, '|' ORDER BY r) FILTER (label = 'Paper' AND r <= 6), '') AS top_papers, coalesce(string_agg(name, '|' ORDER BY r) FILTER (label = 'Topic' AND r <= 8), '') AS top_topics FROM x GROUP BY 1), ranked AS (SELECT *, (row_number() OVER (ORDER BY papers DESC, community) - 1)::INTEGER AS rank FROM prof)"""


def _flat(profiles):
    return profiles.withColumns({"top_papers": F.array_join(F.transform("top_papers", lambda x: x["id"]), "|"), "top_topics": F.array_join("top_topics", "|")})


@query(PROFILES + " SELECT * FROM ranked")
def community_profiles(s, d):
    return _flat(W.community_profiles(P.nodes(s, d), made_metrics(s, d)))


@query(PROFILES + " SELECT * FROM ranked WHERE contains(lower(top_topics), 'ring') ORDER BY rank LIMIT 20")
def tool_communities(s, d):
    t = R.standard_tools(P.nodes(s, d), P.edges(s, d), profiles=W.community_profiles(P.nodes(s, d), made_metrics(s, d)))
    return _flat(t.call(s, "find_research_communities", topic="Ring", limit=20)["result"])


@query(with_("related") + " SELECT src, dst, x.p_name AS src_name, y.p_name AS dst_name, shared AS weight FROM related JOIN part x ON x.p_partkey = src JOIN part y ON y.p_partkey = dst WHERE contains(lower(x.p_name), 'gear') OR contains(lower(y.p_name), 'gear') ORDER BY shared DESC, src, dst LIMIT 50")
def tool_connections(s, d):
    p = T(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    t = R.standard_tools(p, P.edges(s, d), predicted=related(s, d).withColumnRenamed("shared", "weight"))
    return t.call(s, "find_potential_connections", topic="gear", limit=99)["result"].drop("note")


@query(METRICS + """, st AS (SELECT dst AS topic, year FROM edges JOIN nodes ON id = src WHERE type = 'STUDIES'), em AS (SELECT topic, round(r / greatest(1, o)::DOUBLE, 6) AS growth FROM (SELECT topic, count(*) FILTER (year >= 1999) AS r, count(*) FILTER (year < 1999) AS o FROM st GROUP BY 1) WHERE r >= 2 ORDER BY growth DESC, r DESC, topic LIMIT 10),
pm AS (SELECT met.* FROM met JOIN nodes USING (id) WHERE label = 'Paper'), co AS (SELECT 'community:' || field AS id, count(*) FILTER (label = 'Paper') AS papers, count(*) FILTER (label = 'Topic') AS topics FROM nodes WHERE field IS NOT NULL GROUP BY 1 HAVING papers >= 2 OR topics >= 3 ORDER BY papers DESC, id LIMIT 10)
SELECT 'statistics' AS section, 'label:' || label AS name, count(*)::DOUBLE AS value FROM nodes GROUP BY label UNION ALL SELECT 'statistics', 'type:' || type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'statistics', 'total:nodes', count(*) FROM nodes UNION ALL SELECT 'statistics', 'total:edges', count(*) FROM edges
UNION ALL SELECT 'years', year::VARCHAR, count(*) FROM nodes WHERE label = 'Paper' GROUP BY year UNION ALL SELECT 'emerging', topic, growth FROM em UNION ALL SELECT * FROM (SELECT 'influential', id, pagerank FROM pm ORDER BY pagerank DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'bridging', id, betweenness FROM pm ORDER BY betweenness DESC, id LIMIT 10) UNION ALL SELECT 'communities', id, papers FROM co""")
def dashboard(s, d):
    return W.dashboard_rows(W.dashboard(P.nodes(s, d), P.edges(s, d), made_metrics(s, d), since=1999))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_brand = 'Brand#7' ORDER BY p_name, p_partkey LIMIT 160")
def community_members(s, d):
    n = T(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Topic").alias("label"), F.col("p_name").alias("name"))
    return W.community_members(n, T(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community")), "Brand#7").select("id", "name")


@query(with_("related") + " SELECT src, dst, x.p_name AS src_name, y.p_name AS dst_name, shared FROM related JOIN part x ON x.p_partkey = src JOIN part y ON y.p_partkey = dst WHERE x.p_brand = 'Brand#3' OR y.p_brand = 'Brand#3' ORDER BY shared DESC, src, dst LIMIT 20")
def predicted_links(s, d):
    e = related(s, d).select("src", "dst", F.lit("PREDICTED_LINK").alias("type"), F.col("shared").alias("weight"))
    p = T(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand")
    return W.predicted_links(e, p, p.where("p_brand = 'Brand#3'")).select("src", "dst", "src_name", "dst_name", F.col("weight").alias("shared"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium-high' ELSE CASE WHEN s_suppkey % 20 >= 12 AND s_suppkey % 6 >= 4 THEN 'medium-high' WHEN s_suppkey % 20 >= 5 THEN 'medium' ELSE 'low' END END AS confidence FROM supplier")
def answer_confidence(s, d):
    k = F.col("s_suppkey")
    level = F.when(k % 5 == 0, "Low").when(k % 5 == 1, "Medium-High")
    return T(s, d, "supplier").select(k.alias("id"), W.answer_confidence(k % 20, k % 6, level).alias("confidence"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)")
def sliding_counts(s, d):
    return W.sliding_counts(T(s, d, "events"), "user_id", "ts", 3600).select("event_id", "recent")


@query("SELECT o_orderpriority AS field, count(*) AS paper_count FROM orders GROUP BY 1")
def field_counts(s, d):
    return corpus.field_counts(T(s, d, "orders").select(F.col("o_orderpriority").alias("field")))


@query("SELECT l_returnflag AS label, l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(s, d):
    return corpus.duplicates(T(s, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("id")))


@query("SELECT coalesce(a.k, b.k) AS id, coalesce(b.name, a.name) AS name, a.bal FROM (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer) b ON a.k = b.k")
def upsert(s, d):
    from graphloom.sources.sinks import upsert as put

    old = T(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return put(old, T(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name")), "id")


@query()
def distinct_clusters(s, d):
    b = brands(s, d)
    names = T(s, d, "part").select(F.col("p_brand").alias("cluster")).distinct().withColumns({"granularity": F.lit("cluster"), "name": F.regexp_replace("cluster", "[0-9]$", "")})
    own = b.select(F.col("brand").alias("cluster"), "paper")
    return W.distinct_clusters(b.select(F.col("brand").alias("cluster")), names, own)


@query()
def lexical_embedding_fnv(s, d):
    ship(s)
    return made_claims(s, d).select("id", V.lexical(384, V.fnv1a)(F.col("text")).alias("vec"))


@query(with_("adj") + " SELECT src AS id, count(*) AS degree FROM adj WHERE src IN (SELECT 'author:' || c_custkey FROM customer) AND type = 'AUTHORED' GROUP BY 1")
def author_degrees(s, d):
    ids = T(s, d, "customer").select(F.concat(F.lit("author:"), F.col("c_custkey").cast("string")).alias("id"))
    return N.degree(P.edges(s, d).where("type = 'AUTHORED'")).join(ids, "id", "left_semi").select("id", "degree")
