"""Queries over the graph: counts, filters, listings, joins, aggregates."""

from __future__ import annotations


from pyspark.sql import functions as F

from graphloom.operators import aggregates as G
from graphloom.operators import graph as N
from graphloom.sources import corpus, sinks
from graphloom.sources import projection as P
from graphloom.plans.registry import query, with_

T = P.table


@query(with_("nodes") + " SELECT label, count(*) AS n FROM nodes GROUP BY label")
def label_counts(s, d):
    return N.label_counts(P.nodes(s, d))


@query(with_("edges") + " SELECT type, count(*) AS n FROM edges GROUP BY type")
def rel_counts(s, d):
    return N.rel_counts(P.edges(s, d))


@query(with_("nodes", "edges") + " SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type")
def graph_counts(s, d):
    a = N.label_counts(P.nodes(s, d)).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    return a.unionByName(N.rel_counts(P.edges(s, d)).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n"))


@query(with_("nodes") + " SELECT year, count(*) AS n FROM nodes WHERE label = 'Paper' AND field = '1-URGENT' GROUP BY year")
def year_counts(s, d):
    return P.nodes(s, d).where("label = 'Paper' and field = '1-URGENT'").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES (1, 1997), (2, 1998)) t(id, year) WHERE false UNION ALL SELECT id, year FROM (SELECT 0 AS id, NULL::INTEGER AS year UNION ALL SELECT o_orderkey::INTEGER, CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 10 = 1 THEN NULL ELSE year(o_orderdate)::INTEGER END FROM orders) WHERE coalesce(nullif(year, 0), 0) >= 1996 AND coalesce(nullif(year, 0), 9999) <= 1998")
def year_filter_nulls(s, d):
    k = F.col("o_orderkey")
    x = T(s, d, "orders").select(k.cast("int").alias("id"), F.when(k % 10 == 0, 0).when(k % 10 == 1, F.lit(None)).otherwise(F.year("o_orderdate")).cast("int").alias("year"))
    return x.where(N.year_between(F.col("year"), 1996, 1998))


@query(with_("nodes") + " SELECT id, name, year FROM nodes WHERE label = 'Paper' AND field = '2-HIGH'")
def field_filter(s, d):
    return P.nodes(s, d).where("label = 'Paper' and field = '2-HIGH'").select("id", "name", "year")


@query(with_("nodes", "adj") + " SELECT id, label, d AS degree FROM nodes JOIN (SELECT src, count(*) AS d FROM adj GROUP BY src) ON src = id WHERE d >= 40")
def min_degree(s, d):
    return N.with_degree(P.nodes(s, d), P.edges(s, d)).where("degree >= 40").select("id", "label", "degree")


@query(with_("nodes", "adj") + " SELECT id, label FROM nodes WHERE id IN (SELECT src FROM adj WHERE type IN ('AFFILIATED_WITH', 'USES_DATASET'))")
def has_relationship(s, d):
    return N.has_relationship(P.nodes(s, d), P.edges(s, d), ["AFFILIATED_WITH", "USES_DATASET"]).select("id", "label")


@query(with_("edges") + " SELECT type, count(*) AS n FROM edges WHERE type IN ('STUDIES', 'AUTHORED') AND CASE WHEN type = 'AUTHORED' THEN NULL ELSE 'tables' END IS NULL GROUP BY type")
def provenance_audit(s, d):
    e = P.edges(s, d).withColumn("provenance", F.when(F.col("type") != "AUTHORED", F.col("provenance")))
    return N.without_provenance(e, ["STUDIES", "AUTHORED"])


@query(with_("nodes") + " SELECT id, label, name, year, field FROM nodes")
def nodes_orders_graph(s, d):
    return P.nodes(s, d)


@query(with_("edges") + " SELECT src, dst, type FROM edges")
def edges_orders_graph(s, d):
    return P.edges(s, d).select("src", "dst", "type")


@query("SELECT src, dst, type, min(pos) AS pos FROM (SELECT 'o' || l_orderkey AS src, 's' || l_suppkey AS dst, l_returnflag AS type, l_linenumber AS pos FROM lineitem) GROUP BY src, dst, type")
def edge_dedupe(s, d):
    e = T(s, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("pos"))
    return G.top_k(e, 1, ["src", "dst", "type"], [F.col("pos")]).select("src", "dst", "type", "pos")


@query("SELECT lower(replace(replace(p_type, ' ', '-'), '#', '-')) AS id, min(p_type) AS name, count(DISTINCT l_orderkey) AS paper_count FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def dictionary_counts(s, d):
    li = T(s, d, "lineitem").join(T(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    papers = li.groupBy(F.col("l_orderkey").cast("string").alias("arxiv_id")).agg(F.collect_set("p_type").alias("types"))
    return corpus.dictionary(papers, "types")


@query("SELECT 'bad-id' AS kind, 'o' || o_orderkey AS id FROM orders WHERE o_orderkey % 1000 = 7 UNION ALL SELECT 'repeated-id', '1000.0' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') FROM orders WHERE o_orderkey % 1000 <> 7 GROUP BY o_custkey % 1000 HAVING count(*) > 1 UNION ALL SELECT 'dangling-citation', 'x' || n_nationkey FROM nation")
def validation_problems(s, d):
    k = F.col("o_orderkey")
    papers = T(s, d, "orders").select(F.when(k % 1000 == 7, F.concat(F.lit("o"), k.cast("string"))).otherwise(F.concat(F.lit("1000.0"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))).alias("arxiv_id"))
    cites = T(s, d, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("target"))
    return corpus.problems(papers, cites)


@query(with_("nodes", "adj") + " SELECT id, name, coalesce(d, 0) AS degree FROM nodes LEFT JOIN (SELECT src, count(*) AS d FROM adj GROUP BY src) ON src = id WHERE label = 'Dataset' ORDER BY coalesce(d, 0) DESC, id LIMIT 20 OFFSET 10")
def list_nodes_page(s, d):
    return N.page(N.with_degree(P.nodes(s, d).where("label = 'Dataset'"), P.edges(s, d)).select("id", "name", "degree"), "degree", offset=10, limit=20)


@query(with_("nodes", "adj") + " SELECT id, label, d AS degree FROM nodes JOIN (SELECT src, count(*) AS d FROM adj GROUP BY src) ON src = id ORDER BY d DESC, id LIMIT 25")
def top_degree(s, d):
    return N.page(N.degree(P.edges(s, d)).join(P.nodes(s, d), "id").select("id", "label", "degree"), "degree", limit=25)


@query(with_("nodes") + " SELECT id, name, round(CASE WHEN lower(name) = 'order 1' THEN 2.0 ELSE 0.0 END + CASE WHEN starts_with(lower(name), 'order 1') THEN 1.0 ELSE 0.0 END + 0.2 * CAST((length(name) - length(replace(lower(name), 'order 1', ''))) / 7 AS INTEGER), 5)::DOUBLE AS score FROM nodes WHERE contains(lower(name), 'order 1') ORDER BY score DESC, id LIMIT 20")
def search_ranked(s, d):
    return N.search(P.nodes(s, d), " Order 1").select("id", "name", "score")


@query(with_("edges") + " SELECT src AS id, dst AS other, type, 'out' AS direction FROM edges WHERE src IN ('author:1', 'paper:1', 'dataset:1') UNION ALL SELECT dst, src, type, 'in' FROM edges WHERE dst IN ('author:1', 'paper:1', 'dataset:1')")
def neighbours(s, d):
    return N.neighbours(P.edges(s, d), s.createDataFrame([("author:1",), ("paper:1",), ("dataset:1",)], "id string"))


@query(with_("nodes", "edges") + """, n AS (SELECT src AS id, dst AS other, type, 'out' AS direction FROM edges UNION ALL SELECT dst, src, type, 'in' FROM edges),
x AS (SELECT n.id, n.type, n.other, nodes.name AS other_name, n.direction, count(*) OVER (PARTITION BY n.id, n.type) AS total, row_number() OVER (PARTITION BY n.id, n.type ORDER BY nodes.name, n.other, n.direction) AS pos FROM n JOIN nodes ON nodes.id = n.other WHERE starts_with(n.id, 'dataset:'))
SELECT id, type, pos, other, other_name, direction, total FROM x WHERE pos <= 5""")
def neighbour_groups(s, d):
    n = P.nodes(s, d)
    return N.neighbour_groups(P.edges(s, d), n, n.where("label = 'Dataset'"), keep=5)


@query(with_("nodes", "edges") + " SELECT e.src, a.name AS src_name, a.label AS src_label, e.dst, b.name AS dst_name, b.label AS dst_label, e.type FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type = 'AFFILIATED_WITH'")
def node_detail(s, d):
    n = P.nodes(s, d).select("id", "name", "label")
    e = P.edges(s, d).where("type = 'AFFILIATED_WITH'").select("src", "dst", "type")
    return e.join(n.toDF("src", "src_name", "src_label"), "src").join(n.toDF("dst", "dst_name", "dst_label"), "dst")


@query(with_("adj") + " SELECT src AS id, dst AS other, 1.0::DOUBLE AS best, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM adj WHERE src IN ('paper:1', 'paper:2', 'paper:3') AND type IN ('STUDIES', 'AUTHORED') GROUP BY src, dst")
def related_entities(s, d):
    return N.related(P.edges(s, d), s.createDataFrame([("paper:1",), ("paper:2",), ("paper:3",)], "id string"), ["STUDIES", "AUTHORED"])


@query(with_("brands") + """, n AS (SELECT brand, count(*) AS c FROM brands GROUP BY brand), x AS (SELECT a.brand AS a, b.brand AS b, count(*) AS shared FROM brands a JOIN brands b ON a.paper = b.paper AND a.brand < b.brand GROUP BY 1, 2)
SELECT x.a, x.b, x.shared, round(x.shared / (na.c + nb.c - x.shared)::DOUBLE, 6) AS jaccard FROM x JOIN n na ON na.brand = x.a JOIN n nb ON nb.brand = x.b""")
def cooccurrence_jaccard(s, d):
    return N.cooccurrence(brands(s, d), "paper", "brand")


def brands(s, d):
    li = T(s, d, "lineitem").select("l_orderkey", "l_partkey").join(T(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return li.select(F.col("l_orderkey").alias("paper"), F.col("p_brand").alias("brand")).distinct()


@query(with_("brands") + " SELECT paper, count(*) FILTER (brand IN ('Brand#11', 'Brand#12')) AS n_a, count(*) FILTER (brand IN ('Brand#21', 'Brand#22')) AS n_b FROM brands GROUP BY paper HAVING n_a > 0 AND n_b > 0")
def bridge_entities(s, d):
    a, b = (s.createDataFrame([(x,) for x in v], "id string") for v in (["Brand#11", "Brand#12"], ["Brand#21", "Brand#22"]))
    return N.bridges(brands(s, d), "paper", "brand", a, b)


@query(with_("edges") + ", ids AS (SELECT 'author:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'paper:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)")
def induced_edges(s, d):
    return N.induced(P.edges(s, d).select("src", "dst", "type"), some_ids(s, d))


def some_ids(s, d):
    a = T(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("author:"), F.col("c_custkey").cast("string")).alias("id"))
    return a.unionByName(T(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("paper:"), F.col("o_orderkey").cast("string")).alias("id")))


@query(with_("adj") + ", ids AS (SELECT 'author:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'paper:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT DISTINCT dst AS id FROM adj WHERE src IN (SELECT id FROM ids) AND dst NOT IN (SELECT id FROM ids)")
def frontier(s, d):
    return N.frontier(P.edges(s, d), some_ids(s, d))


@query(with_("edges") + " SELECT src, dst, type FROM edges WHERE starts_with(src, 'author:') AND dst = 'institution:3'")
def cross_edges(s, d):
    n = P.nodes(s, d)
    return N.cross_edges(P.edges(s, d).select("src", "dst", "type"), n.where("id = 'institution:3'"), n.where("label = 'Author'"))


@query("SELECT a.c_nationkey AS a, b.c_nationkey AS b, count(DISTINCT a.o_orderpriority) AS shared FROM (SELECT DISTINCT c_nationkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 250000) a JOIN (SELECT DISTINCT c_nationkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 250000) b ON a.o_orderpriority = b.o_orderpriority AND a.c_nationkey < b.c_nationkey GROUP BY 1, 2")
def cross_group_shared(s, d):
    x = T(s, d, "orders").where("o_totalprice > 250000").join(T(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("g"), F.col("o_orderpriority").alias("p")).distinct()
    return N.cooccurrence(x, "p", "g").select("a", "b", "shared")


@query("SELECT c_custkey AS id, c_name AS name, o_orderkey AS other FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
def optional_neighbourhood(s, d):
    c = T(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    o = T(s, d, "orders").select((-F.col("o_custkey") - 1).alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderpriority").alias("type"))
    # customers as negative ids, so that an order of the same number is another node
    x = N.optional_neighbours(c.withColumn("id", -F.col("id") - 1), o, ["1-URGENT"])
    return x.select((-F.col("id") - 1).alias("id"), "name", "other")


def related(s, d):
    return P.related_parts(s, d)


@query(with_("related") + " SELECT a, b FROM (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey + 1 <= (SELECT max(p_partkey) FROM part)) WHERE NOT EXISTS (SELECT 1 FROM related WHERE src = a AND dst = b)")
def unrelated_pairs(s, d):
    p = T(s, d, "part")
    most = p.agg(F.max("p_partkey").alias("m"))
    x = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")).join(F.broadcast(most), F.col("b") <= F.col("m")).select("a", "b")
    return N.unrelated(x, related(s, d))


@query(with_("near") + " SELECT DISTINCT x.dst AS a, y.dst AS b FROM near x JOIN near y ON x.src = y.src AND x.dst < y.dst WHERE NOT EXISTS (SELECT 1 FROM near z WHERE z.src = x.dst AND z.dst = y.dst)")
def two_hop_pairs(s, d):
    return N.two_hop(related(s, d))


@query("SELECT year(o_orderdate)::INTEGER AS year, p_brand AS topic, count(*) AS edges FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand IN (SELECT p_brand FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 12) GROUP BY 1, 2")
def timeline_edges(s, d):
    own = T(s, d, "part").select(F.col("p_partkey").alias("topic"), F.col("p_brand").alias("brand"))
    return G.timeline(P.studies(s, d).join(own, "topic").select("paper", F.col("brand").alias("topic")), paper_years(s, d))


@query("SELECT year(o_orderdate)::INTEGER AS year, count(DISTINCT o_orderkey) AS papers, count(*) AS edges FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def timeline_entities(s, d):
    return G.timeline_entities(P.studies(s, d), paper_years(s, d))


def paper_years(s, d):
    return T(s, d, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"))


@query("SELECT o_orderpriority AS field, count(DISTINCT o_orderkey) AS papers, count(DISTINCT o_custkey) AS authors, count(DISTINCT l_suppkey) AS datasets, count(DISTINCT c_nationkey) AS institutions FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def explorer_counts(s, d):
    x = T(s, d, "orders").join(T(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(T(s, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return G.distinct_counts(x.withColumnRenamed("o_orderpriority", "field"), "field", papers="o_orderkey", authors="o_custkey", datasets="l_suppkey", institutions="c_nationkey")


@query("SELECT c_mktsegment AS field, count(*) AS papers, min(year(o_orderdate))::INTEGER AS first, max(year(o_orderdate))::INTEGER AS last, count(*) FILTER (year(o_orderdate) >= 1999) AS recent, round(count(*) FILTER (year(o_orderdate) >= 1999) / count(*)::DOUBLE, 3) AS share FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def recency(s, d):
    x = T(s, d, "orders").join(T(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("field"), F.year("o_orderdate").alias("y"))
    return G.recency(x, "field", "y", 1999)


@query("SELECT topic, recent, older, round(recent / greatest(1, older)::DOUBLE, 6) AS growth FROM (SELECT l_partkey AS topic, count(*) FILTER (year(o_orderdate) >= 1999) AS recent, count(*) FILTER (year(o_orderdate) < 1999) AS older FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) WHERE recent >= 2 ORDER BY growth DESC, recent DESC, topic LIMIT 10")
def emerging(s, d):
    x = P.studies(s, d).join(T(s, d, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year")), "paper")
    return G.emerging(x, "topic", "year", 1999)


@query(with_("related") + " SELECT id, count(*) AS degree, sum(shared)::DOUBLE AS weighted FROM (SELECT src AS id, shared FROM related UNION ALL SELECT dst, shared FROM related) GROUP BY id")
def degree_weighted(s, d):
    return N.degree(related(s, d).select("src", "dst", F.col("shared").cast("double").alias("weight")))


@query("""WITH p AS (SELECT o_orderkey, o_custkey, c_nationkey, year(o_orderdate)::INTEGER AS y, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey),
t AS (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM p)
SELECT p.c_nationkey AS community, count(*) AS papers, min(y) AS first, max(y) AS last, round(avg(o_totalprice), 2) AS mean, any_value(top) AS top FROM p JOIN (SELECT c_nationkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY r) AS top FROM t WHERE r <= 6 GROUP BY 1) q ON q.c_nationkey = p.c_nationkey GROUP BY 1 HAVING count(*) >= 2""")
def group_profiles(s, d):
    p = T(s, d, "orders").join(T(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_nationkey").alias("community"), F.year("o_orderdate").alias("y"), "o_totalprice")
    top = G.top_k(p, 6, ["community"], [F.desc("o_totalprice"), F.col("o_orderkey")]).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("o_orderkey").cast("string").alias("k")))).alias("l"))
    a = p.groupBy("community").agg(F.count(F.lit(1)).alias("papers"), F.min("y").alias("first"), F.max("y").alias("last"), F.round(F.avg("o_totalprice"), 2).alias("mean")).where("papers >= 2")
    return a.join(top.select("community", F.array_join(F.transform("l", lambda x: x["k"]), ",").alias("top")), "community")


@query(with_("trade") + " SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(n)::DOUBLE AS weight FROM trade WHERE src <> dst GROUP BY 1, 2")
def max_merge(s, d):
    return G.max_merge(P.trade(s, d).select("src", "dst", F.col("n").cast("double").alias("weight")))


def regions(s, d):
    return T(s, d, "nation").join(T(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("cluster"), F.col("n_name").alias("id"))


PAIRS = ", pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(n)::DOUBLE AS weight FROM trade WHERE src <> dst GROUP BY 1, 2), m AS (SELECT r_name AS cluster, n_name AS id FROM nation JOIN region ON r_regionkey = n_regionkey)"


@query(with_("trade") + PAIRS + " SELECT cluster, n, coalesce(w / (n * (n - 1) / 2.0), 0)::DOUBLE AS density FROM (SELECT cluster, count(*) AS n FROM m GROUP BY 1) LEFT JOIN (SELECT x.cluster, sum(weight) AS w FROM pairs JOIN m x ON x.id = a JOIN m y ON y.id = b AND y.cluster = x.cluster GROUP BY 1) USING (cluster)")
def internal_density(s, d):
    return G.density(regions(s, d), max_merge(s, d))


@query("""WITH c AS (SELECT c_mktsegment AS g, n_name AS v, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), p AS (SELECT g, v, n / sum(n) OVER (PARTITION BY g)::DOUBLE AS p FROM c)
SELECT x.g AS a, y.g AS b, round(1 - sum(least(x.p, y.p)), 6) AS separation FROM p x JOIN p y ON x.v = y.v AND x.g < y.g GROUP BY 1, 2""")
def distribution_overlap(s, d):
    c = T(s, d, "customer").join(T(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("c_mktsegment").alias("g"), F.col("n_name").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return G.distribution_overlap(c, "g", "v")


@query("SELECT event_type, n, value FROM (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r FROM events WHERE value IS NOT NULL) WHERE r = least(floor(0.9 * n), n - 1)")
def order_statistic_p90(s, d):
    return G.order_statistic(T(s, d, "events"), "value", 0.9, "event_type")


@query("SELECT event_type, n, value FROM (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r FROM events WHERE value IS NOT NULL) WHERE r = floor(0.5 * n)")
def upper_median(s, d):
    return G.order_statistic(T(s, d, "events"), "value", 0.5, "event_type")


@query("SELECT key, round((v - lo) / (hi - lo), 6) AS scaled FROM (SELECT c_custkey AS key, c_acctbal AS v, min(c_acctbal) OVER () AS lo, max(c_acctbal) OVER () AS hi FROM customer)")
def minmax(s, d):
    return G.minmax(T(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal"), "key", "c_acctbal")


@query("SELECT c_nationkey AS nation, count(*) AS n, round(2 * sum(i * k) / (count(*) * sum(k))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM (SELECT c_nationkey, k, row_number() OVER (PARTITION BY c_nationkey ORDER BY k) AS i FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey) GROUP BY 1")
def gini(s, d):
    k = T(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k")).join(T(s, d, "customer"), "c_custkey").select(F.col("c_nationkey").alias("nation"), "k")
    return G.gini(k, "k", "nation")


@query(with_("near") + " SELECT src AS id, count(DISTINCT p_brand) AS reach FROM near JOIN part ON p_partkey = dst GROUP BY 1")
def bridging_reach(s, d):
    from graphloom.operators.algorithms import bridging

    return bridging(related(s, d), T(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community")))


@query("SELECT cluster, topic, local, total FROM (SELECT c_mktsegment AS cluster, o_orderpriority AS topic, count(*) AS local FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) JOIN (SELECT o_orderpriority AS topic, count(*) AS total FROM orders GROUP BY 1) USING (topic) WHERE local >= 3")
def topic_support(s, d):
    o = T(s, d, "orders")
    return G.topic_support(o.join(T(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")), "c_mktsegment", "o_orderpriority", o)


@query("SELECT c_nationkey AS community, count(*) AS members, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END)::BIGINT AS builders, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS owing FROM customer GROUP BY 1")
def community_sizes(s, d):
    return G.conditional_counts(T(s, d, "customer").withColumnRenamed("c_nationkey", "community"), "community", "members", builders=F.col("c_mktsegment") == "BUILDING", owing=F.col("c_acctbal") < 0)


@query("SELECT p_brand AS topic, count(DISTINCT l_orderkey) AS papers FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 50")
def topic_papers(s, d):
    return G.topic_papers(brands(s, d).withColumnRenamed("brand", "topic"), 50)


@query("SELECT c_nationkey AS cluster, arg_max(c_name, struct_pack(b := c_acctbal, k := c_custkey)) AS anchor FROM customer GROUP BY 1")
def anchor_by_group(s, d):
    return G.anchors(T(s, d, "customer").withColumnRenamed("c_nationkey", "cluster"), "cluster", "c_name", "c_acctbal", "c_custkey")


@query("SELECT c_nationkey AS nation, c_custkey AS id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def topk_per_group(s, d):
    return G.top_k(T(s, d, "customer"), 3, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")]).select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), "rank")


@query("SELECT c_mktsegment AS seg, c_custkey AS id, round((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey) - 1) / greatest(1, count(*) OVER (PARTITION BY c_mktsegment) - 1)::DOUBLE, 6) AS position FROM customer")
def percentile_position(s, d):
    return G.percentile_position(T(s, d, "customer").withColumnsRenamed({"c_mktsegment": "seg", "c_custkey": "id"}), "c_nationkey", "id", "seg")


@query("SELECT o_custkey AS id, min(o_orderkey) AS first FROM (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1) GROUP BY 1")
def first_per_key(s, d):
    return G.top_k(T(s, d, "orders"), 1, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first"))


@query("SELECT key, bucket, row_number() OVER (ORDER BY bucket DESC, rel DESC, key) AS rank FROM (SELECT s_suppkey AS key, round_even(s_acctbal / 2.5, 0)::DOUBLE AS bucket, s_nationkey AS rel FROM supplier)")
def score_bucket_rank(s, d):
    x = T(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("score"), F.col("s_nationkey").alias("rel"))
    return G.bucket_rank(x, "score", "rel", "key").select("key", "bucket", "rank")


def _two(s, d):
    c = T(s, d, "customer")
    return c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("id")), c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_nationkey").alias("id"))


@query("SELECT c_nationkey AS id FROM customer WHERE c_acctbal > 5000 UNION SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def set_union(s, d):
    a, b = _two(s, d)
    return a.union(b).distinct()


@query("SELECT c_nationkey AS id FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def set_intersect(s, d):
    a, b = _two(s, d)
    return a.intersect(b)


@query("SELECT o_custkey AS id FROM orders WHERE o_totalprice > 200000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except(s, d):
    o = T(s, d, "orders")
    return o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")).subtract(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")))


@query("SELECT a.brand AS a, b.brand AS b FROM (SELECT p_brand AS brand, list_sort(list(DISTINCT p_size)) AS v FROM part GROUP BY 1) a JOIN (SELECT p_brand AS brand, list_sort(list(DISTINCT p_size)) AS v FROM part GROUP BY 1) b ON a.brand <> b.brand WHERE len(list_filter(a.v, lambda x: NOT list_contains(b.v, x))) = 0")
def subset_pairs(s, d):
    x = T(s, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set("p_size").alias("v"))
    return x.toDF("a", "va").join(x.toDF("b", "vb"), (F.col("a") != F.col("b")) & (F.size(F.array_except("va", "vb")) == 0)).select("a", "b")


@query("SELECT event_type, list_aggregate(list_sort(list(k)), 'string_agg', ',') AS histogram FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') || '=' || count(*) AS k FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d')) GROUP BY 1")
def histogram_map(s, d):
    return G.histogram(T(s, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "event_type", "day")


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS missing FROM events GROUP BY 1")
def json_props(s, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return T(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("missing"))


@query(with_("nodes", "adj") + ", top AS (SELECT id, label, name, d FROM nodes JOIN (SELECT src, count(*) AS d FROM adj GROUP BY src) ON src = id ORDER BY d DESC, id LIMIT 60) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)")
def export_top_edges(s, d):
    n = N.degree(P.edges(s, d)).join(P.nodes(s, d), "id")
    return sinks.top_subgraph(n, P.edges(s, d), "degree", 60)[1].select("src", "dst", "type")


@query(with_("nodes", "edges") + """ SELECT 0 AS part, '' AS id, '""" + sinks.graphml_head() + """' AS line UNION ALL SELECT 3, '', '</graph></graphml>' UNION ALL SELECT 1, id, '<node id="' || id || '"><data key="node_label">' || label || '</data><data key="node_name">' || name || '</data><data key="node_year">0</data><data key="node_pagerank">0.0</data><data key="node_betweenness">0.0</data><data key="node_degree">0</data><data key="node_community">-1</data></node>' FROM nodes WHERE label IN ('Author', 'Institution')
UNION ALL SELECT 2, src || '|' || type || '|' || dst, '<edge id="' || src || '|' || type || '|' || dst || '" source="' || src || '" target="' || dst || '"><data key="edge_label">' || type || '</data><data key="edge_weight">1.0</data><data key="edge_provenance">tables</data><data key="edge_predicted">false</data></edge>' FROM edges WHERE type = 'AFFILIATED_WITH'""")
def export_graphml_rows(s, d):
    n = P.nodes(s, d).where("label in ('Author', 'Institution')")
    return sinks.graphml_rows(n, N.induced(P.edges(s, d), n.select("id")))


@query(with_("nodes", "edges") + " SELECT 1 AS part, id, 'MERGE (n:' || label || ' {id: ''' || id || '''}) SET n.name = ''' || name || ''';' AS line FROM nodes WHERE label IN ('Author', 'Institution') UNION ALL SELECT 2, src || '|' || type || '|' || dst, 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) MERGE (a)-[r:' || type || ']->(b) SET r.weight = 1.0;' FROM edges WHERE type = 'AFFILIATED_WITH'")
def export_cypher_rows(s, d):
    n = P.nodes(s, d).where("label in ('Author', 'Institution')")
    return sinks.cypher_rows(n, N.induced(P.edges(s, d), n.select("id")))


@query(with_("nodes", "edges") + " SELECT e.src AS source, a.label AS source_type, e.dst AS target, b.label AS target_type, e.type AS relationship FROM edges e LEFT JOIN nodes a ON a.id = e.src LEFT JOIN nodes b ON b.id = e.dst WHERE e.type = 'AFFILIATED_WITH'")
def export_csv_edges(s, d):
    n = P.nodes(s, d).where("label in ('Author', 'Institution')")
    return sinks.csv_frames(n, N.induced(P.edges(s, d), n.select("id")))[1].select("source", "source_type", "target", "target_type", "relationship")


@query(with_("nodes") + """ SELECT 'node' AS kind, id, '{"id":"' || id || '","label":"' || label || '","name":"' || name || '"}' AS json FROM nodes WHERE label = 'Dataset'""")
def export_json_rows(s, d):
    n = P.nodes(s, d).where("label = 'Dataset'")
    return sinks.json_rows(n, N.induced(P.edges(s, d), n.select("id")))


@query("SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2")
def calls_per_minute(s, d):
    from graphloom.streaming.limiter import per_minute

    return per_minute(T(s, d, "events"), "user_id", "ts")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
r(event_id, event_type, i, held, admitted) AS (SELECT event_id, event_type, i, [t], true FROM e WHERE i = 1 UNION ALL SELECT event_id, event_type, i, CASE WHEN len(held) < 3 THEN list_append(held, t) ELSE held END, len(held) < 3 FROM (SELECT e.*, list_filter(r.held, lambda x: x > e.t - 3600000000) AS held FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1))
SELECT event_id, event_type, admitted FROM r""")
def rate_limiter(s, d):
    from graphloom.streaming.limiter import admit

    return admit(T(s, d, "events"), "event_type", "ts", "event_id", limit=3, seconds=3600)


