"""Queries that run graph algorithms, opportunity scoring and the DSL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import algorithms as A
from graphloom.operators import gaps as O
from graphloom.operators import graph as N
from graphloom.operators import paths as H
from graphloom.plans import dsl as D
from graphloom.plans.catalog_graph import brands, related
from graphloom.plans.registry import CTES, SQL, query, with_
from graphloom.plans.research import NOTICE
from graphloom.sources import projection as P
from graphloom.sources.working import keep

T = P.table


def parts_graph(s, d):
    """Parts that share two orders, as string ids."""
    r = related(s, d)
    return r.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("RELATED_TO").alias("type"), F.lit(1.0).alias("weight"))


LP = with_("near") + """, deg AS (SELECT src, count(*) AS d FROM near GROUP BY 1), x AS (SELECT a.dst AS a, b.dst AS b, count(*) AS common, sum(1 / ln(d + 2)) AS aa FROM near a JOIN near b ON a.src = b.src AND a.dst < b.dst JOIN deg ON deg.src = a.src GROUP BY 1, 2)
SELECT a, b, common, round(common / (x1.d + x2.d - common)::DOUBLE, 6) AS jaccard, round(aa, 6) AS adamic_adar FROM x JOIN deg x1 ON x1.src = a JOIN deg x2 ON x2.src = b WHERE NOT EXISTS (SELECT 1 FROM near z WHERE z.src = a AND z.dst = b)"""


@query(LP)
def link_prediction(s, d):
    return A.link_prediction(related(s, d))


@query(with_("near", recursive=True) + ", walk(id, depth) AS (SELECT (SELECT min(src) FROM near), 0 UNION SELECT near.dst, depth + 1 FROM walk JOIN near ON near.src = walk.id WHERE depth < 3) SELECT id::VARCHAR AS id, min(depth)::INTEGER AS depth FROM walk GROUP BY 1")
def bfs_distances(s, d):
    e = parts_graph(s, d)
    start = related(s, d).agg(F.min("src").cast("string").alias("id"))
    return H.distances(e, start, 3)


def nations(s, d):
    return T(s, d, "nation").select(F.col("n_name").alias("id"), F.lit("Institution").alias("label"), F.col("n_name").alias("name"), F.lit(None).cast("int").alias("year"))


def trade_graph(s, d):
    """The trade between nations: each cell of the table but the loops is an edge."""
    return P.trade(s, d).where("src <> dst").select("src", "dst", F.lit("STUDIES").alias("type"), F.col("n").cast("double").alias("weight"), F.lit(False).alias("predicted"))


def places(s, d):
    """(nodes, edges) of suppliers in their nations, and nations in their regions."""
    t = lambda n: T(s, d, n)
    r, n, p = (F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in (("region", "n_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey")))
    up = t("nation").select(n.alias("src"), r.alias("dst")).unionByName(t("supplier").select(p.alias("src"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("dst")))
    own = t("region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id")).unionByName(t("nation").select(n.alias("id"))).unionByName(t("supplier").select(p.alias("id")))
    return own, up.withColumn("weight", F.lit(1.0))


PLACES = """up AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier), e AS (SELECT src, dst FROM up UNION SELECT dst, src FROM up),
ids AS (SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier)"""


def first_author(s, d) -> str:
    return T(s, d, "customer").agg(F.min(F.concat(F.lit("author:"), F.col("c_custkey").cast("string")))).first()[0]


def _sql_paths(most: int) -> str:
    """Level by level over the whole graph: a node keeps its least path."""
    out = with_("adj") + ", one AS (SELECT DISTINCT src, dst FROM adj WHERE src <> dst), p0 AS (SELECT min('author:' || c_custkey) AS id, 0 AS hops, [min('author:' || c_custkey)] AS path FROM customer)"
    for k in range(1, most + 1):
        out += f", p{k} AS MATERIALIZED (SELECT * FROM p{k - 1} UNION ALL SELECT dst, {k}, min(list_append(path, dst)) FROM p{k - 1} JOIN one ON src = id WHERE hops = {k - 1} AND dst NOT IN (SELECT id FROM p{k - 1}) GROUP BY dst)"
    return out


@query(_sql_paths(6) + " SELECT id, hops::INTEGER AS hops, array_to_string(path, '>') AS path FROM p6 WHERE starts_with(id, 'institution:')")
def shortest_path(s, d):
    targets = P.nodes(s, d).where("label = 'Institution'")
    return H.shortest_paths(P.edges(s, d), first_author(s, d), targets, 6).select("id", "hops", F.array_join("path", ">").alias("path"))


@query(_sql_paths(6) + " SELECT id, hops::INTEGER AS hops FROM p6")
def shortest_hops(s, d):
    return H.shortest_paths(P.edges(s, d), first_author(s, d), P.nodes(s, d), 6).select("id", "hops")


@query(SQL["shortest_hops"], name="shortest_hops_distributed")
def shortest_hops_distributed(s, d):
    return H.shortest_paths(P.edges(s, d), first_author(s, d), P.nodes(s, d), 6, local_edges=0).select("id", "hops")


@query(_sql_paths(4) + " SELECT id, hops::INTEGER AS hops, array_to_string(path, '>') AS path FROM p4 WHERE id = (SELECT max('topic:' || p_partkey) FROM part)")
def evidence_path(s, d):
    last = T(s, d, "part").agg(F.max(F.concat(F.lit("topic:"), F.col("p_partkey").cast("string")))).first()[0]
    return H.evidence_path(P.edges(s, d), first_author(s, d), last, 4).select("id", "hops", F.array_join("path", ">").alias("path"))


def _sql_weighted(rounds: int) -> str:
    out = with_("related") + ", e AS (SELECT src, dst, min(len) AS len FROM (SELECT src, dst, 1 / shared::DOUBLE AS len FROM related UNION ALL SELECT dst, src, 1 / shared::DOUBLE FROM related) GROUP BY 1, 2), d0 AS (SELECT min(src) AS id, 0::DOUBLE AS d FROM related)"
    for k in range(1, rounds + 1):
        out += f", d{k} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT * FROM d{k - 1} UNION ALL SELECT e.dst, d + len FROM d{k - 1} JOIN e ON e.src = id) GROUP BY 1)"
    return out + f" SELECT id::VARCHAR AS id, round(d, 6) AS distance FROM d{rounds}"


@query(_sql_weighted(40))
def weighted_distances(s, d):
    e = related(s, d)
    start = e.agg(F.min("src").cast("string")).first()[0]
    w = e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("shared").cast("double").alias("weight"))
    return H.weighted_distances(w, start).select("id", F.round("distance", 6).alias("distance")) if start else w.select(F.col("src").alias("id"), F.col("weight").alias("distance")).limit(0)


@query(with_("near", recursive=True) + ", walk(id, depth) AS (SELECT (SELECT min(src) FROM near), 0 UNION SELECT near.dst, depth + 1 FROM walk JOIN near ON near.src = walk.id WHERE depth < 3) SELECT id::VARCHAR AS id, min(depth)::INTEGER AS depth FROM walk GROUP BY 1")
def bfs_distributed(s, d):
    return H.distances(parts_graph(s, d), related(s, d).agg(F.min("src").cast("string").alias("id")), 3, local_edges=0)


@query(with_("related", recursive=True) + """, near AS (SELECT src, dst FROM related WHERE shared >= 3 UNION SELECT dst, src FROM related WHERE shared >= 3), walk(id, root) AS (SELECT src, src FROM near UNION SELECT near.dst, root FROM walk JOIN near ON near.src = walk.id)
SELECT p_partkey::VARCHAR AS id, coalesce(c, p_partkey)::VARCHAR AS component FROM part LEFT JOIN (SELECT id, min(root) AS c FROM walk GROUP BY 1) ON id = p_partkey""")
def components(s, d):
    n = T(s, d, "part").select(F.col("p_partkey").alias("id"))
    return H.components(n, related(s, d).where("shared >= 3")).select(F.col("id").cast("string").alias("id"), F.col("component").cast("string").alias("component"))


@query(SQL["components"])
def components_distributed(s, d):
    n = T(s, d, "part").select(F.col("p_partkey").alias("id"))
    return H.components(n, related(s, d).where("shared >= 3"), local_edges=0).select(F.col("id").cast("string").alias("id"), F.col("component").cast("string").alias("component"))


@query(with_("near", recursive=True) + ", walk(id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey IN (1, 2, 3) UNION SELECT near.dst, depth + 1 FROM walk JOIN near ON near.src = walk.id WHERE depth < 2) SELECT id::VARCHAR AS id, min(depth)::INTEGER AS depth FROM walk GROUP BY 1 ORDER BY 2, 1 LIMIT 50")
def subgraph_depth(s, d):
    n = T(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("Topic").alias("label"), F.col("p_name").alias("name"), F.lit(None).cast("int").alias("year"))
    return H.subgraph(n, parts_graph(s, d), n.where("id in ('1', '2', '3')"), depth=1, max_nodes=50)["nodes"].select("id", "depth")


@query(with_("near") + " SELECT DISTINCT dst::VARCHAR AS id FROM near WHERE src IN (1, 2, 3) AND dst NOT IN (1, 2, 3)")
def expand_one_hop(s, d):
    return N.frontier(parts_graph(s, d), s.createDataFrame([("1",), ("2",), ("3",)], "id string"))


@query(with_("near", recursive=True) + ", walk(id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey IN (1, 2, 3) UNION SELECT near.dst, depth + 1 FROM walk JOIN near ON near.src = walk.id WHERE depth < 1) SELECT id::VARCHAR AS id, min(depth)::INTEGER AS depth FROM walk GROUP BY 1 ORDER BY 2, 1 LIMIT 90")
def retrieval_expand(s, d):
    return H.retrieval_expand(parts_graph(s, d), s.createDataFrame([("1",), ("2",), ("3",)], "id string"))


def _sql_pagerank(rounds: int) -> str:
    out = with_("trade") + ", w AS (SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT src, dst, n AS w FROM trade WHERE src <> dst UNION ALL SELECT dst, src, n FROM trade WHERE src <> dst) GROUP BY 1, 2), sh AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w), n AS (SELECT count(*) AS n FROM nation), r0 AS (SELECT n_name AS id, 1.0 / n AS r FROM nation, n)"
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        out += f", r{k} AS (SELECT {p}.id, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r), 0) FROM {p} WHERE id NOT IN (SELECT src FROM sh)) / n) AS r FROM {p} CROSS JOIN n LEFT JOIN (SELECT dst, sum(r * p) AS got FROM sh JOIN {p} ON {p}.id = sh.src GROUP BY 1) g ON g.dst = {p}.id)"
    return out + f" SELECT id, round(r, 6) AS pagerank FROM r{rounds}"


@query(_sql_pagerank(10))
def pagerank_10(s, d):
    e = P.trade(s, d).select("src", "dst", F.col("n").cast("double").alias("weight"))
    return A.pagerank(nations(s, d), e, rounds=10, tolerance=0).select("id", F.round("pagerank", 6).alias("pagerank"))


@query(SQL["pagerank_10"])
def pagerank_distributed(s, d):
    e = P.trade(s, d).select("src", "dst", F.col("n").cast("double").alias("weight"))
    return A.pagerank(nations(s, d), e, rounds=10, tolerance=0, local_edges=0).select("id", F.round("pagerank", 6).alias("pagerank"))


@query()
def pagerank_parts(s, d):
    n = T(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return A.pagerank(n, parts_graph(s, d), rounds=20, tolerance=1e-6)


BETWEEN = "WITH RECURSIVE " + PLACES + """, walk(s, id, path) AS (SELECT id, id, [id] FROM ids UNION ALL SELECT s, e.dst, list_append(path, e.dst) FROM walk JOIN e ON e.src = walk.id WHERE NOT list_contains(path, e.dst)),
best AS (SELECT s, id, min(len(path)) AS k FROM walk WHERE s <> id GROUP BY 1, 2), sp AS (SELECT w.s, w.id, w.path FROM walk w JOIN best b ON b.s = w.s AND b.id = w.id AND b.k = len(w.path)), cnt AS (SELECT s, id, count(*) AS c FROM sp GROUP BY 1, 2),
mid AS (SELECT v, sum(1.0 / c) AS t FROM (SELECT s, id, unnest(path[2:-2]) AS v FROM sp) JOIN cnt USING (s, id) GROUP BY 1), bt AS (SELECT id, round(coalesce(t, 0) / ((SELECT count(*) FROM ids) - 1) / ((SELECT count(*) FROM ids) - 2), 6)::DOUBLE AS betweenness FROM ids LEFT JOIN mid ON v = ids.id)"""


@query(BETWEEN + " SELECT * FROM bt")
def betweenness_nations(s, d):
    return A.betweenness(*places(s, d), weighted=False)


@query(BETWEEN + """, rc AS (SELECT src AS id, count(DISTINCT split_part(dst, ':', 1)) AS reach FROM e GROUP BY 1), x AS (SELECT bt.id, betweenness, least(1.0, coalesce(reach, 0) / greatest(1.0, greatest(1, (SELECT count(*) FROM ids) - 1) / 8.0))::DOUBLE AS c FROM bt LEFT JOIN rc USING (id))
SELECT id, betweenness, round(c, 6) AS cross_community, round(0.6 * betweenness + 0.4 * c, 6) AS bridge_score FROM x""")
def bridging_scores(s, d):
    n, e = places(s, d)
    return A.bridging_scores(n, e, A.betweenness(n, e, weighted=False), n.select("id", F.substring_index("id", ":", 1).alias("community")))


@query(LP + " ORDER BY adamic_adar DESC, jaccard DESC, a, b LIMIT 400")
def structural_similarity(s, d):
    n = T(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Topic").alias("label"))
    return A.structural_similarity(n, related(s, d).withColumn("type", F.lit("RELATED_TO")), labels=["Topic"])


@query()
def betweenness_sampled(s, d):
    e = parts_graph(s, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return A.betweenness(n, e, weighted=True, samples=64)


@query()
def louvain(s, d):
    n = T(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return A.louvain(n, parts_graph(s, d))


@query("SELECT count(*) AS nodes, true AS as_good FROM part")
def louvain_distributed(s, d):
    """Whether the distributed form's communities reach 95 % of the modularity of those that move one node at a time."""
    n, e = T(s, d, "part").select(F.col("p_partkey").cast("string").alias("id")), keep(parts_graph(s, d), "graph")
    made = A.louvain_distributed(n, e)
    score = [A.modularity(e, x).select(F.col("modularity").alias(k)) for k, x in (("many", made), ("one", A.louvain(n, e)))]
    both = score[0].join(F.broadcast(score[1])).join(F.broadcast(made.agg(F.count(F.lit(1)).alias("nodes"))))  # one row each
    return both.select("nodes", (F.col("many") >= 0.95 * F.col("one")).alias("as_good"))


@query(with_("related") + " SELECT round(sum(coalesce(i, 0) / m - power(t / (2 * m), 2)), 6) AS modularity FROM (SELECT c, sum(w)::DOUBLE AS t FROM (SELECT x.p_brand AS c, 1 AS w FROM related JOIN part x ON x.p_partkey = src UNION ALL SELECT y.p_brand, 1 FROM related JOIN part y ON y.p_partkey = dst) GROUP BY c) LEFT JOIN (SELECT x.p_brand AS c, count(*)::DOUBLE AS i FROM related JOIN part x ON x.p_partkey = src JOIN part y ON y.p_partkey = dst AND y.p_brand = x.p_brand GROUP BY 1) USING (c), (SELECT count(*)::DOUBLE AS m FROM related)")
def modularity_brands(s, d):
    labels = T(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("community"))
    return A.modularity(parts_graph(s, d), labels)


# Opportunity scoring over fixed clusters of brands: the brand's number over two.
def gap_frames(s, d):
    p = T(s, d, "part").select("p_brand").distinct()
    members = p.select((F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") / 2).cast("int").cast("string").alias("cluster"), F.col("p_brand").alias("topic"))
    studies = brands(s, d).withColumnRenamed("brand", "topic")
    deg = studies.groupBy("paper").agg(F.count(F.lit(1)).cast("double").alias("k"))
    o = T(s, d, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("community"), F.col("o_totalprice").alias("pagerank"))
    papers = o.join(deg, "paper").select("paper", "year", "community", "pagerank", F.col("k").alias("betweenness"))
    co = N.cooccurrence(brands(s, d), "paper", "brand", least=1)
    links = co.select("a", "b", F.col("jaccard").alias("weight"))
    return members, studies, papers, links


def gap_vectors(s, d):
    """A vector for each brand: mean of the embeddings of one label, by the brand's number modulo five."""
    from graphloom.operators.vectors import centroids

    v = P.vectors(s, d)
    c = centroids(v.select("id", "vec"), v.select("cluster", "id"))
    p = T(s, d, "part").select("p_brand").distinct()
    return p.join(c, F.col("cluster") == F.pmod(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int"), F.lit(5))).select(F.col("p_brand").alias("id"), "vec")


GAP = with_("brands") + """, members AS (SELECT DISTINCT ((regexp_extract(p_brand, '[0-9]+')::INTEGER // 2)::INTEGER)::VARCHAR AS cluster, p_brand AS topic FROM part), own AS (SELECT DISTINCT cluster, paper FROM brands JOIN members ON topic = brand),
pr AS (SELECT x.cluster AS a, y.cluster AS b FROM (SELECT DISTINCT cluster FROM members) x JOIN (SELECT DISTINCT cluster FROM members) y ON x.cluster < y.cluster)"""


@query(GAP + """, n AS (SELECT cluster, count(*) AS n FROM own GROUP BY 1), sh AS (SELECT x.cluster AS a, y.cluster AS b, count(*) AS shared FROM own x JOIN own y ON x.paper = y.paper AND x.cluster < y.cluster GROUP BY 1, 2)
SELECT pr.a, pr.b, CASE WHEN coalesce(shared, 0) / least(na.n, nb.n)::DOUBLE >= 0.35 THEN 'entangled papers' END AS reason FROM pr JOIN n na ON na.cluster = pr.a JOIN n nb ON nb.cluster = pr.b LEFT JOIN sh ON sh.a = pr.a AND sh.b = pr.b""")
def pair_rejections(s, d):
    members, studies, _, _ = gap_frames(s, d)
    names = members.select("cluster").distinct().select("cluster", F.array(F.concat(F.lit("group"), "cluster")).alias("words"))
    return O.rejections(names, members, O.cluster_papers(members, studies))


FEATURES = GAP.replace("WITH ", "WITH " + CTES["vecs"] + ", ", 1) + """, papers AS (SELECT o_orderkey AS paper, year(o_orderdate) AS year, o_orderpriority AS community, o_totalprice AS pagerank, k::DOUBLE AS betweenness FROM orders JOIN (SELECT paper, count(*) AS k FROM brands GROUP BY 1) ON paper = o_orderkey),
f AS (SELECT * FROM own JOIN papers USING (paper)), bn AS (SELECT brand, count(*) AS n FROM brands GROUP BY 1),
links AS (SELECT a, b, round(k / (x.n + y.n - k)::DOUBLE, 6) AS weight FROM (SELECT p.brand AS a, q.brand AS b, count(*) AS k FROM brands p JOIN brands q ON p.paper = q.paper AND p.brand < q.brand GROUP BY 1, 2) JOIN bn x ON x.brand = a JOIN bn y ON y.brand = b),
sz AS (SELECT cluster, count(*) AS n FROM members GROUP BY 1), inn AS (SELECT cluster, n, CASE WHEN n > 1 THEN coalesce(w, 0) / (n * (n - 1) / 2.0) ELSE 0 END AS density FROM sz LEFT JOIN (SELECT x.cluster, sum(weight) AS w FROM links JOIN members x ON x.topic = a JOIN members y ON y.topic = b AND y.cluster = x.cluster GROUP BY 1) USING (cluster)),
cr AS (SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b, sum(weight) AS w FROM links JOIN members x ON x.topic = links.a JOIN members y ON y.topic = links.b WHERE x.cluster <> y.cluster GROUP BY 1, 2),
nb AS (SELECT DISTINCT m.cluster, l.b AS topic FROM members m JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = m.topic WHERE NOT EXISTS (SELECT 1 FROM members z WHERE z.cluster = m.cluster AND z.topic = l.b)),
nk AS (SELECT cluster, count(*) AS k FROM nb GROUP BY 1), met AS (SELECT x.cluster AS a, y.cluster AS b, count(*) AS m FROM nb x JOIN nb y ON x.topic = y.topic AND x.cluster < y.cluster GROUP BY 1, 2),
cc AS (SELECT cluster, community, count(*) AS n FROM f GROUP BY 1, 2), cp AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster)::DOUBLE AS p FROM cc), sep AS (SELECT x.cluster AS a, y.cluster AS b, round(1 - sum(least(x.p, y.p)), 6) AS s FROM cp x JOIN cp y ON x.community = y.community AND x.cluster < y.cluster GROUP BY 1, 2),
rk AS (SELECT paper, 0.5::DOUBLE * (p1 + p2) AS position FROM (SELECT paper, round((row_number() OVER (ORDER BY pagerank, paper) - 1) / greatest(1, count(*) OVER () - 1)::DOUBLE, 6) AS p1, round((row_number() OVER (ORDER BY betweenness, paper) - 1) / greatest(1, count(*) OVER () - 1)::DOUBLE, 6) AS p2 FROM papers)),
u AS (SELECT a, b, count(*) AS n, count(*) FILTER (year >= 1999) AS recent, sum(position) AS pos, count(*) FILTER (k = 2) AS bridges, count(*) FILTER (k = 2 AND year >= 2000) AS bridges_recent, count(*) FILTER (k = 2 AND year < 2000 AND year > 0) AS bridges_older FROM (SELECT a, b, paper, any_value(year) AS year, any_value(position) AS position, count(*) AS k FROM pr JOIN f ON cluster IN (a, b) JOIN rk USING (paper) GROUP BY 1, 2, 3) GROUP BY 1, 2),
bv AS (SELECT p_brand AS topic, list(x ORDER BY i) AS vec FROM (SELECT DISTINCT p_brand FROM part) JOIN (SELECT cluster AS label, i, avg(x) AS x FROM (SELECT cluster, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS x FROM vecs) GROUP BY 1, 2) ON label = regexp_extract(p_brand, '[0-9]+')::INTEGER % 5 GROUP BY 1), mv AS (SELECT cluster, topic, vec FROM members JOIN bv USING (topic)),
cs AS (SELECT a, b, list_cosine_similarity(x.vec, y.vec) AS c, true AS crossed FROM pr JOIN mv x ON x.cluster = a JOIN mv y ON y.cluster = b UNION ALL SELECT a, b, list_cosine_similarity(x.vec, y.vec), false FROM pr JOIN mv x ON x.cluster IN (a, b) JOIN mv y ON y.cluster = x.cluster AND x.topic < y.topic),
si AS (SELECT a, b, avg(c) FILTER (crossed) AS similarity, greatest(0.12, least(0.85, list_sort(list(c))[least(floor(0.9 * count(*))::INTEGER, count(*)::INTEGER - 1) + 1])) AS reference FROM cs GROUP BY 1, 2), w AS (SELECT count(*) FILTER (year >= 1999) / greatest(1, count(*))::DOUBLE AS w FROM papers),
g AS (SELECT pr.a, pr.b, coalesce(sep.s, 1.0) AS s, coalesce(similarity, 0.0) AS similarity, coalesce(reference, 0.35) AS reference, CASE WHEN coalesce(ka.k, 0) + coalesce(kb.k, 0) - coalesce(m, 0) > 0 THEN coalesce(m, 0) / (coalesce(ka.k, 0) + coalesce(kb.k, 0) - coalesce(m, 0))::DOUBLE ELSE 0 END AS jac, 0.5 * (ia.density + ib.density) AS internal, coalesce(cr.w, 0) AS crossed, coalesce(cr.w, 0) / greatest(1.0, ia.n * ib.n) AS density, u.* EXCLUDE (a, b), w.w
 FROM pr JOIN inn ia ON ia.cluster = pr.a JOIN inn ib ON ib.cluster = pr.b JOIN u ON u.a = pr.a AND u.b = pr.b LEFT JOIN sep ON sep.a = pr.a AND sep.b = pr.b LEFT JOIN si ON si.a = pr.a AND si.b = pr.b LEFT JOIN cr ON cr.a = pr.a AND cr.b = pr.b LEFT JOIN met ON met.a = pr.a AND met.b = pr.b LEFT JOIN nk ka ON ka.cluster = pr.a LEFT JOIN nk kb ON kb.cluster = pr.b, w),
features AS (SELECT a, b, round(s, 6)::DOUBLE AS community_separation, round(0.6 * least(1.0, similarity / reference) + 0.4 * least(1.0, jac / 0.6), 6)::DOUBLE AS semantic_similarity, round(1 - least(1.0, CASE WHEN internal > 0 THEN density / (internal * 0.5) ELSE 0 END), 6)::DOUBLE AS relationship_sparsity,
 round(least(1.0, recent / n::DOUBLE / greatest(0.05, w) * 0.75), 6)::DOUBLE AS research_activity, round(least(1.0, pos / n + CASE WHEN bridges > 0 THEN 0.15 ELSE 0 END), 6)::DOUBLE AS bridge_potential, round(crossed, 6)::DOUBLE AS cross_edge_weight, bridges AS bridge_papers, bridges_recent, bridges_older, round(jac, 6)::DOUBLE AS neighbourhood_jaccard, n AS scoped_papers, recent AS recent_papers FROM g)"""
SCORES = FEATURES + ", scored AS (SELECT *, round(0::DOUBLE + " + " + ".join(f"{100 * w!r}::DOUBLE * {k}" for k, w in O.WEIGHTS.items()) + ", 2) AS score FROM features), told AS (SELECT *, CASE WHEN score >= 68 AND scoped_papers >= 8 THEN 'Medium-High' WHEN score >= 55 AND scoped_papers >= 5 THEN 'Medium' ELSE 'Low' END AS confidence, CASE WHEN bridges_recent + bridges_older = 0 THEN 'no bridges in corpus' WHEN bridges_recent = 0 THEN 'persistent gap' WHEN bridges_older = 0 THEN 'emerging bridge' WHEN bridges_recent * 2 >= bridges_recent + bridges_older THEN 'closing gap' ELSE 'slowly closing gap' END AS trajectory FROM scored)"


@query(FEATURES + " SELECT * FROM features")
def pair_features(s, d):
    members, studies, papers, links = gap_frames(s, d)
    return O.features(members, studies, papers, links, gap_vectors(s, d), recent=1999, bridge_recent=2000)


@query(SCORES + " SELECT * FROM told")
def opportunity_score(s, d):
    members, studies, papers, links = gap_frames(s, d)
    f = O.score(O.features(members, studies, papers, links, gap_vectors(s, d), recent=1999, bridge_recent=2000))
    return f.withColumns({"confidence": O.confidence(F.col("score"), F.col("scoped_papers")), "trajectory": O.trajectory(F.col("bridges_recent"), F.col("bridges_older"))})


@query("SELECT s_suppkey AS id, CASE WHEN sc >= 68 AND k >= 8 THEN 'Medium-High' WHEN sc >= 55 AND k >= 5 THEN 'Medium' ELSE 'Low' END AS confidence FROM (SELECT s_suppkey, s_acctbal / 100 AS sc, s_suppkey % 12 AS k FROM supplier)")
def confidence(s, d):
    return T(s, d, "supplier").select(F.col("s_suppkey").alias("id"), O.confidence(F.col("s_acctbal") / 100, F.col("s_suppkey") % 12).alias("confidence"))


@query("SELECT s_suppkey AS id, CASE WHEN r + o = 0 THEN 'no bridges in corpus' WHEN r = 0 THEN 'persistent gap' WHEN o = 0 THEN 'emerging bridge' WHEN r * 2 >= r + o THEN 'closing gap' ELSE 'slowly closing gap' END AS status FROM (SELECT s_suppkey, s_suppkey % 4 AS r, s_suppkey % 3 AS o FROM supplier)")
def trajectory(s, d):
    return T(s, d, "supplier").select(F.col("s_suppkey").alias("id"), O.trajectory(F.col("s_suppkey") % 4, F.col("s_suppkey") % 3).alias("status"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{label}', {w}::DOUBLE)" for k, label, w in O.score_model_rows()) + ") v(component, label, weight)")
def score_model(s, d):
    return s.createDataFrame(O.score_model_rows(), "component string, label string, weight double")


EVIDENCE = GAP + """, p AS (SELECT cluster, paper, o_totalprice AS pagerank FROM own JOIN orders ON o_orderkey = paper), t AS (SELECT cluster, paper, r FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pagerank DESC, paper) AS r FROM p) WHERE r <= 3),
c AS (SELECT a, b, paper, 1 AS k, r, 'cluster_a' AS role FROM pr JOIN t ON cluster = a UNION ALL SELECT a, b, paper, 2, r, 'cluster_b' FROM pr JOIN t ON cluster = b UNION ALL SELECT a, b, paper, 3, r, 'bridge' FROM (SELECT x.cluster AS a, y.cluster AS b, paper, row_number() OVER (PARTITION BY x.cluster, y.cluster ORDER BY x.pagerank DESC, paper) AS r FROM p x JOIN p y USING (paper) WHERE x.cluster < y.cluster) WHERE r <= 3),
ev AS (SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY k, r) AS pos, paper, role FROM (SELECT *, row_number() OVER (PARTITION BY a, b, paper ORDER BY k, r) AS z FROM c) WHERE z = 1)"""


@query(EVIDENCE + " SELECT * FROM ev")
def evidence_papers(s, d):
    members, studies, papers, _ = gap_frames(s, d)
    own = O.cluster_papers(members, studies)
    return O.evidence(own, papers, O.pairs(members))


@query(EVIDENCE + """, b3 AS (SELECT a, b, paper, row_number() OVER (PARTITION BY a, b ORDER BY pos, paper) AS r FROM ev WHERE role = 'bridge'), one AS (SELECT a, b, r, min(topic) FILTER (cluster = a) AS l, min(topic) FILTER (cluster = b) AS z FROM b3 JOIN brands USING (paper) JOIN members ON topic = brand WHERE r <= 3 GROUP BY 1, 2, 3 HAVING l IS NOT NULL AND z IS NOT NULL),
few AS (SELECT cluster, topic, row_number() OVER (PARTITION BY cluster ORDER BY topic) AS i FROM members), two AS (SELECT a, b, x.i * 4 + y.i AS r, x.topic AS l, y.topic AS z FROM pr JOIN few x ON x.cluster = a AND x.i <= 4 JOIN few y ON y.cluster = b AND y.i <= 4 WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.a = pr.a AND one.b = pr.b)),
ends AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY r) AS k FROM (SELECT * FROM one UNION ALL SELECT * FROM two)), pp AS (SELECT x.brand AS l, y.brand AS z, min('paper:' || paper) AS p FROM brands x JOIN brands y USING (paper) WHERE x.brand <> y.brand GROUP BY 1, 2),
got AS (SELECT a, b, l, pp.p, z, min(k) AS k FROM ends JOIN pp USING (l, z) WHERE k <= 3 GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY k) AS pos FROM got)
SELECT a, b, pos::INTEGER AS pos, 'topic:' || l || '>' || p || '>topic:' || z AS path, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.a = top.a AND ev.b = top.b AND role = 'bridge' AND 'paper:' || ev.paper = top.p) THEN p ELSE '' END AS bridge_papers FROM top WHERE pos <= 2""")
def candidate_paths(s, d):
    from graphloom.plans.research import candidate_paths as paths

    members, studies, _, _ = gap_frames(s, d)
    members, studies = keep(members, "members"), keep(studies, "studies")  # each is read several times
    papers = T(s, d, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_totalprice").alias("pagerank"))
    of = O.pairs(members)
    bridge = O.evidence(O.cluster_papers(members, studies), papers, of).where("role = 'bridge'").select("a", "b", "pos", F.concat(F.lit("paper:"), F.col("paper").cast("string")).alias("paper"))
    topic = F.concat(F.lit("topic:"), "topic")
    e = studies.select(F.concat(F.lit("paper:"), F.col("paper").cast("string")).alias("src"), topic.alias("dst"), F.lit("STUDIES").alias("type"))
    x = paths(e, members.select("cluster", topic.alias("topic")), of, bridge)
    return x.select("a", "b", "pos", F.array_join("path", ">").alias("path"), F.array_join("bridge_papers", ",").alias("bridge_papers"))


ENTANGLED = """, size AS (SELECT cluster, count(*) AS n FROM own GROUP BY 1), both_ AS (SELECT x.cluster AS a, y.cluster AS b, count(*) AS k FROM own x JOIN own y ON x.paper = y.paper AND x.cluster < y.cluster GROUP BY 1, 2),
fit AS (SELECT told.* FROM told JOIN size x ON x.cluster = a JOIN size y ON y.cluster = b LEFT JOIN both_ USING (a, b) WHERE coalesce(k, 0) / least(x.n, y.n)::DOUBLE < 0.35), best AS (SELECT *, 1.0::DOUBLE AS relevance, round_even(score / 2.5, 0) AS bucket, a || '|' || b AS key FROM fit ORDER BY bucket DESC, key LIMIT 10),
ranked AS (SELECT * EXCLUDE (key), row_number() OVER (ORDER BY bucket DESC, key) AS rank FROM best)"""


@query(SCORES + ENTANGLED + f" SELECT *, printf('%s and %s: score %.1f over %d papers, %d bridges, %s. %s', a, b, round(score, 1), scoped_papers, bridge_papers, trajectory, '{NOTICE}') AS rationale FROM ranked")
def gaps(s, d):
    from graphloom.plans.research import find_gaps

    return find_gaps(*gap_frames(s, d), gap_vectors(s, d), recent=1999, bridge_recent=2000)


DSL = {
    "dsl_type_year": ("year>=1997 year<=1998 type in (Paper) limit 30", "label = 'Paper' AND year >= 1997 AND year <= 1998", 30),
    "dsl_author": ('author:"000000" type in (Author) limit 25', "label = 'Author' AND contains(lower(name), '000000')", 25),
    "dsl_relationship": ("type in (Dataset, Institution) rel in (AFFILIATED_WITH, USES_DATASET) limit 40", "label IN ('Dataset', 'Institution') AND id IN (SELECT src FROM edges WHERE type IN ('AFFILIATED_WITH', 'USES_DATASET') UNION SELECT dst FROM edges WHERE type IN ('AFFILIATED_WITH', 'USES_DATASET'))", 40),
}


def _dsl(text):
    return lambda s, d: D.run(text, P.nodes(s, d), P.edges(s, d)).select("id", "label", "name", "year")


for _name, (_text, _where, _limit) in DSL.items():
    query(with_("nodes", "edges") + f" SELECT id, label, name, year FROM nodes WHERE {_where} ORDER BY id LIMIT {_limit}", name=_name)(_dsl(_text))


@query(with_("nodes") + " SELECT id, label, name, year FROM (SELECT *, (length(name) - length(replace(lower(name), 'order', ''))) / 5 + (length(name) - length(replace(lower(name), '42', ''))) / 2 + CASE WHEN lower(name) = 'order 42' THEN 2 ELSE 0 END AS score FROM nodes WHERE label = 'Paper') WHERE score > 0 ORDER BY score DESC, id LIMIT 40")
def dsl_text(s, d):
    return D.run('topic:"order 42" type in (Paper) limit 40', P.nodes(s, d), P.edges(s, d)).select("id", "label", "name", "year")


@query(with_("edges") + ", top AS (SELECT id FROM (SELECT 'dataset:' || s_suppkey AS id FROM supplier) ORDER BY id LIMIT 2), n AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM top)) SELECT id, min(depth)::INTEGER AS depth FROM (SELECT id, 0 AS depth FROM top UNION ALL SELECT id, 1 FROM n) GROUP BY id")
def dsl_depth(s, d):
    return D.run("type in (Dataset) depth<=2 limit 2", P.nodes(s, d), P.edges(s, d)).select("id", "depth")


@query("SELECT * FROM (VALUES ('topic:\"AI Agents\" type in (Paper, Method) depth<=3 limit 5000', 3, 200, 3400, true), ('rel in (CONTRADICTS) limit 10', 1, 10, 10, true), ('depth<=9 limit 99999 papers about evaluation', 3, 200, 3400, true)) v(dsl, depth, seeds, visited, safe)")
def dsl_cost(s, d):
    rows = []
    for t in ('topic:"AI Agents" type in (Paper, Method) depth<=3 limit 5000', "rel in (CONTRADICTS) limit 10", "depth<=9 limit 99999 papers about evaluation"):
        c = D.cost(D.parse(t))
        rows.append((t, c["depth"], c["seeds"], c["estimated_nodes_visited"], c["safe"]))
    return s.createDataFrame(rows, "dsl string, depth int, seeds int, visited int, safe boolean")
