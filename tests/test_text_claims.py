"""Text functions, claims, vectors, the DSL, sources, sinks, the limiter and the research plans."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions import vectors as V
from graphloom.operators import aggregates as G
from graphloom.operators import claims as C
from graphloom.operators import gaps as O
from graphloom.operators import vectors as K
from graphloom.plans import dsl as D
from graphloom.plans import research as R
from graphloom.sources import corpus, sinks
from graphloom.streaming import limiter


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_tokens_and_stems(spark):
    assert column(spark, ["The Multi-Agent systems, x of v1.2!", None], X.tokens) == [["multi-agent", "systems", "v1.2"], []]
    words = ["improves", "studies", "ties", "planning", "ring", "based", "classes", "as"]
    assert column(spark, words, X.stem) == [X.py_stem(w) for w in words] == ["improv", "study", "ties", "plann", "ring", "based", "class", "as"]


def test_negation_strength_direction(spark):
    assert column(spark, ["It does not work", "It can't", "Nothing", "lacking data", "notable", None], X.negated) == [True, True, False, True, False, False]
    t = lambda f: lambda c: f(X.tokens(c))
    assert column(spark, ["clearly robust", "perhaps slight", "clearly perhaps", "plain"], t(X.strength)) == ["strong", "weak", "moderate", "moderate"]
    assert column(spark, ["it degrades", "loss rises", "increases the loss", "plain"], t(X.direction)) == ["degrade", "loss", "increase", None]


def test_negation_agrees_with_its_sql_beyond_ascii(spark):
    from graphloom.plans.catalog_text import sql_negated

    x = ["noñamente", "señor ñno", "un no", "lac\u212a of data", "in\u017fufficient", "cannoté", "anoté", "no_", "it can\u2019t", "élack\u00df", "nor\u0301", "not\u200d", "fail\u017f to"]
    want = [r[0] for r in duckdb.execute(f"SELECT {sql_negated('x')} FROM (SELECT unnest(?) AS x)", [x]).fetchall()]
    assert want[:3] == [True, True, True] and want[4]
    assert column(spark, x, X.negated) == want


def test_intent_and_slug(spark):
    got = column(spark, ["Which gaps are underexplored opportunities?", "hello", "pagerank and betweenness"], X.intent)
    assert [(g.name, g.confidence) for g in got] == [("research_gaps", 0.95), ("general_qa", 0.35), ("centrality", 0.85)]
    assert column(spark, [" Ein Überblick -- 2.0 ", "***", "x" * 99], X.slug) == ["ein-überblick-2-0", column(spark, ["***"], lambda c: F.substring(F.md5(c), 1, 10))[0], "x" * 64]


def claims(spark, rows):
    return C.parse(spark.createDataFrame(rows, "id string, text string, paper string"))


def test_claim_pairs(spark):
    polar = C.conflicts(claims(spark, [("1", "Multi-agent coordination consistently improves reasoning performance.", "p"), ("2", "Multi-agent coordination does not improve reasoning performance.", "q")])).collect()
    assert [(r.kind, r.score) for r in polar] == [("polarity", 0.57)]
    against = C.conflicts(claims(spark, [("1", "Long-term memory reduces coordination overhead in agent teams.", "p"), ("2", "Long-term memory increases coordination overhead in agent teams.", "q")])).collect()
    assert [r.kind for r in against] == ["directional"]
    same = [("1", "Retrieval augmentation improves factual grounding.", "p"), ("2", "Retrieval augmentation improves factual grounding and latency.", "q")]
    assert C.conflicts(claims(spark, same)).collect() == []
    assert C.conflicts(claims(spark, [("1", "Memory does not help agent teams here", "p"), ("2", "Memory helps agent teams here", "p"), ("3", None, "p")])).collect() == []


def shuffled(spark, run):
    """Rows that the stages of a run write to shuffles."""
    sc = spark.sparkContext
    jvm, store = sc._jvm, sc._jsc.sc().statusStore()

    def total():
        x = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(x.apply(i).shuffleWriteRecords() for i in range(x.size()))

    before = total()
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, total() - before


def test_conflicts_make_no_pairs_but_those_that_oppose(spark):
    words = ["retrieval", "augmentation", "planning", "grounding"]
    rows = [(f"{i:04d}", " ".join([*words[: 3 + i % 2], f"case{i}"]), f"p{i}") for i in range(1500)]  # each shares three stems with all
    found, n = shuffled(spark, lambda: C.conflicts(claims(spark, [*rows, ("x", "retrieval augmentation planning does not help", "q")])).collect())
    assert len(found) == 1500 and {r.score for r in found} <= {0.54, 0.563, 0.6} and n < 60_000


@pytest.mark.parametrize("name", ["conflicts_enriched", "counter_evidence", "tool_conflicts"])
def test_queries_on_conflicts_move_no_pair(spark, tmp_path, name):
    from graphloom.plans import catalog

    for t in os.listdir("/root/testdata/sf0.001"):
        os.symlink(f"/root/testdata/sf0.001/{t}", tmp_path / t)
    os.unlink(tmp_path / "supplier.parquet")
    spark.range(3000).selectExpr("id as s_suppkey", "concat('Supplier#', id) as s_name", "cast(id % 25 as int) as s_nationkey", "0D as s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = [tuple(map(str, r)) for r in duck.execute(catalog.oracle_sql()[name]).fetchall()]
    got, n = shuffled(spark, lambda: [tuple(map(str, r)) for r in catalog.queries()[name](spark, str(tmp_path)).collect()])
    # some 214,000 pairs conflict
    assert sorted(got) == sorted(want) and n < 150_000


@pytest.mark.parametrize("rare, block", [(0, 1), (1, 3), (3, 2), (99, 4)])
def test_conflicts_by_classes_are_those_of_all_pairs(spark, rare, block):
    say = ["memory {x} does not reduce overhead {y}", "memory {x} reduces overhead {y}", "memory {x} increases overhead {y} clearly shows", "memory shows {x} overhead increases {y}", "nothing {x}", "planning {y} helps memory {x} overhead", "of the"]
    rows = [(None if i == 11 else f"{i % 40:02d}", say[i % 7].format(x=f"case{i // 7 % 3}", y=f"task{i % 5}"), [None, "", "p", "q"][i // 3 % 4]) for i in range(44)]
    p = claims(spark, rows)
    got = sorted(tuple(map(str, r)) for r in C.conflicts(p, texts=True, rare=rare, block=block).collect())
    k = {r.grp: r["count"] for r in p.groupBy("grp").count().collect()}
    c = [(r, k[r.grp]) for r in p.where("id is not null").collect()]
    poles = {x for a, b in X.DIRECTIONS for x in ((a, b), (b, a))}
    want = []
    for a, m in c:
        for b, n in c:
            if not a.id < b.id or (m > 1) != (n > 1) or (m > 1 and a.grp != b.grp) or (a.paper and a.paper == b.paper):
                continue
            shared, low = len(set(a.stems) & set(b.stems)), min(len(a.stems), len(b.stems))
            overlap = shared / low if low else 0.0
            polar, against, same = a.negated != b.negated, (a.direction, b.direction) in poles, a.subject != "" and a.grp == b.grp
            close, firm = shared >= 2 and overlap >= 0.2, a.strength == b.strength == "strong"
            kind = "polarity" if polar and (same or close) else "directional" if against and close else None
            score = round(min(1.0, 0.45 * polar + 0.35 * against + 0.2 * same + 0.1 * firm + 0.15 * overlap), 3)
            why = ["polarity differs"] * polar + [f"opposite direction: {a.direction} {b.direction}"] * against + ["same subject and predicate"] * same + ["both assertive"] * firm + [f"shared concepts: {shared}"] * (shared > 0)
            if kind and score >= (0.35 if m > 1 else 0.45):
                want.append(tuple(map(str, (a.id, b.id, a.paper, b.paper, score, kind, why, a.text, b.text))))
    assert got == sorted(want) and len(want) > 50


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, vec array<double>")
    top = {r.id: (r.other, r.score) for r in K.knn(v, 1, block=2).where("id = 'a'").collect()}
    assert top["a"] == ("b", pytest.approx(0.993884, abs=1e-6))
    assert [r.id for r in K.search(v, [1.0, 0.0], 2).collect()] == ["a", "b"]
    assert v.select(F.max(V.cosine(F.col("vec"), F.array(F.lit(0.0), F.lit(0.0))))).first()[0] == 0.0
    e = spark.createDataFrame([("graph graphs",), (None,)], "t string").select(V.lexical(32)("t").alias("v")).collect()
    assert sum(x * x for x in e[0].v) == pytest.approx(1) and sum(e[1].v) == 0


@pytest.mark.parametrize("block", [3, None])
def test_neighbours_of_queries_are_those_of_all_rows(spark, block):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [(None, [1.0, 1.0, 1.0]), (100, [0.0, 0.0, 0.0]), (7, [0.5, 0.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = v.where("id % 10 = 0")
    every = lambda df: sorted((r.id, r["rank"], r.other, r.score) for r in df.collect())
    want = every(K.knn(v, 4, block=block).where("id % 10 = 0"))
    assert every(K.knn(v, 4, block=block, queries=q)) == want and {r[0] for r in want} == {0, 10, 20, 30, 40, 50, 100}
    units = {i: [x / (sum(y * y for y in vec) ** 0.5 or 1) for x in vec] for i, vec in rows[:60]}
    near = sorted((-round(sum(x * y for x, y in zip(units[20], u)), 6), i) for i, u in units.items() if i != 20)
    assert [(r[3], r[2]) for r in want if r[0] == 20] == [(pytest.approx(-s), i) for s, i in near[:4]]


def test_recall_moves_vectors_a_few_times(spark, tmp_path):
    from graphloom.plans import catalog

    x = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k).cast("float"))
    spark.range(6000).select(F.col("id").alias("vec_id"), x.alias("embedding"), F.lit(0).alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    got, n = shuffled(spark, lambda: catalog.queries()["knn_recall"](spark, str(tmp_path)).collect())
    assert [tuple(r) for r in got] == [(5, True, 6000)] and n < 100_000


def test_paths_between_hubs_spread_no_pair(spark):
    from graphloom.operators import paths as H

    hubs = [f"t{i}" for i in range(8)]
    e = spark.range(1000).select(F.concat(F.lit("p"), F.format_string("%04d", "id")).alias("src"), F.explode(X.words([*hubs, "t1"])).alias("dst"))
    e = e.unionByName(spark.createDataFrame([("t0", "t1"), ("t0", "t0"), ("x", "p0007"), ("y", "x"), (None, "t0"), ("lone", None)], "src string, dst string"))
    want = {(a, b): [a, b] if {a, b} == {"t0", "t1"} else [a, "p0000", b] for a in hubs for b in hubs if a != b}
    pairs = [(a, b, 4) for a, b in want] + [("t0", "t0", 0), ("t2", "y", 3), ("t2", "x", 1), ("x", "t3", 2), ("t4", "lone", 4)]
    want |= {("t0", "t0"): ["t0"], ("t2", "y"): ["t2", "p0007", "x", "y"], ("x", "t3"): ["x", "p0007", "t3"]}
    got, n = shuffled(spark, lambda: H.pair_paths(e, spark.createDataFrame(pairs, "source string, target string, most int")).collect())
    assert {(r.source, r.target): (r.hops, r.path) for r in got} == {k: (len(v) - 1, v) for k, v in want.items()} and len(got) == len(want)
    assert n < 50_000


RECORDS = {
    'topic:"AI Agents" type in (Paper, Method) depth<=3 limit 5000': ("AI Agents", ["Paper", "Method"], [], [], 3, 500),
    'author:"Yao" type in (Paper) rel in (CITES, STUDIES) limit 25': (None, ["Paper"], ["CITES", "STUDIES"], [("TextContains", "name", "Yao")], 1, 25),
    "year>=2022 year<=2025 type in (Paper) limit 30": (None, ["Paper"], [], [("IntAtLeast", "year", 2022), ("IntAtMost", "year", 2025)], 1, 30),
    "multi-agent coordination community detection": ("multi-agent coordination community detection", [], [], [], 1, 50),
    'topic:"Agent Memory" rel in (CITES) year>=2023 limit 40': ("Agent Memory", [], ["CITES"], [("IntAtLeast", "year", 2023)], 1, 40),
    "rel in (CONTRADICTS) limit 10": (None, [], ["CONTRADICTS"], [], 1, 10),
    'topic:"AI Agents"': ("AI Agents", [], [], [], 1, 50),
    "depth<=9 limit 99999 papers about evaluation": ("9 papers about evaluation", [], [], [], 3, 500),
    'author:"Nakano" type in (Method, Dataset, Community) limit 12': (None, ["Method", "Dataset", "Community"], [], [("TextContains", "name", "Nakano")], 1, 12),
}


@pytest.mark.parametrize("text", RECORDS)
def test_dsl_records(text):
    q = D.parse(text)
    assert (q.text, q.labels, q.relationships, q.filters, q.depth, q.limit) == RECORDS[text]


def test_dsl_rejects_and_costs():
    for bad in ("type in (Paper, SecretVault)", "   ", "rel in (HATES)"):
        with pytest.raises(D.DslError):
            D.parse(bad)
    c = D.cost(D.parse("depth<=3 limit 500 x"))
    assert (c["seeds"], c["estimated_nodes_visited"], c["safe"]) == (200, 3400, True)


def paper(i, **k):
    base = {"arxiv_id": f"2301.0000{i}", "title": f"Paper {i}", "year": 2023, "field": "AI", "topics": ["Agents"], "methods": ["PPO"], "datasets": [], "authors": [f"A{i}"], "summary": "", "author_status": "verified", "corpus_tier": "pool"}
    return base | k


def test_corpus_build(spark, tmp_path):
    doc = {"papers": [paper(1, topics=["AI", "Agents"]), paper(2, authors=[])], "citations": [{"source": "2301.00001", "target": "2301.00002"}, {"source": "2301.00001", "target": "x"}], "claims": [{"id": "2301.00001:1", "text": "t" * 130, "paper": "2301.00001"}], "topics": [], "methods": [], "datasets": []}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    c = corpus.read_corpus(spark, str(tmp_path / "c.json"))
    nodes, edges = corpus.build_graph(c)
    n = {r.id: r for r in nodes.collect()}
    assert set(n) == {"paper:2301.00001", "paper:2301.00002", "topic:ai", "topic:agents", "method:ppo", "author:a1", "claim:2301.00001:1"}
    assert len(n["claim:2301.00001:1"].name) <= 120
    e = {(r.src, r.dst, r.type): r.weight for r in edges.collect()}
    assert e["paper:2301.00001", "topic:ai", "STUDIES"] == 0.6 and ("paper:2301.00001", "paper:2301.00002", "CITES") in e and len(e) == 9
    assert {(r.kind, r.id) for r in corpus.problems(c["papers"], c["citations"], least=3).collect()} == {("dangling-citation", "x"), ("too-few-rows", "2")}
    assert [(r.id, r.paper_count) for r in corpus.dictionary(c["papers"], "topics").collect()] == [("agents", 2), ("ai", 1)]
    for shape in (doc["papers"], {"papers": doc["papers"]}):
        (tmp_path / "p.json").write_text(json.dumps(shape))
        assert corpus.read_papers(spark, str(tmp_path / "p.json")).count() == 2
    sinks.write_csv(nodes, edges, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/edges")).count() == 9
    sinks.write_lines(sinks.graphml_rows(nodes, edges), str(tmp_path / "g"))
    import xml.dom.minidom

    text = "".join(p.read_text() for p in (tmp_path / "g").glob("part*"))
    assert len(xml.dom.minidom.parseString(text).getElementsByTagName("node")) == 7


def test_atom(spark):
    feed = "<feed><entry><id>http://x/abs/2301.00001v2</id><title>A\n  b</title><summary>s</summary><published>2023-01-02</published><author><name>N One</name></author><author><name>Two</name></author></entry><entry><id>http://x/abs/2301.00001v1</id><title>z</title></entry></feed>"
    r = corpus.parse_atom(spark.createDataFrame([(feed,)], "value string")).collect()
    assert [(x.arxiv_id, x.title, x.year, x.authors) for x in r] == [("2301.00001", "A b", 2023, ["N One", "Two"])]


def test_limiter(spark):
    rows = [(i, "k", t) for i, t in enumerate([0, 1, 2, 3, 61, 62, 63, 64])] + [(100, "j", 0)]
    df = spark.createDataFrame(rows, "id long, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.admitted for r in limiter.admit(df, "k", "ts", "id", limit=3, seconds=60).collect()}
    assert [got[i] for i in range(8)] == [True, True, True, False, True, True, True, False] and got[100]


def test_limiter_stream(spark, tmp_path):
    rows = [("k", t) for t in (0, 1, 2, 61)]
    spark.createDataFrame(rows, "k string, s int").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = limiter.admit_stream(s, "k", "ts", limit=2).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.admitted for r in spark.table("admitted").orderBy("ts").collect()] == [True, True, False, True]


def test_score_model_and_states(spark):
    assert sum(O.WEIGHTS.values()) == pytest.approx(1)
    r = spark.range(1).select(*[O.trajectory(F.lit(a), F.lit(b)).alias(f"t{i}") for i, (a, b) in enumerate([(0, 0), (0, 2), (2, 0), (2, 2), (1, 3)])]).first()
    assert list(r) == ["no bridges in corpus", "persistent gap", "emerging bridge", "closing gap", "slowly closing gap"]
    c = spark.range(1).select(*[O.confidence(F.lit(s), F.lit(n)).alias(f"c{i}") for i, (s, n) in enumerate([(70, 9), (70, 6), (50, 99)])]).first()
    assert list(c) == ["Medium-High", "Medium", "Low"]


def test_gap_order_never_rises_by_more_than_a_bucket(spark):
    members = spark.createDataFrame([(c, f"{c}{i}") for c in "abcd" for i in range(3)], "cluster string, topic string")
    studies = spark.createDataFrame([(p, f"{'abcd'[p % 4]}{p % 3}") for p in range(48)] + [(p, f"{'abcd'[(p + 1) % 4]}0") for p in range(0, 48, 9)], "paper long, topic string")
    papers = spark.createDataFrame([(p, 2018 + p % 8, p % 4, p / 48, (p * 7 % 48) / 48) for p in range(48)], "paper long, year int, community int, pagerank double, betweenness double")
    links = spark.createDataFrame([(f"{c}{i}", f"{c}{j}", 0.5) for c in "abcd" for i in range(3) for j in range(i + 1, 3)] + [("a0", "b0", 0.2)], "a string, b string, weight double")
    vecs = spark.createDataFrame([(f"{c}{i}", [float(k == i) + 0.3 * ord(c) / 100 for k in range(3)]) for c in "abcd" for i in range(3)], "id string, vec array<double>")
    got = R.find_gaps(members, studies, papers, links, vecs).collect()
    assert len(got) == 6 and [r["rank"] for r in got] == sorted(r["rank"] for r in got)
    s = [r["score"] for r in sorted(got, key=lambda r: r["rank"])]
    assert all(b - a <= 2.5 for a, b in zip(s, s[1:], strict=False)) and all(0 <= r[k] <= 1 for r in got for k in O.WEIGHTS)
    assert R.report_rows(R.find_gaps(members, studies, papers, links, vecs)).count() == 6


def test_rejections(spark):
    members = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", "t3")], "cluster string, topic string")
    names = spark.createDataFrame([("a", ["agent"]), ("b", ["agent", "memory"]), ("c", ["vision"])], "cluster string, words array<string>")
    own = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("c", 3)], "cluster string, paper int")
    got = {(r.a, r.b): r.reason for r in O.rejections(names, members, own).collect()}
    assert got == {("a", "b"): "nested concepts", ("a", "c"): None, ("b", "c"): "entangled papers"}


def test_order_statistic_is_no_percentile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert G.order_statistic(df, "v", 0.9).first().value == 9.0 and G.order_statistic(df, "v", 0.5).first().value == 5.0


def test_tools_reject_and_clamp(spark):
    n = spark.createDataFrame([("paper:1", "Paper", "Alpha", 2000)], "id string, label string, name string, year int")
    e = spark.createDataFrame([], "src string, dst string, type string, weight double, predicted boolean")
    t = R.standard_tools(n, e)
    assert not t.call(spark, "nothing")["ok"] and not t.call(spark, "search_papers", wrong=1)["ok"]
    assert t.call(spark, "search_papers", query="alp", limit="9999")["result"].count() == 1
    assert R.bounded("x", {"type": int, "default": 4}) == 4 and R.bounded(99, {"type": int, "low": 1, "high": 50}) == 50


def test_paper_ranking(spark):
    p = spark.createDataFrame([("1", "Planning with memory", "", "", 2020), ("2", "Vision", "memory of planning", "", 2021), ("3", "Nothing", "", "", None)], "id string, title string, summary string, taxonomy string, year int")
    got = R.rank_papers(p, "How does planning use memory?").collect()
    assert [r.id for r in got] == ["1", "2"] and got[0].relevance > got[1].relevance
    assert R.rank_papers(p, "what is the best?").count() == 0


def test_views(spark):
    from graphloom.plans import views as W

    n = spark.createDataFrame([(f"p{i}", "Paper", f"P{i}", 2020 + i) for i in range(4)] + [("t1", "Topic", "One", None), ("t2", "Topic", "Two", None)], "id string, label string, name string, year int")
    e = spark.createDataFrame([(f"p{i}", f"t{1 + i // 2}", "STUDIES", 1.0, False) for i in range(4)] + [("t1", "t2", "PREDICTED_LINK", 0.5, True)], "src string, dst string, type string, weight double, predicted boolean")
    m = W.analytics(n, e)
    got = {r.id: r for r in m.collect()}
    assert got["p0"].community == got["t1"].community != got["t2"].community and got["t1"].degree == 2
    made, belongs = W.communities(n, m.select("id", "community"))
    assert sorted(r.name for r in made.collect()) == ["One", "Two"] and belongs.count() == 6
    board = W.dashboard(n, e, m, since=2022)
    assert [r.topic for r in board["emerging"].collect()] == ["t2"] and board["influential"].count() == 4
    assert [(r.src_name, r.dst_name) for r in W.predicted_links(e, n, n.where("id = 't2'")).collect()] == [("One", "Two")]
    c = spark.createDataFrame([("c1", "c2", "p0", "p3", 0.5), ("c1", "c3", "p0", "zz", 0.9)], "claim_a string, claim_b string, paper_a string, paper_b string, score double")
    papers = n.where("label = 'Paper'").select(F.col("id").alias("paper"))
    assert [r.claim_b for r in W.pair_conflicts(c, papers.where("paper = 'p0'"), papers.where("paper = 'p3'")).collect()] == ["c2"]
    names = spark.createDataFrame([("a", "cluster", "x"), ("b", "cluster", "x"), ("c", "cluster", "y"), ("d", "topic", "x")], "cluster string, granularity string, name string")
    own = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 50)] + [("c", i) for i in range(8)] + [("d", 3)], "cluster string, paper int")
    assert {r.cluster for r in W.distinct_clusters(own.select("cluster"), names, own).collect()} == {"a", "d"}


def test_embeddings_by_fnv():
    assert V.fnv1a("") == 0xCBF29CE484222325 and V.fnv1a("a") == 0xAF63DC4C8601EC8C
    v = V.embed_text("graphs graph", 16, V.fnv1a)
    assert sum(x * x for x in v) == pytest.approx(1) and V.embed_text("", 4) == [0.0] * 4
