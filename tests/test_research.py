"""Composite plans on small graphs worked out by hand, and queries without SQL against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_graph import edges_of, nodes_of

from graphloom.operators import algorithms as A
from graphloom.operators import concepts as K
from graphloom.operators import paths as H
from graphloom.plans import catalog
from graphloom.plans import research as R
from graphloom.plans import views as W

DATA = "/root/testdata/sf0.001"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# --- paths between pairs


def test_pair_paths_stop_at_their_bound_and_take_the_least(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "c"), ("p", "q")])
    pairs = frame(spark, [("a", "c", 3), ("a", "d", 2), ("a", "d", 3), ("d", "a", 2), ("a", "q", 9), ("a", "a", 1)], "source string, target string, most int")
    got = {(r.source, r.target): (r.hops, r.path) for r in H.pair_paths(e, pairs).collect()}
    assert got == {("a", "c"): (2, ["a", "b", "c"]), ("a", "d"): (3, ["a", "b", "c", "d"]), ("a", "a"): (0, ["a"])}
    assert H.pair_paths(e, pairs.limit(0)).collect() == []


def test_candidate_paths_prefer_ends_at_bridges(spark):
    e = frame(spark, [("p1", "t1", "STUDIES"), ("p1", "t9", "USES_METHOD"), ("p2", "t2", "STUDIES"), ("p2", "t8", "STUDIES"), ("p3", "t3", "STUDIES"), ("p3", "t7", "STUDIES"), ("t3", "t7", "RELATED_TO"), ("t1", "t9", "SIMILAR_TO")], "src string, dst string, type string")
    members = frame(spark, [("A", "t1"), ("A", "t2"), ("B", "t8"), ("B", "t9"), ("C", "t3"), ("D", "t7")], "cluster string, topic string")
    pairs = frame(spark, [("A", "B"), ("C", "D"), ("A", "C")], "a string, b string")
    bridges = frame(spark, [("A", "B", 1, "p2"), ("A", "B", 2, "p1"), ("A", "B", 3, "px")], "a string, b string, pos int, paper string")
    got = sorted((r.a, r.b, r.pos, r.path, r.bridge_papers) for r in R.candidate_paths(e, members, pairs, bridges).collect())
    # a similarity is no evidence, and clusters that nothing observed connects have no path
    assert got == [("A", "B", 1, ["t2", "p2", "t8"], ["p2"]), ("A", "B", 2, ["t1", "p1", "t9"], ["p1"]), ("C", "D", 1, ["t3", "p3", "t7"], [])]


def test_central_papers_are_joined_by_evidence(spark):
    papers = frame(spark, [("a", 0.4), ("b", 0.3), ("c", 0.2), ("d", 0.1), ("e", 0.05)], "id string, pagerank double")
    e = edges_of(spark, [("a", "t"), ("t", "c"), ("b", "u"), ("u", "e"), ("c", "d")], "STUDIES")
    assert [(r.source, r.target, r.path) for r in R.central_paths(papers, e).collect()] == [("a", "c", ["a", "t", "c"]), ("c", "d", ["c", "d"])]
    n = frame(spark, [("a", "Paper A"), ("t", None)], "id string, name string")
    assert R.labelled_path(R.central_paths(papers, e), n).where("source = 'a'").first().label == "Paper A → t → c"


# --- retrieval, evidence and tools


def graph(spark):
    n = frame(spark, [("p1", "Paper", "One", 2020, "f"), ("p2", "Paper", "Two", None, "f"), ("t", "Topic", "Agent memory", None, "f"), ("t2", "Topic", "Planning", None, "g"), ("far", "Paper", "Far", 2021, "g")], "id string, label string, name string, year int, field string")
    return n, edges_of(spark, [("p1", "t"), ("p2", "t"), ("far", "t2")], "STUDIES")


def test_retrieval_orders_papers_and_gathers_what_touches_them(spark):
    n, e = graph(spark)
    m = frame(spark, [("p1", 0.01, 0.5, 3, "x"), ("p2", 0.02, 0.0, 1, "x"), ("far", 0.9, 0.0, 1, "y")], "id string, pagerank double, betweenness double, degree int, community string")
    seeds = frame(spark, [("t", 1.0), ("p1", 0.2)], "id string, score double")
    claims = frame(spark, [("c2", "y" * 300, "p2"), ("c1", "x", "p1"), ("c3", "z", "far")], "id string, text string, paper string")
    conflicts = frame(spark, [("c1", "c3", "p1", "far", 0.9), ("c3", "c4", "far", "other", 0.95)], "claim_a string, claim_b string, paper_a string, paper_b string, score double")
    predicted = frame(spark, [("t", "t2", "PREDICTED_LINK", 0.7), ("t2", "t3", "PREDICTED_LINK", 0.9)], "src string, dst string, type string, weight double")
    profiles = frame(spark, [("x", 2), ("y", 1)], "community string, papers int")
    c = R.retrieval_context(n, e, seeds, claims=claims, metrics=m, profiles=profiles, conflicts=conflicts, predicted=predicted)
    # .2 + 30 * .01 = .5 lies before... 30 * .02 = .6
    assert [(r.pos, r.id) for r in c["papers"].orderBy("pos").collect()] == [(1, "p2"), (2, "p1")]
    assert [r.id for r in c["claims"].collect()] == ["c1", "c2"] and [r.claim_a for r in c["conflicts"].collect()] == ["c1"]
    assert [(r.community, r.retrieved_papers) for r in c["communities"].collect()] == [("x", 2)] and [(r.src, r.dst) for r in c["predicted"].collect()] == [("t", "t2")]
    assert [r.path for r in c["paths"].collect()] == [["p2", "t", "p1"]]
    told = R.evidence_list(c).orderBy("pos").collect()
    assert [(r.pos, r.kind, r.id) for r in told] == [(1, "paper", "p2"), (2, "paper", "p1"), (13, "claim", "c1"), (14, "claim", "c2")] and len(told[-1].title) == 180
    d = {r.id: r for r in R.describe(n, m, "seed").collect()}
    assert (d["p1"].pagerank, d["p1"].degree, d["t"].pagerank, d["t"].degree, d["t"].community, d["p1"].type) == (0.01, 3, 0.0, 0, None, "Paper")


def test_tools_filter_fall_back_and_bound_their_limits(spark):
    n, e = graph(spark)
    conflicts = frame(spark, [("a", "b", "p1", "p2", 0.9, "memory helps", "it hurts"), ("c", "d", "p3", "p4", 0.5, "planning helps", None)], "claim_a string, claim_b string, paper_a string, paper_b string, score double, text_a string, text_b string")
    predicted = frame(spark, [("t", "t2", 0.7)], "src string, dst string, weight double")
    ranked = frame(spark, [("A", "B", 1, 70.0), ("A", "C", 2, 60.0)], "a string, b string, rank int, score double")
    evidence = frame(spark, [("A", "B", 1, "p1", "bridge"), ("A", "C", 1, "p2", "bridge")], "a string, b string, pos int, paper string, role string")
    asked = []
    t = R.standard_tools(n, e, conflicts=conflicts, predicted=predicted, opportunities=lambda *a: asked.append(a) or ranked, evidence=evidence)
    call = lambda name, **a: t.call(spark, name, **a)["result"].collect()
    assert [r.claim_a for r in call("find_conflicting_claims", topic="MEMORY")] == ["a"]
    assert [(r.claim_a, r.matched) for r in call("find_conflicting_claims", topic="nothing")] == [("a", False), ("c", False)]
    assert [r.claim_a for r in call("find_conflicting_claims", limit=0)] == ["a"]
    assert [r.src_name for r in call("find_potential_connections", topic="planning")] == ["Agent memory"] and call("find_potential_connections", topic="zzz") == []
    assert len(call("find_research_gaps", topic="x", top_k="99")) == 2 and asked[-1] == ("x", None, None, 12)
    assert [r.paper for r in call("get_evidence", index=0)] == ["p1"] and [r.paper for r in call("get_evidence", index=7)] == ["p2"]
    assert t.call(spark, "nope") == {"ok": False, "error": "unknown tool 'nope'"} and not t.call(spark, "get_paper", other=1)["ok"]
    with pytest.raises(RuntimeError):  # a fault of the engine is no answer
        t.add("broken", lambda s: (_ for _ in ()).throw(RuntimeError("x")))
        t.call(spark, "broken")


def test_an_answer_names_its_evidence(spark):
    n, e = graph(spark)
    m = frame(spark, [("p1", 0.01, "x"), ("p2", 0.02, "x")], "id string, pagerank double, community string")
    claims = frame(spark, [("c1", "memory helps", "p1")], "id string, text string, paper string")
    context = R.retrieval_context(n, e, frame(spark, [("t", 1.0)], "id string, score double"), claims=claims, metrics=m)
    gaps = frame(spark, [("A", "B", 1, "Medium", "A and B: score 60")], "a string, b string, rank int, confidence string, rationale string")
    got = R.synthesize("What is emerging in memory?", context, gaps)
    assert got["confidence"] == "medium" and got["used"] == {"papers": 2, "claims": 1, "conflicts": 0, "opportunities": 1}
    assert "Two" in got["answer"] and "One (2020)" in got["answer"] and "Opportunity 1: A and B: score 60" in got["answer"] and R.NOTICE in got["answer"]
    assert {r.id for r in got["evidence"].collect()} == {"p1", "p2", "c1"} and got["follow_ups"]
    none = R.synthesize("?", R.retrieval_context(n, e, frame(spark, [("zz", 1.0)], "id string, score double")))
    assert none["confidence"] == "low" and "Nothing in the corpus" in none["answer"]


def test_entities_by_dictionary_alias_and_title(spark):
    from graphloom.operators import claims as C

    papers = frame(spark, [(1, "Multi-agent systems for RAG", "We use chain-of-thought on the gsm8k set; accuracy rises. Multi-agent systems win."), (2, "A Study of llm-Based Sorting Networks, etc", None), (3, None, "society of minds"), (4, None, None)], "id int, title string, abstract string")
    got = C.extract_entities(
        papers, {"Topic": ["multi-agent systems", "tool use"], "Method": ["chain-of-thought"], "Dataset": ["gsm8k"], "Metric": ["accuracy", "for"]},
        aliases=[("society of minds", "multi-agent systems"), ("rag", "retrieval augmentation"), ("multi-agent", "multi-agent systems")], acronyms={"gsm8k": "GSM8K", "llm": "LLM"}, small=["of"],
    )
    rows = sorted((r.id, r.kind, r.entity, r.field, r.offset) for r in got.collect())
    assert rows == [
        (1, "Dataset", "GSM8K", "abstract", 31), (1, "Method", "Chain-Of-Thought".replace("Of", "of"), "abstract", 7), (1, "Metric", "Accuracy", "abstract", 42), (1, "Topic", "Multi-Agent Systems", "title", 0),
        (1, "Topic", "Retrieval Augmentation", "title", 24), (2, "Topic", "Study LLM-Based Sorting", "abstract", 0), (3, "Topic", "Multi-Agent Systems", "abstract", 0),
    ]


# --- concepts


def test_query_relevance_counts_aliases_half(spark):
    named = frame(spark, [("A", "Language model planning"), ("B", "Agentic llm"), ("C", "the of"), ("D", "Graphs")], "cluster string, name string")
    got = {r.cluster: r.relevance for r in K.query_relevance(named, "llm planning").collect()}
    # asked llm, planning; aliases of llm: language, model, ai
    assert got == {"A": pytest.approx(0.5 + 0.5 * 2 / 3, abs=1e-6), "B": 0.5, "C": 0.2, "D": 0.0}
    assert {r.relevance for r in K.query_relevance(named, "the").collect()} == {1.0}


def test_bridging_scores_weigh_communities_met(spark):
    e = edges_of(spark, [("h", x) for x in "abcdefgh"[:7]])
    n = nodes_of(spark, "habcdefg")
    between = frame(spark, [("h", 0.5)], "id string, betweenness double")
    labels = frame(spark, [(x, x) for x in "abcdefgh"], "id string, community string")
    got = {r.id: r.bridge_score for r in A.bridging_scores(n, e, between, labels).collect()}
    assert got["h"] == pytest.approx(0.6 * 0.5 + 0.4) and got["b"] == pytest.approx(0.4)


def test_distinct_clusters_as_a_plain_greedy_loop(spark):
    members, names, own = [], [], []
    for k in range(60):
        papers = [p for p in range(40) if (p * 7 + k * 13) % (3 + k % 5) == 0][: 3 + k % 20]
        own += [(f"c{k:02d}", p) for p in papers]
        members.append((f"c{k:02d}", f"t{k}"))
        names.append((f"c{k:02d}", "fine" if k % 3 else "cluster", f"n{k % 25}"))
    sets = {}
    for c, p in own:
        sets.setdefault(c, set()).add(p)
    kept = []
    for c, g, n in sorted((x for x in names if x[0] in sets), key=lambda x: (-len(sets[x[0]]), x[0])):
        if all(g != g2 or (n != n2 and len(sets[c] & sets[c2]) <= 0.8 * min(len(sets[c]), len(sets[c2]))) for c2, g2, n2 in kept):
            kept.append((c, g, n))
    got = W.distinct_clusters(frame(spark, members, "cluster string, topic string"), frame(spark, names, "cluster string, granularity string, name string"), frame(spark, own, "cluster string, paper int"))
    assert sorted(r.cluster for r in got.collect()) == sorted(c for c, _, _ in kept)


# --- vectors


@pytest.mark.parametrize("block", [7, 2048])
def test_the_index_finds_what_all_pairs_find(spark, block):
    import random

    from graphloom.operators import vectors as V

    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    rows = [(k, [x + r.gauss(0, 0.4) for x in base[k % 9]]) for k in range(260)] + [(1000 + k, base[0]) for k in range(60)] + [(5000, [0.0] * 12)]
    v = frame(spark, rows, "id long, vec array<double>")
    found, exact = V.index_knn(v, 4, lists=9, probes=4, block=block), V.knn(v, 4)
    assert V.recall(found, exact).first().recall >= 0.9 and V.recall(exact, exact).first().recall == 1.0
    every = {(x.id, x.other): x.score for x in V.index_knn(v, 4, lists=9, probes=9, block=block).collect()}
    assert every == {(x.id, x.other): x.score for x in exact.collect()}
    assert V.index_knn(v.limit(0), 4).collect() == []


def test_betweenness_refuses_what_no_task_can_hold(spark):
    with pytest.raises(ValueError):
        A.betweenness(nodes_of(spark, "ab"), edges_of(spark, [("a", "b"), ("b", "a")]), most=3)


# --- queries without SQL


def rows_of(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def test_cluster_names_as_a_plain_greedy_loop(spark):
    from graphloom.functions import text as X

    by = {}
    for r in rows_of(spark, "name_scores"):
        by.setdefault(r.cluster, []).append(r)
    want = {}
    for c, rows in by.items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.distinctiveness, -r.local, r.name)):
            t = {X.py_stem(w) for w in re.findall(X.TOKEN, r.name.lower()) if w not in X.STOPWORDS}
            if t and len(kept) < 3 and not any(t <= k or k <= t for _, k in kept):
                kept.append((r.name, t))
        if any(re.findall(X.TOKEN, r.name.lower()) for r in rows):
            want[c] = " · ".join(n for n, _ in kept)
    assert {r.cluster: r.name for r in rows_of(spark, "cluster_names")} == want


def test_pagerank_of_parts_by_plain_rounds(spark):
    got = {r.id: r.pagerank for r in rows_of(spark, "pagerank_parts")}
    near = {}
    for r in catalog.queries()["related_links"](spark, DATA).select("src", "dst").collect():
        near.setdefault(str(r.src), []).append(str(r.dst))
        near.setdefault(str(r.dst), []).append(str(r.src))
    rank = dict.fromkeys(got, 1 / len(got))
    for _ in range(60):
        lost = sum(v for k, v in rank.items() if k not in near)
        rank = {k: 0.15 / len(got) + 0.85 * (sum(rank[u] / len(near[u]) for u in near.get(k, ())) + lost / len(got)) for k in got}
    assert got == pytest.approx(rank, abs=1e-5) and sum(got.values()) == pytest.approx(1)


def test_communities_of_parts_are_connected_and_beat_their_parts(spark):
    from graphloom.plans.catalog_algorithms import parts_graph

    e = parts_graph(spark, DATA)
    labels = catalog.queries()["louvain"](spark, DATA)
    own = {r.id: r.community for r in labels.collect()}
    near = {}
    for r in e.collect():
        if own[r.src] == own[r.dst]:
            near.setdefault(r.src, set()).add(r.dst)
            near.setdefault(r.dst, set()).add(r.src)
    for c in set(own.values()):
        members = {k for k, v in own.items() if v == c}
        seen, todo = {c}, [c]
        while todo:
            for v in near.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        assert c == min(members) and seen == members
    best = A.modularity(e, labels).first()[0]
    alone = A.modularity(e, labels.withColumn("community", F.col("id"))).first()[0]
    whole = A.modularity(e, labels.withColumn("community", F.lit("x"))).first()[0]
    assert best > alone and best >= whole


def test_lexical_embeddings_by_plain_hashing(spark):
    def fnv(s):
        h = 14695981039346656037
        for b in s.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    def blake(s):
        return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")

    bench = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    from graphloom.plans.catalog_text import made_claims

    said = {r.id: r.text for r in made_claims(spark, DATA).collect()}
    for name, texts, key, digest in (("lexical_embedding_blake2b", bench, "item_id", blake), ("lexical_embedding_fnv", said, "id", fnv)):
        for r in rows_of(spark, name):
            weights = Counter()
            for w in re.findall("[a-z0-9]+", (texts[r[key]] or "").lower()):
                weights["w:" + w] += 1.0
                if len(w) > 4:
                    for i in range(len(w) - 2):
                        weights["g:" + w[i : i + 3]] += 0.35
            v = [0.0] * 384
            for f, w in weights.items():
                v[digest(f) % 384] += w
            size = sum(x * x for x in v) ** 0.5 or 1.0
            assert list(r.vec) == pytest.approx([x / size for x in v], abs=1e-9)


def test_sampled_betweenness_and_composites_have_their_shape(spark):
    from graphloom.plans.catalog_algorithms import nations, parts_graph, trade_graph

    e = parts_graph(spark, DATA)
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    exact = {r.id: r.betweenness for r in A.betweenness(n, e).collect()}
    got = {r.id: r.betweenness for r in rows_of(spark, "betweenness_sampled")}
    assert set(got) == set(exact) and sum(got.values()) == pytest.approx(sum(exact.values()), rel=0.35)
    a = {r.id: r for r in rows_of(spark, "analytics_nations")}
    e = trade_graph(spark, DATA)
    rank = {r.id: round(r.pagerank, 6) for r in A.pagerank(nations(spark, DATA), e).collect()}
    assert {k: r.pagerank for k, r in a.items()} == pytest.approx(rank, abs=2e-6) and all(r.degree > 0 for r in a.values())
    c = rows_of(spark, "clusters")
    assert c and len({r.cluster for r in c}) <= 12 and Counter((r.cluster, r.topic) for r in c).most_common(1)[0][1] == 1 and min(Counter(r.cluster for r in c).values()) >= 2
