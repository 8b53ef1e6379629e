"""Graph operators and algorithms on graphs small enough to work out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import algorithms as A
from graphloom.operators import graph as N
from graphloom.operators import paths as H
from graphloom.sources import model


def edges_of(spark, pairs, type_="RELATED_TO"):
    return spark.createDataFrame([(a, b, type_, float(w[0]) if w else 1.0, False) for a, b, *w in pairs], "src string, dst string, type string, weight double, predicted boolean")


def nodes_of(spark, ids):
    return spark.createDataFrame([(i, "Topic", i, None) for i in ids], "id string, label string, name string, year int")


TRIANGLES = [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2"), ("b2", "b3"), ("b1", "b3"), ("a1", "b1")]
TOY = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")]


@pytest.mark.parametrize("most", [0, 10**6])
def test_pagerank_values(spark, most):
    got = {r.id: r.pagerank for r in A.pagerank(nodes_of(spark, ["a1", "a2", "a3", "b1", "b2", "b3"]), edges_of(spark, TRIANGLES), local_edges=most).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-9)
    assert got["a1"] == pytest.approx(0.208029, abs=1e-6) and got["a2"] == pytest.approx(0.145985, abs=1e-6)
    toy = {r.id: r.pagerank for r in A.pagerank(nodes_of(spark, "abcd"), edges_of(spark, TOY), local_edges=most).collect()}
    assert [toy[k] for k in "abcd"] == pytest.approx([0.245928, 0.245928, 0.366736, 0.141408], abs=1e-6)


@pytest.mark.parametrize("most", [0, 10**6])
def test_pagerank_spreads_dangling_mass(spark, most):
    got = {r.id: r.pagerank for r in A.pagerank(nodes_of(spark, "abz"), edges_of(spark, [("a", "b"), ("a", "a")]), local_edges=most).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-9) and got["a"] == pytest.approx(got["b"]) and got["z"] < got["a"]
    assert A.pagerank(nodes_of(spark, "a").limit(0), edges_of(spark, TOY)).collect() == []


@pytest.mark.parametrize("most", [0, 10**6])
def test_pagerank_leaves_out_unknown_ends_loops_and_null_ids(spark, most):
    e = edges_of(spark, [("a", "b"), ("c", "zz"), ("c", "c"), ("a", "b")])
    ids = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "id string")
    got = {r.id: r.pagerank for r in A.pagerank(ids, e, local_edges=most).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-9) and got == pytest.approx({"a": 0.465116, "b": 0.465116, "c": 0.069767}, abs=1e-6)


def test_pagerank_has_equal_rounds_in_both_forms(spark):
    e = edges_of(spark, [*TRIANGLES, ("a1", "z", 3.0), ("b2", "y")])
    ids = nodes_of(spark, ["a1", "a2", "a3", "b1", "b2", "b3", "z", "y", "alone"])
    one, many = ({r.id: r.pagerank for r in A.pagerank(ids, e, tolerance=1e-3, local_edges=k).collect()} for k in (10**6, 0))
    assert one == pytest.approx(many, abs=1e-12)


def test_weighted_paths_go_all_the_way(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}", 2.0) for i in range(70)]
    e = edges_of(spark, [*chain, ("n000", "n002", 0.9), ("m", "n070", 1.0), ("n000", "far", 0.01), ("n003", "far", 1.0), ("lone", "lone2")])
    got = {r.id: (r.distance, r.path) for r in H.weighted_paths(e, "n000", nodes_of(spark, ["n070", "m", "far", "n000", "lone"])).collect()}
    line = [f"n{i:03d}" for i in range(71)]
    assert got == {"n070": (35.0, line), "m": (36.0, [*line, "m"]), "far": (2.5, [*line[:4], "far"]), "n000": (0.0, ["n000"])}


def test_communities_and_modularity(spark):
    e = edges_of(spark, TRIANGLES)
    labels = A.louvain(nodes_of(spark, ["a1", "a2", "a3", "b1", "b2", "b3", "z"]), e)
    got = {r.id: r.community for r in labels.collect()}
    assert {got[k] for k in ("a1", "a2", "a3")} == {"a1"} and {got[k] for k in ("b1", "b2", "b3")} == {"b1"} and got["z"] == "z"
    assert A.modularity(e, labels).first()[0] == pytest.approx(0.357143, abs=1e-6)


def test_communities_in_the_distributed_form(spark):
    e = edges_of(spark, TRIANGLES)
    got = {r.id: r.community for r in A.louvain_distributed(nodes_of(spark, ["a1", "a2", "a3", "b1", "b2", "b3", "z"]), e).collect()}
    assert {got[k] for k in ("a1", "a2", "a3")} == {"a1"} and {got[k] for k in ("b1", "b2", "b3")} == {"b1"} and got["z"] == "z"
    assert A.louvain_distributed(nodes_of(spark, "ab"), e.limit(0)).count() == 2


def test_three_cliques_and_a_bridge(spark):
    pairs = [(f"c{c}_n{i}", f"c{c}_n{j}") for c in range(3) for i in range(6) for j in range(i)] + [("bridge", "c0_n0", 0.25), ("bridge", "c1_n0", 0.25)]
    e = edges_of(spark, pairs)
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    got = {r.id: r.community for r in A.louvain(n, e).collect()}
    assert len({got[f"c{c}_n1"] for c in range(3)}) == 3
    between = {r.id: r.betweenness for r in A.betweenness(n, e).collect()}
    assert between["bridge"] > 0


def test_betweenness_of_paths(spark):
    got = {r.id: r.betweenness for r in A.betweenness(nodes_of(spark, "abc"), edges_of(spark, [("a", "b"), ("b", "c")])).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 0.0}
    four = {r.id: r.betweenness for r in A.betweenness(nodes_of(spark, "abcd"), edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")])).collect()}
    assert four["b"] > four["a"] and four["c"] > four["d"]
    all_sources = A.betweenness(nodes_of(spark, "abcd"), edges_of(spark, TOY), samples=4).collect()
    assert {r.id: r.betweenness for r in all_sources} == {r.id: r.betweenness for r in A.betweenness(nodes_of(spark, "abcd"), edges_of(spark, TOY)).collect()}


def test_link_prediction(spark):
    r = A.link_prediction(edges_of(spark, [("a", "b"), ("b", "c")])).collect()
    assert [(x.a, x.b, x.common, x.jaccard) for x in r] == [("a", "c", 1, 1.0)] and r[0].adamic_adar == pytest.approx(1 / math.log(4), abs=1e-6)


@pytest.mark.parametrize("most", [0, 10**6])
def test_paths_and_components(spark, most):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("p", "q")])
    got = {r.id: (r.hops, r.path) for r in H.shortest_paths(e, "a", nodes_of(spark, "dq"), 4, local_edges=most).collect()}
    assert got == {"d": (2, ["a", "x", "d"])}
    assert {r.id: r.depth for r in H.distances(e, nodes_of(spark, "a"), 1, local_edges=most).collect()} == {"a": 0, "b": 1, "x": 1}
    assert {r.id: r.component for r in H.components(nodes_of(spark, "abcdxpqz"), e, local_edges=most).collect()} == {**dict.fromkeys("abcdx", "a"), "p": "p", "q": "p", "z": "z"}
    chain = edges_of(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)])
    assert {r.component for r in H.components(nodes_of(spark, [f"n{i:02d}" for i in range(31)]), chain, local_edges=most).collect()} == {"n00"}
    w = {r.id: r.distance for r in H.weighted_distances(edges_of(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.25)]), "a").collect()}
    assert w == {"a": 0.0, "b": 1.0, "c": 2.0}


def test_evidence_path_ignores_predictions(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c")], "STUDIES").unionByName(edges_of(spark, [("a", "c")], model.PREDICTED)).unionByName(edges_of(spark, [("a", "c")], "STUDIES").withColumn("predicted", F.lit(True)))
    assert H.evidence_path(e, "a", "c").first().path == ["a", "b", "c"]


def test_neighbourhoods(spark):
    e, n = edges_of(spark, TOY), nodes_of(spark, "abcd")
    assert {(r.other, r.direction) for r in N.neighbours(e, nodes_of(spark, "c")).collect()} == {("a", "in"), ("b", "in"), ("d", "out")}
    assert [r.id for r in N.frontier(e, nodes_of(spark, "ab")).collect()] == ["c"]
    assert {(r.src, r.dst) for r in N.induced(e, nodes_of(spark, "abd")).collect()} == {("a", "b")}
    assert {(r.a, r.b) for r in N.two_hop(e).collect()} == {("a", "d"), ("b", "d")}
    kept = N.neighbour_groups(e, n, nodes_of(spark, "c"), keep=2).collect()
    assert len(kept) == 2 and {r.total for r in kept} == {3}
    sub = H.subgraph(n, e, nodes_of(spark, "d"), depth=0, max_nodes=1)
    assert [r.id for r in sub["nodes"].collect()] == ["d"] and sub["note"].first().truncated


def test_zero_and_null_weights_count_one(spark):
    e = spark.createDataFrame([("a", "b", "X", 0.0), ("a", "c", "X", None), ("a", "d", "X", 2.0)], "src string, dst string, type string, weight double")
    assert {r.id: (r.degree, r.weighted) for r in N.degree(e).collect()}["a"] == (3, 4.0)


def test_year_rule(spark):
    y = spark.createDataFrame([(None,), (0,), (1995,), (2001,)], "year int").where(N.year_between(F.col("year"), 1990, 2000))
    assert [r.year for r in y.collect()] == [1995]


def test_search_ranks(spark):
    n = spark.createDataFrame([("1", "Topic", "Agent", None), ("2", "Topic", "agent memory", None), ("3", "Topic", "An agent's agent", None), ("4", "Topic", None, None)], "id string, label string, name string, year int")
    assert [(r.id, r.score) for r in N.search(n, " AGENT ").collect()] == [("1", 3.2), ("2", 1.2), ("3", 0.4)]
