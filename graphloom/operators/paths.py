"""Breadth-first operators: distances, paths, subgraphs and components, as frontier loops over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import local
from graphloom.operators.graph import adjacency, induced, simple
from graphloom.sources import model
from graphloom.sources.working import drop, keep


def distances(edges: DataFrame, sources: DataFrame, most: int, local_edges: int = local.EDGES) -> DataFrame:
    """(id, depth) of every node at most ``most`` hops from a source, by the undirected edges."""
    near = keep(simple(edges), "adjacency")
    if local.fits(near, local_edges):
        return local.distances(near, sources, most)
    seen = keep(sources.select("id", F.lit(0).alias("depth")).distinct(), "seen")
    front = seen
    for depth in range(1, most + 1):
        step = front.select(F.col("id").alias("src")).join(near, "src").select(F.col("dst").alias("id")).distinct()
        last, front = front, keep(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        old, seen = seen, keep(seen.unionByName(front), "seen")
        drop(last, old)
    drop(near, *([] if front is seen else [front]))
    return seen


def shortest_paths(edges: DataFrame, source: str, targets: DataFrame, most: int, local_edges: int = local.EDGES) -> DataFrame:
    """(id, hops, path): to each reachable target the shortest path, of several the least in order of its ids.

    A node keeps one path, the least, so the frontier holds a row per node.
    """
    near = keep(simple(edges), "adjacency")
    if local.fits(near, local_edges):
        return local.shortest_paths(near, source, most).join(targets.select("id").distinct(), "id", "left_semi")
    spark = edges.sparkSession
    seen = keep(spark.createDataFrame([(source, 0, [source])], "id string, hops int, path array<string>"), "paths")
    front = seen
    for depth in range(1, most + 1):
        step = front.select(F.col("id").alias("src"), "path").join(near, "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        step = step.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")).groupBy("id").agg(F.min("path").alias("path"))
        last, front = front, keep(step.select("id", F.lit(depth).alias("hops"), "path"), "front")
        if front.isEmpty():
            break
        old, seen = seen, keep(seen.unionByName(front), "paths")
        drop(last, old)
    drop(near, *([] if front is seen else [front]))
    return seen.join(targets.select("id").distinct(), "id", "left_semi")


def observed(edges: DataFrame) -> DataFrame:
    """Edges of observed types that aren't predicted."""
    e = edges.where(F.col("type").isin(model.OBSERVED))
    return e.where(~F.coalesce("predicted", F.lit(False))) if "predicted" in edges.columns else e


def evidence_path(edges: DataFrame, source: str, target: str, most: int = 4) -> DataFrame:
    """The shortest path over observed, non-predicted edges, at most four hops."""
    one = edges.sparkSession.createDataFrame([(target,)], "id string")
    return shortest_paths(observed(edges), source, one, min(most, 4))


def pair_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, hops, path) of each of ``pairs`` (source, target, most) with a path of at most ``most`` hops.

    Of several shortest paths the least in order of its ids counts.  Paths of up to two hops are read off the edges at the pairs'
    ends, which meet in the middle, so no neighbourhood is spread by pair.  What is left goes level by level together; a pair is
    done when its target is met, so cost is that of the pairs' own neighbourhoods: meant for few pairs.
    """
    p = keep(pairs.groupBy("source", "target").agg(F.max("most").alias("most")), "pairs")
    ends = keep(p.select(F.explode(F.array("source", "target")).alias("end")).distinct(), "pair-ends")
    way = lambda a, b: F.struct(F.col(a).alias("end"), F.col(b).alias("mid"))
    at = edges.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("x")).select("x.*").where("end <> mid").join(ends, "end", "left_semi")
    none = p.where("source = target and most >= 0").select("source", "target", F.array("source").alias("path"))
    one = at.toDF("source", "target").join(p.where("most >= 1"), ["source", "target"], "left_semi").distinct().select("source", "target", F.array("source", "target").alias("path"))
    # a node between is met once with all ends beside it, and of the nodes between the same ends the least counts
    beside = at.groupBy("mid").agg(F.array_sort(F.collect_set("end")).alias("ends")).where("size(ends) > 1").groupBy("ends").agg(F.min("mid").alias("mid"))
    met = beside.select("ends", "mid", F.explode("ends").alias("source")).select("mid", "source", F.explode("ends").alias("target")).where("source <> target")
    two = met.join(p.where("most >= 2").select("source", "target"), ["source", "target"]).groupBy("source", "target").agg(F.min("mid").alias("mid")).select("source", "target", F.array("source", "mid", "target").alias("path"))
    every = none.unionByName(one).unionByName(two).groupBy("source", "target").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("x"))
    found = keep(every.select("source", "target", (F.col("x.n") - 1).alias("hops"), "x.path"), "pair-paths")
    rest = keep(p.where("most > 2").join(found, ["source", "target"], "left_anti"), "pairs")
    drop(p, ends)
    return found if rest.isEmpty() else found.unionByName(_by_level(edges, rest))


def _by_level(edges: DataFrame, p: DataFrame) -> DataFrame:
    near = keep(simple(edges), "adjacency")
    front = seen = keep(p.select("source", "target", "most", F.col("source").alias("id"), F.array("source").alias("path")), "pair-paths")
    most = p.agg(F.max("most")).first()[0] or 0
    met = seen.where("id = target")
    for depth in range(1, most + 1):
        todo = front.where(F.col("most") >= depth).join(met.select("source", "target"), ["source", "target"], "left_anti")
        step = todo.select("source", "target", "most", F.col("id").alias("src"), "path").join(near, "src").select("source", "target", "most", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen.select("source", "target", "id"), ["source", "target", "id"], "left_anti").groupBy("source", "target", "most", "id").agg(F.min("path").alias("path"))
        last, front = front, keep(step, "pair-paths")
        if front.isEmpty():
            break
        old, seen = seen, keep(seen.unionByName(front), "pair-paths")
        met = seen.where("id = target")
        drop(last, old)
    drop(near, *([] if front is seen else [front]))
    return met.select("source", "target", (F.size("path") - 1).alias("hops"), "path")


def _lengths(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("src", "dst").agg(F.min(1 / F.greatest("weight", F.lit(1e-6))).alias("len"))


def weighted_distances(edges: DataFrame, source: str) -> DataFrame:
    """(id, distance) of every node that can be reached, with lengths 1 / max(1e-6, weight): relaxation until nothing improves.

    A round costs a join with the nodes that have just improved; there are as many as the longest shortest path has hops.
    """
    a = keep(_lengths(edges), "lengths")
    best = keep(edges.sparkSession.createDataFrame([(source, 0.0)], "id string, distance double"), "best")
    front = best
    while not front.isEmpty():
        step = front.select(F.col("id").alias("src"), "distance").join(a, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("len")).alias("new"))
        better = step.join(best, "id", "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance") - 1e-12))
        last, front = front, keep(better.select("id", F.col("new").alias("distance")), "front")
        old, best = best, keep(best.join(front.select("id"), "id", "left_anti").unionByName(front), "best")
        drop(last, old)
    drop(a, front)
    return best


def weighted_paths(edges: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """(id, distance, path): to each target (id) that can be reached the path of least length.

    Of several ways into a node the one from the least id counts.  Paths are followed back from the targets alone.
    """
    best = weighted_distances(edges, source)
    at = best.select(F.col("id").alias("src"), F.col("distance").alias("d"))
    into = _lengths(edges).join(at, "src").join(best, F.col("dst") == F.col("id")).where((F.col("id") != source) & (F.abs(F.col("d") + F.col("len") - F.col("distance")) <= 1e-9))
    before = keep(into.groupBy("id").agg(F.min("src").alias("before")), "before")
    found = best.join(targets.select("id").distinct(), "id", "left_semi").select("id", "distance", F.array("id").alias("path"), F.col("id").alias("now"))
    found = keep(found, "paths")
    while not found.where(F.col("now") != source).isEmpty():
        step = found.join(before.select(F.col("id").alias("now"), "before"), "now", "left")
        found = keep(step.select("id", "distance", F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat(F.array("before"), "path")).alias("path"), F.coalesce("before", F.lit(source)).alias("now")), "paths")
    return found.drop("now")


def components(nodes: DataFrame, edges: DataFrame, local_edges: int = local.EDGES) -> DataFrame:
    """(id, component): the least id that each node reaches; contraction of edges to least neighbours."""
    near = keep(simple(edges), "links")
    if local.fits(near, local_edges):
        return local.components(nodes.select("id").distinct(), near).join(nodes.select("id").distinct(), "id", "left_semi")
    e = near.toDF("a", "b")
    root = keep(nodes.select("id", F.col("id").alias("component")).distinct(), "roots")
    while not e.isEmpty():
        par = e.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        up = par.select(F.col("a").alias("p"), F.col("p").alias("q"))
        par = keep(par.join(up, "p").select("a", F.col("q").alias("p")), "parents")
        old, root = root, keep(root.join(par.select(F.col("a").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component")), "roots")
        pb = par.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        last, e = e, keep(e.join(par, "a").join(pb, "b").where("p <> pb").select(F.col("p").alias("a"), F.col("pb").alias("b")).distinct(), "links")
        drop(old, last, par, near)
    drop(e)
    return root


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, depth: int = 1, types: list[str] | None = None, low: int | None = None, high: int | None = None, max_nodes: int = 400, max_edges: int = 1200) -> dict[str, DataFrame]:
    """Nodes within depth + 1 levels of the seeds (depth at most 3), induced edges, caps and a note where a cap cut.

    Filters hold for levels past the seeds.  Caps keep the nearest nodes, then the least ids.
    """
    from graphloom.operators.graph import year_between

    e = edges.where(F.col("type").isin(types)) if types else edges
    found = distances(e, seeds, min(depth, 3) + 1).join(nodes, "id")
    if low is not None or high is not None:
        found = found.where((F.col("depth") == 0) | year_between(F.col("year"), low or 0, high or 9999))
    kept = found.orderBy("depth", "id").limit(max_nodes)
    inside = induced(e, kept.select("id"))
    note = found.agg((F.count(F.lit(1)) > max_nodes).alias("truncated"))
    return {"nodes": kept, "edges": inside.orderBy("src", "dst", "type").limit(max_edges), "note": note}


def retrieval_expand(edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 90) -> DataFrame:
    """(id, depth): ``depth`` levels with the seeds as the first, at most 90 nodes, nearest first."""
    return distances(edges, seeds, depth - 1).orderBy("depth", "id").limit(most)
