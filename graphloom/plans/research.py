"""Composite plans: opportunities, paper ranking, retrieval context, investigation, tools and reports."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.vectors import cosine
from graphloom.operators import aggregates as G
from graphloom.operators import gaps as O
from graphloom.operators import graph as N
from graphloom.operators import paths as H
from graphloom.sources.working import keep

NOTICE = "A hypothesis from the analysed corpus, to be checked independently; absence here proves nothing about work elsewhere."


def find_gaps(members: DataFrame, studies: DataFrame, papers: DataFrame, links: DataFrame, vectors: DataFrame, *, names: DataFrame | None = None, top: int = 10, recent: int = O.RECENT, bridge_recent: int = O.BRIDGE_RECENT) -> DataFrame:
    """Ranked opportunities: features, rejection of entangled or nested pairs, score, labels, and rank by score bucket."""
    members, studies, papers, links = keep(members, "members"), keep(studies, "studies"), keep(papers, "papers"), keep(links, "links")
    own = keep(O.cluster_papers(members, studies), "own")
    names = names if names is not None else members.select("cluster").distinct().select("cluster", F.array(F.lower("cluster")).alias("words"))
    bad = O.rejections(names, members, own)
    f = O.score(O.features(members, studies, papers, links, vectors, recent, bridge_recent)).join(bad, ["a", "b"]).where("reason is null").drop("reason")
    f = f.withColumns({"confidence": O.confidence(F.col("score"), F.col("scoped_papers")), "trajectory": O.trajectory(F.col("bridges_recent"), F.col("bridges_older")), "key": F.concat_ws("|", "a", "b"), "relevance": F.lit(1.0)})
    best = f.orderBy(F.bround(F.col("score") / 2.5, 0).desc(), F.desc("relevance"), "key").limit(top)
    out = G.bucket_rank(best, "score", "relevance", "key")
    return out.withColumn("rationale", F.format_string("%s and %s: score %.1f over %d papers, %d bridges, %s. %s", "a", "b", "score", "scoped_papers", "bridge_papers", "trajectory", F.lit(NOTICE))).drop("key")


def question_terms(question: str, scope: str | None = None) -> list[str]:
    """Stemmed words of a question, and of its compounds' parts, without noise, generic terms and the scope's words."""
    import re

    def split(text: str) -> set[str]:
        out = set()
        noise = set(X.QUESTION_NOISE) | set(X.STOPWORDS)
        for raw in (t for t in re.findall(X.TOKEN, (text or "").lower()) if t not in X.STOPWORDS):
            for part in (raw, *raw.replace("_", "-").split("-")):
                s = X.py_stem(part)
                if len(s) > 1 and s not in noise:
                    out.add(s)
        return out

    return sorted(split(question) - set(X.GENERIC_TERMS) - split(scope or ""))


def compound_tokens(c):
    """The same splitting as ``question_terms`` for a column."""
    noise = sorted(set(X.QUESTION_NOISE) | set(X.STOPWORDS))
    parts = F.flatten(F.transform(X.tokens(c), lambda t: F.concat(F.array(t), F.split(F.replace(t, F.lit("_"), F.lit("-")), "-"))))
    return F.array_distinct(F.filter(F.transform(parts, X.stem), lambda t: (F.length(t) > 1) & ~t.isin(noise)))


def rank_papers(papers: DataFrame, question: str, *, scope: str | None = None, seeds: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(id, relevance, matched, year) of papers (id, title, summary, taxonomy, year) that share a term with the question.

    idf-weighted coverage of the title .52, summary .30 and taxonomy .18, and .05 for a retrieval seed, over 1.05.
    """
    terms = question_terms(question, scope)
    if not terms:
        return papers.limit(0).select("id", F.lit(0.0).alias("relevance"), F.lit("").alias("matched"), "year")
    p = papers.select("id", "year", "title", *[F.array_intersect(compound_tokens(F.col(c)), X.words(terms)).alias(f"t_{c}") for c in ("title", "summary", "taxonomy")])
    p = p.withColumn("t_all", F.array_distinct(F.concat("t_title", "t_summary", "t_taxonomy")))
    # one pass for all document frequencies: a row of counters, as many as the question has terms
    counts = p.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("t_all", t)).alias(f"d{i}") for i, t in enumerate(terms)]).first()
    weight = {t: math.log(1 + (max(1, counts["n"]) + 0.5) / (counts[f"d{i}"] + 0.5)) for i, t in enumerate(terms)}
    whole = sum(weight.values())
    cover = lambda c: sum((F.when(F.array_contains(c, t), w).otherwise(0.0) for t, w in weight.items()), F.lit(0.0)) / whole
    p = p.where(F.size("t_all") > 0)
    if seeds is not None:
        top = seeds.agg(F.max("score").alias("top"))
        p = p.join(seeds.select("id", "score"), "id", "left").join(F.broadcast(top))  # one row
        seed = F.coalesce(F.try_divide("score", "top"), F.lit(0.0))
    else:
        seed = F.lit(0.0)
    score = (0.52 * cover("t_title") + 0.30 * cover("t_summary") + 0.18 * cover("t_taxonomy") + 0.05 * seed) / 1.05
    out = p.select("id", "year", "title", F.round(score, 4).alias("relevance"), F.array_join(F.array_sort("t_all"), ",").alias("matched"))
    return out.orderBy(F.desc("relevance"), F.desc(F.coalesce("year", F.lit(0))), F.lower("title"), "id").limit(limit).select("id", "relevance", "matched", "year")


def coverage_report(ranked: DataFrame, question: str, scope: str | None = None) -> DataFrame:
    """One row: question terms, how many a returned paper has, their share (3 dp), and the span of years."""
    terms = question_terms(question, scope)
    hit = ranked.select(F.explode(F.split("matched", ",")).alias("t")).agg(F.countDistinct("t").alias("hit"))
    span = ranked.agg(F.count(F.lit(1)).alias("papers"), F.min("year").alias("first"), F.max("year").alias("last"))
    return span.join(F.broadcast(hit)).select("papers", "first", "last", F.lit(len(terms)).alias("terms"), "hit", F.round(F.col("hit") / max(1, len(terms)), 3).alias("coverage"))


def coverage_counts(papers: DataFrame) -> DataFrame:
    """(kind, name, n) of papers (field, summary_source): how many of each, the nameless left out."""
    each = papers.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("field", "summary_source")])).alias("x")).select("x.*")
    return each.where("name is not null and name <> ''").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def candidate_relevance(candidates: DataFrame, question: str, scope: str | None = None) -> DataFrame:
    """(key, relevance, supported) of candidates (key, labels): .82 question and .18 scope coverage of their words."""
    terms, scoped = question_terms(question, scope), question_terms(scope or "")
    toks = compound_tokens(F.col("labels"))
    hit = F.size(F.array_intersect(toks, X.words(terms))) if terms else F.lit(0)
    near = F.size(F.array_intersect(toks, X.words(scoped))) if scoped else F.lit(0)
    q, s = hit / max(1, len(terms)), near / max(1, len(scoped))
    score = 0.82 * q + 0.18 * s if terms and scoped else (q if terms else s)
    enough = (hit >= min(2, len(terms))) & (hit > 0) if terms else s >= 0.5
    return candidates.select("key", F.round(score, 4).alias("relevance"), enough.alias("supported"))


def vector_seeds(vectors: DataFrame, query: list[float], k: int = 8, least: float = 0.0) -> DataFrame:
    """(id, score) of the nearest vectors."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return vectors.select("id", F.round(cosine(F.col("vec"), q), 6).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def retrieval_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, depth: int = 2, most: int = 90, claims: DataFrame | None = None, metrics: DataFrame | None = None, profiles: DataFrame | None = None, conflicts: DataFrame | None = None, predicted: DataFrame | None = None) -> dict[str, DataFrame]:
    """Frames for a prompt: nodes by level with seed scores, edges among them, and what is known of the nodes reached.

    ``papers`` are ordered by seed score + 30 * PageRank of ``metrics`` (id, pagerank, community).  With the frames given there are
    also ``claims`` of the papers (25 at most), ``communities`` of most papers reached (six), ``conflicts`` of the 25 strongest that
    a paper is in, ``predicted`` of the 80 heaviest links that touch a topic reached, and ``paths``: of each of the four papers
    first by PageRank, the evidence path of at most three hops to the first later one that has any.
    """
    reached = keep(H.retrieval_expand(edges, seeds.select("id"), depth, most), "reached")
    found = reached.join(nodes, "id").join(seeds.select("id", "score"), "id", "left").orderBy("depth", F.desc(F.coalesce("score", F.lit(0.0))), "id")
    out = {"nodes": found, "edges": N.induced(edges, reached.select("id"))}
    known = metrics if metrics is not None else nodes.select("id", F.lit(0.0).alias("pagerank"), F.lit(None).cast("string").alias("community"))
    papers = keep(found.where("label = 'Paper'").join(known.select("id", "pagerank", "community"), "id", "left").withColumns({"score": F.coalesce("score", F.lit(0.0)), "pagerank": F.coalesce("pagerank", F.lit(0.0))}), "papers")
    out["papers"] = paper_order(papers)
    ids = papers.select(F.col("id").alias("paper"))
    if claims is not None:
        out["claims"] = claims.join(ids, "paper", "left_semi").orderBy("id").limit(25)
    if profiles is not None:
        out["communities"] = papers.groupBy("community").agg(F.count(F.lit(1)).alias("retrieved_papers")).join(profiles, "community").orderBy(F.desc("retrieved_papers"), "community").limit(6)
    if conflicts is not None:
        out["conflicts"] = counter_evidence(conflicts.orderBy(F.desc("score"), "claim_a", "claim_b").limit(25), papers, 25)
    if predicted is not None:
        from graphloom.plans.views import predicted_links

        strong = predicted.orderBy(F.desc("weight"), "src", "dst").limit(80)
        out["predicted"] = predicted_links(strong, nodes, found.where("label = 'Topic'").select("id"), 80)
    if metrics is not None:
        out["paths"] = central_paths(papers, edges)
    return out


def paper_order(papers: DataFrame) -> DataFrame:
    """Papers (score, pagerank) with ``pos`` by score + 30 * PageRank, ties by id; a context's few."""
    return papers.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.col("score") + 30 * F.col("pagerank")), "id")))


def central_paths(papers: DataFrame, edges: DataFrame, first: int = 4, hops: int = 3) -> DataFrame:
    """(source, target, hops, path): of each of the ``first`` papers by PageRank, the observed path to the first later one in reach."""
    top = [r["id"] for r in papers.orderBy(F.desc("pagerank"), "id").limit(first).collect()]
    two = [(a, b, hops, i, j) for i, a in enumerate(top) for j, b in enumerate(top) if i < j]
    pairs = papers.sparkSession.createDataFrame(two, "source string, target string, most int, i int, j int")
    got = H.pair_paths(H.observed(edges), pairs.select("source", "target", "most")).join(pairs, ["source", "target"])
    return G.top_k(got, 1, ["source"], [F.col("j")]).orderBy("i").select("source", "target", "hops", "path")


def candidate_paths(edges: DataFrame, members: DataFrame, candidates: DataFrame, bridges: DataFrame) -> DataFrame:
    """(a, b, pos, path, bridge_papers): at most two observed paths for each candidate pair of clusters (a, b).

    Ends that touch one of the first three ``bridges`` (a, b, pos, paper) come first: the least topic of either cluster
    (members: cluster, topic) that the paper studies or uses, at most three hops apart.  A pair without such ends is tried on the
    first four topics of either side, four hops.  Of all ends three are followed; paths that repeat count once.
    """
    link = edges.where(F.col("type").isin("STUDIES", "USES_METHOD")).select(F.explode(F.array(F.struct(F.col("src").alias("paper"), F.col("dst").alias("topic")), F.struct(F.col("dst").alias("paper"), F.col("src").alias("topic")))).alias("x")).select("x.*")
    bridges = keep(bridges, "bridges")
    b = G.top_k(bridges.join(candidates.select("a", "b"), ["a", "b"], "left_semi"), 3, ["a", "b"], [F.col("pos"), F.col("paper")]).select("a", "b", F.col("rank").alias("r"), "paper")
    touch = keep(keep(b, "first-bridges").join(link, "paper").distinct(), "touch")  # the few bridges go to the links, not the links to them
    side = lambda c: touch.join(members.toDF(c, "topic"), [c, "topic"]).groupBy("a", "b", "r").agg(F.min("topic").alias(f"end_{c}"))
    one = side("a").join(side("b"), ["a", "b", "r"]).select("a", "b", "r", F.col("end_a").alias("source"), F.col("end_b").alias("target"), F.lit(3).alias("most"))
    one = keep(one, "bridged")
    rest = candidates.select("a", "b").join(one, ["a", "b"], "left_anti")
    few = G.top_k(members, 4, ["cluster"], [F.col("topic")]).select("cluster", "topic", "rank")
    two = rest.join(few.toDF("a", "source", "i"), "a").join(few.toDF("b", "target", "j"), "b").select("a", "b", (F.col("i") * 4 + F.col("j")).alias("r"), "source", "target", F.lit(4).alias("most"))
    ends = keep(G.top_k(one.unionByName(two), 3, ["a", "b"], [F.col("r")]).select("a", "b", F.col("rank").alias("r"), "source", "target", "most"), "ends")
    got = ends.join(H.pair_paths(H.observed(edges), ends.select("source", "target", "most")), ["source", "target"]).where(F.col("hops") <= F.col("most"))
    got = G.top_k(got.groupBy("a", "b", "path").agg(F.min("r").alias("r")), 2, ["a", "b"], [F.col("r")])
    known = bridges.groupBy("a", "b").agg(F.collect_set("paper").alias("known"))
    return got.join(known, ["a", "b"], "left").select("a", "b", F.col("rank").alias("pos"), "path", F.array_sort(F.array_intersect("path", F.coalesce("known", F.array().cast("array<string>")))).alias("bridge_papers"))


def evidence_list(context: dict[str, DataFrame]) -> DataFrame:
    """(pos, kind, id, title) that an answer cites: the first twelve papers, then the first eight claims, cut to 180 characters."""
    p = context["papers"].where("pos <= 12").select("pos", F.lit("paper").alias("kind"), "id", F.coalesce("name", "id").alias("title"))
    if "claims" not in context:
        return p
    c = context["claims"].withColumn("pos", F.row_number().over(Window.orderBy("id"))).where("pos <= 8")  # 25 rows at most
    return p.unionByName(c.select((F.col("pos") + 12).alias("pos"), F.lit("claim").alias("kind"), "id", F.substring("text", 1, 180).alias("title")))


def describe(nodes: DataFrame, metrics: DataFrame, reason: str) -> DataFrame:
    """(id, label, type, reason, year, field, pagerank, betweenness, degree, community) of each node, metrics to six digits, 0 where unknown."""
    m = metrics.select("id", "pagerank", "betweenness", "degree", "community")
    six = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return nodes.join(m, "id", "left").select("id", F.col("name").alias("label"), F.col("label").alias("type"), F.lit(reason).alias("reason"), "year", "field", six("pagerank"), six("betweenness"), F.coalesce("degree", F.lit(0)).alias("degree"), "community")


def labelled_path(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, label): each path's node names joined by arrows."""
    each = paths.select("source", "target", F.posexplode("path").alias("k", "id")).join(nodes.select("id", "name"), "id", "left")
    return each.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("name", "id").alias("n")))).alias("l")).select("source", "target", F.array_join(F.transform("l", lambda x: x["n"]), " → ").alias("label"))


def context_rows(context: dict[str, DataFrame], chars: int = 9000) -> DataFrame:
    """(pos, line): the context as prompt lines, cut where their total passes ``chars``."""
    n = context["nodes"].select(F.lit(1).alias("k"), "id", F.format_string("[%s] %s (%s)", "label", F.coalesce("name", F.lit("")), "id").alias("line"))
    e = context["edges"].select(F.lit(2).alias("k"), F.concat_ws("|", "src", "type", "dst").alias("id"), F.format_string("%s -%s-> %s", "src", "type", "dst").alias("line"))
    x = n.unionByName(e).withColumn("pos", F.row_number().over(Window.orderBy("k", "id")))  # bounded by the context's caps
    x = x.withColumn("upto", F.sum(F.length("line") + 1).over(Window.orderBy("pos")))
    return x.where(F.col("upto") <= chars).select("pos", "line")


def investigate(papers: DataFrame, candidates: DataFrame, question: str, scope: str | None = None, limit: int = 5) -> dict[str, DataFrame]:
    """Ranked papers, their coverage, and supported candidates by (relevance, score, key)."""
    ranked = rank_papers(papers, question, scope=scope)
    fit = candidate_relevance(candidates, question, scope)
    chosen = candidates.join(fit, "key").where("supported").orderBy(F.desc("relevance"), F.desc("score"), "key").limit(limit)
    return {"papers": ranked, "coverage": coverage_report(ranked, question, scope), "candidates": chosen}


def counter_evidence(conflicts: DataFrame, papers: DataFrame, limit: int = 5) -> DataFrame:
    """The strongest conflicts in which either paper is one of ``papers`` (id); conflicts are read once."""
    ids = papers.select("id").where("id is not null").distinct().withColumn("known", F.lit(True))
    x = conflicts.join(ids.toDF("paper_a", "in_a"), "paper_a", "left").join(ids.toDF("paper_b", "in_b"), "paper_b", "left")
    return x.where("in_a or in_b").select(*conflicts.columns).orderBy(F.desc("score"), "claim_a", "claim_b").limit(limit)


def explain_metrics(metrics: DataFrame) -> DataFrame:
    """(id, notes) of (id, pagerank, betweenness): what the values mean."""
    pr = F.when(F.col("pagerank") > 0.01, "top-tier influence").when(F.col("pagerank") > 0.004, "notable influence").otherwise("local influence")
    return metrics.select("id", F.array_join(F.array_compact(F.array(pr, F.when(F.col("betweenness") > 0.01, "bridge"))), "; ").alias("notes"))


#: What to ask next, by intent; {a} and {b} are the first opportunity's clusters.
FOLLOW_UPS = {
    "research_gap": ["Which papers connect {a} and {b}?", "What evidence speaks against this gap?"],
    "connection": ["Which papers bridge the two areas?", "Are there conflicting claims between them?"],
    "conflict": ["Which papers make these claims?", "What would settle the disagreement?"],
}


def synthesize(question: str, context: dict[str, DataFrame], opportunities: DataFrame | None = None) -> dict:
    """An answer to a question from a retrieval context and the ranked opportunities: intent, confidence, text, evidence and follow-ups.

    The text is made by templates from counts and the first few rows of each frame, which the context bounds; every paper and
    claim that it names is in ``evidence``.
    """
    from graphloom.plans.views import answer_confidence

    spark = context["nodes"].sparkSession
    asked = spark.createDataFrame([(question,)], "q string").select(X.intent(F.col("q")).alias("i")).first()["i"]
    few = lambda name, n, *order: context[name].orderBy(*order).limit(n).collect() if name in context else []
    papers, claims, conflicts = few("papers", 12, "pos"), few("claims", 8, "id"), few("conflicts", 3, F.desc("score"), "claim_a", "claim_b")
    gaps = opportunities.orderBy("rank").limit(3).collect() if opportunities is not None else []
    n_papers, n_claims = context["papers"].count(), context["claims"].count() if "claims" in context else 0
    level = gaps[0]["confidence"] if gaps else None
    sure = spark.createDataFrame([(n_papers, n_claims, level)], "p long, c long, l string").select(answer_confidence(F.col("p"), F.col("c"), F.col("l")).alias("s")).first()["s"]
    lines = [f"{n_papers} papers and {n_claims} claims of the corpus bear on: {question}", ""]
    lines += [f"- {r['name']}" + (f" ({r['year']})" if r["year"] else "") for r in papers[:5]]
    lines += [f"- Tension ({r['score']:.2f}): {r['claim_a']} against {r['claim_b']}" for r in conflicts]
    lines += [f"- Opportunity {r['rank']}: {r['rationale']}" for r in gaps]
    if not papers and not gaps:
        lines.append("Nothing in the corpus bears on it.")
    a, b = (gaps[0]["a"], gaps[0]["b"]) if gaps else ("this", "that")
    after = FOLLOW_UPS.get(asked["name"], ["Which papers are closest to this question?", "Where are opportunities near this topic?"])
    return {
        "intent": asked["name"], "intent_confidence": asked["confidence"], "confidence": sure, "answer": "\n".join([*lines, "", NOTICE]), "evidence": evidence_list(context),
        "follow_ups": [f.format(a=a, b=b) for f in after], "used": {"papers": len(papers), "claims": len(claims), "conflicts": len(conflicts), "opportunities": len(gaps)},
    }


def report_rows(opportunities: DataFrame) -> DataFrame:
    """(rank, line): a Markdown section of each opportunity."""
    line = F.format_string("## %d. %s × %s\n\nScore %.1f, confidence %s, %s.\n\n| component | value |\n| --- | ---: |\n%s\n\n%s", "rank", "a", "b", "score", "confidence", "trajectory", F.array_join(F.array(*[F.format_string(f"| {label} | %.1f |", 100 * F.col(k)) for k, label in O.LABELS.items()]), "\n"), F.lit(NOTICE))
    return opportunities.select("rank", line.alias("line"))


def report(topic: str, landscape: DataFrame, communities: DataFrame, opportunities: DataFrame) -> str:
    """A Markdown report: landscape (kind, name, n), communities (name, papers, topics) and ranked opportunities, all short lists."""
    rows = ["# Research opportunities", "", f"**{topic}**", "", "## Landscape", ""]
    rows += [f"- {r['kind']} {r['name']}: {r['n']}" for r in landscape.orderBy("kind", "name").limit(60).collect()]
    rows += ["", "## Communities", ""] + [f"- {r['name']}: {r['papers']} papers, {r['topics']} topics" for r in communities.orderBy(F.desc("papers"), "name").limit(12).collect()]
    rows += ["", "## Opportunities", "", f"> {NOTICE}", ""] + [r["line"] + "\n" for r in report_rows(opportunities).orderBy("rank").limit(25).collect()]
    return "\n".join(rows)


class Tools:
    """Named callables over (spark, parameters): unknown names are rejected, errors are answers."""

    def __init__(self):
        self.known: dict[str, tuple[Callable[..., DataFrame], dict]] = {}

    def add(self, name: str, run: Callable[..., DataFrame], parameters: dict | None = None) -> None:
        self.known[name] = (run, parameters or {})

    def call(self, spark: SparkSession, name: str, **arguments) -> dict:
        if name not in self.known:
            return {"ok": False, "error": f"unknown tool '{name}'"}
        run, parameters = self.known[name]
        extra = set(arguments) - set(parameters)
        if extra:
            return {"ok": False, "error": f"unknown parameters: {', '.join(sorted(extra))}"}
        try:
            return {"ok": True, "result": run(spark, **{k: bounded(arguments.get(k), parameters[k]) for k in parameters})}
        except (ValueError, TypeError, KeyError, AnalysisException) as e:  # arguments that don't fit are answered; faults of the engine are raised
            return {"ok": False, "error": str(e).splitlines()[0]}


def bounded(value, rule: dict):
    """A value of a rule {type, default, low, high}: parsed, defaulted and clamped."""
    if value is None:
        return rule.get("default")
    if rule.get("type") is int:
        try:
            value = int(value)
        except (TypeError, ValueError):
            return rule.get("default")
        return max(rule.get("low", value), min(rule.get("high", value), value))
    return value


def standard_tools(nodes: DataFrame, edges: DataFrame, metrics: DataFrame | None = None, *, profiles: DataFrame | None = None, predicted: DataFrame | None = None, conflicts: DataFrame | None = None, opportunities: Callable[..., DataFrame] | None = None, evidence: DataFrame | None = None) -> Tools:
    """The graph tools; those that need metrics, community profiles, predicted links, conflicts (enriched) or opportunities are there with them.

    ``opportunities`` is a callable of (topic, year_min, year_max, top_k); ``evidence`` are the rows of (a, b, pos, paper, role).
    """
    t, n10 = Tools(), {"type": int, "default": 10, "low": 1, "high": 50}
    n40, text = n10 | {"high": 40}, {"default": None}
    t.add("search_papers", lambda s, query, limit: N.search(nodes, query, limit=limit, labels=["Paper"]), {"query": {}, "limit": n10})
    t.add("get_paper", lambda s, id: nodes.where(F.col("id") == id), {"id": {}})
    t.add("find_related_papers", lambda s, id, limit: N.related(edges, nodes.where(F.col("id") == id), ["SIMILAR_TO", "CITES", "RELATED_TO"]).orderBy(F.desc("best"), "other").limit(limit), {"id": {}, "limit": n10})
    t.add("shortest_evidence_path", lambda s, source, target: H.evidence_path(edges, source, target), {"source": {}, "target": {}})
    t.add("query_graph", lambda s, node_type, limit: N.page(N.with_degree(nodes.where(F.col("label") == node_type), edges), "degree", limit=limit), {"node_type": {"default": "Topic"}, "limit": n10})
    t.add("neighbours", lambda s, id: N.neighbour_groups(edges, nodes, nodes.where(F.col("id") == id)), {"id": {}})
    t.add("find_connecting_papers", lambda s, area_a, area_b: connecting(nodes, edges, area_a, area_b), {"area_a": {}, "area_b": {}})
    if metrics is not None:
        t.add("find_bridge_nodes", lambda s, label, limit: nodes.where(F.col("label") == label).join(metrics, "id").orderBy(F.desc("betweenness"), "id").limit(limit), {"label": {"default": "Paper"}, "limit": n10})
        t.add("graph_metrics", lambda s, id: explain_metrics(metrics.where(F.col("id") == id)), {"id": {}})
    if profiles is not None:
        t.add("find_research_communities", lambda s, topic, limit: communities_about(profiles, topic, limit), {"topic": text, "limit": n40})
    if predicted is not None:
        t.add("find_potential_connections", lambda s, topic, limit: potential_connections(predicted, nodes, topic, limit), {"topic": text, "limit": n10})
    if conflicts is not None:
        t.add("find_conflicting_claims", lambda s, topic, limit: conflicts_about(conflicts, topic, limit), {"topic": text, "limit": n40})
    if opportunities is not None:
        year, k = {"type": int, "default": None}, {"type": int, "default": 5, "low": 1, "high": 12}
        t.add("find_research_gaps", opportunities_of(opportunities), {"topic": {"default": ""}, "year_min": year, "year_max": year, "top_k": k})
        if evidence is not None:
            t.add("get_evidence", lambda s, topic, index: evidence_of(opportunities("" if topic is None else topic, None, None, 12), evidence, index), {"topic": text, "index": {"type": int, "default": 0, "low": 0, "high": 11}})
    return t


def opportunities_of(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return lambda s, topic, year_min, year_max, top_k: run(topic, year_min, year_max, top_k)


def communities_about(profiles: DataFrame, topic: str | None, limit: int = 10) -> DataFrame:
    """Community profiles by rank, those of a topic: with it in their name or a top topic's."""
    q = (topic or "").lower()
    about = F.exists("top_topics", lambda x: F.lower(x).contains(q))
    about = about | F.lower("name").contains(q) if "name" in profiles.columns else about
    return (profiles.where(F.coalesce(about, F.lit(False))) if q else profiles).orderBy("rank").limit(limit)


def potential_connections(predicted: DataFrame, nodes: DataFrame, topic: str | None, limit: int = 10) -> DataFrame:
    """Predicted links (src, dst, weight) with both names, the heaviest first; those with a topic in a name."""
    name = nodes.select("id", "name")
    x = predicted.join(name.toDF("src", "src_name"), "src").join(name.toDF("dst", "dst_name"), "dst")
    q = (topic or "").lower()
    x = x.where(F.lower("src_name").contains(q) | F.lower("dst_name").contains(q)) if q else x
    return x.orderBy(F.desc("weight"), "src", "dst").limit(limit).withColumn("note", F.lit("Predicted, not observed: a hypothesis."))


def conflicts_about(conflicts: DataFrame, topic: str | None, limit: int = 10) -> DataFrame:
    """Enriched conflicts (text_a, text_b, paper_a, paper_b, score), the strongest first, with ``matched``.

    Those with the topic in a text or a paper's id; where none has it, the strongest of all, ``matched`` false.
    """
    q = (topic or "").lower()
    has = F.lit(True)
    if q:
        has = F.lower(F.concat("text_a", "text_b")).contains(q) | F.lower("paper_a").contains(q) | F.lower("paper_b").contains(q)
    order = [F.desc("matched"), F.desc("score"), "claim_a", "claim_b"]
    x = conflicts.withColumn("matched", F.coalesce(has, F.lit(False))).orderBy(*order).limit(limit)  # conflicts are read once
    return x.withColumn("some", F.max("matched").over(Window.partitionBy())).where("matched or not some").drop("some").orderBy(*order)  # of ``limit`` rows at most


def evidence_of(opportunities: DataFrame, evidence: DataFrame, index: int = 0) -> DataFrame:
    """The evidence rows of the opportunity at ``index`` of the ranking, or of the last where there are fewer."""
    most = opportunities.agg(F.max("rank").alias("most"))
    chosen = opportunities.join(F.broadcast(most)).where(F.col("rank") == F.least(F.lit(index + 1), F.col("most"))).select("a", "b", "rank", "score")  # one row
    return evidence.join(chosen, ["a", "b"]).orderBy("pos")


def connecting(nodes: DataFrame, edges: DataFrame, area_a: str, area_b: str) -> DataFrame:
    """Papers that study a topic of each of two areas, topics by case-folded substring."""
    topics = nodes.where("label = 'Topic'")
    pick = lambda a: topics.where(F.lower("name").contains(a.lower())).select("id")
    e = edges.where("type = 'STUDIES'").select(F.col("src").alias("paper"), F.col("dst").alias("topic"))
    return N.bridges(e, "paper", "topic", pick(area_a), pick(area_b))
