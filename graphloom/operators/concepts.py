"""Concept graph, clusters, their names, single-topic candidates, and the scope of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import aggregates as G
from graphloom.operators import algorithms as A
from graphloom.operators import vectors as K
from graphloom.sources.working import keep

# Thresholds of the concept graph and its clusters.
RESOLUTION, FINE_RESOLUTION, LARGE = 1.2, 1.35, 12
LEAST_TOPICS, LEAST_PAPERS, FINE_TOPICS, FINE_PAPERS, MOST_SUB, MOST_CLUSTERS = 2, 3, 3, 4, 3, 12
NOT_NAMES = ["ai agents", "llm agents", "survey", "agents", "agent architecture"]


def related_links(pairs: DataFrame) -> DataFrame:
    """(src, dst, weight) of pairs (a, b, shared) with two or more in common: min(1, shared / 6)."""
    return pairs.where("shared >= 2").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.least(F.lit(1.0), F.col("shared") / 6).alias("weight"))


def concept_graph(related: DataFrame, vectors: DataFrame, k: int = 4, least: float = 0.35) -> DataFrame:
    """(a, b, weight): related links fused with .7 of the nearest vectors' cosine; the greatest weight of a pair counts."""
    near = K.knn(vectors, k, least).select(F.col("id").alias("src"), F.col("other").alias("dst"), (0.7 * F.col("score")).alias("weight"))
    return G.max_merge(related.select("src", "dst", "weight").unionByName(near))


def node_similarity(pairs: DataFrame, group: str, item: str, top: int = 15, least: float = 0.4) -> DataFrame:
    """(a, b, jaccard, rank): of each item the most alike by their sets of groups."""
    from graphloom.operators.graph import cooccurrence

    c = cooccurrence(pairs, group, item).where(F.col("jaccard") >= least).select("a", "b", "jaccard")
    both = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    return G.top_k(both, top, ["a"], [F.desc("jaccard"), F.col("b")])


def name_scores(members: DataFrame, studies: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, topic, name, local, distinctiveness) of topics that three of the cluster's papers study.

    distinctiveness = share of the cluster's papers * (.5 + .5 * share of the topic's papers) * ln(2 + local).
    """
    own = studies.join(members, "topic").select("cluster", "paper").distinct()
    total = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("papers"))
    every = studies.groupBy("topic").agg(F.countDistinct("paper").alias("every"))
    local = own.join(studies, "paper").join(members, ["cluster", "topic"]).groupBy("cluster", "topic").agg(F.countDistinct("paper").alias("local"))
    x = local.where("local >= 3").join(total, "cluster").join(every, "topic").join(names.select(F.col("id").alias("topic"), "name"), "topic").where(~F.lower("name").isin(NOT_NAMES))
    d = F.col("local") / F.col("papers") * (0.5 + 0.5 * F.col("local") / F.greatest(F.lit(1), F.col("every"))) * F.log(2 + F.col("local"))
    return x.select("cluster", "topic", "name", "local", F.round(d, 6).alias("distinctiveness"))


def cluster_names(scores: DataFrame, most: int = 3) -> DataFrame:
    """(cluster, name): up to three topic names in order of distinctiveness, none whose words contain another's."""
    toks = X.stems(X.tokens(F.col("name")))
    s = scores.withColumn("t", toks).where(F.size("t") > 0)
    key = F.struct((-F.col("distinctiveness")).alias("d"), (-F.col("local")).alias("local"), "name", "t")
    x = s.groupBy("cluster").agg(F.array_sort(F.collect_list(key)).alias("l"))  # a cluster's topics: few, as its papers name them
    start = F.filter("l", lambda x: F.lit(False))

    def step(kept, x):
        nested = F.exists(kept, lambda k: (F.size(F.array_except(x["t"], k["t"])) == 0) | (F.size(F.array_except(k["t"], x["t"])) == 0))
        return F.when(nested | (F.size(kept) >= most), kept).otherwise(F.array_append(kept, x))

    picked = F.aggregate("l", start, step)
    return x.select("cluster", F.array_join(F.transform(picked, lambda k: k["name"]), " · ").alias("name"))


def clusters(links: DataFrame, studies: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, topic, name, granularity): communities of the concept graph with two topics and three papers; those of
    twelve topics or more are split again at a finer resolution; at most twelve clusters, the largest by papers first.
    """
    # written between steps: each is read by several later ones
    e = keep(links.select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), "weight"), "concepts")
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    coarse = keep(A.louvain(n, e, resolution=RESOLUTION).select(F.col("community").alias("cluster"), F.col("id").alias("topic")), "coarse")
    st = keep(studies.select("paper", F.col("topic").cast("string").alias("topic")).join(n.withColumnRenamed("id", "topic"), "topic", "left_semi"), "studies")
    first = keep(_kept(coarse, st, LEAST_TOPICS, LEAST_PAPERS).withColumn("granularity", F.lit("cluster")), "clusters")
    large = first.groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LARGE)
    inside = first.join(large, "cluster", "left_semi").select("cluster", "topic")
    own = e.join(inside.toDF("cs", "src"), "src").join(inside.toDF("cd", "dst"), "dst").where("cs = cd")
    fine = A.louvain(inside.select(F.col("topic").alias("id")), own.select("src", "dst", "weight"), resolution=FINE_RESOLUTION)
    fine = keep(fine, "fine").toDF("topic", "sub").join(inside, "topic").select(F.concat_ws("/", "cluster", "sub").alias("cluster"), "topic", F.col("cluster").alias("parent"))
    kept = _kept(fine.select("cluster", "topic"), st, FINE_TOPICS, FINE_PAPERS)
    size = kept.groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).withColumn("parent", F.substring_index("cluster", "/", 1))
    sub = G.top_k(size, MOST_SUB, ["parent"], [F.desc("k"), F.col("cluster")]).select("cluster")
    every = keep(first.unionByName(kept.join(sub, "cluster", "left_semi").withColumn("granularity", F.lit("sub-cluster"))), "every")
    papers = st.join(every.select("cluster", "topic"), "topic").groupBy("cluster").agg(F.countDistinct("paper").alias("p"))
    top = papers.orderBy(F.desc("p"), "cluster").limit(MOST_CLUSTERS).select("cluster")
    chosen = every.join(top, "cluster", "left_semi")
    named = cluster_names(name_scores(chosen.select("cluster", "topic"), st, names.select(F.col("id").cast("string").alias("id"), "name")))
    return chosen.join(named, "cluster", "left").select("cluster", "topic", F.coalesce("name", F.lit("Mixed concepts")).alias("name"), "granularity")


def _kept(members: DataFrame, studies: DataFrame, topics: int, papers: int) -> DataFrame:
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= topics)
    own = studies.join(members, "topic").groupBy("cluster").agg(F.countDistinct("paper").alias("p")).where(F.col("p") >= papers)
    return members.join(size.join(own, "cluster"), "cluster", "left_semi").select("cluster", "topic")


def topic_candidates(studies: DataFrame, ranks: DataFrame, limit: int = 14, least: int = 3) -> DataFrame:
    """(id, topic, papers): single topics in order of ``ranks`` (topic, rank value), studied by max(3, least) papers; ids -1, -2, ..."""
    p = studies.groupBy("topic").agg(F.countDistinct("paper").alias("papers")).where(F.col("papers") >= max(3, least))
    top = p.join(ranks, "topic").orderBy(F.desc("value"), "topic").limit(limit)
    return top.select((-F.row_number().over(Window.orderBy(F.desc("value"), "topic"))).alias("id"), "topic", "papers")  # at most ``limit`` rows


def scope(topics: DataFrame, studies: DataFrame, papers: DataFrame, *, low: int = 0, high: int = 9999, least: int = 3) -> DataFrame:
    """(paper): papers of the resolved topics (topic) within years low..high, none if they are fewer than ``least``."""
    from graphloom.operators.graph import year_between

    s = studies.join(topics.select("topic").distinct(), "topic", "left_semi").select("paper").distinct()
    s = s.join(papers.where(year_between(F.col("year"), low, high)).select("paper"), "paper", "left_semi")
    n = s.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return s.join(F.broadcast(n)).select("paper")  # one row or none


def areas(question) -> F.col:
    """struct(a, b): the two areas that a question asks to connect; null where there are none."""
    low = F.lower(F.coalesce(question, F.lit("")))
    # Phrasings that name two areas.
    phrasings = [r"connect(?:s|ing)?\s+(.+?)\s+(?:and|with|to)\s+(.+?)(?:\?|\.|$)", r"between\s+(.+?)\s+and\s+(.+?)(?:\?|\.|$)", r"link(?:s|ing)?\s+(.+?)\s+(?:and|to)\s+(.+?)(?:\?|\.|$)"]
    found = []
    for p in phrasings:
        a, b = (F.trim(F.regexp_extract(low, p, k), F.lit(" ?.,")) for k in (1, 2))
        found.append(F.when((F.length(a) > 2) & (F.length(b) > 2), F.struct(a.alias("a"), b.alias("b"))))
    return F.coalesce(*found)


def answer_match(questions: DataFrame, answers: DataFrame, least: float = 0.5) -> DataFrame:
    """(q, a, jaccard): of each question (q, text) the recorded one (a, text) most alike by word sets, from ``least``.

    Candidates share a word: recorded questions are met through their words.
    """
    q = questions.select("q", F.array_distinct(X.tokens(F.col("text"))).alias("tq"))
    a = answers.select("a", F.array_distinct(X.tokens(F.col("text"))).alias("ta"))
    met = q.select("q", F.explode("tq").alias("w")).join(a.select("a", F.explode("ta").alias("w")), "w").groupBy("q", "a").agg(F.count(F.lit(1)).alias("c"))
    x = met.join(q.select("q", F.size("tq").alias("nq")), "q").join(a.select("a", F.size("ta").alias("na")), "a")
    x = x.withColumn("jaccard", F.round(F.col("c") / (F.col("nq") + F.col("na") - F.col("c")), 6)).where(F.col("jaccard") >= least)
    return G.top_k(x, 1, ["q"], [F.desc("jaccard"), F.col("a")]).select("q", "a", "jaccard")


def _tokens(question: str) -> list[str]:
    import re

    return [t for t in re.findall(X.TOKEN, question.lower()) if t not in X.STOPWORDS]


def resolution(names, key: str, name: str, question: str, least: float | None = None):
    """Topic names scored against a question: whole substring 1, else shared tokens, aliases and the head word.

    Kept from .75 (one-word questions .5), or from ``least``.
    """
    asked = sorted({X.py_stem(t) for t in _tokens(question) if t not in X.QUERY_STOP})
    head = X.py_stem([t for t in question.lower().replace("-", " ").split() if t not in X.QUERY_STOP][-1])
    more = sorted({a for t in asked for a in X.ALIASES.get(t, [])} - set(asked))
    toks = X.stems(F.filter(X.tokens(F.col(name)), lambda t: ~t.isin(X.QUERY_STOP)))
    direct = F.size(F.array_intersect(toks, X.words(asked))) / max(1, len(asked))
    alias = F.when(F.arrays_overlap(toks, X.words(more)), 1.0).otherwise(0.0) if more else F.lit(0.0)
    score = F.when(F.lower(name).contains(question.lower()), 1.0).otherwise(F.least(F.lit(1.0), direct + F.when(direct > 0, 0.25 * alias).otherwise(0.0) + F.when(F.array_contains(toks, head), 0.3).otherwise(0.0)))
    out = names.where(F.size(toks) > 0).select(key, name, F.round(score, 6).alias("score"))
    return out.where(F.col("score") >= (least or (0.75 if len(asked) >= 2 else 0.5))).orderBy(F.desc("score"), name)


def scope_scores(names, key: str, name: str, support: str, question: str):
    """Topics scored as the scope of a question: .75 precision + .25 recall of their tokens; one word at most .55; a whole name 1."""
    asked = sorted({X.py_stem(t) for t in _tokens(question)} - set(X.QUESTION_NOISE))
    toks = X.stems(F.filter(X.tokens(F.col(name)), lambda t: ~t.isin(X.QUESTION_NOISE)))
    both = F.size(F.array_intersect(toks, X.words(asked)))
    raw = 0.75 * both / F.size(toks) + 0.25 * both / max(1, len(asked))
    score = F.when(F.lit(question.lower()).contains(F.lower(name)), 1.0).when(F.size(toks) == 1, F.least(raw, F.lit(0.55))).otherwise(raw)
    return names.where((F.size(toks) > 0) & (both > 0)).select(key, F.round(score, 6).alias("score"), support).orderBy(F.desc("score"), F.desc(support), F.lower(name))


def query_relevance(named: DataFrame, question: str) -> DataFrame:
    """(cluster, relevance) of (cluster, name), a row a topic: how near a cluster's words are to a question, for ranking only.

    The share of the question's words that the topics have, and half the share of their aliases; 1 without a question, .2 for a cluster without words.
    """
    asked = sorted({X.py_stem(t) for t in _tokens(question) if t not in X.QUERY_STOP})
    more = sorted({a for t in asked for a in X.ALIASES.get(t, [])} - set(asked))
    toks = X.stems(F.filter(X.tokens(F.col("name")), lambda t: ~t.isin(X.QUERY_STOP)))
    has = named.select("cluster", toks.alias("t")).groupBy("cluster").agg(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("t", X.words(asked + more))))).alias("t") if asked else F.lit(None).alias("t"), F.sum(F.size("t")).alias("n"))
    if not asked:
        return has.select("cluster", F.lit(1.0).alias("relevance"))
    part = lambda of: F.size(F.array_intersect("t", X.words(of))) / max(1, len(of)) if of else F.lit(0.0)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part(asked) + 0.5 * part(more)))
    return has.select("cluster", F.round(F.when(F.col("n") > 0, near).otherwise(0.2), 6).alias("relevance"))
