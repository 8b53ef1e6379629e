"""Claims: parsing, the opposition gate, conflict scores and support pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.sources.working import drop, keep

LEAST, LEAST_SINGLE = 0.35, 0.45


def parse(claims: DataFrame) -> DataFrame:
    """(id, text, paper) with tokens, subject, predicate, direction, negated, strength, stems and grp; null texts go."""
    c = claims.where("text is not null").select("id", "text", "paper").withColumn("tokens", X.tokens(F.col("text")))
    t = F.col("tokens")
    c = c.withColumns({"subject": X.subject(t), "predicate": X.predicate(t), "direction": X.direction(t), "negated": X.negated(F.col("text")), "strength": X.strength(t), "stems": X.stems(X.content(t))})
    return c.withColumn("grp", F.concat_ws("|", "subject", "predicate"))


SIDE = ("class", "subject", "predicate", "direction", "negated", "strength", "stems", "n")


def _side(c: DataFrame, p: str, *more: str) -> DataFrame:
    return c.select(*[F.col(x).alias(f"{p}_{x}") for x in (*SIDE, *more)])


def _opposed() -> Column:
    """What any conflict needs: one of two claims negated, or poles of one pair of directions."""
    return (F.col("a_negated") != F.col("b_negated")) | X.opposing(F.col("a_direction"), F.col("b_direction"))


def _apart(a: Column, b: Column) -> Column:
    return ~F.coalesce((a != "") & (a == b), F.lit(False))


def _scored(pairs: DataFrame) -> DataFrame:
    """Pairs of sides that pass the gate, with kind, score and reasons; ``stems`` are those that they may share, ``n`` how many a claim has in all."""
    a, b = (lambda x: F.col(f"a_{x}")), (lambda x: F.col(f"b_{x}"))
    shared = F.size(F.array_intersect(a("stems"), b("stems")))
    low = F.least(a("n"), b("n"))
    pairs = pairs.withColumn("shared", shared).withColumn("overlap", F.coalesce(F.try_divide("shared", low), F.lit(0.0)))
    same = (a("subject") != "") & (a("subject") == b("subject")) & (a("predicate") == b("predicate"))
    against, polar = X.opposing(a("direction"), b("direction")), a("negated") != b("negated")
    close = (F.col("shared") >= 2) & (F.col("overlap") >= 0.2)
    kind = F.when(polar & (same | close), "polarity").when(against & close, "directional")
    both = lambda c: F.coalesce(c, F.lit(False))
    strong = (a("strength") == "strong") & (b("strength") == "strong")
    agree = ~a("negated") & ~b("negated") & both(a("direction") == b("direction"))

    def part(c: Column, w: float) -> Column:
        return F.when(c, F.lit(w)).otherwise(F.lit(0.0))

    score = part(polar, 0.45) + part(against, 0.35) + part(same, 0.20) + part(strong, 0.10) - part(agree, 0.20) + 0.15 * F.col("overlap")
    reasons = F.array_compact(F.array(
        F.when(polar, "polarity differs"), F.when(against, F.concat_ws(" ", F.lit("opposite direction:"), a("direction"), b("direction"))), F.when(same, "same subject and predicate"),
        F.when(strong, "both assertive"), F.when(agree, "same polarity and direction"), F.when(F.col("shared") > 0, F.concat_ws(" ", F.lit("shared concepts:"), F.col("shared").cast("string"))),
    ))
    return pairs.withColumn("kind", kind).where("kind is not null").withColumns({"score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3), "reasons": reasons})


#: Claims alone with their proposition that a stem may have to count as rare; claims of a class in a block; pairs that a task makes.
RARE, BLOCK, TASK_PAIRS = 32, 1024, 2_000_000


def conflicts(parsed: DataFrame, *, texts: bool = False, rare: int = RARE, block: int = BLOCK) -> DataFrame:
    """(claim_a, claim_b, paper_a, paper_b, score, kind, reasons) of a < b, with ``texts`` also (text_a, text_b).

    Pairs of one proposition from .35; claims alone with theirs meet others that share two stems from .45.  Claims alike in all that
    a score depends on are folded into a class: classes are scored once a pair, and only pairs that conflict are spread to members,
    in blocks, so no stem that many claims have makes a pair that isn't returned.  Rare stems would tell nearly every claim from the
    next: they stay out of the classes, and claims that share one are compared by themselves.
    """
    more = ["text"] if texts else []
    # claims without content words share the empty group and no stem, so none of them can oppose another
    group = parsed.groupBy("grp").agg(F.count(F.lit(1)).alias("k"))
    p = parsed.join(group, "grp").where("id is not null and size(stems) > 0 and (k = 1 or subject <> '')")
    p = keep(p.select("grp", "k", "id", "paper", *more, "subject", "predicate", "direction", "negated", "strength", "stems", F.size("stems").alias("n")), "claims")
    one = p.where("k = 1")  # their groups are their keys
    s = one.select("grp", F.explode("stems").alias("stem"))
    often = s.groupBy("stem").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > rare)
    s = s.join(often, "stem", "left").groupBy("grp").agg(F.array_sort(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "stem")))).alias("often"), F.collect_list(F.when(F.col("df").isNull(), F.col("stem"))).alias("rare"))
    one = one.withColumn("every", F.col("stems")).drop("stems", "subject", "predicate")  # of two propositions no two are the same
    one = one.join(s.select("grp", F.transform("often", lambda x: x["stem"]).alias("stems"), F.array_sort("rare").alias("rare")), "grp").withColumns({"subject": F.lit(""), "predicate": F.lit("")})
    many = p.where("k > 1").withColumns({"every": F.col("stems"), "rare": F.array().cast("array<string>")})
    key = lambda *first: F.sha2(F.concat_ws("\n", *first, F.array_join("stems", " "), F.col("n").cast("string"), F.col("negated").cast("string"), F.coalesce("direction", F.lit("")), "strength"), 256)
    c = keep(one.withColumn("class", key(F.lit("alone"))).unionByName(many.withColumn("class", key(F.lit("group"), F.col("grp")))), "claims")
    drop(p)

    first = lambda x: F.first(x).alias(x)
    kinds = keep(c.groupBy("class").agg(*[first(x) for x in SIDE[1:]], F.when(F.first("k") > 1, F.first("grp")).alias("grp"), F.count(F.lit(1)).alias("size")), "classes")
    told = ["class_a", "class_b", "score", "kind", "reasons"]
    done = lambda x, least: _scored(x).where(F.col("score") >= least).withColumns({"class_a": F.col("a_class"), "class_b": F.col("b_class")}).select(*told)
    g = kinds.where("grp is not null")
    told_many = done(_side(g, "a", "grp").join(_side(g, "b", "grp"), (F.col("a_grp") == F.col("b_grp")) & _opposed()), LEAST)
    # two classes that share two stems share one that isn't the last of either, the commonest
    g = kinds.where("grp is null and size(stems) > 1").withColumn("head", F.slice("stems", F.lit(1), F.size("stems") - 1)).withColumn("stem", F.explode("head"))
    meet = _side(g, "a", "head", "stem").join(_side(g, "b", "head", "stem"), (F.col("a_stem") == F.col("b_stem")) & _opposed())
    told_one = done(meet.where(F.get(F.array_intersect("a_head", "b_head"), F.lit(0)) == F.col("a_stem")), LEAST_SINGLE)

    dealt = c.join(kinds.select("class", F.ceil(F.col("size") / block).cast("int").alias("parts")), "class").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    packed = keep(dealt.groupBy("class", "part").agg(F.collect_list(F.struct("id", "paper", "rare", *more)).alias("all")), "blocks")
    at = packed.select("class", "part", F.size("all").alias("m"))
    plan = told_many.unionByName(told_one).join(at.toDF("class_a", "part_a", "m_a"), "class_a").join(at.toDF("class_b", "part_b", "m_b"), "class_b")
    plan = keep(plan, "plan")
    tasks = -(-(plan.agg(F.sum(F.col("m_a").cast("long") * F.col("m_b"))).first()[0] or 0) // TASK_PAIRS)
    x = plan.join(packed.toDF("class_a", "part_a", "all_a"), ["class_a", "part_a"]).join(packed.toDF("class_b", "part_b", "all_b"), ["class_b", "part_b"])
    x = x.repartition(max(1, tasks), "class_a", "part_a", "class_b", "part_b")  # a block's bytes don't tell how many pairs it makes
    x = x.select("score", "kind", "reasons", "all_b", F.explode("all_a").alias("a")).select("score", "kind", "reasons", "a", F.explode("all_b").alias("b"))
    x = x.where((F.col("a.id") < F.col("b.id")) & _apart(F.col("a.paper"), F.col("b.paper")) & ~F.arrays_overlap("a.rare", "b.rare"))
    pair = lambda a, b: [a("id").alias("claim_a"), b("id").alias("claim_b"), a("paper").alias("paper_a"), b("paper").alias("paper_b"), "score", "kind", "reasons", *[f(y).alias(f"{y}_{z}") for y in more for f, z in ((a, "a"), (b, "b"))]]
    spread = x.select(*pair(lambda y: F.col(f"a.{y}"), lambda y: F.col(f"b.{y}")))

    r = c.where("k = 1").withColumn("stems", F.col("every")).withColumn("stem", F.explode("rare"))
    own = ("id", "paper", "rare", "stem", *more)
    met = _side(r, "a", *own).join(_side(r, "b", *own), (F.col("a_stem") == F.col("b_stem")) & (F.col("a_id") < F.col("b_id")) & _opposed())
    met = _scored(met.where(_apart(F.col("a_paper"), F.col("b_paper")) & (F.get(F.array_intersect("a_rare", "b_rare"), F.lit(0)) == F.col("a_stem")))).where(F.col("score") >= LEAST_SINGLE)
    return spread.unionByName(met.select(*pair(lambda y: F.col(f"a_{y}"), lambda y: F.col(f"b_{y}"))))


def enriched(found: DataFrame, claims: DataFrame) -> DataFrame:
    """``found`` with the texts of both claims, by joins; ``conflicts`` can bring them along, which moves no pair."""
    a, b = claims.select(F.col("id").alias("claim_a"), F.col("text").alias("text_a")), claims.select(F.col("id").alias("claim_b"), F.col("text").alias("text_b"))
    return found.join(a, "claim_a").join(b, "claim_b")


def supports(parsed: DataFrame) -> DataFrame:
    """(claim_a, claim_b, direction): claims of one direction and proposition group in different papers, neither negated."""
    p = parsed.where("direction is not null and not negated").select("id", "paper", "direction", "subject")
    a, b = p.toDF("claim_a", "pa", "direction", "subject"), p.toDF("claim_b", "pb", "direction", "subject")
    return a.join(b, ["direction", "subject"]).where("claim_a < claim_b and not (pa <=> pb)").select("claim_a", "claim_b", "direction", "subject")


def claim_sentences(docs: DataFrame, key: str, text: str, low: int = 45, high: int = 400, most: int = 3) -> DataFrame:
    """(key, pos, sentence, stance): the first sentences of fitting length that take a stance."""
    s = docs.select(key, F.posexplode(X.sentences(F.col(text))).alias("at", "sentence")).where(F.length("sentence").between(low, high))
    s = s.withColumn("stance", X.stance(F.col("sentence"))).where("stance is not null")
    from pyspark.sql import Window

    return s.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("pos") <= most).select(key, "pos", "sentence", "stance")


def dictionary_entities(docs: DataFrame, key: str, text: str, terms: list[tuple[str, str]]) -> DataFrame:
    """(key, kind, entity, offset): dictionary terms (kind, term) found in a text, with the first 0-based offset.

    The dictionary is a constant of the plan, so a document is read once and nothing is joined.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("entity"), (F.instr(low, t) - 1).alias("offset")) for k, t in terms])
    return docs.select(key, F.explode(F.filter(hits, lambda h: h["offset"] >= 0)).alias("h")).select(key, "h.kind", "h.entity", "h.offset")


def titled(phrase: str, acronyms: dict[str, str], small: list[str]) -> str:
    """A phrase in title case: words and the parts of compounds capitalised, acronyms as they are spelt, small words small inside."""
    def word(w: str, first: bool) -> str:
        if w.lower() in acronyms:
            return acronyms[w.lower()]
        mark = "/" if "/" in w else "-"
        parts = [p for p in w.replace("/", "-").split("-") if p] if mark in w else [w]
        if len(parts) < 2:
            low = w.lower()
            return low if not first and low in small else low[:1].upper() + low[1:]
        return mark.join(acronyms.get(p.lower(), p.lower() if i and p.lower() in small else p[:1].upper() + p[1:].lower()) for i, p in enumerate(parts))

    return " ".join(word(w, i == 0) for i, w in enumerate(phrase.split(" ")))


def extract_entities(papers: DataFrame, dictionaries: dict[str, list[str]], *, aliases: list[tuple[str, str]] = (), acronyms: dict[str, str] | None = None, small: list[str] = ()) -> DataFrame:
    """(id, kind, entity, field, offset) of papers (id, title, abstract): dictionary phrases, each name once a kind.

    Topics are looked for in the title and then in the abstract, with ``aliases`` (mention, topic) for those not found as such; a
    paper without any takes the first three longer words of its title.  Other kinds are looked for in abstract and title, metrics in
    the abstract alone.  ``dictionaries`` go by kind (Topic, Method, Dataset, Metric) in lower case; they are constants of the plan.
    """
    acronyms = acronyms or {}
    title, abstract = F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))
    one = lambda kind, phrase, field, at: F.struct(F.lit(kind).alias("kind"), F.lit(titled(phrase, acronyms, small)).alias("entity"), F.lit(field).alias("field"), (at - 1).cast("int").alias("offset"))
    none = F.array().cast("array<struct<kind:string,entity:string,field:string,offset:int>>")

    def hits(kind: str, text: Column, field: str, more: list[tuple[str, str]] = ()) -> Column:
        low = F.lower(text)
        found = [F.when(F.instr(low, p) > 0, one(kind, p, field, F.instr(low, p))) for p in dictionaries.get(kind, [])]
        known = set(dictionaries.get(kind, []))
        found += [F.when((F.instr(low, m) > 0) & ((F.instr(low, c) == 0) if c in known else F.lit(True)), one(kind, c, field, F.instr(low, m))) for m, c in more]
        return F.array_compact(F.array(*found)) if found else none

    words = F.slice(F.filter(F.split(F.regexp_replace(title, "[^a-zA-Z0-9\\- ]", " "), " +"), lambda w: F.length(w) > 3), 1, 3)
    names = F.create_map(*[F.lit(x) for pair in acronyms.items() for x in pair]) if acronyms else F.lit(None).cast("map<string,string>")
    part = lambda w: F.coalesce(F.element_at(names, F.lower(w)), F.initcap(F.lower(w)))
    own = F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(names, F.lower(w)), F.array_join(F.transform(F.filter(F.split(w, "-"), lambda p: p != ""), part), "-"))), " ")
    topics = F.concat(hits("Topic", title, "title", list(aliases)), hits("Topic", abstract, "abstract", list(aliases)))
    alone = F.array(F.struct(F.lit("Topic").alias("kind"), own.alias("entity"), F.lit("abstract").alias("field"), F.lit(0).alias("offset")))
    topics = F.when(F.size(topics) > 0, topics).when(own != "", alone).otherwise(none)
    both = F.concat(abstract, F.lit(" "), title)
    every = F.concat(topics, hits("Method", both, "abstract"), hits("Dataset", both, "abstract"), hits("Metric", abstract, "abstract"))
    x = papers.select("id", F.posexplode(every).alias("k", "x")).select("id", "k", "x.*")
    first = x.groupBy("id", "kind", "entity").agg(F.min(F.struct("k", "field", "offset")).alias("m"))
    return first.select("id", "kind", "entity", "m.field", "m.offset")
