"""Mixing sources to target weights along a time-varying curriculum.  DataFrame functions only.

Every source has a weight schedule, constant or linear between knots of training progress.  Its integral
is the source's share; targets are filled up to a multiple of the source's size, and what
is over is shared again by weight.  A source's documents follow a hashed order, once through for each whole
pass and on through the rest; a document's place is where the source's cumulative demand meets its
cumulative words, and the mix is range-sorted by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import Tables

#: Weights dealt to sources in code point order, again and again; share of all words to take; most passes over a source.
WEIGHTS, SHARE, PASSES = (3.0, 1.0, 2.0), 1.5, 2
#: Schedules dealt the same way: weight factor at progress 0, 1/2 and 1.  Their integral is 1, so the weights hold on average.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Documents of a bucket of the two-level prefix sums; buckets of more than CROWD times as many hold repeated rows.
BUCKET, CROWD = 2048, 4
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of words: runs of anything but space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``sizes`` (source, source_size) with ``weight`` and ``target``; one row per source in and out.

    Targets are least(passes * size, level * weight), with the level at which they sum to share * all sizes
    (or everything at its bound).  That is where repeated resharing of the excess by weight ends.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    x = sizes.withColumn("ordinal", F.row_number().over(by_name) - 1).withColumn("weight", F.get(dealt, F.col("ordinal") % n))
    x = x.withColumn("most", passes * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "ordinal")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    x = x.withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    x = x.withColumn("goal", share * F.sum("source_size").over(every).cast("double"))
    # the level if exactly the sources from this one on stay below their bounds: right for the first whose bound it doesn't pass
    x = x.withColumn("level", F.greatest(F.lit(0.0), F.col("goal") - F.col("capped")) / F.col("open")).withColumn("r", F.row_number().over(fill))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("r", "level"))
    x = x.withColumn("level", F.min(fits).over(every)["level"])
    return x.select("source", "source_size", "ordinal", "weight", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def ticket(seed: int) -> Column:
    """Order of a document within its source: 60 bits of a digest of doc_id, text and seed."""
    told = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def place(fraction: Column, schedule: Column) -> Column:
    """Training progress at which the integral of a three-knot schedule reaches ``fraction`` of its whole."""
    a, b, c = (F.get(schedule, F.lit(k)) for k in range(3))
    left, right = (a + b) / 4, (b + c) / 4
    need = fraction * (left + right)

    def solve(w0, w1, area):  # w0 x + (w1 - w0) x^2 = area over a half of length 1/2, x in [0, 1/2]
        k = w1 - w0
        root = F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 4 * k * area))
        return F.when(F.abs(k) < 1e-12, area / F.greatest(w0, F.lit(1e-12))).otherwise(2 * area / F.greatest(w0 + root, F.lit(1e-12)))

    return F.least(F.lit(1.0), F.when(need <= left, solve(a, b, need)).otherwise(0.5 + solve(b, c, need - left)))


def _ahead(rows: DataFrame, plan: DataFrame, bucket: int) -> DataFrame:
    """``rows`` (_id, doc_id, source, size, ticket) with their source's row of ``plan`` and ``at``: the words before them, by (ticket, doc_id, _id).

    Prefix sums of two levels: over the buckets of a source, then inside a bucket.  Rows that repeat share a ticket, and very
    many of them a bucket; they are numbered within the partitions of the table that _id tells, and sums over
    those partitions come between, so no task sees them all.
    """
    x = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    x = x.withColumn("b", F.floor(F.shiftright("ticket", 29) * F.col("buckets") / F.lit(1 << 31)).cast("long"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(upto(w)), F.lit(0))
    heads = x.groupBy("ordinal", "b").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    heads = heads.select("ordinal", "b", "n", sums("words", Window.partitionBy("ordinal").orderBy("b")).alias("before"))
    x = x.join(heads, ["ordinal", "b"])
    few = x.where(F.col("n") <= CROWD * bucket).withColumn("at", F.col("before") + sums("size", Window.partitionBy("ordinal", "b").orderBy("ticket", "doc_id", "_id")))
    many = x.where(F.col("n") > CROWD * bucket).withColumn("part", F.shiftright("_id", 33)).withColumn("known", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("null", F.col("doc_id").isNull())
    same = ["ordinal", "b", "ticket", "null", "known", "part"]
    starts = many.groupBy(*same).agg(F.sum("size").alias("words"))
    starts = starts.select(*same, sums("words", Window.partitionBy("ordinal", "b").orderBy("ticket", F.desc("null"), "known", "part")).alias("start"))
    many = many.join(starts, same).withColumn("at", F.col("before") + F.col("start") + sums("size", Window.partitionBy(*same).orderBy("_id")))
    return few.unionByName(many.select(*few.columns))


def _planned(tables: Tables, rows: DataFrame, weights: tuple[float, ...], share: float, passes: int, base: int, schedules, bucket: int) -> DataFrame:
    """``rows`` with source_size, target, taken and position."""
    per = tables.write(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    plan = targets(per.select("source", "source_size"), weights=weights, share=share - base, passes=passes - base)
    plan = plan.withColumn("target", F.col("target") + base * F.col("source_size"))
    plan = plan.join(per.select(F.col("source").alias("other"), "n"), F.col("source").eqNullSafe(F.col("other")))
    # written, so that its size is known where it is joined
    plan = tables.write(plan.select(F.col("source").alias("of"), "source_size", "ordinal", "target", F.ceil(F.col("n") / bucket).cast("long").alias("buckets")), "plan")
    x = _ahead(rows, plan, bucket)
    goal = F.round("target").cast("long")
    whole = F.expr("cast(round(target) as bigint) div greatest(source_size, 1)")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), goal - whole * F.col("source_size") - F.col("at")))
    deal = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in schedules])
    x = x.withColumn("taken", taken.cast("long"))
    progress = place(F.col("at") / F.greatest(F.col("target"), F.lit(1.0)), F.get(deal, F.col("ordinal") % len(schedules)))
    return x.withColumn("position", F.when(F.col("taken") > 0, progress)).select("_id", "doc_id", "source", "size", "source_size", "target", "taken", "position", "ticket")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, base: int = 0, schedules=SCHEDULES, seed: int = 11, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken, position, ticket.

    ``taken`` counts the words that the mix takes of the document, repeats counted, at most ``passes`` * size: all of it
    for each whole pass, and of the last pass whatever lies below the source's target, to the word.
    ``base`` whole passes over every source come first, and only what is over them is shared by weight.
    ``position`` is the training progress of its first word (null if none is taken); rows are sorted by it.
    Order within a source is ``ticket``, a hash of doc_id and text, so reruns agree; rows equal in both tie and take their turns.
    A null source is a source of its own, null and wordless texts have size 0 and are never taken; an empty table gives an
    empty mix; other columns, whatever their names, are ignored.
    """
    tables = Tables(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("_id"), "doc_id", "source", words(F.col("text")).alias("size"), ticket(seed).alias("ticket"))
    x = _planned(tables, tables.write(rows, "sizes"), weights, share, passes, base, schedules, bucket)  # the texts are read once
    return x.orderBy(F.col("position").asc_nulls_last(), "doc_id", "ticket", "_id").drop("_id")


def take(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, base: int = 0, schedules=SCHEDULES, seed: int = 11, bucket: int = BUCKET) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each once per pass that takes it, sorted by position.

    Of the one document per source and pass at which the target is met, the text ends with the last word taken.  Nulls, ties,
    repeated rows and empty tables are as in ``mix``; columns may have any name.
    """
    tables, names = Tables(docs.sparkSession), docs.columns
    own = lambda c: F.col("`" + c.replace("`", "``") + "`")
    row = F.struct(F.lit(0).alias("_"), *[own(c).alias(f"c{k}") for k, c in enumerate(names) if c != "text"])
    # rows are numbered in a written copy, by which each meets its plan: rows that repeat are rows of their own
    kept = tables.write(docs.select(F.monotonically_increasing_id().alias("_id"), "doc_id", "source", "text", row.alias("_row")), "rows")
    rows = tables.write(kept.select("_id", "doc_id", "source", words(F.col("text")).alias("size"), ticket(seed).alias("ticket")), "sizes")
    plan = _planned(tables, rows, weights, share, passes, base, schedules, bucket).where("taken > 0").select("_id", "size", "taken", "position")
    x = kept.join(plan, "_id")
    # sorted before the passes are dealt out: a document's passes stay together and its text is moved once
    turns = F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), k -> least(size, taken - (k - 1) * size))")
    x = x.orderBy("position", "doc_id", "_id").withColumn("_words", F.explode(turns))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("(?:^[\\x20\\x09-\\x0D]+)?[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")
    text = F.when(F.col("_words") < F.col("size"), cut).otherwise(F.col("text"))
    return x.select(*[(text if c == "text" else F.col("_row")[f"c{k}"]).alias(c) for k, c in enumerate(names)])
