"""URL filters: a temporal join of captures with dated list entries.  DataFrame functions only.

A list's dated entries (add or remove, of a host or domain) become validity intervals; every capture is joined as of
its fetch time with the last interval of each listed domain that it lies in, and counts those still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import Tables

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#@]*\\]|[^/?#:@]+)"
#: Captures of one domain that meet its intervals in one group; a domain with more is dealt out to several.
SPLIT = 100_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot, IPv6 addresses in their brackets; empty where the URL has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), "\\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, valid_from, valid_to) of dated entries (list, domain, action, at).

    ``action`` is add or remove.  An entry holds from its add until the next remove, or for good; a second
    add while it holds changes nothing, nor does a remove while it doesn't.  At the same instant removes
    come first, so remove and add together leave it in force.  Rows with a null are ignored.
    """
    key = Window.partitionBy("list", "domain")
    e = entries.where("list is not null and domain is not null and at is not null and action in ('add', 'remove')")
    e = e.select("list", F.lower("domain").alias("domain"), "at", (F.col("action") == "add").alias("on")).distinct()
    # of an instant the add counts
    e = e.groupBy("list", "domain", "at").agg(F.max("on").alias("on"))
    e = e.withColumn("was", F.lag("on").over(key.orderBy("at"))).where("on <> coalesce(was, false)")
    e = e.withColumn("valid_to", F.lead("at").over(key.orderBy("at"))).where("on")
    return e.select("list", "domain", F.col("at").alias("valid_from"), "valid_to")


def as_of(asked: DataFrame, held: DataFrame, *, split: int = SPLIT) -> DataFrame:
    """Rows of ``asked`` (host, fetched_at, domain) with each interval of ``held`` (from intervals) that holds then: and list.

    Captures and intervals of a list and domain stand in one order of time, and each capture sees the last interval
    begun, so a capture costs one row a list, however long the domain's history.  A domain of more than ``split`` captures
    is dealt out to several groups, which hold its intervals each.
    """
    load = asked.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    plan = held.select("list", "domain").distinct().join(load, "domain").select("list", "domain", F.ceil(F.col("n") / split).cast("int").alias("groups"))
    plan = Tables(asked.sparkSession).write(plan, "groups")  # a plain join follows, whose hot domains Spark can split
    group = F.pmod(F.xxhash64("host", "fetched_at"), F.col("groups")).cast("int")
    none = F.lit(None).cast("timestamp")
    met = asked.join(plan, "domain").select("list", "domain", group.alias("g"), F.col("fetched_at").alias("t"), F.lit(1).alias("capture"), "host", none.alias("valid_from"), none.alias("valid_to"))
    known = held.join(plan, ["list", "domain"]).select("list", "domain", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.col("valid_from").alias("t"), F.lit(0).alias("capture"), F.lit(None).cast("string").alias("host"), "valid_from", "valid_to")
    order = Window.partitionBy("list", "domain", "g").orderBy("t", "capture").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("capture") == 0, F.struct("valid_from", "valid_to")), ignorenulls=True).over(order)
    seen = known.unionByName(met).withColumn("last", last).where("capture = 1 and last is not null and (last.valid_to is null or t < last.valid_to)")
    return seen.select("host", F.col("t").alias("fetched_at"), "domain", "list")


def evaluate(captures: DataFrame, entries: DataFrame, *, blocking: list[str], allowing: list[str], split: int = SPLIT) -> DataFrame:
    """Each row of ``captures`` (page_id, url, fetched_at) with host, hits, lists, matched and verdict.

    An entry matches its host and every host below it.  The longest matching domain decides; on a tie an
    allowing list wins.  ``hits`` counts active entries, ``lists`` names their lists in order, ``matched`` is the
    deciding domain.  Verdict is ``block``, ``allow``, or ``pass`` without an active entry; a capture without a host
    or time passes.  Rows that repeat have one result row each; page_id may be null.  Without captures there is no row,
    without entries every capture passes; other columns of either table are ignored, whatever their names.
    """
    held = intervals(entries.select("list", "domain", "action", "at")).where(F.col("list").isin(blocking + allowing))
    c = captures.select("page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"))
    # every domain that the host lies in, itself included
    parts = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    # captures meet entries as distinct (host, time), so no row is wide
    asked = c.where("host <> '' and fetched_at is not null").select("host", "fetched_at").distinct()
    found = as_of(asked.select("host", "fetched_at", F.explode(above).alias("domain")), held, split=split)
    ranks = F.when(F.col("list").isin(allowing), 1).when(F.col("list").isin(blocking), 0)
    best = F.max(F.struct(F.length("domain").alias("n"), ranks.alias("allow"), F.col("domain").alias("domain")))
    found = found.groupBy("host", "fetched_at").agg(F.count(F.lit(1)).alias("hits"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), best.alias("best"))
    out = c.join(found, ["host", "fetched_at"], "left")
    return out.select(
        "page_id", "url", "host", "fetched_at", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("best.domain", F.lit("")).alias("matched"),
        F.when(F.col("hits").isNull(), "pass").when(F.col("best.allow") == 1, "allow").otherwise("block").alias("verdict"),
    )
