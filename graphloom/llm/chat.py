"""Chat formatting in budgeted windows.  DataFrame functions only.

A conversation's turns are rendered by a template and cut into windows at turn boundaries, chosen by
prefix sums of the turns' tokens.  Every window keeps the system turn and, after the first, repeats as
many of the last turns before it as a history budget holds; repeated targets are masked.

``### role:`` and a line break open a turn, ``</turn>`` and a line break end it.  Inside texts and roles
``\\`` becomes ``\\b``, ``#`` becomes ``\\h`` and ``<`` becomes ``\\l`` (in roles also ``:`` ``\\c`` and a line
break ``\\n``), so no control string occurs in them and the escape can be undone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens (here words) of a window, and of the history repeated in it.
BUDGET, HISTORY = 512, 128
OPEN, MID, CLOSE = "### ", ":\n", "</turn>\n"
_TEXT = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
_ROLE = [*_TEXT, (":", "\\c"), ("\n", "\\n")]


def escape(x: Column, table=_TEXT) -> Column:
    return reduce(lambda c, ab: F.replace(c, F.lit(ab[0]), F.lit(ab[1])), table, x)


def unescape(x: Column, table=_TEXT) -> Column:
    return reduce(lambda c, ab: F.replace(c, F.lit(ab[1]), F.lit(ab[0])), reversed(table), x)


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): conv_id, n_turns and ``windows``.

    A window is a struct of ``formatted``, ``repeated`` (how many of its first turns are repeats: the system turn and
    the history) and ``loss`` (start and length, in code points from 1, of the assistant texts that count).
    Each turn is new in exactly one window.  A window closes before the turn that would pass the budget, less what the system
    turn takes; one turn over the budget makes a window alone and is not cut.  The system turn is the first turn, if its
    role is ``system``.

    Null texts and roles are empty; turns tie by role, then text; repeated rows are turns of their own; a null conv_id
    is a conversation; an empty table gives none; other columns are ignored, whatever their names.  A conversation is one
    document: its turns meet in one row, which must fit a task.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    each = turns.select("conv_id", F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), tokens(text).cast("long").alias("n"))
    # prefix sums by a window, in the order that the turns are gathered in
    upto = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("upto", upto).select("conv_id", F.struct("turn", "role", "text", "n", "upto").alias("t"))
    conv = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    conv = conv.withColumn("sys", F.when(F.get("t", F.lit(0))["role"] == "system", 1).otherwise(0))
    conv = conv.withColumn("room", F.greatest(F.lit(1), F.lit(budget) - F.when(F.col("sys") == 1, F.get("t", F.lit(0))["n"]).otherwise(F.lit(0))))
    # prefix sums: upto[i] = tokens of the first i turns
    conv = conv.withColumn("upto", F.expr("concat(array(0L), transform(t, x -> x.upto))"))
    # starts of windows: a turn whose end lies beyond the window's room opens the next; the first window holds no history
    conv = conv.withColumn(
        "starts",
        F.expr(
            f"""aggregate(sequence(sys, greatest(sys, size(t) - 1)), array(sys), (s, i) ->
                if(i < size(t) and i > element_at(s, -1)
                   and get(upto, i + 1) - get(upto, element_at(s, -1)) + if(size(s) = 1, 0, {int(history)}) > room,
                   array_append(s, i), s))"""
        ),
    )
    # of each window: first new turn, turn after its last, first repeated turn
    conv = conv.withColumn(
        "spans",
        F.expr(
            f"""transform(starts, (a, k) -> struct(a as a, coalesce(get(starts, k + 1), size(t)) as b,
                if(k = 0, a, a - size(filter(sequence(sys, greatest(sys, a - 1)), i -> i < a and get(upto, a) - get(upto, i) <= {int(history)}))) as h))"""
        ),
    )
    shown = F.transform("t", lambda x: F.struct(F.concat(F.lit(OPEN), escape(x["role"], _ROLE), F.lit(MID)).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("goal")))
    conv = conv.withColumn("shown", shown)
    conv = conv.withColumn(
        "picked",
        F.expr(
            """transform(spans, (w, k) -> if(k = 0,
                 struct(0 as repeated, slice(shown, 1, w.b) as p),
                 struct(sys + w.a - w.h as repeated, concat(slice(shown, 1, sys), slice(shown, w.h + 1, w.b - w.h)) as p)))"""
        ),
    )
    close = len(CLOSE)
    # a window's offsets: where each of its turns begins
    conv = conv.withColumn("picked", F.expr(f"transform(picked, w -> struct(w.repeated as repeated, w.p as p, aggregate(w.p, array(0), (s, x) -> array_append(s, element_at(s, -1) + length(x.head) + length(x.body) + {close})) as at))"))
    conv = conv.withColumn(
        "windows",
        F.expr(
            f"""transform(picked, w -> struct(
                 array_join(transform(w.p, x -> concat(x.head, x.body, '{CLOSE[:-1]}\\n')), '') as formatted,
                 w.repeated as repeated,
                 filter(transform(w.p, (x, i) -> if(x.goal and i >= w.repeated, struct(w.at[i] + length(x.head) + 1 as start, length(x.body) as len), null)), x -> x is not null) as loss))"""
        ),
    )
    return conv.select("conv_id", F.size("t").cast("long").alias("n_turns"), "windows")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, windows, and from the windows' text alone: ``turns`` (role, text) new in each, in order, and ``loss_text``."""
    close, role = CLOSE.replace("\n", "\\n"), reduce(lambda c, ab: f"replace({c}, '{_sql(ab[1])}', '{_sql(ab[0])}')", reversed(_ROLE), "substring_index(substring(x, 5), ':\\n', 1)")
    body = "substring(x, 5 + length(substring_index(substring(x, 5), ':\\n', 1)) + 2)"
    text = reduce(lambda c, ab: f"replace({c}, '{_sql(ab[1])}', '{_sql(ab[0])}')", reversed(_TEXT), body)
    read = f"flatten(transform(windows, w -> transform(slice(slice(split(w.formatted, '{close}'), 1, size(split(w.formatted, '{close}')) - 1), w.repeated + 1, 1000000000), x -> struct({role} as role, {text} as text))))"
    loss = "array_join(flatten(transform(windows, w -> transform(w.loss, s -> substring(w.formatted, s.start, s.len)))), '')"
    return formatted.select("*", F.expr(read).alias("turns"), unescape(F.expr(loss)).alias("loss_text"))


def _sql(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\n", "\\n")
