"""A sliding-window rate limiter: admit a call if fewer than ``limit`` were admitted in the last ``seconds``.

Rejected calls leave no state, so the decision depends on the calls before it, one key at a time.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.shipping import ship

LIMIT, SECONDS = 240, 60


def _admit(times, held: deque, limit: int, seconds: int) -> list[bool]:
    out = []
    for t in times:
        while held and held[0] <= t - seconds:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out


def admit(calls: DataFrame, key: str, at: str, tie: str, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """(tie, key, admitted) of a bounded set of calls, in order of (at, tie).

    Calls stream through each task in order of key and time, and only the window's admitted calls are held: a hot key
    is not gathered in memory.
    """
    ship(calls.sparkSession)
    kinds = calls.select(tie, key).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", admitted boolean"
    x = calls.select(tie, key, F.unix_micros(F.col(at).cast("timestamp")).alias("t")).repartition(key).sortWithinPartitions(key, "t", tie)

    def run(batches):
        held, last, started = deque(), None, False
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf["t"], strict=True):
                if not started or k != last:
                    held, last, started = deque(), k, True
                out += _admit([t / 1e6], held, limit, seconds)
            yield pd.DataFrame({tie: pdf[tie], key: pdf[key], "admitted": out})

    return x.mapInPandas(run, ddl)


def admit_stream(calls: DataFrame, key: str, at: str, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """The same over a stream: state is the admitted times of each key's last window."""

    ship(calls.sparkSession)

    def step(k, batches, state):
        held = deque(state.get[0] if state.exists else [])
        for pdf in batches:
            pdf = pdf.sort_values(at)
            ok = _admit([x.timestamp() for x in pdf[at]], held, limit, seconds)
            yield pd.DataFrame({key: [k[0]] * len(pdf), at: pdf[at], "admitted": ok})
        state.update((list(held),))

    kind = calls.schema[key].dataType.simpleString()
    return calls.select(key, at).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, admitted boolean", "held array<double>", "append", "NoTimeout")


def per_minute(calls: DataFrame, key: str, at: str, late: str = "1 minute") -> DataFrame:
    """Calls per key and minute; on a stream, minutes close when the watermark passes."""
    x = calls.withWatermark(at, late) if calls.isStreaming else calls
    return x.groupBy(F.window(at, "1 minute").alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("minute"), "n")
