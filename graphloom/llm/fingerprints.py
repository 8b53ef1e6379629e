"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A fingerprint holds every distinct shingle hash below a fixed share of hash space, and only those, beside a sum that
names the whole set.  Fingerprints of parts merge by union, and the share of common hashes estimates Jaccard likeness
and, between very unequal documents, containment.  A set of n shingles keeps none with odds of (1 - share) ** n: under
some 20 shingles the estimates are rough, and where nothing is kept only equal sets are known to be alike.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm import _bytes
from graphloom.llm.shared import partitions
from graphloom.shipping import ship

WIDTH = 5
#: The share of hash space that is kept.
SHARE = 1 / 4


class Sketch(NamedTuple):
    kept: np.ndarray  # sorted hashes below the bound
    total: int  # sum that names the whole set: 0 for a set without shingles, -1 where it isn't known


def sketches(texts: list[bytes], width: int = WIDTH, share: float = SHARE) -> list[Sketch]:
    """The sketch of each text."""
    out = []
    bound = np.uint64(min(int(share * 2.0**64), 2**64 - 1))
    for _, part in _bytes.slices(texts):
        h, b = _bytes.shingle_sets(part, width)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_bytes.mix(h))))
        totals = ((sums[b[1:]] - sums[b[:-1]]) >> np.uint64(1)).tolist()
        for i in range(len(part)):
            own = h[b[i] : b[i + 1]]
            out.append(Sketch(own[: int(np.searchsorted(own, bound))].copy(), totals[i]))
    return out


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both sets' union."""
    total = a.total if b.total in (0, a.total) else b.total if a.total == 0 else -1
    return Sketch(np.union1d(a.kept, b.kept), total)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard likeness: 1 for equal sets, 0 where neither keeps anything."""
    if a.total == b.total >= 0:
        return 1.0
    both = len(np.intersect1d(a.kept, b.kept, assume_unique=True))
    return both / max(1, len(a.kept) + len(b.kept) - both)


def containment(a: Sketch, b: Sketch) -> float | None:
    """Estimated share of a's shingles that b has: 1 for a set without shingles, None where a keeps nothing to tell by."""
    if a.total == 0 or a.total == b.total >= 0:
        return 1.0
    return len(np.intersect1d(a.kept, b.kept, assume_unique=True)) / len(a.kept) if len(a.kept) else None


def to_text(a: Sketch) -> str:
    """Sixteen digits of the sum (all f: not known), then sixteen for each hash."""
    return f"{a.total % 2**64:016x}" + a.kept.astype(">u8").tobytes().hex()


def from_text(s: str) -> Sketch:
    total = int(s[:16], 16)
    return Sketch(np.frombuffer(bytes.fromhex(s[16:]), ">u8").astype(np.uint64), -1 if total == 2**64 - 1 else total)


def fingerprint(docs: DataFrame, *keep: str, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """Columns ``keep`` and ``fingerprint`` (hex) of the whole of column ``text`` (null: empty).

    Other columns are ignored, whatever their names; repeated rows repeat, an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    own = [F.col("`" + c.replace("`", "``") + "`") for c in keep]
    schema = StructType([*docs.select(*own).schema]).add("fingerprint", "string")

    def run(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            made = sketches([b or b"" for b in batch.column(len(keep)).to_pylist()], width, share)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array([to_text(x) for x in made], pa.string())], names=[*keep, "fingerprint"])

    return docs.select(*[c.alias(f"c{k}") for k, c in enumerate(own)], F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_next double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
#: Documents of one range.
RANGE_ROWS = 20_000
#: At most so many ranges: their bounds are part of the plan.  A range is sorted with spilling and streamed, so its size is not held in memory.
RANGES = 20_000


def compare_with_next(docs: DataFrame, *, width: int = WIDTH, share: float = SHARE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document against its edited text and its successor by (doc_id, text); the last one's is the first.

    Columns as in _OUT; ``contained_next`` is null where the text keeps no hash to tell by.  Null texts are empty, a null
    doc_id comes first and keeps its row, repeated rows follow each other, other columns are ignored.  Documents are dealt out once by ranges of doc_id; the first document of each range also goes to
    the range before it, so every successor is at hand in the task that needs it and none sees more than its range.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"))
    n = ids.count()
    ranges = min(max(partitions(spark), -(-n // range_rows)), RANGES)
    cuts = ids.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    # ranges are (cut[i-1], cut[i]]; a range's first document is its least (doc_id, text)
    at = _range_of(cuts)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("p", at(F.col("k")))
    heads = [r["k"] for r in ids.withColumn("p", at(F.col("k"))).groupBy("p").agg(F.min("k").alias("k")).orderBy("p").collect()]
    full = sorted({int(np.searchsorted(cuts, h)) for h in heads})
    before = {h: full[i - 1] for i, h in enumerate(sorted(heads))}  # the first one's text also ends the last range
    lead = F.create_map(*[x for h, p in before.items() for x in (F.lit(h).cast("long"), F.lit(p).cast("int"))]) if before else None
    if lead is None:
        return spark.createDataFrame([], _OUT)
    first = src.where(F.col("k").isin(heads)).groupBy("k").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", "k", F.element_at(lead, F.col("k")).alias("p"), F.lit(1).alias("guest"))
    dealt = src.withColumn("guest", F.lit(0)).unionByName(first).repartitionById(ranges, F.col("p")).sortWithinPartitions("p", "guest", "k", "text")

    def run(batches):
        held = None  # (p, doc_id, text, sketch) that waits for its successor

        def row(held, text, sketch):
            _, doc_id, own, mine = held
            new = edited(own, text)
            other = sketches([new.encode()], width, share)[0]
            return (doc_id, len(own), hashlib.sha256(new.encode()).hexdigest(), to_text(mine), to_text(other), likeness(mine, other), likeness(mine, sketch), containment(mine, sketch))

        for batch in batches:
            rows = []
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                p, guest, doc_id, text = (part.column(c).to_pylist() for c in ("p", "guest", "doc_id", "text"))
                made = sketches([t.encode() for t in text], width, share)
                for i in range(len(p)):
                    if held is not None and held[0] == p[i]:
                        rows.append(row(held, text[i], made[i]))
                    held = None if guest[i] else (p[i], doc_id[i], text[i], made[i])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=_NAMES)

    return dealt.select("p", "guest", "doc_id", "text").mapInArrow(run, _OUT)


def _range_of(cuts: list[int]):
    """The number of cuts below a key, by binary search over a literal array."""
    if not cuts:
        return lambda k: F.lit(0)
    table = F.array(*[F.lit(c).cast("long") for c in cuts])

    def at(k):
        lo, hi = F.lit(0), F.lit(len(cuts))
        state = F.struct(lo.alias("lo"), hi.alias("hi"))
        steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
        mid = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")

        def step(s, _):
            go = (s["lo"] < s["hi"]) & (F.get(table, F.least(mid(s), F.lit(len(cuts) - 1))) < k)
            return F.struct(F.when(go, mid(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(go | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid(s)).alias("hi"))

        return F.aggregate(steps, state, step, lambda s: s["lo"])

    return at
