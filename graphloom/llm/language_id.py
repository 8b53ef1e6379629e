"""Language ID: nearest of several centroids per language, by cosine of TF-IDF n-gram vectors.

A text's vector counts its byte n-grams of two to four bytes (letters folded to lower case,
everything but letters one blank) in a fixed number of hashed dimensions, damped, weighted by
the fit's document frequencies and normalised.  Each language's fit vectors are clustered by
spherical k-means; a text takes the language of its nearest centroid.  A text farther from
every centroid than nearly all of the fit's own texts is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm import _bytes
from graphloom.shipping import ship

BITS = 13
DIMS = 1 << BITS
#: Bounds of the fit: distinct labelled texts per language, and in all (each language has one at least).
FIT_ROWS, FIT_TOTAL = 300, 6000
#: Bytes of a text whose n-grams are counted at a time.
STEP = 1 << 20
CENTROIDS = 3
#: The fit's own similarities, scaled by this much, give the rejection bound.
SLACK = 0.5
#: Texts of fewer bytes are held to a bound lower in proportion.
FULL_BYTES = 512

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray  # one row each, unit length
    idf: np.ndarray
    least: np.ndarray  # similarity below which a language rejects

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, similarity 0 to 1, rejected) of each text."""
        near = vectors(texts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        sim = np.clip(near[np.arange(len(texts)), best], 0, 1).astype(float)
        lang = self.owner[best]
        # short texts have few n-grams and lie far from any centroid: their bound is lower
        full = np.minimum(1.0, np.fromiter(map(len, texts), float, len(texts)) / FULL_BYTES)
        return lang, sim, sim < self.least[lang] * full


def _counts(text: bytes) -> np.ndarray:
    b = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = b[keep]
    out = np.zeros(DIMS, np.int64)
    for at in range(0, len(b), STEP):
        part = b[at : at + STEP + 3].astype(np.uint64)
        code = part
        for k in (1, 2, 3):
            code = code[: max(0, min(STEP, len(part) - k))]
            code = code * np.uint64(257) + part[k : k + len(code)]
            out += np.bincount(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).view(np.int64), minlength=DIMS)
    return out.astype(np.float32)


def vectors(texts: list[bytes], idf: np.ndarray | None) -> np.ndarray:
    rows = np.empty((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        rows[i] = _counts(t)
    np.log1p(rows, out=rows)
    if idf is not None:
        rows *= idf
        size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        rows /= np.where(size > 0, size, 1)[:, None]
    return rows


def _packed(batches):
    """Damped counts of each whole text, as the numbers of its dimensions and their values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = [(np.flatnonzero(v), v) for v in vectors([bytes(x.as_py()) for x in part.column(1)], None)]
            packed = [pa.array(x, pa.binary()) for x in ([i.astype("<u2").tobytes() for i, _ in rows], [v[i].astype("<f4").tobytes() for i, v in rows])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *packed], names=["lang", "o", "at", "value"])
    _bytes.trim()


def fit(labelled: DataFrame, *, rows: int = FIT_ROWS, total: int = FIT_TOTAL, centroids: int = CENTROIDS, slack: float = SLACK) -> Model:
    """Fit on a bounded sample of ``labelled`` (text, lang): of each language, the ``rows`` texts first by hash
    (fewer where that would be over ``total`` in all, but one at least).

    Null texts, null languages and texts without a letter teach nothing; every other language is learnt, so the model
    grows with their number (some 100 kB a language).  Texts are counted whole, in the tasks; the driver gets
    their vectors.  Without any labelled row the model is empty and predicts nothing.  Other columns are ignored.
    """
    ship(labelled.sparkSession)
    known = labelled.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    order = F.xxhash64("text", F.lit(7))
    # all copies of a text have one hash, so the texts are counted, not the rows
    most = [(r["lang"], r["texts"]) for r in known.groupBy("lang").agg(F.approx_count_distinct(order).alias("texts")).collect()]
    rows = max(1, min(rows, total // max(1, len(most))))
    # a hash range that holds about four times the rows wanted, then the least hashes of those
    wanted = max(4.0 * rows, 100.0)  # so many that a language has none of its texts in the range only by odds of e^-100
    most = labelled.sparkSession.createDataFrame([(name, min(1.0, wanted / max(1, n))) for name, n in most], "lang string, share double")
    use = known.select("lang", "text", order.alias("o")).join(F.broadcast(most), "lang").where(F.col("o") <= (F.col("share") * 2 - 1) * F.lit(float(1 << 63)))
    use = use.select("lang", F.col("text").cast("binary").alias("text"), "o").distinct()
    few = use.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))).where(F.col("r") <= rows)
    sample = few.select("lang", "text", "o").mapInArrow(_packed, "lang string, o long, at binary, value binary").toPandas().sort_values(["lang", "o", "at", "value"])
    names = sorted(sample["lang"].unique())
    raw = np.zeros((len(sample), DIMS), np.float32)
    for i, (at, value) in enumerate(zip(sample["at"], sample["value"], strict=True)):
        raw[i, np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f4")
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    raw *= idf
    raw /= np.maximum(np.sqrt(np.einsum("ij,ij->i", raw, raw)), 1e-9)[:, None]
    owner, out, least = [], [], []
    for k, name in enumerate(names):
        own = raw[(sample["lang"] == name).to_numpy()]
        made = _cluster(own, centroids)
        owner += [k] * len(made)
        out.append(made)
        least.append(slack * float(np.quantile((own @ made.T).max(axis=1), 0.01)))
    return Model(names, np.array(owner, int), np.concatenate(out) if out else np.zeros((0, DIMS), np.float32), idf, np.array(least))


def _cluster(x: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest points."""
    c = x.mean(axis=0, keepdims=True)
    start = [int((x @ c[0]).argmax())]
    while len(start) < min(k, len(x)):
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    c = x[start].copy()
    for _ in range(turns):
        at = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


_OUT = StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")


def identify(docs: DataFrame, model: Model, *, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and rejected, from the whole of column ``text``.

    ``und`` with score 0, rejected: null texts, texts without a letter, and any text if the model is
    empty.  The model (a few centroids per learnt language) is broadcast to the workers.
    Columns of other names are ignored, also those named lang_pred, score or rejected; repeated rows repeat; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    shipped, n = spark.sparkContext.broadcast(model), len(keep)
    own = [F.col("`" + c.replace("`", "``") + "`") for c in keep]
    schema = StructType([*docs.select(*own).schema, *_OUT])
    names = [*keep, *_OUT.names]
    at = keep.index("text") if "text" in keep else n + 1

    def run(batches):
        model = shipped.value
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            column = batch.column(at)
            texts, has = column.cast(pa.binary()), np.array(batch.column(n).to_pylist(), bool)
            lang = np.full(batch.num_rows, -1)
            score, off = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if model.languages:
                some = np.flatnonzero(has)
                for first, part in _bytes.slices([texts[i].as_py() for i in some], 8 << 20):
                    put = some[first : first + len(part)]
                    lang[put], score[put], off[put] = model.predict(part)
            called = [model.languages[k] if k >= 0 else "und" for k in lang]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(called, pa.string()), pa.array(score), pa.array(off)], names=names)
        _bytes.trim()

    has = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_has")
    return docs.select(*[c.alias(f"c{k}") for k, c in enumerate(own)], has, *([] if at < n else [F.col("text").cast("binary").alias("_text")])).mapInArrow(run, schema)
