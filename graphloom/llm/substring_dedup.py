"""Substring dedup: remove sentences covered by any non-first repeated run of several sentences.

Every run of consecutive sentences - at least three, and on to ``min_words`` words - is hashed and
joined globally.  Of a run's occurrences the first by (doc_id, place) stays; the sentences of every
other occurrence go.

A sentence ends after ``.``, ``!`` or ``?`` (with closing marks), at a line break, or before a
word that starts with a capital.  Of every ``long`` words in a row without such an end, the word of
least hash begins one as well, so that ends depend on the words around them alone: texts without
punctuation have sentences, and a passage of 50 words has the same run wherever it is pasted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _bytes
from graphloom.llm.shared import Tables, bitmap, maybe, partitions

SENTENCES, MIN_WORDS, LONG = 3, 20, 8
#: Text of a tile, and text for each block of hash space.
TILE_BYTES, BLOCK_BYTES = 16 << 20, 16 << 20
_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[34, 39, 41, 93, 125]] = True


def runs_of(texts: list[bytes], sentences: int = SENTENCES, min_words: int = MIN_WORDS, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, first byte, byte after) of every run, in order."""
    words, bounds = _bytes.word_hashes(texts)
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none.astype(np.uint64), none, none
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _bytes._SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    n = len(words)
    tail = buf[last - 1]
    ends = _END[tail] | (_CLOSE[tail] & (last - first > 1) & _END[buf[np.maximum(last - 2, 0)]])
    lines = np.concatenate((np.zeros(1, np.int64), np.cumsum(buf == 10)))
    head, second = buf[first], buf[np.minimum(first + 1, len(buf) - 1)]
    capital = (head >= 65) & (head <= 90) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97) | (head == 0xCE) & (second >= 0x91) & (second <= 0xA9) | (head == 0xD0) & (second >= 0x80) & (second <= 0xAF)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    new = np.ones(n, bool)
    new[1:] = ends[:-1] | (lines[first[1:]] > lines[last[:-1]]) | capital[1:] | (doc[1:] != doc[:-1])
    new |= _least(words, new, long)
    at = np.flatnonzero(new)  # the first word of each sentence
    owner = doc[at]
    stop = np.searchsorted(owner, owner, side="right")  # the sentence after the text's last
    after = np.append(at, n)
    k = np.arange(len(at))
    till = np.maximum(k + sentences, np.searchsorted(after, at + min_words))  # the sentence after the run
    good = till <= stop
    k, till = k[good], till[good]
    a, b = at[k], after[till]
    # sums of position-weighted word hashes, normalised to the run's start by an odd inverse power
    power = np.full(n, _ROOT, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(n, _BACK, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)))
    h = _bytes.mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) + 1 for t in texts])))
    own = doc[a]
    upto = np.where(b < bounds[own + 1], first[np.minimum(b, n - 1)], begin[own + 1] - 1)
    return own, h, first[a] - begin[own], upto - begin[own]


def _least(words: np.ndarray, new: np.ndarray, long: int) -> np.ndarray:
    """Words that have the least hash of some ``long`` words in a row, none of which begins a sentence."""
    n, out = len(words), np.zeros(len(words), bool)
    if n < long:
        return out
    # of one word said again and again, only every long-th counts: their runs are equal wherever they begin
    k = np.arange(n)
    change = np.ones(n, bool)
    change[1:] = (words[1:] != words[:-1]) | new[1:]
    key = np.where((k - np.maximum.accumulate(np.where(change, k, 0))) % long == 0, words, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[new] = 0
    window = np.lib.stride_tricks.sliding_window_view(key, long)
    out[np.arange(len(window)) + window.argmin(axis=1)] = True
    return out


_ROOT = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed byte planes; the first is sorted and held as differences."""
    import zstandard

    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    wide = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(wide)
    out, at = [], 0
    for k, w in zip(kinds, wide, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


_KINDS = ("<u8", "<u4", "<i8", "<u4", "<u4")  # hash, document of the tile, its doc_id, first byte, byte after
_LAST = (1 << 63) - 1
_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _merged(idx: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(documents, their byte ranges) with ranges that meet made one."""
    order = np.lexsort((a, idx))
    idx, a, b = idx[order].astype(np.int64), a[order].astype(np.int64), b[order].astype(np.int64)
    far = np.int64(1) << 33
    reach = np.maximum.accumulate(b + idx * far)
    new = np.ones(len(a), bool)
    new[1:] = (a + idx * far)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    end = reach[np.append(at[1:], len(a)) - 1] - idx[at] * far if len(at) else at
    docs, first = np.unique(idx[at], return_index=True)
    spans = pa.StructArray.from_arrays([pa.array(a[at].astype(np.int32)), pa.array(end.astype(np.int32))], names=["a", "b"])
    return docs, pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), spans)


_TILES = "kind int, tile long, idx int, doc_id long, print long, spans array<struct<a:int,b:int>>, block int, data binary"
_NAMES = ["kind", "tile", "idx", "doc_id", "print", "spans", "block", "data"]


def _tiles(blocks: int, sentences: int, min_words: int, long: int, tile_bytes: int):
    """Rows of documents (kind 0, with the ranges repeated inside the tile) and packed runs by block of hash (kind 1)."""

    def run(batches):
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        docs, runs, size, seen = [], [], 0, set()

        def close():
            nonlocal no, size
            tile = (part << 24) | no
            ids = np.array([_LAST if d is None else d for d, _ in docs], np.int64)
            idx, h, a, b = (np.concatenate([r[k] for r in runs]) for k in range(4))
            order = np.lexsort((a, ids[idx], h))
            h, idx, a, b = h[order], idx[order], a[order], b[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
            stay = (ids[idx] == ids[idx[lead]]) & (a == a[lead])
            hit, spans = _merged(idx[~stay], a[~stay], b[~stay])
            place = np.full(len(docs), -1)
            place[hit] = np.arange(len(hit))
            m = len(docs)
            null = lambda t, n=m: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(np.full(m, tile)), pa.array(np.arange(m, dtype=np.int32)), pa.array([d for d, _ in docs], pa.int64()), pa.array([p for _, p in docs], pa.int64()), spans.take(pa.array(place, mask=place < 0)) if len(hit) else pa.nulls(m, _SPAN), null(pa.int32()), null(pa.binary())], names=_NAMES)
            h, idx, a, b = h[stay], idx[stay], a[stay], b[stay]
            cut = np.searchsorted(((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), np.arange(blocks + 1))
            full = np.flatnonzero(np.diff(cut))
            for some in (full[i : i + 64] for i in range(0, len(full), 64)):
                k = len(some)
                data = [_pack(*(c[cut[x] : cut[x + 1]].astype(t) for c, t in zip((h, idx, ids[idx], a, b), _KINDS, strict=True))) for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(np.full(k, tile)), null(pa.int32(), k), null(pa.int64(), k), null(pa.int64(), k), null(_SPAN, k), pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], names=_NAMES)
            no, size = no + 1, 0
            docs.clear(), runs.clear(), seen.clear()

        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            keys, prints = batch.column("doc_id").to_pylist(), batch.column("print").to_pylist()
            for start, texts in _bytes.slices([b or b"" for b in batch.column("text").to_pylist()]):
                doc, h, a, b = runs_of(texts, sentences, min_words, long)
                base = len(docs)
                own = list(zip(keys[start : start + len(texts)], prints[start : start + len(texts)], strict=True))
                fresh = np.ones(len(own), bool)  # rows that repeat are one document
                for i, k in enumerate(own):
                    fresh[i] = k not in seen
                    seen.add(k)
                docs.extend(own)
                keep = fresh[doc]
                runs.append((doc[keep] + base, h[keep], a[keep], b[keep]))
                size += sum(map(len, texts))
                if size >= tile_bytes:
                    yield from close()
        if docs:
            yield from close()
        _bytes.trim()

    return run


def _later(table: pa.Table) -> pa.Table:
    """For each tile the runs of one block of hash that aren't the first of their kind."""
    tiles = table.column("tile").to_pylist()
    parts = [_unpack(d, *_KINDS) for d in table.column("data").to_pylist()]
    h, idx, ids, a, b = (np.concatenate([p[k] for p in parts]) for k in range(5))
    row = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((a, ids, h))
    h, idx, ids, a, b, row = (c[order] for c in (h, idx, ids, a, b, row))
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    gone = np.flatnonzero((ids != ids[lead]) | (a != a[lead]))
    gone = gone[np.lexsort((idx[gone], row[gone]))]
    cut = np.searchsorted(row[gone], np.arange(len(parts) + 1))
    out = [_pack(*(c[gone[cut[k] : cut[k + 1]]].astype("<u4") for c in (idx, a, b))) for k in range(len(parts))]
    del parts, h, idx, ids, a, b, row, order, first, lead, gone
    _bytes.trim()
    return pa.table({"tile": pa.array(tiles, pa.int64()), "data": pa.array(out, pa.binary())})


def _gather(table: pa.Table) -> pa.Table:
    """A tile's replies as merged byte ranges of each document: (tile, idx, far)."""
    parts = [_unpack(d, "<u4", "<u4", "<u4") for d in table.column("data").to_pylist()]
    docs, spans = _merged(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
    return pa.table({"tile": pa.array([table.column("tile")[0].as_py()] * len(docs), pa.int64()), "idx": pa.array(docs.astype(np.int32)), "far": spans})


def _joined(batches):
    """Ranges of each document that meet made one, in order."""
    for batch in batches:
        spans = batch.column("spans")
        each, size = spans.flatten(), np.diff(np.asarray(spans.offsets))
        _, made = _merged(np.repeat(np.arange(batch.num_rows), size), np.asarray(each.field("a")), np.asarray(each.field("b")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), made], names=["doc_id", "print", "spans"])


def repeated_spans(docs: DataFrame, *, sentences: int = SENTENCES, min_words: int = MIN_WORDS, long: int = LONG, tile_bytes: int = TILE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, print, spans): byte ranges of non-first repeated runs, in order and apart, for each text that has any.

    A text is known by doc_id and the hash of its bytes, so rows that repeat both count once.  Runs repeated inside
    a tile of documents are found in its task; of each run the tile sends its first occurrence, packed, to the run's block of
    hash space, so a run that very many documents share arrives once a tile.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.col("text").cast("binary").alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(partitions(spark), -(-size // block_bytes))
    first = tables.write(src.mapInArrow(_tiles(blocks, sentences, min_words, long, tile_bytes), _TILES), "spans", "kind")
    later = first.where("kind = 1").select("block", "tile", "data").groupBy("block").applyInArrow(_later, "tile long, data binary").groupBy("tile").applyInArrow(_gather, "tile long, idx int, far array<struct<a:int,b:int>>")
    every = first.where("kind = 0").select("tile", "idx", "doc_id", "print", "spans").join(later, ["tile", "idx"], "left")
    none = F.array().cast("array<struct<a:int,b:int>>")
    every = every.select("doc_id", "print", F.concat(F.coalesce("spans", none), F.coalesce("far", none)).alias("spans")).where(F.size("spans") > 0)
    every = every.groupBy("doc_id", "print").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    out = tables.write(every.mapInArrow(_joined, "doc_id long, print long, spans array<struct<a:int,b:int>>"), "repeated")
    tables.drop("spans")
    tables.release()
    return out


def dedup(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` (doc_id long, text string, ...) with the cut text, and ``removed``.

    ``options`` are those of ``repeated_spans``.  ``removed`` is an array of the byte ranges (a, b) of the original text that went.  Ties: of equal runs the
    one least by (doc_id, place) is the first, both of rows that share the doc_id; a null doc_id comes last.  Null texts
    stay null, empty ones empty; texts too short for a run are untouched; rows that repeat are cut alike; an empty table gives an empty one.
    A column named ``removed`` is replaced; others may have any name.

    Texts that may have a range, by a bitmap of fixed size, are joined with their ranges and cut by expressions; the others aren't moved.
    """
    columns = [c for c in docs.columns if c != "removed"]
    own = lambda c: F.col("`" + c.replace("`", "``") + "`")
    spans = repeated_spans(docs, **options).select(F.col("doc_id").alias("_doc"), F.col("print").alias("_print"), "spans")
    rest = F.struct(F.lit(0).alias("_"), *[own(c).alias(f"c{k}") for k, c in enumerate(columns) if c != "text"])
    rows = docs.select(rest.alias("_row"), F.col("text").cast("binary").alias("_text"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_of"))
    rows = rows.withColumn("_key", F.xxhash64("_id", "_of"))
    rows = maybe(rows, "_key", bitmap(spans.select(F.xxhash64("_doc", "_print").alias("_key")), "_key"))
    hit = rows.where("_maybe").join(spans, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_of") == F.col("_print")), "left").select("_row", "_text", "spans")
    none = F.array().cast("array<struct<a:int,b:int>>")
    every = hit.unionByName(rows.where("not _maybe").select("_row", "_text", none.alias("spans")))
    start = "if(i = 0, 0, spans[i - 1].b)"
    kept = F.expr(f"array_join(transform(sequence(0, size(spans)), i -> cast(substring(_text, {start} + 1, if(i = size(spans), octet_length(_text), spans[i].a) - {start}) as string)), '')")
    text = F.when(F.size(F.coalesce("spans", none)) > 0, kept).otherwise(F.col("_text").cast("string"))
    made = [(text if c == "text" else F.col("_row")[f"c{k}"]).alias(c) for k, c in enumerate(columns)]
    return every.select(*made, F.coalesce("spans", none).alias("removed"))
