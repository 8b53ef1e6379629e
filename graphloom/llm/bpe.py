"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Documents are cut into pre-tokens by a pattern.  A tile of documents keeps, for each document, the
places of its words in the tile's sorted list of distinct words; the lists are exploded by a hash
of the word, so each distinct word of the corpus meets in one task and is encoded once there.  Its ids go back
to each tile that has it, and the tile's documents are reassembled by position.  Words and ids
travel in packed runs, one per tile and hash bucket.  Decoding looks ids up in the token-byte table.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._bytes import trim
from graphloom.llm.shared import partitions
from graphloom.shipping import ship

#: Text of a tile, in characters, and distinct words of a tile.
TILE_CHARS, TILE_WORDS = 16 << 20, 1 << 20
#: Bytes of text for each bucket of words.
BUCKET_BYTES = 16 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Decoder:
    """Ids to bytes by the token-byte table."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        table = [b""] * size
        for token, rank in ranks.items():
            table[rank] = token
        self.length = np.fromiter(map(len, table), np.int64, size)
        self.start = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.length)))[:-1]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        out, step = [], 1 << 18
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            if len(part) and (part.min() < 0 or part.max() >= len(self.length)):
                raise ValueError("an id that the vocabulary doesn't have")
            n = self.length[part]
            end = np.cumsum(n)
            place = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - n, n) + np.repeat(self.start[part], n)
            out.append(self.bytes[place].tobytes())
        return b"".join(out)


def _encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _tiles(pattern: str, tile_chars: int, tile_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        squeeze = zstandard.ZstdCompressor(level=1).compress
        part, no = TaskContext.get().partitionId(), 0
        words: dict[str, int] = {}
        docs: list[tuple] = []
        chars = 0

        def close():
            nonlocal no, chars
            # frequent words first, by powers of two, then by bytes: places and lists both compress
            level = np.frexp(np.bincount(np.concatenate([d[1] for d in docs]), minlength=len(words)))[1]
            listed = [(w, i) for _, w, i in sorted((-int(level[i]), w.encode("utf-8", "surrogatepass"), i) for w, i in words.items())]
            rank = np.empty(len(listed), np.uint32)
            rank[[i for _, i in listed]] = np.arange(len(listed), dtype=np.uint32)
            kind = "<u4" if len(listed) > 1 << 16 else "<u2"
            packed = zlib.crc32(b"\0".join(w for w, _ in listed))
            tile = f"{part}-{no}-{len(listed)}-{packed:08x}"  # the words are part of the name: a rerun with other rows can't be mixed in
            for at in range(0, len(docs), 256):
                some = docs[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * len(some), pa.int32()), pa.array([tile] * len(some)), pa.array([d[0] for d in some], pa.int64()), pa.array([len(d[1]) for d in some], pa.int64()), pa.array([squeeze(_planes(rank[d[1]].astype(kind))) for d in some], pa.binary())],
                    names=["kind", "tile", "doc_id", "n", "data"],
                )
            data = b"\0".join(w.replace(b"\x01", b"\x01\x02").replace(b"\0", b"\x01\x03") for w, _ in listed)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([tile]), pa.nulls(1, pa.int64()), pa.array([len(listed)], pa.int64()), pa.array([squeeze(data)], pa.binary())], names=["kind", "tile", "doc_id", "n", "data"])
            no, chars = no + 1, 0
            words.clear(), docs.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = find(text.as_py() or "")
                place = np.empty(len(found), np.uint32)
                for at in range(0, len(found), 1 << 16):
                    some = found[at : at + (1 << 16)]
                    place[at : at + len(some)] = [words.setdefault(w, len(words)) for w in some]
                docs.append((doc_id, place))
                chars += sum(map(len, found))
                if chars >= tile_chars or len(words) >= tile_words:
                    yield from close()
        if docs:
            yield from close()
        trim()

    return run


def _planes(a: np.ndarray) -> bytes:
    """Low bytes first, then high ones: they compress apart."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(b: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _listed(data: bytes, n: int) -> list[bytes]:
    return [w.replace(b"\x01\x03", b"\0").replace(b"\x01\x02", b"\x01") for w in data.split(b"\0")] if n else []


def _buckets(count: int):
    """Deal each tile's words out by hash: (bucket, tile, their places in the tile, the words)."""

    def run(batches):
        press, open_ = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            batch = batch.filter(pc.equal(batch.column("kind"), 1))
            for tile, n, data in zip(*(batch.column(c).to_pylist() for c in ("tile", "n", "data")), strict=True):
                words = _listed(open_(data), n)
                at = np.fromiter((zlib.crc32(w) % count for w in words), np.int64, len(words))
                order = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[order], np.arange(count + 1))
                raw = data and [w.replace(b"\x01", b"\x01\x02").replace(b"\0", b"\x01\x03") for w in words]
                full = np.flatnonzero(np.diff(cut))
                for some in (full[i : i + 64] for i in range(0, len(full), 64)):
                    own = [order[cut[k] : cut[k + 1]] for k in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some.astype(np.int32)), pa.array([tile] * len(some)), pa.array([press(_planes(np.diff(o, prepend=0).astype("<u4"))) for o in own], pa.binary()), pa.array([press(b"\0".join([raw[i] for i in o])) for o in own], pa.binary())],
                        names=["bucket", "tile", "places", "words"],
                    )

    return run


def _encode_bucket(shipped, pattern: str):
    """Encode each distinct word of a bucket once; its ids go back to each tile."""

    def run(key, batches):
        encode = _worker(shipped, pattern)
        press, open_ = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            tiles, places, lists = (batch.column(c).to_pylist() for c in ("tile", "places", "words"))
            out = []
            for data in lists:
                ids = []
                for w in _listed(open_(data), 1):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w)
                    ids.append(got)
                flat = np.fromiter((x for i in ids for x in i), np.uint32)
                out.append(press(_planes(np.fromiter(map(len, ids), np.uint32, len(ids))) + _planes(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(tiles), pa.array(places, pa.binary()), pa.array(out, pa.binary())], names=["tile", "places", "ids"])

    return run


_held: dict = {}


def _worker(shipped, pattern: str):
    """This worker's encoder: made once from the broadcast ranks (a vocabulary, at most some MB)."""
    key = (id(shipped.value), pattern)
    if key not in _held:
        _held.clear()
        _held[key] = _encoder(shipped.value, pattern)._encode_single_piece
    return _held[key]


def _assemble(shipped, emit: str):
    """Ids of each document of a tile, in order of position."""

    def run(key, docs, words):
        open_ = zstandard.ZstdDecompressor().decompress
        docs = [b.filter(pc.equal(b.column("kind"), 0)) for b in docs]
        rows = [r for b in docs for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "data")), strict=True)]
        size = int(key[0].as_py().split("-")[2])
        length, runs = np.zeros(size, np.int64), []
        for batch in words:
            for places, ids in zip(batch.column("places").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                at = np.cumsum(_unplanes(open_(places), "<u4"), dtype=np.int64)
                raw = open_(ids)
                n = _unplanes(raw[: 4 * len(at)], "<u4")
                length[at] = n
                runs.append((at, n.astype(np.int64), _unplanes(raw[4 * len(at) :], "<u4")))
        if size and not length.all():
            raise RuntimeError("words of this tile are missing: its rows changed between two reads")
        start = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
        table = np.zeros(int(start[-1]), np.uint32)
        for at, n, ids in runs:
            table[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        kind = "<u4" if size > 1 << 16 else "<u2"
        decoder = Decoder(shipped.value) if emit == "digest" else None
        for first in range(0, len(rows), 128):
            keys, counts, bodies, one, two = [], [], [], [], []
            for doc_id, n, data in rows[first : first + 128]:
                seq = _unplanes(open_(data), kind).astype(np.int64) if n else np.zeros(0, np.int64)
                m = length[seq]
                end = np.cumsum(m)
                ids = table[np.repeat(start[seq] - (end - m), m) + np.arange(int(end[-1]) if n else 0)]
                keys.append(doc_id), counts.append(len(ids))
                if emit == "ids":
                    bodies.append(ids.astype(np.int32))
                else:
                    one.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    two.append(hashlib.sha256(decoder.decode(ids.astype(np.int64))).hexdigest())
            cols = [pa.array(keys, pa.int64()), pa.array(counts, pa.int64())]
            if emit == "ids":
                yield pa.RecordBatch.from_arrays([*cols, pa.array(bodies, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(one), pa.array(two)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, emit: str = "ids", tile_chars: int = TILE_CHARS, tile_words: int = TILE_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Token ids of the whole text of each row of ``docs`` (doc_id long, text string).

    ``emit="ids"``: doc_id, n_tokens, ids array<int>.  ``emit="digest"``: doc_id, n_tokens, ids_sha256 (of
    little-endian unsigned 32-bit ids) and decoded_sha256 (of the bytes that the ids decode to).
    Null and empty texts have no ids; a null doc_id keeps its row; repeated rows repeat; an empty
    table gives an empty result; other columns are ignored.  No special token is ever made.

    A document's positions and ids are held by one task together with its tile's, so a tile (and at
    least one document) must fit a Python worker: some 20 bytes a character of the longest document.
    """
    spark = docs.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(ranks)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # one exchange by tile serves both sides below: the word lists to deal out and the documents to reassemble
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(partitions(spark), math.ceil(size / bucket_bytes))
    first = src.mapInArrow(_tiles(pattern, tile_chars, tile_words), "kind int, tile string, doc_id long, n long, data binary").repartition(count, "tile")
    back = first.mapInArrow(_buckets(count), "bucket int, tile string, places binary, words binary").groupBy("bucket").applyInArrow(_streamed(_encode_bucket(shipped, pattern)), "tile string, places binary, ids binary")
    out = "doc_id long, n_tokens long, " + ("ids array<int>" if emit == "ids" else "ids_sha256 string, decoded_sha256 string")
    return first.groupBy("tile").cogroup(back.groupBy("tile")).applyInArrow(_tabled(_assemble(shipped, emit)), out)


def _streamed(f):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(f(None, table.to_batches(max_chunksize=64))), schema=pa.schema([("tile", pa.string()), ("places", pa.binary()), ("ids", pa.binary())]))

    return run


def _tabled(f):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        made = list(f(key, left.to_batches(), right.to_batches()))
        return pa.Table.from_batches(made) if made else None

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int], *keep: str, ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and ``decoded`` (binary): the token bytes of each row's ids, in order.

    The token-byte table is shipped to the tasks: it has one row per vocabulary entry, whatever the corpus.
    Null ids decode to no bytes; an id outside the vocabulary fails the task.
    """
    ship(encoded.sparkSession)
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = encoded.select(*keep).schema
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema) + "decoded binary"

    def run(batches):
        decoder = Decoder(shipped.value)
        for batch in batches:
            made = [decoder.decode(np.asarray(x.as_py() or [], np.int64)) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(made, pa.binary())], names=[*keep, "decoded"])

    return encoded.select(*keep, F.col(ids)).mapInArrow(run, ddl)
