"""N-gram Jaccard join: every link of Jaccard >= 0.8 on five-word shingles, as components.

The document by n-gram incidence is multiplied with its transpose block by block, and a
pair is dropped as soon as a bound that follows from the sizes alone rules it out:

1. A linked document shares at least 80 % of its own shingles with its partner.  Of a
   fixed share of hash space, screened column block by column block, at most 20 % of its
   size may therefore be its own alone; other documents leave (``_tiler``, ``_shared``).
2. The rest are held to the bound on all their shingles, counted exactly, and keep as many
   of their rarest shared ones as a partner can't miss all of (prefix filtering).
3. Columns with several documents first compare each document with one pivot, then, in
   columns that still hold several components, all pairs between components.  Pairs inside a
   component need no test, so a group of copies costs a star and no square; a pair is met only
   in a column where the shingles still ahead of both can make up the overlap it needs.
4. The product of the pairs that are left is taken column block by column block: each block gives
   a pair's overlap in it, the overlaps add up, and pairs below the bound of their sizes go.

Identical sets are folded into one class before any of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import _bytes
from graphloom.llm.shared import Tables, bitmap, components, maybe_in, partitions

WIDTH = 5
SIMILARITY = 80
#: Share of hash space that the screen looks at; the bound holds for any share.
SCREEN = 0.4
#: Texts of one tile; a tile is one row block of the incidence.
TILE_BYTES = 16 << 20
#: Entries of a column block of the screen.
BLOCK = 1 << 21
#: Rounds of pivots before the remaining columns are compared in full.
PIVOTS = 3
#: Column blocks of the product, by the first bits of the hash.
CELL_BITS = 2

_HELD = np.uint32(0xFFFFFFFF)
_ROWS = "kind int, tile long, idx int, doc_id long, n long, f1 long, f2 long, q int, loc int, hs binary, ids binary"


def _pack(h: np.ndarray) -> bytes:
    """Sorted 48-bit values as byte planes of their differences."""
    d = np.diff(h, prepend=np.uint64(0))
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(6, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :6] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def prints(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify each set."""
    one, two = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=one[1:])
    np.cumsum(_bytes.mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=two[1:])
    return (one[bounds[1:]] - one[bounds[:-1]]).view(np.int64), (two[bounds[1:]] - two[bounds[:-1]]).view(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in batch.column("text").to_pylist()]


def _tiler(width: int, screen: float, tile_bytes: int):
    edge = np.uint64(int(screen * (1 << 48)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        docs, hs, ids, size, seen = [], [], [], 0, 0

        def close():
            nonlocal no, size, seen
            tile = (part << 24) | no
            doc_id, n, f1, f2 = (np.concatenate([d[k] for d in docs]) if k else [x for d in docs for x in d[0]] for k in range(4))
            h, idx = np.concatenate(hs), np.concatenate(ids)
            q = np.bincount(idx, minlength=seen)
            # of equal sets in the tile only the first takes part
            _, first = np.unique(np.rec.fromarrays([f1, f2, n]), return_index=True)
            lead = np.zeros(seen, bool)
            lead[first] = True
            keep = lead[idx]
            h, idx = h[keep], idx[keep]
            order = np.argsort(h, kind="stable")
            h, idx = h[order], idx[order]
            at = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
            many = np.diff(np.append(at, len(h))) > 1
            run_of = np.repeat(many, np.diff(np.append(at, len(h))))
            loc = np.bincount(idx[run_of], minlength=seen)
            mine = np.where(many, _HELD, idx[at].astype(np.uint32)) if len(at) else np.zeros(0, np.uint32)
            m = seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), pa.array(np.full(m, tile)), pa.array(np.arange(m, dtype=np.int32)), pa.array(doc_id, pa.int64()), pa.array(n), pa.array(f1), pa.array(f2), pa.array(q.astype(np.int32)), pa.array(np.where(lead, loc, -1).astype(np.int32)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())],
                names=NAMES,
            )
            null = lambda t: pa.nulls(1, t)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([tile]), null(pa.int32()), null(pa.int64()), pa.array([len(at)]), null(pa.int64()), null(pa.int64()), null(pa.int32()), null(pa.int32()), pa.array([_pack(h[at])]), pa.array([mine.astype("<u4").tobytes()])], names=NAMES)
            no, size, seen = no + 1, 0, 0
            docs.clear(), hs.clear(), ids.clear()

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), _texts(batch)
            for start, part_texts in _bytes.slices(texts):
                h, b = _bytes.shingle_sets(part_texts, width)
                f1, f2 = prints(h, b)
                docs.append((keys[start : start + len(part_texts)], np.diff(b), f1, f2))
                short = h >> np.uint64(16)
                take = short < edge
                hs.append(short[take])
                ids.append(np.repeat(np.arange(seen, seen + len(part_texts)), np.diff(b))[take])
                seen += len(part_texts)
                size += sum(map(len, part_texts))
                if size >= tile_bytes:
                    yield from close()
        if seen:
            yield from close()
        _bytes.trim()

    return run


NAMES = ["kind", "tile", "idx", "doc_id", "n", "f1", "f2", "q", "loc", "hs", "ids"]


def _columns(blocks: int, screen: float):
    """Cut each tile into its column blocks."""
    edges = np.array([int(screen * (1 << 48)) * k // blocks for k in range(blocks + 1)], np.uint64)

    def run(batches):
        for batch in batches:
            for tile, hs, ids in zip(*(batch.column(c).to_pylist() for c in ("tile", "hs", "ids")), strict=True):
                h, i = _unpack(hs), np.frombuffer(ids, "<u4")
                cut = np.searchsorted(h, edges)
                cut[-1] = len(h)
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), tile)), pa.array([_pack(h[cut[k] : cut[k + 1]]) for k in full], pa.binary()), pa.array([i[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())], names=["block", "tile", "hs", "ids"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The documents of each tile, once for each entry that another document has too, in one column block."""
    tiles = table.column("tile").to_pylist()
    parts = [_unpack(b) for b in table.column("hs").to_pylist()]
    h, ids = np.concatenate(parts), np.concatenate([np.frombuffer(b, "<u4") for b in table.column("ids").to_pylist()])
    row = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
    order = np.argsort(h, kind="stable")
    h, ids, row = h[order], ids[order], row[order]
    at = np.flatnonzero(np.concatenate((np.ones(1, bool), h[1:] != h[:-1])))
    length = np.diff(np.append(at, len(h)))
    many = (length > 1) | np.logical_or.reduceat(ids == _HELD, at)
    take = np.repeat(many, length) & (ids != _HELD)
    take = np.flatnonzero(take)[np.argsort(row[take], kind="stable")]
    row, ids = row[take], ids[take]
    cut = np.searchsorted(row, np.arange(len(parts) + 1))
    return pa.table({"tile": pa.array(tiles, pa.int64()), "ids": pa.array([ids[cut[k] : cut[k + 1]].tobytes() for k in range(len(parts))], pa.binary())})


def _counts(table: pa.Table) -> pa.Table:
    """Add up a tile's replies: (tile, idx, c)."""
    ids = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("ids").to_pylist()])
    idx, c = np.unique(ids, return_counts=True)
    return pa.table({"tile": pa.array([table.column("tile")[0].as_py()] * len(idx), pa.int64()), "idx": pa.array(idx.astype(np.int32)), "c": pa.array(c.astype(np.int32))})


def _sets(width: int):
    """Each document's shingles, cut into the column blocks of the product."""
    cells = 1 << CELL_BITS

    def run(batches):
        for batch in batches:
            keys = batch.column("doc_id")
            for start, texts in _bytes.slices(_texts(batch)):
                h, b = _bytes.shingle_sets(texts, width)
                f1, f2 = prints(h, b)
                at = np.repeat(np.arange(len(texts)), np.diff(b)) * cells + (h >> np.uint64(64 - CELL_BITS)).view(np.int64)
                cut = np.searchsorted(at, np.arange(len(texts) * cells + 1))
                inner = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * cells + 1, cells), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([keys.slice(start, len(texts)), pa.array(np.diff(b)), pa.array(f1), pa.array(f2), made], names=["doc_id", "n", "f1", "f2", "cells"])
        _bytes.trim()

    return run


def jaccard_join(docs: DataFrame, *, width: int = WIDTH, similarity: int = SIMILARITY, screen: float = SCREEN, tile_bytes: int = TILE_BYTES, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string): doc_id, n_shingles, component_id, class_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a document's set is its distinct shingles
    of ``width`` words, or its whole sequence where it has fewer.  Documents link when
    100 * intersection >= ``similarity`` * union.  ``component_id`` is the least doc_id reachable by
    links; ``class_id`` the least one with the same set.

    Null and wordless texts have n_shingles 0 and stand alone.  A null doc_id keeps its row, links
    as any other, and never is a component's id unless the component has no other.  Repeated rows
    give repeated result rows, an empty table an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    first = tables.write(src.mapInArrow(_tiler(width, screen, tile_bytes), _ROWS), "tiles", "kind")
    rows = first.where("kind = 0").select("tile", "idx", "doc_id", "n", "f1", "f2", "q", "loc")
    tiles = first.where("kind = 1").select("tile", "n", "hs", "ids")
    blocks = max(partitions(spark), math.ceil((tiles.agg(F.sum("n")).first()[0] or 0) / block))
    cut = tiles.select("tile", "hs", "ids").mapInArrow(_columns(blocks, screen), "block int, tile long, hs binary, ids binary")
    shared = cut.groupBy("block").applyInArrow(_shared, "tile long, ids binary").groupBy("tile").applyInArrow(_counts, "tile long, idx int, c int")
    need = F.expr(f"cast(ceil({similarity} * n / 100.0) as long)")
    passed = (F.col("n") > 0) & (F.col("loc") >= 0) & (F.col("q") - F.col("loc") - F.coalesce("c", F.lit(0)) <= F.col("n") - need)
    classes = tables.write(rows.join(shared, ["tile", "idx"], "left").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.max(passed).alias("open")), "classes")
    members = tables.write(rows.select("doc_id", "n", "f1", "f2"), "members")
    tables.drop("tiles")
    del first, rows, tiles, cut, shared
    tables.release()

    live = classes.where("open").select("f1", "f2", "n", "rep")
    near = maybe_in(src, "doc_id", bitmap(live, "rep")).mapInArrow(_sets(width), "doc_id long, n long, f1 long, f2 long, cells array<array<bigint>>")
    near = near.join(live, ["f1", "f2", "n"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).groupBy("f1", "f2", "n").agg(F.first("rep").alias("rep"), F.first("cells").alias("cells"))
    near = tables.write(near.select(F.monotonically_increasing_id().alias("node"), "*"), "sets")
    tables.release()

    entries = tables.write(_prefixes(near, similarity), "prefixes")
    roots = _merge(tables, entries, near.select("node", "n", "cells"), similarity, pivots)

    known = near.select("node", "f1", "f2", "n", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("rep").alias("component"))
    named = known.join(least, "root").select("f1", "f2", "n", "component")
    named = tables.write(classes.join(named, ["f1", "f2", "n"], "left").select("f1", "f2", "n", "rep", F.coalesce("component", "rep").alias("component")), "named")
    tables.drop("prefixes", "sets", "classes")
    out = members.join(named, ["f1", "f2", "n"])
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"),
    )


def _prefixes(near: DataFrame, similarity: int) -> DataFrame:
    """(h, node, n, r): the rarest shared shingles of each set, so many that partners can't miss them all.

    ``r`` is the shingle's place among all of the set's, rarest first.
    """
    each = near.select("node", "n", F.explode(F.flatten("cells")).alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    found = each.join(often, "h")
    from pyspark.sql import Window

    found = found.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("df", "h")))
    found = found.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("node")))
    # those shared with no other set come first and can't match
    found = found.withColumn("r", F.col("r") + F.col("n") - F.col("k"))
    return found.where(F.expr(f"r <= n - ceil({similarity} * n / 100.0) + 1")).select("h", "node", "n", "r")


def _reach(similarity: int) -> F.col:
    """Whether a pair whose first common shingle this is can still reach the overlap that it needs.

    Both sets have at most n - r + 1 common shingles left; sizes too far apart fail as well.
    """
    need = f"(({similarity} * (n + pn) + {100 + similarity} - 1) div {100 + similarity})"
    return F.expr(f"r <= n - {need} + 1 and pr <= pn - {need} + 1")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (x, y, a, b) with the sizes nx and ny of their sets and their overlap c, added up over the column blocks."""
    each = sets.select("node", "n", F.posexplode("cells").alias("block", "cell")).where(F.size("cell") > 0)
    x = each.select(F.col("node").alias("x"), F.col("n").alias("nx"), "block", F.col("cell").alias("cx"))
    y = each.select(F.col("node").alias("y"), F.col("n").alias("ny"), "block", F.col("cell").alias("cy"))
    met = pairs.join(x, "x").join(y, ["y", "block"]).withColumn("c", F.size(F.array_intersect("cx", "cy")))
    return met.groupBy("x", "y", "a", "b", "nx", "ny").agg(F.sum("c").alias("c"))


def _merge(tables: Tables, entries: DataFrame, sets: DataFrame, similarity: int, pivots: int) -> DataFrame:
    """(node, root) of every node that has a link."""
    labels = entries.select("node").distinct().withColumn("root", F.col("node"))
    labels = tables.write(labels, "labels")
    fits = _reach(similarity)
    for turn in range(pivots + 1):
        now = entries.join(labels, "node")
        # the first pivot of a column is the set that has least ahead of it; later ones are drawn by hash
        order = F.col("r") if turn == 0 else F.xxhash64("node", F.lit(turn))
        per = now.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(order.alias("o"), "node", "n", "r")).alias("m"))
        per = per.groupBy("h").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.count(F.lit(1)).alias("roots"), F.min(F.struct("m.o", "m.node", "m.n", "m.r", "root")).alias("m")).where("roots > 1")
        open_ = tables.write(per.select("h", "k", "kk", F.col("m.node").alias("pivot"), F.col("m.n").alias("pn"), F.col("m.r").alias("pr"), F.col("m.root").alias("proot")), "columns")
        left = open_.agg(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2).alias("pairs"), F.sum("k").alias("k")).first()
        if not left["k"]:
            break
        last = turn == pivots or left["pairs"] <= left["k"]
        if not last:
            pairs = now.join(open_.drop("k", "kk"), "h").where(fits & (F.col("root") != F.col("proot")))
            pairs = pairs.select(F.col("node").alias("x"), F.col("pivot").alias("y"), F.col("root").alias("a"), F.col("proot").alias("b")).distinct()
        else:
            one = now.join(open_.select("h"), "h", "left_semi")
            two = one.select("h", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("r").alias("pr"), F.col("root").alias("proot"))
            pairs = one.join(two, "h").where(fits & (F.col("node") < F.col("pivot")) & (F.col("root") != F.col("proot")))
            pairs = pairs.select(F.col("node").alias("x"), F.col("pivot").alias("y"), F.col("root").alias("a"), F.col("proot").alias("b")).distinct()
        links = tables.write(_overlaps(pairs, sets).where(100 * F.col("c") >= similarity * (F.col("nx") + F.col("ny") - F.col("c"))).select("a", "b").distinct(), "links")
        if not links.isEmpty():
            roots = components(tables, links).select(F.col("id").alias("root"), F.col("root").alias("to"))
            labels = tables.write(labels.join(roots, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            tables.drop("cc-result")
        tables.drop("columns", "links")
        if last:
            break
        tables.release()
    return labels
