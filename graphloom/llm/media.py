"""Media columns: interleaved documents whose media are resolved by digest.

An HTML document is parsed into an ordered sequence of text and media-reference structs; a media
reference names its payload by digest.  Payloads are stored as lossless 8-bit RGB images (PNG) in
a media table with one row per digest; reading decodes the stored bytes again.  References and
media meet in a join on the digest that carries features, or the media themselves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import Tables, bitmap, maybe  # noqa: F401
from graphloom.shipping import ship

#: Pixels of a row, bytes of a row, and the value that fills the last row.
SIDE, ROW, FILL = 64, 192, 32


def padded(payload: bytes) -> bytes:
    """The payload filled with bytes 32 to a positive multiple of 192."""
    return payload + bytes([FILL]) * (ROW - len(payload) if not payload else -len(payload) % ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A PNG of 64 pixels a row whose RGB samples are the padded payload."""
    rows = np.frombuffer(padded(payload), np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such a PNG; ValueError if any of its bytes has changed."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBB", body[:10])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], ROW + 1)
    if size != (SIDE, len(rows), 8, 2) or rows[:, 0].any():
        raise ValueError("another kind of PNG")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Channel means and deviations in thousandths, and a 64-bit mean hash over an 8 x 8 grid of the samples."""
    x = np.frombuffer(payload, np.uint8)
    n = len(x) // 3
    sums = [(int(c.sum(dtype=np.int64)), int((c.astype(np.int32) ** 2).sum(dtype=np.int64))) for c in (x[0::3], x[1::3], x[2::3])]
    stats = [f"{s * 1000 // n}:{(q * n - s * s) * 1000 // (n * n)}" for s, q in sums]
    edges = np.arange(65, dtype=np.int64) * len(x) // 64
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)))
    cells, width, whole = np.diff(total[edges]), np.diff(edges), int(total[-1])
    bits = "".join("1" if int(c) * len(x) > whole * int(w) else "0" for c, w in zip(cells, width, strict=True))
    return ",".join(stats) + f",{int(bits, 2):016x}"


class _Parser(HTMLParser):
    """Text and media in reading order; script and style content is not text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[tuple[str, str | None, str | None]] = []
        self.buffer: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None

    def _text(self):
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.parts.append(("text", text, None))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figcaption":
            self._text()
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            a = dict(attrs)
            ref = a.get("src") or a.get("data-src")
            if ref:
                self._text()
                self.parts.append(("media", a.get("alt") or None, ref))
        elif tag not in ("a", "b", "i", "em", "strong", "span", "code", "sub", "sup"):
            self._text()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for k in range(len(self.parts) - 1, -1, -1):  # it belongs to the media just before it
                if self.parts[k][0] == "media":
                    self.parts[k] = ("media", text or self.parts[k][1], self.parts[k][2])
                    break
        elif tag not in ("a", "b", "i", "em", "strong", "span", "code", "sub", "sup"):
            self._text()

    def handle_data(self, data):
        if not self.hidden:
            (self.buffer if self.caption is None else self.caption).append(data)


def sequence(page: str | None) -> list[tuple[str, str | None, str | None]]:
    """(kind, text or caption, reference) of each part of an HTML page, in order."""
    p = _Parser()
    p.feed(page or "")
    p.close()
    p._text()
    return p.parts


SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string>>"


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, parts) with the ordered parts of each page; a null or empty page has none.

    ``parts`` are structs of position, kind (text or media), text (of a media part: its caption) and ref.
    """
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType

    def run(batches):
        for batch in batches:
            made = [[{"pos": i, "kind": k, "text": t, "ref": r} for i, (k, t, r) in enumerate(sequence(x))] for x in batch.column(1).to_pylist()]
            parts = pa.array(made, pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), parts], names=[key, "parts"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind.simpleString()}, parts {SEQUENCE}")


def store(payloads: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Columns ``keep``, n_bytes, digest (SHA-256 of the unpadded payload) and media, its stored form, of each row.

    A null payload is empty; a payload of any length is one image and must fit a worker; repeated rows repeat (group by
    digest for a media table), an empty table gives an empty one, other columns are ignored.
    """
    ship(payloads.sparkSession)
    schema = payloads.select(*keep).schema
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema) + "n_bytes long, digest string, media binary"

    def run(batches):
        for batch in batches:
            at = batch.num_columns - 1
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = [b or b"" for b in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(at)), pa.array([len(b) for b in raw], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in raw]), pa.array([encode(b) for b in raw], pa.binary())],
                    names=[*keep, "n_bytes", "digest", "media"],
                )

    return payloads.select(*keep, F.col(text).cast("binary").alias("_payload")).mapInArrow(run, ddl)


def media_table(payloads: DataFrame, references: DataFrame) -> DataFrame:
    """(n_bytes, digest, media): one row per digest of ``payloads`` (text, digest).

    ``references`` (digest) tell which digests several rows have: those rows meet by digest, of which one stays, and the others,
    told apart by a bitmap of fixed size, are stored where they are read and never moved.  Nulls are empty payloads.
    """
    several = references.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    told = maybe(payloads.select("text", "digest"), "digest", bitmap(several, "digest"))
    alone = store(told.where("not _maybe"), "text")
    met = store(told.where("_maybe"), "text").groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("media").alias("media"))
    return alone.unionByName(met)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read(media: DataFrame) -> DataFrame:
    """What the stored media (never null) hold when read back; the other columns stay and ``media`` goes, as do those of READ's names.

    Repeated rows repeat, an empty table gives an empty one.
    """
    keep = [c for c in media.columns if c != "media" and c not in {x.split()[0] for x in READ.split(", ")}]
    ship(media.sparkSession)
    schema = media.select(*keep).schema
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema) + READ

    def run(batches):
        for batch in batches:
            at = batch.num_columns - 1
            rows = []
            for m in (x.as_py() for x in batch.column(at)):
                p = decode(m)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*keep, *(x.split()[0] for x in READ.split(", "))])

    return media.select(*keep, "media").mapInArrow(run, ddl)


def resolve(parts: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per part of ``parts`` (from interleave), in no order but with its pos; media parts with what ``media`` (digest, ...) knows.

    References are ``sha256:`` and a digest; one that no media row has stays, with nulls, and so do texts.  ``media`` must have
    one row per digest: of several, each gives a row.  Its columns named key, pos, kind or text are ignored.  A page that is
    repeated, or whose key is null, keeps its parts; an empty table gives none.  A digest that many documents use is one
    row of the small side of the join.
    """
    each = parts.select(key, F.explode("parts").alias("p")).select(key, "p.pos", "p.kind", "p.text", F.regexp_extract(F.coalesce("p.ref", F.lit("")), "^sha256:([0-9a-f]{64})$", 1).alias("digest"))
    return each.join(media.drop(key, "pos", "kind", "text"), "digest", "left")


def page_of(digest, caption) -> F.col:
    """A minimal interleaved page: a heading, the media reference and its caption."""
    return F.concat(F.lit("<h1>Document</h1><figure><img src=\"sha256:"), digest, F.lit("\"><figcaption>"), caption, F.lit("</figcaption></figure>"))
