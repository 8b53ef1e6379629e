"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def shingles(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def jaccard_components(rows, similarity=80):
    """{row index: (n_shingles, component_id)} of (doc_id, text) rows, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {}
    for ids in by.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                pairs[ids[a], ids[b]] = pairs.get((ids[a], ids[b]), 0) + 1
    for (a, b), both in pairs.items():
        if 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            up[root(b)] = root(a)
    out = {}
    for i in range(len(rows)):
        ids = [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None]
        out[i] = (len(sets[i]), min(ids, default=None))
    return out


def sentence_starts(words, raw, places, hashes, long=8):
    """Numbers of the words that begin a sentence, by the rules one after another."""
    begins = []
    for i, (a, _) in enumerate(places):
        before = raw[places[i - 1][0] : places[i - 1][1]] if i else b""
        marked = before[-1:] in (b".", b"!", b"?") or (len(before) > 1 and before[-1:] in (b'"', b"'", b")", b"]", b"}") and before[-2:-1] in (b".", b"!", b"?"))
        c = ord(raw[a : places[i][1]].decode(errors="replace")[0])
        capital = 0x41 <= c <= 0x5A or 0xC0 <= c <= 0xDE and c != 0xD7 or 0x391 <= c <= 0x3A9 or 0x400 <= c <= 0x42F
        begins.append(i == 0 or marked or capital or b"\n" in raw[places[i - 1][1] : a])
    keys, since = [], 0
    for i, w in enumerate(words):
        if not i or w != words[i - 1] or begins[i]:
            since = i
        keys.append(-1 if begins[i] else hashes[i] if (i - since) % long == 0 else 2**64 - 1)
    picked = {i for i, b in enumerate(begins) if b}
    for i in range(len(words) - long + 1):
        picked.add(min(range(i, i + long), key=lambda k: (keys[k], k)))
    return sorted(picked)


def sentence_runs(text, sentences=3, min_words=20):
    """(words, first byte, byte after) of every run of sentences."""
    from graphloom.llm import _bytes

    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    words = [raw[a:b].lower() for a, b in places]
    starts = sentence_starts(words, raw, places, _bytes.word_hashes([raw])[0].tolist())
    edges, out = [*starts, len(words)], []
    for k, at in enumerate(starts):
        for j in range(k + sentences, len(edges)):
            if edges[j] - at >= min_words:
                out.append((tuple(words[at : edges[j]]), places[at][0], places[edges[j]][0] if edges[j] < len(words) else len(raw)))
                break
    return out


def substring_dedup(rows):
    """Texts of (doc_id, text) rows without the sentences of runs that a dictionary has met before."""
    first, runs, seen = {}, [], set()
    for key, text in rows:
        if text is None or (key, text) in seen:
            continue
        seen.add((key, text))
        for x, s, e in sentence_runs(text):
            place = (float("inf") if key is None else key, s)
            first[x] = min(first.get(x, place), place)
            runs.append((key, text, x, place, s, e))
    cut = {}
    for key, text, x, place, s, e in runs:
        if place != first[x]:
            cut.setdefault((key, text), []).append((s, e))
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, None))
            continue
        raw, keep = text.encode(), bytearray(b"\1" * len(text.encode()))
        for s, e in cut.get((key, text), []):
            keep[s:e] = b"\0" * (e - s)
        out.append((key, bytes(c for c, k in zip(raw, keep, strict=True) if k).decode()))
    return out


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    """{source: target} by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        give = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += give[s]
            if target[s] >= passes * sizes[s]:
                left += target[s] - passes * sizes[s]
                target[s] = passes * sizes[s]
                open_.discard(s)
    return target


def media_row(text):
    raw = (text or "").encode()
    pay = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
    return len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])


def conversation(rows):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "", r[2] or ""))
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def ngram_counts(text, bits=13):
    """Occurrences in each hashed dimension of byte n-grams of two to four bytes, letter runs parted by one blank."""
    folded = bytearray()
    for c in b" " + text.encode() + b" ":
        c = c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
        if c != 32 or not folded or folded[-1] != 32:
            folded.append(c)
    out = [0] * (1 << bits)
    for k in (2, 3, 4):
        for i in range(len(folded) - k + 1):
            code = 0
            for c in folded[i : i + k]:
                code = code * 257 + c
            out[(code * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)] += 1
    return out


def nearest(text, model):
    """(language, cosine) of the nearest centroid, one product after another."""
    v = [math.log1p(c) * float(w) for c, w in zip(ngram_counts(text), model.idf, strict=True)]
    size = math.sqrt(sum(x * x for x in v)) or 1.0
    near = [sum(x * float(y) for x, y in zip(v, c, strict=True)) / size for c in model.centroids]
    return model.languages[model.owner[near.index(max(near))]], max(near)


def sketch(text, share=0.25):
    """Hashes of the text's distinct shingles, each hashed alone, that lie below the share of hash space."""
    from graphloom.llm import _bytes

    hashes = [int(_bytes.shingle_sets([" ".join(s).encode()], 5)[0][0]) for s in shingles(text)]
    return {h for h in hashes if h < share * 2**64}


def sketch_likeness(a, b):
    if shingles(a) == shingles(b):
        return 1.0
    x, y = sketch(a), sketch(b)
    return len(x & y) / max(1, len(x | y))


def _padded(raw):
    return raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)


def png(raw):
    """An RGB PNG of 64 pixels a row, written out part by part."""
    pay = _padded(raw)
    lines = b"".join(b"\0" + pay[i : i + 192] for i in range(0, len(pay), 192))
    out = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", (64).to_bytes(4, "big") + (len(pay) // 192).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])), (b"IDAT", zlib.compress(lines, 6)), (b"IEND", b"")):
        out += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return out


def media_feature(raw):
    pay = _padded(raw)
    told = []
    for c in range(3):
        x = pay[c::3]
        s, q, n = sum(x), sum(v * v for v in x), len(x)
        told.append(f"{s * 1000 // n}:{(q * n - s * s) * 1000 // (n * n)}")
    bits = 0
    for k in range(64):
        a, b = k * len(pay) // 64, (k + 1) * len(pay) // 64
        bits = bits * 2 + (sum(pay[a:b]) * len(pay) > sum(pay) * (b - a))
    return ",".join(told) + f",{bits:016x}"
