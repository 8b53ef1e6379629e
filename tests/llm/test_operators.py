"""The ten operators against plain Python on small tables, and the cases each promises to survive."""

import hashlib
import random
import re
import textwrap

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import _bytes, bpe, chat, fingerprints, language_id, license_scans, media, mixing, ngram_jaccard, queries, substring_dedup, url_filters

DOCS = "doc_id long, text string, lang string, source string, extra string"
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + str(r.randrange(40)) for _ in range(n))


def odd_rows():
    """Nulls, empties, ties, repeated rows, whitespace, control characters, long and unusual texts."""
    base = prose(1, 120)
    words = base.split()
    rows = [(1, base), (2, base.upper()), (3, None), (4, ""), (5, " \t\n "), (6, "one two"), (7, "ONE  two"), (None, base), (None, None), (8, base), (8, base)]
    rows += [(100 + k, " ".join(words[:k] + ["other"] + words[k + 1 :])) for k in range(0, 60, 7)]
    rows += [(30, prose(2, 3000)), (31, "a\0b\x01c ’s don't 日本語 ​ é \U0001f600\U0001f600 ١٢٣ ½ ǅ"), (32, "x" * 5000), (33, "a " * 400), (34, "!!! ??? ..."), (35, "\x1c\x1d\x85  z")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s" if i is None or i % 2 else None, "x") for i, t in odd_rows()]
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ranks_and_pattern():
    return queries.vocabulary()


# --- word and shingle hashing


def test_shingle_sets_count_as_plain_sets():
    texts = [t or "" for _, t in odd_rows()]
    h, b = _bytes.shingle_sets([t.encode() for t in texts], 5)
    assert list(np.diff(b)) == [len(brute.shingles(t)) for t in texts]


def test_slices_keep_every_value_in_order():
    values = [b"a" * n for n in (0, 3, 10, 2, 0, 7)]
    got = list(_bytes.slices(values, 5))
    assert [v for _, part in got for v in part] == values and [s for s, _ in got] == sorted(s for s, _ in got)


# --- 3: BPE


def test_bpe_encodes_as_the_library_and_decodes_back(odd):
    import tiktoken

    ranks, pattern = ranks_and_pattern()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(odd, ranks, pattern, emit="digest", tile_chars=300, bucket_bytes=500).collect())
    want = []
    for i, t in odd_rows():
        ids = enc.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_ids_decode_by_the_token_table(odd):
    ranks, pattern = ranks_and_pattern()
    back = bpe.decode(bpe.encode(odd, ranks, pattern), ranks, "doc_id").collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded).decode()) for r in back) == sorted((i or -1, t or "") for i, t in odd_rows())


def test_bpe_of_nothing_and_of_foreign_ids(empty):
    assert bpe.encode(empty, *ranks_and_pattern()).collect() == []
    decoder = bpe.Decoder({b"a": 0, b"bc": 1})
    assert decoder.decode(np.array([1, 0, 1])) == b"bcabc"
    for ids in ([-1], [0, 2]):
        with pytest.raises(ValueError):
            decoder.decode(np.array(ids))


# --- 4: Jaccard join


def check_components(rows, got):
    want = brute.jaccard_components(rows)
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == sorted((rows[i][0] or -1, n, c if c is not None else -1) for i, (n, c) in want.items())


@pytest.mark.parametrize("options", [{}, {"tile_bytes": 2000, "block": 50, "pivots": 1}, {"screen": 1.0, "pivots": 0, "tile_bytes": 500}])
def test_jaccard_components(odd, options):
    check_components([(i if n else i, t) for n, (i, t) in enumerate(odd_rows())], [r for r in ngram_jaccard.jaccard_join(odd, **options).collect()])


def test_jaccard_on_chained_near_copies(spark):
    r = random.Random(5)
    rows, words = [], prose(7, 90).split()
    for k in range(150):
        own = list(words)
        for _ in range(r.randrange(5)):
            own[r.randrange(len(own))] = r.choice(VOCABULARY)
        rows.append((k, " ".join(own)))
        if k % 30 == 0:
            words[r.randrange(len(words))] = f"w{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_components(rows, ngram_jaccard.jaccard_join(df, tile_bytes=4000, block=100).collect())


def test_jaccard_overlaps_add_up_over_blocks(spark):
    texts = [prose(k // 3, 60) + " " + prose(90 + k, 5 * k) for k in range(9)] + ["a", "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    sets = df.mapInArrow(ngram_jaccard._sets(5), "doc_id long, n long, f1 long, f2 long, cells array<array<bigint>>").withColumnRenamed("doc_id", "node")
    pairs = spark.createDataFrame([(x, y, x, y) for x in range(len(texts)) for y in range(x)], "x long, y long, a long, b long")
    got = {(r.x, r.y): (r.nx, r.ny, r.c) for r in ngram_jaccard._overlaps(pairs, sets).collect()}
    own = [brute.shingles(t) for t in texts]
    for x in range(len(texts)):
        for y in range(x):
            both = len(own[x] & own[y])
            assert got.get((x, y), (len(own[x]), len(own[y]), 0)) == (len(own[x]), len(own[y]), both)


def test_jaccard_of_nothing(empty):
    assert ngram_jaccard.jaccard_join(empty).collect() == []


# --- 5: mixing


def test_mixing_meets_targets(spark):
    r = random.Random(3)
    rows = [(k, prose(k, r.randrange(0, 60)), f"s{r.choice([0, 0, 0, 0, 1, 2, 3])}" if k % 11 else None) for k in range(400)] + [(1, prose(1, 5), "s1"), (1, prose(1, 5), "s1"), (401, None, "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, bucket=16).collect()
    assert len(got) == len(rows)
    size, taken = {}, {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        size[x.source] = size.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    want = brute.mix_targets(size)
    for x in got:
        assert x.source_size == size[x.source] and x.target == pytest.approx(want[x.source], abs=1e-6)
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert [x.position for x in got if x.taken] == sorted(x.position for x in got if x.taken)
    again = mixing.mix(df.repartition(7), bucket=16).collect()
    assert [(x.doc_id, x.taken) for x in again] == [(x.doc_id, x.taken) for x in got]


def test_mixing_places_follow_the_schedule(spark):
    c = spark.range(1).select(*[mixing.place(F.lit(f), F.array(*[F.lit(v) for v in (1.5, 1.0, 0.5)])).alias(f"p{i}") for i, f in enumerate((0.0, 0.25, 0.625, 1.0))]).first()
    area = lambda x: 1.5 * x - x * x / 2 if x <= 0.5 else 0.625 + (x - 0.5) - (x - 0.5) ** 2 / 2
    assert [area(v) for v in c] == pytest.approx([0.0, 0.25, 0.625, 1.0], abs=1e-9)


def test_mixing_takes_rows_of_any_columns(spark):
    names = ["size", "position", "ticket", "taken", "turn", "_id", "_row", "_words", "c0", "at", "a.b", "of"]
    rows = [(k, prose(k, 20), "a" if k < 30 else "b", *(f"{n}{k}" for n in names)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    plan = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    got = mixing.take(df)
    assert got.columns == df.columns
    words = {}
    for r in got.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert prose(r.doc_id, 20).startswith(r.text.strip()) and tuple(r[3:]) == rows[r.doc_id][3:]
    assert words == {k: v for k, v in plan.items() if v}


@pytest.mark.parametrize("bucket", [2, 2048])
def test_mixing_of_very_many_equal_rows(spark, bucket):
    rows = [(None, "one two three", "a", k) for k in range(300)] + [(7, "four five", "a", 1000 + k) for k in range(200)] + [(k, prose(k, 9), "ab"[k % 2], k) for k in range(100)] + [(None, "six", "a", 0), (None, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long").repartition(5)
    got = mixing.mix(df, bucket=bucket).collect()
    # the plain prefix sums over the same order
    sizes, at = {}, {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, told = brute.mix_targets(sizes), []
    order = lambda r: (int(hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1] or ''}|11".encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0)
    for i, t, s, _ in sorted(rows, key=order):
        n, goal = len((t or "").split()), int(want[s] + 0.5)
        whole = goal // max(1, sizes[s])
        told.append((i, s, n, whole * n + max(0, min(n, goal - whole * sizes[s] - at.get(s, 0)))))
        at[s] = at.get(s, 0) + n
    assert sorted(map(str, told)) == sorted(str((r.doc_id, r.source, r.size, r.taken)) for r in got)
    words = {}
    for r in mixing.take(df, bucket=bucket).collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert words == {s: sum(x[3] for x in told if x[1] == s) for s in ("a", "b")}


def test_mixing_of_odd_and_empty(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows()) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(empty).collect() == []


# --- 6: substring dedup


def passages():
    p = "Shared things begin here and go on. They then say much more of it, at length. A third sentence follows. And the fourth one ends it all quite soon after."
    rows = [(k, f"Own start number {k} with {prose(k, 12)}. {p} Own end {prose(k + 50, 9)} of {k}.") for k in range(6)]
    return [*rows, (9, f"{prose(77, 30)} {p} {prose(78, 20)}"), (10, f"{p}\n{p}"), (11, prose(99, 60)), (None, p), (12, None), (13, ""), (2, rows[2][1])]


@pytest.mark.parametrize("options", [{}, {"tile_bytes": 300, "block_bytes": 64}])
def test_substring_dedup_as_brute_force(spark, options):
    rows = passages() + odd_rows()
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(brute.substring_dedup(rows), key=key)


def test_substring_dedup_leaves_first_and_own_texts(spark):
    rows = passages()[:6]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].removed == []
    for k in range(1, 6):
        assert "third sentence" not in got[k].text and f"Own start number {k}" in got[k].text and f"of {k}." in got[k].text


def test_substring_dedup_keeps_other_columns(spark, odd, empty):
    assert substring_dedup.dedup(odd).columns == [*odd.columns, "removed"]
    assert substring_dedup.dedup(empty).collect() == []
    names = ["spans", "_doc", "_print", "_text", "_row", "_id", "_of", "_key", "_maybe", "_at", "_bits", "a.b"]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in passages()]
    clash = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = substring_dedup.dedup(clash)
    assert got.columns == [*clash.columns, "removed"]
    assert sorted(map(str, ((r[0], *r[2:-1]) for r in got.collect()))) == sorted(map(str, ((r[0], *r[2:]) for r in rows)))


def test_any_passage_of_51_words_has_a_run_wherever_it_stands():
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(500)]
    marks = ["", "", "", "", "", "", "", "", "", "."]
    for trial in range(1500):
        end = (lambda: r.choice(marks)) if trial % 2 else (lambda: "")
        some = lambda n: [r.choice(vocabulary) + end() for _ in range(n)]  # noqa: E731, B023
        passage = some(51)
        texts = [" ".join([*some(r.randrange(3, 90)), *passage, *some(r.randrange(3, 90))]).encode() for _ in range(2)]
        doc, h, _, _ = substring_dedup.runs_of(texts)
        assert set(h[doc == 0].tolist()) & set(h[doc == 1].tolist()), texts


# --- 7: media


def test_media_round_trip():
    for text in (b"", b"a", b"x" * 192, bytes(range(256)) * 3):
        stored = media.encode(text)
        assert media.decode(stored) == media.padded(text) and len(media.padded(text)) % 192 == 0 < len(media.padded(text))
        with pytest.raises(ValueError):
            media.decode(stored[:30] + bytes([stored[30] ^ 1]) + stored[31:])


def test_media_parts_keep_order_and_captions():
    page = '<html><style>p{}</style><p>One <b>bold</b></p><figure><img src="sha256:ab" alt="A"><figcaption>Cap <i>tion</i></figcaption></figure><p>Two</p><img src="x.png" alt="B"><script>no</script>tail'
    assert media.sequence(page) == [("text", "One bold", None), ("media", "Cap tion", "sha256:ab"), ("text", "Two", None), ("media", "B", "x.png"), ("text", "tail", None)]
    assert media.sequence(None) == [] and media.sequence("") == []


def test_media_resolve(spark):
    pages = spark.createDataFrame([(1, '<p>t</p><img src="sha256:' + "a" * 64 + '"><img src="sha256:' + "b" * 64 + '">'), (2, None)], "page_id long, html string")
    known = spark.createDataFrame([("a" * 64, 7)], "digest string, media_bytes long")
    got = media.resolve(media.interleave(pages), known).orderBy("pos").collect()
    assert [(r.kind, r.media_bytes) for r in got] == [("text", None), ("media", 7), ("media", None)]


def test_media_resolve_payloads_in_order_beside_their_texts(spark):
    texts = ["", "one", "x" * 200_000, "one"]
    stored = media.store(spark.createDataFrame([(t, "c", 1) for t in texts] + [(None, "c", 1)], "text string, kind string, pos int")).dropDuplicates(["digest"])
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in texts}
    page = "".join(f'<p>before {k}</p><figure><img src="sha256:{digest[t]}"><figcaption>caption {k}</figcaption></figure>' for k, t in enumerate(texts))
    pages = spark.createDataFrame([(1, page, "x"), (None, page, "y"), (1, page, "x"), (3, "", "z"), (4, None, "z")], "page_id long, html string, kind string")
    known = stored.join(media.read(stored), ["digest", "n_bytes"]).withColumn("kind", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = media.resolve(media.interleave(pages), known).collect()
    for key, times in ((1, 2), (None, 1)):
        rows = sorted((r for r in got if r.page_id == key), key=lambda r: r.pos)
        want = [x for k, t in enumerate(texts) for x in [("text", f"before {k}", None)] * times + [("media", f"caption {k}", media.padded(t.encode()))] * times]
        assert [(r.kind, r.text, None if r.media is None else media.decode(bytes(r.media))) for r in rows] == want
    assert {r.page_id for r in got} == {1, None} and media.resolve(media.interleave(pages.limit(0)), known).collect() == []


def test_media_sequences_of_the_pages_table(spark):
    """Every text node and image of real pages, against a plain reading of their tags."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in media.interleave(pages, "url").collect():
        assert [p.pos for p in r.parts] == list(range(len(r.parts))) and all(p.text == " ".join(p.text.split()) for p in r.parts if p.kind == "text")
    html = {r.url: r.html or "" for r in pages.collect()}
    for r in media.interleave(pages, "url").collect():
        plain = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html[r.url])
        assert len(re.findall(r"(?i)<(?:img|video|audio|source)\b[^>]*\ssrc=", plain)) == sum(p.kind == "media" for p in r.parts)


def test_media_query_of_nothing_and_its_stored_form(spark, odd, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.op7_media_columns(spark, f"{tmp_path}/e").collect() == []
    odd.write.parquet(f"{tmp_path}/o/documents.parquet")
    text = {i: t or "" for i, t in odd_rows()}
    for r in queries.op7_media_columns(spark, f"{tmp_path}/o").collect():
        if r.doc_id is None:
            continue
        stored = brute.png(text[r.doc_id].encode())
        assert (r.media_bytes, r.media_sha256, r.caption, r.pos) == (len(stored), hashlib.sha256(stored).hexdigest(), f"document {r.doc_id}", 1)
        assert r.feature == brute.media_feature(text[r.doc_id].encode())


def test_media_query_on_whole_texts(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_media_columns(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((i or -1, *brute.media_row(t)) for i, t in odd_rows())


def test_media_query_writes_and_reads_one_row_a_digest(spark, odd, tmp_path, monkeypatch):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    made, write = {}, media.Tables.write
    monkeypatch.setattr(media.Tables, "write", lambda self, df, name, *by: made.setdefault(name, write(self, df, name, *by)))
    got = queries.op7_media_columns(spark, str(tmp_path)).collect()
    rows = {r.digest: bytes(r.media) for r in made["media"].collect()}
    assert made["media"].count() == len(rows) == len({t or "" for _, t in odd_rows()})
    assert {hashlib.sha256(x).hexdigest() for x in rows.values()} == {r.media_sha256 for r in got}
    assert {media.decode(x) for x in rows.values()} == {media.padded((t or "").encode()) for _, t in odd_rows()}


# --- 8: language ID

SAMPLES = {"en": "the of and to in that with for from this have are which", "fr": "le la des une est dans pour avec que les sur pas vous", "de": "der die und das nicht mit ein eine auf für ist sich werden"}


def sentences_of(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(SAMPLES[lang].split()) for _ in range(n))


def test_language_id_on_held_out_texts(spark):
    rows = [(k, sentences_of(lang, k), lang) for lang in SAMPLES for k in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = spark.createDataFrame([(k, sentences_of(lang, k), lang) for lang in SAMPLES for k in range(100, 130)], "doc_id long, text string, lang string")
    got = language_id.identify(new, model, keep=["doc_id", "lang"]).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) == 0
    noise = spark.createDataFrame([(1, "qxzj wvkq zzxq jjqk " * 60)], "doc_id long, text string")
    assert language_id.identify(noise, model, keep=["doc_id"]).first().rejected


def test_language_id_as_plain_cosines(spark, monkeypatch):
    texts = [t for _, t in odd_rows() if t] + ["Ünïcode ÅÄÖ and plain", "a"]
    monkeypatch.setattr(language_id, "STEP", 7)
    for t in texts[:14]:
        assert language_id._counts(t.encode()).tolist() == brute.ngram_counts(t)
    monkeypatch.undo()
    assert all(language_id._counts(t.encode()).tolist() == brute.ngram_counts(t) for t in texts)
    rows = [(sentences_of(lang, k), lang) for lang in SAMPLES for k in range(12)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    new = [(k, sentences_of(lang, 700 + k, 9) + " " + prose(k, 5)) for k, lang in enumerate([*SAMPLES] * 4)]
    for r in language_id.identify(spark.createDataFrame(new, "doc_id long, text string"), model, keep=["text"]).collect():
        lang, score = brute.nearest(r.text, model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_language_id_of_any_columns_and_very_long_texts(spark):
    rows = [(lang, " ".join(sentences_of(lang, k) for k in range(n))) for lang in SAMPLES for n in (1, 2, 3, 2000)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    names = ["lang_pred", "score", "_text", "_has", "a.b"]
    df = spark.createDataFrame([(lang, t, *names) for lang, t in rows], "lang string, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = language_id.identify(df, model, keep=["_text", "text", "_has", "a.b", "lang"]).collect()
    assert [r.lang for r in got] == [r.lang_pred for r in got] and {(r._text, r._has, r["a.b"]) for r in got} == {("_text", "_has", "a.b")} and sorted(r.text for r in got) == sorted(t for _, t in rows)


def test_language_id_und_and_empty(spark, odd, empty):
    model = language_id.fit(spark.createDataFrame([("abc def", "en"), (None, "fr"), ("12", "de"), ("x", None)], "text string, lang string"))
    assert model.languages == ["en"]
    got = {(r.doc_id or -1): r for r in language_id.identify(odd, model, keep=["doc_id"]).collect()}
    assert [got[k].lang_pred for k in (3, 4, 5, 34)] == ["und"] * 4 and got[1].lang_pred == "en"
    assert language_id.identify(empty, model, keep=["doc_id"]).collect() == []
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(odd, none, keep=["doc_id"]).collect()} == {"und"}


def test_language_id_learns_languages_of_few_texts_in_many_copies(spark):
    names = [f"l{k}" for k in range(8)]
    few = spark.createDataFrame([(name, " ".join(f"{name}w{chr(97 + j)}{chr(97 + i)}" for i in range(12))) for name in names for j in range(10)], "lang string, text string")
    model = language_id.fit(few.crossJoin(spark.range(1000)).select("text", "lang"))
    once = language_id.fit(few)
    assert model.languages == names and (model.idf == once.idf).all() and (model.centroids == once.centroids).all()


# --- 9: fingerprints


def test_fingerprints_merge_and_contain():
    a, b = prose(1, 800), prose(2, 4000)
    sa, sb, both = fingerprints.sketches([a.encode(), b.encode(), (a + "\n" + b).encode()])
    one = fingerprints.merge(sa, sb)
    assert set(one.kept) <= set(both.kept) and len(both.kept) - len(one.kept) <= 4  # but for shingles over the seam
    assert fingerprints.containment(sa, both) == 1.0 and fingerprints.likeness(sa, sb) == 0.0
    assert abs(fingerprints.likeness(sb, both) - len(brute.shingles(b)) / len(brute.shingles(a + " " + b))) < 0.06
    for x in (sa, one, fingerprints.sketches([b""])[0]):
        back = fingerprints.from_text(fingerprints.to_text(x))
        assert list(back.kept) == list(x.kept) and back.total == x.total


def test_fingerprints_of_short_texts_are_never_wrongly_contained():
    long = prose(3, 2000).split()
    parts = [" ".join(long[k : k + 6]) for k in range(0, 1200, 6)]
    *some, whole = fingerprints.sketches([t.encode() for t in [*parts, " ".join(long)]])
    told = [fingerprints.containment(x, whole) for x in some]
    assert set(told) == {1.0, None} and 60 < told.count(1.0) < 120
    merged = some[0]
    for x in some[1:]:
        merged = fingerprints.merge(merged, x)
    assert set(merged.kept) <= set(whole.kept)
    two = fingerprints.sketches([parts[0].encode(), parts[1].encode(), b"", parts[0].upper().encode()])
    assert fingerprints.likeness(two[0], two[1]) == 0.0 and fingerprints.likeness(two[0], two[3]) == 1.0 and fingerprints.likeness(two[2], two[2]) == 1.0


def test_fingerprint_keeps_any_columns(spark):
    names = ["fingerprint_", "_text", "text", "a.b"]
    df = spark.createDataFrame([("f", "t", prose(1, 30), "x"), ("g", "t", None, "y")], ", ".join(f"`{n}` string" for n in names))
    got = fingerprints.fingerprint(df, *names).collect()
    assert [tuple(r[:4]) for r in got] == [("f", "t", prose(1, 30), "x"), ("g", "t", None, "y")] and got[0].fingerprint == fingerprints.to_text(fingerprints.sketches([prose(1, 30).encode()])[0])


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_fingerprints_against_next(spark, range_rows):
    rows = [(i, t) for i, t in odd_rows() if i is not None and i != 8]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), range_rows=range_rows).collect()}
    ids = sorted(i for i, _ in rows)
    text = {i: t or "" for i, t in rows}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(text[i]) // 2
        new = text[i][: len(text[i]) - half] + text[j][:half]
        assert got[i].n_chars == len(text[i]) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[i].near_edited == brute.sketch_likeness(text[i], new) and got[i].near_next == brute.sketch_likeness(text[i], text[j])
        assert [got[i].fingerprint[k : k + 16] for k in range(16, len(got[i].fingerprint), 16)] == [f"{h:016x}" for h in sorted(brute.sketch(text[i]))]
    one = {}
    for i in ids:
        assert one.setdefault(brute.shingles(text[i]), got[i].fingerprint) == got[i].fingerprint
    assert len(set(one.values())) == len(one)


def test_fingerprints_of_odd_and_empty(odd, empty, spark):
    assert len(fingerprints.compare_with_next(odd).collect()) == len(odd_rows())
    assert fingerprints.compare_with_next(empty).collect() == []
    one = fingerprints.compare_with_next(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


# --- 10: chat

TURNS = "conv_id long, turn long, role string, text string"


def chats():
    r = random.Random(4)
    rows = []
    for c in range(12):
        turns = [(0, "system", prose(c, 9))] if c % 3 == 0 else []
        turns += [(k + 1, "user" if k % 2 == 0 else "assistant", prose(c * 50 + k, r.randrange(0, 120))) for k in range(r.randrange(1, 30))]
        rows += [(c, *t) for t in turns]
    rows += [(20, 0, "user", None), (20, 1, None, "x"), (20, 1, "assistant", "a"), (20, 1, "assistant", "a"), (None, 0, "assistant", "lost"), (21, 0, "system", "only"), (22, None, "assistant", "</turn>\n### user:\n\\b\\h#<"), (23, 0, "we:ird\n#", "t"), (23, 1, "assistant", prose(8, 900))]
    return rows


@pytest.mark.parametrize("budget, history", [(64, 16), (512, 128), (1, 0), (100000, 10)])
def test_chat_reads_back(spark, budget, history):
    rows = chats()
    made = chat.read_back(chat.windows(spark.createDataFrame(rows, TURNS).repartition(3), budget=budget, history=history)).collect()
    by = {}
    for c, *t in rows:
        by.setdefault(c, []).append(tuple(t))
    assert {r.conv_id for r in made} == set(by)
    for r in made:
        told = "".join(f"{x.role}\n{x.text}\n" for x in r.turns)
        got = (len(r.turns), hashlib.sha256(told.encode()).hexdigest(), len(r.loss_text), hashlib.sha256(r.loss_text.encode()).hexdigest())
        assert got == brute.conversation(by[r.conv_id]), r.conv_id
        system = sorted(by[r.conv_id], key=lambda t: (t[0] is not None, t[0] or 0, t[1] or ""))[0]
        for k, w in enumerate(r.windows):
            turns = w.formatted.split(chat.CLOSE)[:-1]
            if system[1] == "system":
                assert turns[0].startswith("### system:\n")
            if k and len(turns) - w.repeated > 1:
                assert sum(len(t[t.index(chat.MID) + 2 :].split()) for t in turns) <= budget


def test_chat_of_nothing(spark):
    assert chat.windows(spark.createDataFrame([], TURNS)).collect() == []


# --- columns that clash with what the operators use inside


def test_columns_of_any_name_change_nothing(spark, odd):
    names = ["n", "hs", "cells", "node", "rep", "tile", "kind", "data", "bucket", "k", "p", "guest", "_row", "h", "block", "word", "license", "dir", "line", "key", "score", "parts", "t", "upto", "windows", "sys", "head"]
    clash = lambda df: df.select("*", *[F.lit("x").alias(c) for c in names if c not in df.columns])
    rows = lambda df: sorted(map(str, df.collect()))
    docs = odd.where("doc_id is null or doc_id <> 30").drop("extra")
    ranks, pattern = ranks_and_pattern()
    turns = spark.createDataFrame(chats(), TURNS)
    files = spark.createDataFrame([("LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/x.py", None)], "path string, text string")
    for run, df in (
        (lambda x: ngram_jaccard.jaccard_join(x), docs), (lambda x: bpe.encode(x, ranks, pattern, emit="digest"), docs), (lambda x: mixing.mix(x), docs), (lambda x: fingerprints.compare_with_next(x), docs.where("doc_id is not null")),
        (lambda x: license_scans.scan(x), files), (lambda x: chat.read_back(chat.windows(x)), turns), (lambda x: media.store(x, "text"), docs), (lambda x: substring_dedup.dedup(x).select("doc_id", "text", "removed"), docs),
    ):
        assert rows(run(clash(df))) == rows(run(df))


# --- 1: URL filters


@pytest.mark.parametrize("split", [2, 100_000])
def test_url_filters_evaluate_as_of(spark, split):
    entries = spark.createDataFrame(
        [("bad", "evil.com", "add", 10), ("bad", "evil.com", "add", 12), ("bad", "evil.com", "remove", 20), ("bad", "evil.com", "add", 30), ("ok", "good.evil.com", "add", 15), ("bad", "x.org", "remove", 1), ("bad", "x.org", "add", 5), ("bad", "x.org", "remove", 5), (None, "y", "add", 1), ("bad", "z.net", "add", None)],
        "list string, domain string, action string, s int",
    ).withColumn("at", F.timestamp_seconds("s")).drop("s")
    urls = ["http://evil.com/a", "https://u:p@Good.EVIL.com:80/x", "http://notevil.com", "http://x.org.", "ftp://z.net", None, "", "nonsense", "http://www.evil.com"]
    rows = [(k * 100 + t, u, t) for k, u in enumerate(urls) for t in (5, 10, 19, 20, 35)] + [(7, "http://evil.com", None), (10, "http://evil.com/a", 10)]
    got = url_filters.evaluate(spark.createDataFrame(rows, "page_id long, url string, s int").withColumn("fetched_at", F.timestamp_seconds("s")).drop("s"), entries, blocking=["bad"], allowing=["ok"], split=split).collect()
    assert len(got) == len(rows)
    on = {"bad": {"evil.com": [(10, 20), (30, 99)], "x.org": [(5, 99)]}, "ok": {"good.evil.com": [(15, 99)]}}
    hosts = ["evil.com", "good.evil.com", "notevil.com", "x.org", "z.net", "", "", "", "www.evil.com"]
    want = {}
    for i, u, t in rows:
        host = hosts[urls.index(u)] if u in urls else "evil.com"
        hits = [(len(d), name == "ok", d) for name, ds in on.items() for d, spans in ds.items() if t is not None and (host == d or host.endswith("." + d)) and any(a <= t < b for a, b in spans)]
        want[i, u, t] = (host, len(hits), "pass" if not hits else "allow" if max(hits)[1] else "block")
    for r in got:
        t = None if r.fetched_at is None else int(r.fetched_at.timestamp())
        assert (r.host, r.hits, r.verdict) == want[r.page_id, r.url, t]


def test_url_filters_of_odd_hosts_columns_and_long_urls(spark):
    urls = ["http://[2001:DB8::1]:80/x", "http://u@[2001:db8::1]/", "http://10.0.0.1/", "http://a.b/" + "x" * 100_000, "//no.scheme/"]
    rows = [(k, u, k, "c") for k, u in enumerate(urls)]
    captures = spark.createDataFrame(rows, "page_id long, url string, s int, host string").withColumn("fetched_at", F.timestamp_seconds("s")).withColumn("list", F.lit("x")).withColumn("hits", F.lit(9))
    entries = spark.createDataFrame([("bad", "[2001:db8::1]", "add", 0, "x"), ("bad", "a.b", "add", 9, "x"), ("bad", "10.0.0.1", "add", 2, "y"), ("ok", "10.0.0.1", "add", 2, "y"), ("other", "a.b", "add", 0, "z")], "list string, domain string, action string, s int, host string").withColumn("at", F.timestamp_seconds("s"))
    got = sorted((r.page_id, r.host, r.hits, r.lists, r.verdict) for r in url_filters.evaluate(captures, entries, blocking=["bad"], allowing=["ok"]).collect())
    assert got == [(0, "[2001:db8::1]", 1, "bad", "block"), (1, "[2001:db8::1]", 1, "bad", "block"), (2, "10.0.0.1", 2, "bad,ok", "allow"), (3, "a.b", 0, "", "pass"), (4, "", 0, "", "pass")]


def test_url_filters_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, fetched_at timestamp")
    e = spark.createDataFrame([], "list string, domain string, action string, at timestamp")
    assert url_filters.evaluate(none, e, blocking=["a"], allowing=[]).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/", None)], "page_id long, url string, fetched_at timestamp")
    assert [r.verdict for r in url_filters.evaluate(one, e, blocking=["a"], allowing=[]).collect()] == ["pass"]


# --- 2: license scans


def test_license_scan_inherits_from_the_nearest(spark):
    apache, mit = "// Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [("LICENSE", apache), ("a/x.py", "code"), ("a/b/LICENSE.txt", mit), ("a/b/c/y.py", "more\ncode"), ("a/b/z.py", "# Licensed under CC BY-NC 4.0.\nx"), ("q/none.py", None), ("q/none.py", ""), (None, mit), ("a/bb/w.py", ""), ("a/b/COPYING", "no licence that anyone knows"), ("long.txt", "word " * 3000 + "Released under the MIT License. " + "word " * 3000)]
    got = {r.path: (r.license, r.how, r.from_path) for r in license_scans.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "LICENSE": ("Apache-2.0", "own", None),
        "a/x.py": ("Apache-2.0", "inherited", "LICENSE"),
        "a/b/LICENSE.txt": ("MIT", "own", None),
        "a/b/c/y.py": ("MIT", "inherited", "a/b/LICENSE.txt"),
        "a/b/z.py": ("CC-BY-NC-4.0", "own", None),
        "q/none.py": ("Apache-2.0", "inherited", "LICENSE"),
        "a/bb/w.py": ("Apache-2.0", "inherited", "LICENSE"),
        "a/b/COPYING": ("MIT", "inherited", "a/b/LICENSE.txt"),
        "long.txt": got["long.txt"],
    }
    assert got["long.txt"][1] in ("own", "inherited")
    assert license_scans.scan(spark.createDataFrame([], "path string, text string")).collect() == []


def test_license_scan_reads_every_stretch_of_a_line(spark):
    notice, long = "Released under the MIT License.", "word " * 3000
    rows = [
        ("long.txt", long + notice + " " + long),
        ("late.js", "/* copyright 2020 someone */ " + long + "Licensed under the Apache License, Version 2.0. " + long),
        ("joined.txt", "a sentence that says something else entirely " + notice.rstrip(".") + " and then the talk goes on and on without a stop " * 2),
        ("between.txt", "The first sentence says what this is about. " + notice + " Another one tells how it is to be used, at some length."),
        ("no.txt", long + "their license was lost " + long),
        ("end.txt", long + "Licensed under CC BY-NC 4.0"),
    ]
    got = {r.path: (r.license, r.how, r.score) for r in license_scans.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"long.txt": ("MIT", "own", 1.0), "late.js": ("Apache-2.0", "own", 1.0), "joined.txt": ("MIT", "own", 1.0), "between.txt": ("MIT", "own", 1.0), "no.txt": ("", "none", 0.0), "end.txt": ("CC-BY-NC-4.0", "own", 1.0)}


def test_license_scan_knows_headers_texts_and_identifiers(spark):
    from graphloom.llm import license_texts

    wrap = lambda name, k=0, mark=" * ": "\n".join(mark + x for x in textwrap.wrap(license_texts.HEADERS[name][k], 60))
    code = "\nint main() { return 0; }\n" * 50
    rows = [(f"head/{name}.c", "/*\n * Copyright 2020 Someone\n" + wrap(name) + "\n */" + code) for name in license_texts.HEADERS]
    rows += [(f"id/{name}.py", f"# SPDX-License-Identifier: {name}\nx = 1") for name in ("MIT", "Apache-2.0", "GPL-3.0-or-later", "No-Such-1.0")]
    rows += [(f"whole/{name}/LICENSE", text[0]) for name, text in license_texts.whole().items()]
    rows += [("whole/MIT/x.py", ""), ("prose/LICENSE", "The text of this file is about the sea and the ships of the harbour. " * 40), ("mit.js", "x=1;/* copyright MIT 2020 */")]
    got = {r.path: (r.license, r.how) for r in license_scans.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    want = {f"head/{name}.c": (name, "own") for name in license_texts.HEADERS} | {f"whole/{name}/LICENSE": (name, "own") for name in license_texts.whole()}
    want |= {"id/MIT.py": ("MIT", "own"), "id/Apache-2.0.py": ("Apache-2.0", "own"), "id/GPL-3.0-or-later.py": ("GPL-3.0", "own"), "id/No-Such-1.0.py": ("", "none")}
    assert got == want | {"whole/MIT/x.py": ("MIT", "inherited"), "prose/LICENSE": ("", "none"), "mit.js": ("", "none")}
