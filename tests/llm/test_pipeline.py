"""The pipeline on a small table, stage by stage against plain Python."""

import hashlib

import brute
import numpy as np
import pytest
import test_operators as T

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def documents():
    rows = []
    for k in range(60):
        lang = ("en", "fr", "de")[k % 3]
        rows.append((k, T.sentences_of(lang, k, 30) + ". " + T.prose(k, 40), lang, f"s{k % 5}", 0))
    base = rows[4][1]
    rows += [(100 + k, base + f" more{k}", "en", "s1", 0) for k in range(5)]
    passage = "Shared things begin here and go on. They then say much more of it, at length. A third sentence follows. And the fourth one ends it all."
    rows += [(200 + k, f"{T.sentences_of('en', 300 + k, 30)}. {passage} {T.prose(400 + k, 30)}.", "en", "s2", 0) for k in range(4)]
    return [*rows, (300, "", "en", "s3", 0), (301, None, "en", "s3", 0), (302, "12 34 !!", "en", None, 0), (303, base, "en", None, 0)]


def test_each_stage(spark, tmp_path):
    import tiktoken

    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    known = [(r.doc_id, r.text) for r in seen["language_id"]]
    assert {i for i, _ in known} == {i for i, *_ in documents()} - {300, 301, 302}
    kept = [(r.doc_id, r.text) for r in seen["ngram_jaccard"]]
    assert {i for i, _ in kept} == {c for _, c in brute.jaccard_components(known).values()}
    want = [(i, t) for i, t in brute.substring_dedup(sorted(kept)) if t.strip()]
    assert sorted((r.doc_id, r.text) for r in seen["substring_dedup"]) == want
    words = {}
    for r in seen["mixing"]:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
        assert dict(want)[r.doc_id].startswith(r.text.rstrip()) and r.n_chars == len(r.text)
    size = {i: len(brute.WORD.findall(t)) for i, t in want}
    assert all(size[i] <= words[i] <= 2 * size[i] for i in size)
    assert abs(sum(words.values()) - 1.5 * sum(size.values())) <= 5
    ranks, pattern = T.ranks_and_pattern()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    digest = lambda t: hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in seen["bpe"]) == sorted((r.doc_id, digest(r.text)) for r in seen["mixing"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, seen["bpe"]))


def test_near_duplicates_keep_unrelated_rows_of_equal_or_null_ids(spark, tmp_path):
    texts = [T.prose(500 + k, 60) for k in range(12)]
    rows = [(None, texts[k]) for k in range(5)] + [(7, texts[k]) for k in range(5, 8)] + [(9, texts[8])]
    extra = [(None, texts[0] + " more0"), (None, texts[1]), (7, texts[5]), (8, texts[6] + " more1"), (None, texts[8]), (3, texts[2])]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows + extra + [(None, ""), (None, ""), (4, None)]], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/d")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()]
    one = [t for i, t in kept if t]
    assert sorted(t.removesuffix(" more0") for t in one) == sorted(texts[:9])
    assert sorted(i for i, t in kept if t and i is not None) == [3, 7, 7, 7, 9] and (3, texts[2]) in kept and (7, texts[6]) in kept
    assert sorted(map(str, (r for r in kept if not r[1]))) == sorted(map(str, [(None, ""), (None, ""), (4, None)]))


NAMES = ["size", "position", "spans", "rejected", "removed", "lang_pred", "score", "taken", "_row", "_id", "_text", "component_id", "other0", "a.b"]


def test_every_stage_survives_any_columns_nulls_repeats_and_no_rows(spark, tmp_path):
    rows = [(i, t, lang, s, n, *(f"{x}-{i}" for x in NAMES)) for i, t, lang, s, n in documents()]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None, *[None] * len(NAMES)), (None, T.prose(9000, 80), None, None, None, *[None] * len(NAMES)), (900, T.prose(7, 20_000), "en", "s1", 0, *["long"] * len(NAMES))]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in NAMES)
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{tmp_path}/full")
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/none")
    carried = {i: r[5:] for r in rows if (i := r[0]) is not None}
    for path, some in ((f"{tmp_path}/full", True), (f"{tmp_path}/none", False)):
        docs = spark.read.parquet(path)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            out.write.parquet(f"{path}-{name}")
            docs = spark.read.parquet(f"{path}-{name}")
            got = docs.collect()
            assert bool(got) == some, name
            if k < len(corpus_pipeline.STAGES) - 1:
                assert all(tuple(r[5:]) == carried[r.doc_id] for r in got if r.doc_id is not None and r.doc_id != 0), name
                assert not some or {r.doc_id for r in got} >= {2, 900}, name
