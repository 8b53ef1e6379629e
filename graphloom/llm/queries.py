"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat, fingerprints, language_id, license_scans, media, mixing, ngram_jaccard, substring_dedup, url_filters
from graphloom.llm.oracles import ORACLES

RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """(ranks, pattern) of the public rank file; ``path`` names another one."""
    import public_tokenizers

    return bpe.load_ranks(path or public_tokenizers.path(RANKS)), public_tokenizers.PATTERN


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries over the hosts of ``pages``, by rules on a digest of the name (made up: the tables hold no lists)."""
    names = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    names = names.select("host", F.array_join(F.slice(F.split("host", "\\."), -2, 2), ".").alias("zone"))
    code = lambda c, at: F.conv(F.substring(F.md5(c), at, 4), 16, 10).cast("int")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)  # noqa: E731  days after 2024-01-01 UTC
    h = names.select("host", code(F.col("host"), 1).alias("a"), code(F.col("host"), 5).alias("b"))
    z = names.select("zone").distinct().select("zone", code(F.col("zone"), 1).alias("a"))
    rows = [
        h.where("a % 3 <> 0").select(F.lit("spam").alias("list"), F.col("host").alias("domain"), F.lit("add").alias("action"), day(F.col("a") % 40).alias("at")),
        h.where("a % 3 <> 0").select(F.lit("spam"), "host", F.lit("remove"), day(F.col("a") % 40 + F.col("b") % 30 + 1)),
        h.where("a % 3 = 1").select(F.lit("spam"), "host", F.lit("add"), day(F.col("a") % 40 + F.col("b") % 30 + 21)),
        h.where("b % 4 = 0").select(F.lit("trusted"), "host", F.lit("add"), day(F.col("b") % 60)),
        z.where("a % 2 = 0").select(F.lit("adult"), "zone", F.lit("add"), day(F.col("a") % 50)),
        z.where("a % 2 = 0").select(F.lit("adult"), "zone", F.lit("remove"), day(F.col("a") % 50 + 25)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def captures(pages: DataFrame) -> DataFrame:
    """``pages`` as captures: fetched one after another through 90 days, 7,919 s apart modulo that."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(90 * 86400)))
    return pages.select("page_id", "url", at.alias("fetched_at"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filters.evaluate(captures(pages), list_entries(pages), blocking=["spam", "adult"], allowing=["trusted"])
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


def file_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files: source / thousands / fifties / name; each 25th is its directory's licence file."""
    i = F.col("doc_id")
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), (i / 1000).cast("long").cast("string"), (F.pmod(i, F.lit(1000)) / 50).cast("long").cast("string"))
    root = F.concat_ws("/", F.coalesce("source", F.lit("none")), (i / 1000).cast("long").cast("string"))
    path = F.when(F.pmod(i, F.lit(100)) == 0, F.concat(root, F.lit("/LICENSE."), i)).when(F.pmod(i, F.lit(25)) == 0, F.concat(folder, F.lit("/LICENSE."), i)).otherwise(F.concat(folder, F.lit("/file"), i, F.lit(".txt")))
    return docs.select(path.alias("path"), "text")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan(file_paths(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def op3_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    ranks, pattern = vocabulary(ranks_path)
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern, emit="digest")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.withColumn("position", F.round("position", 6)).drop("ticket")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "text", F.size("removed").alias("n_removed"), gone.alias("bytes_removed"), "removed")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tables = media.Tables(spark)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    read = tables.write(docs.select("doc_id", digest), "references")
    first = tables.write(media.media_table(docs.select("text", digest), read), "media")
    known = tables.write(media.read(first), "known")  # a plain join follows, whose hot digests Spark can split
    pages = read.select("doc_id", media.page_of(F.col("digest"), F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("html"))
    parts = media.resolve(media.interleave(pages, "doc_id"), known, "doc_id").where("kind = 'media'")
    return parts.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", F.col("text").alias("caption"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = language_id.fit(docs.where(~held).select("text", "lang"))
    return language_id.identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    read = chat.read_back(chat.windows(turns.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    chars = F.aggregate("windows", F.lit(0).cast("long"), lambda s, w: s + F.length(w["formatted"]))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), chars.alias("formatted_chars"), F.size("windows").alias("n_windows"),
    )


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_license_scans, op3_bpe, op4_ngram_jaccard, op5_mixing, op6_substring_dedup, op7_media_columns, op8_language_id, op9_fingerprints, op10_chat_formatting)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
