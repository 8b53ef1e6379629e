"""Vector functions as Columns over arrays of doubles, and hashed word embeddings."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 64


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common dimensions."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common dimensions; 0 where either is zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    size = norm(x) * norm(y)
    return F.when(size > 0, dot(x, y) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


# How features are named and weighed before they are hashed.
WORD_MARK, GRAM_MARK, GRAM_WEIGHT, LONG_WORD = "w:", "g:", 0.35, 4


def blake(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")


def fnv1a(feature: str) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for byte in feature.encode():
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def embed_text(text: str, dims: int, digest=blake) -> list[float]:
    """Words, and the trigrams of longer words at less weight, summed in hashed buckets; unit length."""
    weights: Counter[str] = Counter()
    for word in re.findall("[a-z0-9]+", (text or "").lower()):
        weights[WORD_MARK + word] += 1.0
        if len(word) > LONG_WORD:
            for gram in map("".join, zip(word, word[1:], word[2:], strict=False)):
                weights[GRAM_MARK + gram] += GRAM_WEIGHT
    vector = [0.0] * dims
    for feature, weight in weights.items():
        vector[digest(feature) % dims] += weight
    size = math.hypot(*vector)
    return [x / size for x in vector] if size else vector


def lexical(dims: int = 384, digest=blake):
    """A pandas UDF: text to its hashed lexical embedding."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embed_text(t or "", dims, digest))

    return run


def lexical_sql(df: DataFrame, key: str, text: str, dims: int = DIMS) -> DataFrame:
    """(key, bucket, weight): the sparse word embedding with MD5 buckets, in DataFrame functions only."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    bucket = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(dims))
    raw = words.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    size = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("size"))
    return raw.join(size, key).select(key, "bucket", (F.col("n") / F.col("size")).alias("weight"))
