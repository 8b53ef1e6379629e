"""License scans: TF-IDF cosine of header lines and licence files to templates, then inheritance by path.

DataFrame functions only.  Lines that speak of a licence, their sentences, and their stretches of each template's length
around every licence word are vectors of word weights; each is compared with every template that shares a word.  So are
standard headers, at their first words, and licence files as a whole; SPDX identifiers are looked up.  A file without a licence of its own takes that of the licence file in its
nearest ancestor directory.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import license_texts
from graphloom.llm.shared import Tables

# Short notices by which works name well-known licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
}
LINE = "(?i)licen[sc]|copyright|creative commons|public domain|spdx|permission is hereby granted|\\bCC[ -]BY\\b|\\bCC0\\b"
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.75
#: The oracle's SQL compares longer lines by this much around their first licence word; ``headers`` reads all of them.
AROUND = 240
#: Words of a line at which stretches are laid; every template has one.
ANCHOR = "licen[sc]|copyright|^creative$|^public$|spdx|^permission$|^cc(-|$)|^cc0"


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def model(templates: dict[str, list[str]] = TEMPLATES) -> tuple[dict[str, float], float, list[tuple[str, int, str, float]]]:
    """(idf of each template word, idf of any other word, rows of (word, template number, licence, unit weight))."""
    flat = [(name, _words(t)) for name, texts in sorted(templates.items()) for t in texts]
    n = len(flat)
    df: dict[str, int] = {}
    for _, words in flat:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
    rows = []
    for no, (name, words) in enumerate(flat):
        size = math.sqrt(sum((words.count(w) * idf[w]) ** 2 for w in set(words)))
        rows += [(w, no, name, words.count(w) * idf[w] / size) for w in sorted(set(words))]
    return idf, math.log(1 + n) + 1, rows


def lines(text: Column) -> Column:
    """Array of the licence lines of a text, whole."""
    return F.when(text.rlike(LINE), F.filter(F.split(text, "\n"), lambda x: x.rlike(LINE))).otherwise(F.array().cast("array<string>"))


def stretches(said: DataFrame, lengths: list[int]) -> DataFrame:
    """(line, stretch) of the distinct lines ``said``: the line, its licence sentences, and its runs of so many words at a licence word.

    Runs are made in two steps, surroundings of a licence word and then what they hold of each length, so that a very long
    line makes rows of a bounded size.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    most = max(lengths, default=1)
    first = lambda p: F.greatest(p - most + 1, F.lit(0))
    split = said.select("line", words("line").alias("w"))
    at = F.filter(F.transform("w", lambda x, i: F.when(x.rlike(ANCHOR), i)), lambda i: i.isNotNull())
    near = split.withColumn("at", at).select("line", F.explode(F.transform("at", lambda p: F.struct((p - first(p)).alias("p"), F.slice("w", first(p) + 1, p - first(p) + most).alias("w")))).alias("s")).select("line", "s.*").distinct()
    start = lambda n: F.greatest(F.col("p") - n + 1, F.lit(0))
    runs_of = lambda n: F.transform(F.sequence(start(n), F.greatest(F.least(F.col("p"), F.size("w") - n), start(n))), lambda i: F.array_join(F.slice("w", i + 1, F.lit(n)), " "))
    runs = F.flatten(F.array(*[runs_of(n) for n in lengths]))
    sentences = F.filter(F.split("line", "(?<=[.!?;])\\s+"), lambda x: x.rlike(LINE))
    own = said.select("line", F.explode(F.array_union(F.array("line"), sentences)).alias("stretch"))
    return own.union(near.select("line", F.explode(runs).alias("stretch"))).distinct() if lengths else own


def headers(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(path, license, score): the best template of each file that has one at cosine ``least`` or more.

    Of several stretches of a line and of several lines the best counts; ties go to the licence's name.  Each distinct stretch
    is scored once.
    """
    tables = Tables(files.sparkSession)
    # the texts are read once: what follows needs their licence lines alone
    each = tables.write(files.select("path", F.explode(lines(F.col("text"))).alias("line")), "lines")
    parts = tables.write(stretches(each.select("line").distinct(), sorted({len(_words(t)) for texts in templates.values() for t in texts})), "stretches")
    best = scores(parts.select(F.col("stretch").alias("key"), F.col("stretch").alias("text")).distinct(), templates, least).withColumnRenamed("key", "stretch")
    return _top(each.join(_top(parts.join(best, "stretch"), "line"), "line"), "path")


def _top(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("b")).select(key, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scores(texts: DataFrame, templates: dict[str, list[str]], least: float) -> DataFrame:
    """(key, license, score) of the best template of each of ``texts`` (key, text; keys differ) at cosine ``least`` or more."""
    spark = texts.sparkSession
    idf, other, rows = model(templates)
    known = F.broadcast(spark.createDataFrame(rows, "word string, template int, license string, w double"))  # a constant
    weight = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    terms = texts.select("key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("tf"))
    terms = terms.join(weight, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    size = terms.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = terms.select("key", "word", F.col("w").alias("v")).join(known, "word").groupBy("key", "template", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    return _top(dots.join(size, "key").withColumn("score", F.round(F.col("dot") / F.col("size"), 6)).where(F.col("score") >= least), "key")


def standard(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(path, license, score) by standard headers, which may go over many lines, and by SPDX identifiers."""
    spark = files.sparkSession
    flat = [_words(t) for texts in license_texts.HEADERS.values() for t in texts]
    mark = "(?:" + "|".join(sorted({"[^a-z0-9]+".join(map(re.escape, w[:4])) for w in flat})) + ")"
    at = F.filter(F.split(F.lower("text"), f"(?={mark})"), lambda x: x.rlike(f"^{mark}"))
    tables = Tables(spark)
    found = files.select("path", F.when(F.col("text").rlike(f"(?i){mark}"), at).alias("parts"), F.regexp_extract_all("text", F.lit("(?i)spdx-license-identifier:[ \\t(]*([a-z0-9.+-]+)"), F.lit(1)).alias("ids"))
    found = tables.write(found.where("parts is not null or size(ids) > 0"), "headers")
    words = found.select("path", F.explode("parts").alias("part")).select("path", F.regexp_extract_all("part", F.lit(WORD), F.lit(0)).alias("w"))
    runs = words.select("path", F.explode(F.array(*[F.array_join(F.slice("w", 1, n), " ") for n in sorted({len(w) for w in flat})])).alias("text")).withColumn("key", F.sha2("text", 256))
    runs = tables.write(runs, "runs")
    best = scores(runs.select("key", "text").distinct(), license_texts.HEADERS, least)
    named = F.broadcast(spark.createDataFrame(sorted(license_texts.SPDX.items()), "id string, license string"))
    ids = found.select("path", F.explode("ids").alias("id")).select("path", F.lower("id").alias("id")).join(named, "id").select("path", "license", F.lit(1.0).alias("score"))
    return runs.select("path", "key").join(best, "key").select("path", "license", "score").union(ids)


def licence_files(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(path, license, score) of files whose whole text is near a whole licence text; equal texts are scored once."""
    keyed = files.where(F.col("text") != "").withColumn("key", F.sha2("text", 256))
    best = scores(keyed.groupBy("key").agg(F.first("text").alias("text")), license_texts.whole(), least)
    return keyed.select("path", "key").join(best, "key").select("path", "license", "score")


def scan(files: DataFrame, *, license_name: str = "(?i)^(licen[sc]e|copying)([.-].*)?$", templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Each distinct path of ``files`` (path, text): path, license, score, how, from_path.

    ``how`` is ``own`` (a header or the licence file itself), ``inherited`` (from the licence file at from_path, of the
    nearest ancestor directory that has one with a recognised licence; of several the least path) or ``none``.  Null and empty texts can only inherit; rows with a
    null path are left out; rows that repeat a path are one file, known by all their lines.  Lines are read whole, however long;
    of ties the licence's name decides; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    files = files.where("path is not null")
    name = F.element_at(F.split("path", "/"), -1)
    own = headers(files.select("path", "text"), templates, least).union(standard(files, least)).union(licence_files(files.where(name.rlike(license_name)), least))
    own = Tables(files.sparkSession).write(_top(own, "path"), "own")
    of = F.regexp_replace("path", "/?[^/]*$", "")
    law = own.where(name.rlike(license_name)).groupBy(of.alias("dir")).agg(F.min(F.struct(F.col("path").alias("from_path"), F.col("license").alias("license"))).alias("l"))
    law = law.select("dir", "l.from_path", "l.license")
    paths = files.select("path").distinct().withColumn("dir", of)
    dirs = paths.select("dir").distinct()
    # a directory and its ancestors up to the root (the empty path)
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    found = dirs.select(F.col("dir").alias("at"), F.explode(F.array_distinct(up)).alias("dir")).join(law, "dir")
    nearest = found.groupBy("at").agg(F.max(F.struct(F.length("dir").alias("n"), "license", "from_path")).alias("m")).select(F.col("at").alias("dir"), F.col("m.license").alias("law"), F.col("m.from_path").alias("from_path"))
    x = paths.join(own, "path", "left").join(nearest, "dir", "left")
    return x.select(
        "path",
        F.coalesce("license", "law", F.lit("")).alias("license"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("law").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(F.col("license").isNull(), F.col("from_path")).alias("from_path"),
    )
