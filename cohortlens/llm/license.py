"""1. License scan by diagonal voting.

All rolling word k-grams of a text are joined to the positions they have in license
templates. A k-gram at word p of the text and word q of a template votes for the
diagonal p - q; an exact copy puts all its votes on one diagonal, and an edit moves
the rest to a neighbouring one. Neighbouring diagonals are merged into spans, and a
span counts when enough of the template is there. DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import UPPER

SHORT_K, LONG_K = 2, 4
MAX_SHIFT = 8      # diagonals at most this far apart are one span
MIN_COVER = 0.6    # share of a template's k-grams that a span must hold

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Opening words of public licenses and common notices, with labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def _grams_of(words: list[str], k: int) -> list[str]:
    return [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]


def template_positions(spark, base: dict[str, str], templates: list[tuple[str, str]]) -> DataFrame:
    """(gram, t, label, is_base, q, n): the k-grams of the templates, a table as large
    as the templates alone. Phrases of the base, and templates shorter than a long
    k-gram, go by pairs of words."""
    rows = []
    phrases = [(label, p, True) for p, label in base.items()] + [(label, p, False) for label, p in templates]
    for t, (label, phrase, is_base) in enumerate(phrases):
        words = phrase.split(" ")
        k = SHORT_K if is_base or len(words) < LONG_K else LONG_K
        grams = _grams_of(words, k)
        rows += [(g, t, label, is_base, q, len(grams), k) for q, g in enumerate(grams)]
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("t", T.IntegerType()),
                           T.StructField("label", T.StringType()), T.StructField("is_base", T.BooleanType()),
                           T.StructField("q", T.IntegerType()), T.StructField("n", T.IntegerType()),
                           T.StructField("k", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


def words_of(text: Column) -> Column:
    """Words of ASCII letters and digits and of all other characters from U+0080 on,
    A-Z lowered: separators become spaces, then one split (several times faster than
    extracting every match)."""
    apart = [chr(c) for c in range(128) if not chr(c).isalnum()]
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), UPPER + "".join(apart), UPPER.lower() + " " * len(apart)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def votes(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """One row for each k-gram of a text that a template has: key, t, label, is_base, n,
    k, p, q. Hashes are joined; the words themselves decide."""
    # every row carries its own k words, never the word array of its text
    rolled = F.arrays_zip(*[F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))).alias(f"w{i}")
                            for i in range(LONG_K)])
    each = docs.select("key", F.posexplode(rolled).alias("p", "g")).select("key", "p", "g.*")
    w = [F.col(f"w{i}") for i in range(LONG_K)]
    pair, four = F.xxhash64(*w[:SHORT_K]), F.xxhash64(*w)
    hashed = each.select("key", "p", *w, F.explode(F.array(pair, four)).alias("h"))
    part = [F.split_part("gram", F.lit(" "), F.lit(i + 1)) for i in range(LONG_K)]
    table = positions.withColumn("h", F.when(F.col("k") == SHORT_K, F.xxhash64(*part[:SHORT_K]))
                                 .otherwise(F.xxhash64(*part)))
    found = hashed.join(F.broadcast(table), "h")
    words = F.when(F.col("k") == SHORT_K, F.concat_ws(" ", *w[:SHORT_K])).otherwise(F.concat_ws(" ", *w))
    return found.where(words == F.col("gram")).select("key", "t", "label", "is_base", "n", "k", "p", "q")


def spans(found: DataFrame, max_shift: int = MAX_SHIFT, min_cover: float = MIN_COVER) -> DataFrame:
    """Verified spans: key, label, is_base, start, n_words, cover. A base phrase needs
    all its votes on one diagonal; another template needs ``min_cover`` of its k-grams
    on diagonals at most ``max_shift`` apart."""
    diagonals = (found.groupBy("key", "t", "label", "is_base", "n", "k", (F.col("p") - F.col("q")).alias("d"))
                 .agg(F.count(F.lit(1)).alias("votes"), F.min("p").alias("lo"), F.max("p").alias("hi"),
                      F.collect_set("q").alias("qs")))  # a set of template positions: as long as the template
    base = diagonals.where("is_base and votes = n").select(
        "key", "label", "is_base", F.col("d").alias("start"), (F.col("n") + F.col("k") - 1).alias("n_words"),
        F.lit(1.0).alias("cover"))
    w = Window.partitionBy("key", "t").orderBy("d")
    opens = (F.col("d") - F.lag("d").over(w) > max_shift) | F.lag("d").over(w).isNull()
    merged = (diagonals.where("not is_base").withColumn("o", opens.cast("int")).withColumn("span", F.sum("o").over(w))
              .groupBy("key", "t", "label", "is_base", "n", "k", "span")
              .agg(F.min("lo").alias("start"), F.max("hi").alias("hi"),
                   F.size(F.array_distinct(F.flatten(F.collect_set("qs")))).alias("got"))
              .where(F.col("got") >= F.lit(min_cover) * F.col("n")))
    return base.unionByName(merged.select(
        "key", "label", "is_base", "start", (F.col("hi") - F.col("start") + F.col("k")).alias("n_words"),
        (F.col("got") / F.col("n")).alias("cover")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] | None = None,
         templates: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has ``row`` (the input row without its text), ``key`` and
    ``n_words``; spans has ``key`` and what ``spans`` returns.

    The key joins id and text, so repeated rows share one answer and different texts of
    one id don't mix; null ids and null texts (no words) take part; an empty table gives
    empty results; columns of any name stay inside ``row``."""
    positions = template_positions(docs.sparkSession, BASE if base is None else base,
                                   TEMPLATES if templates is None else templates)
    text_col, words = F.col(f"`{text}`"), words_of(F.col(f"`{text}`"))
    key_col = F.struct(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\\N")).alias("id"),
                       F.xxhash64(text_col).alias("h"))
    keyed = docs.select(key_col.alias("key"), words.alias("words"))
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
                        key_col.alias("key"), F.size(words).cast("long").alias("n_words"))
    # equal rows vote twice for one place; one vote is enough
    return texts, spans(votes(keyed, positions).distinct())


def op1_license_scan(spark, sf_dir) -> DataFrame:
    """License phrases of every document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the largest template cover; 0 without any)."""
    from ._common import read
    texts, found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    each = found.groupBy("key").agg(
        F.count_if("is_base").alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"))
    return texts.join(each, "key", "left").select(
        "row.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
