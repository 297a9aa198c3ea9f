"""6. Sharding by a Feistel permutation over global row numbers.

Row r goes to place p(r), p a keyed permutation of [0, n): shard p mod k, slot
p div k. Both can be computed for any row, and undone, without looking at data.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import mix64

ROUNDS = 6
SEED = 20240229
BUCKETS = 1 << 16  # hash buckets that row numbers are counted in


def _halves(n: int) -> tuple[int, int]:
    """Bits of the left and right half of the smallest power of two from n on."""
    bits = max(2, (max(1, n) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _rounds(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    """One pass of the alternating Feistel network over [0, 2**bits)."""
    a, b = _halves(n)
    left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
    masks = (np.uint64((1 << a) - 1), np.uint64((1 << b) - 1))
    for r in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)
        if r % 2 == 0:  # the half that is not read is shifted by a mix of the other
            left = (left ^ mix64(right + key)) & masks[0]
        else:
            right = (right ^ mix64(left + key)) & masks[1]
    return (left << np.uint64(b)) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Permutation of [0, n): places that fall past n walk on along their cycle."""
    out = _rounds(np.asarray(rows, np.uint64), n, seed, back)
    while len(past := np.flatnonzero(out >= n)):
        out[past] = _rounds(out[past], n, seed, back)
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """The row number at a shard and slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shard_rows(df: DataFrame, key: list[str], shards: int, seed: int = SEED) -> DataFrame:
    """``row`` (the input row as a struct), ``row_number``, ``shard`` (int) and ``slot``.

    Shards differ by one row at most and slots have no gaps. Row numbers follow a hash
    of both the columns of ``key`` and the whole row, so they depend on the data alone, not
    on partitions, and different rows of one key (or of none) lie in different buckets. Equal rows are counted before they are dealt out, so many
    copies (or nulls) are one row in a bucket; they take consecutive numbers. Empty
    tables give no rows; columns of any name stay inside ``row``. Whole rows are
    shuffled once; all else runs on two hashes of a row."""
    spark, columns = df.sparkSession, [F.col(f"`{c}`") for c in df.columns]
    named = df.select(
        F.struct(*columns).alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in key]).alias("k"),
        F.xxhash64(F.lit(seed), *columns, *[c.isNull() for c in columns]).alias("h"))
    counted = (named.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("b", F.shiftrightunsigned(F.xxhash64("k", "h"), 48)))
    sums = counted.groupBy("b").agg(F.sum("n").alias("n")).toPandas().sort_values("b")  # at most BUCKETS rows
    n = int(sums["n"].sum())
    sums["start"] = sums["n"].cumsum() - sums["n"]
    starts = spark.createDataFrame([(int(b), int(s)) for b, s in zip(sums["b"], sums["start"])], "b long, start long")
    inside = Window.partitionBy("b").orderBy("k", "h").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.join(F.broadcast(starts), "b").withColumn(
        "at", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).select("k", "h", "at", "n")
    each = numbered.join(named.dropDuplicates(["k", "h"]), ["k", "h"]).select(
        "row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("row_number"))

    @F.pandas_udf("long")
    def place(r: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), n, seed))

    return (each.withColumn("p", place("row_number"))
            .select("row", "row_number", (F.col("p") % shards).cast("int").alias("shard"),
                    F.floor(F.col("p") / shards).cast("long").alias("slot")))


def op6_sharding(spark, sf_dir) -> DataFrame:
    """Shard and slot of every document: doc_id, size, text_crc32, law, shard, slot,
    grown_shard. A null text has size 1 and no checksum."""
    from ._common import read
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    out = shard_rows(docs, ["doc_id", "text_crc32", "size"], 16)
    return out.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
