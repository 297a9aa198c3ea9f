"""Split operators (x_*): seeded stratified / random splits, k folds, fold
expansion, split application, label encoding.

Membership is decided by an exact per-stratum rank of md5(id || seed). The
rank is computed without sorting a whole stratum in one task: rows are first
counted per (stratum, hash bucket) (65,536 buckets from the hash prefix, a
partial aggregate), bucket offsets are a running sum over that small table,
and the final rank is offset + row_number inside one (stratum, bucket). A
stratum holding a third of all rows is therefore spread over 65,536 tasks'
worth of buckets.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX = 4  # 16**4 = 65,536 hash buckets per stratum


def _hash(id_col: str, seed: int):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def stratum_rank(df: DataFrame, id_col: str, strata: list[str], seed: int = 42) -> DataFrame:
    """Add ``rank`` (1-based, exact order of (md5(id||seed), id) in the
    stratum) and ``n`` (stratum size)."""
    h = df.withColumn("_h", _hash(id_col, seed)).withColumn(
        "_b", F.conv(F.substring("_h", 1, BUCKET_HEX), 16, 10).cast("int"))
    counts = h.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*strata).orderBy("_b")
    offs = (counts.withColumn("_off", F.sum("_c").over(w) - F.col("_c"))
            .withColumn("n", F.sum("_c").over(Window.partitionBy(*strata))).drop("_c"))
    inner = Window.partitionBy(*strata, "_b").orderBy("_h", id_col)
    r = h.withColumn("_r", F.row_number().over(inner)).join(offs, [*strata, "_b"])
    return r.withColumn("rank", F.col("_off") + F.col("_r")).drop("_h", "_b", "_r", "_off")


def stratified_split(df: DataFrame, id_col: str, strata: list[str], frac: float,
                     seed: int = 42, names=("train", "test")) -> DataFrame:
    """x_stratified_split / x_random_split (strata=[]): the first
    round(n*frac) rows of each stratum in hash order go to ``names[1]``."""
    if not strata:
        df = df.withColumn("_all", F.lit(0))
        strata = ["_all"]
    r = stratum_rank(df, id_col, strata, seed)
    out = r.withColumn("split", F.when(F.col("rank") <= F.round(F.col("n") * frac),
                                       F.lit(names[1])).otherwise(F.lit(names[0])))
    return out.drop("rank", "n", "_all")


def train_val_test(df: DataFrame, id_col: str, strata: list[str], test_frac: float, val_frac: float,
                   seed: int = 42) -> DataFrame:
    """x_stratified_split: the test share is split off first, then the validation share of
    the rest, both within strata: ``split`` is train or test, ``part`` train, val or test."""
    first = stratified_split(df, id_col, strata, test_frac, seed)
    r = stratum_rank(first, id_col, [*strata, "split"], seed)
    val = (F.col("split") == "train") & (F.col("rank") <= F.round(F.col("n") * val_frac))
    return r.withColumn("part", F.when(val, F.lit("val")).otherwise(F.col("split"))).drop("rank", "n")


def stratified_kfold(df: DataFrame, id_col: str, strata: list[str], k: int = 4,
                     seed: int = 42) -> DataFrame:
    """x_stratified_kfold: fold = (rank - 1) % k inside each stratum."""
    r = stratum_rank(df, id_col, strata, seed)
    return r.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "n")


def fold_expand(folds: DataFrame, k: int = 4) -> DataFrame:
    """x_fold_expand: for each fold i, its rows are 'val' and all others 'train'
    (a generate over the k fold ids, not a cross join)."""
    return (folds.withColumn("fold_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn("role", F.when(F.col("fold") == F.col("fold_i"), "val").otherwise("train")))


def apply_split(notes: DataFrame, outcomes: DataFrame, ids: DataFrame) -> DataFrame:
    """x_apply_split: notes and outcomes restricted to the split's ids, joined."""
    ids = ids.select("pat_deid")
    n = notes.join(ids, "pat_deid", "left_semi")
    o = outcomes.join(ids, "pat_deid", "left_semi")
    return n.join(o, "pat_deid")


def label_encode(df: DataFrame, key: str, out: str = "label") -> DataFrame:
    """p_label_encode: sorted-order integer code of a label key. The distinct
    keys (at most 2^classes) are ranked on their own, then joined back."""
    codes = df.select(key).distinct()
    codes = codes.withColumn(out, (F.dense_rank().over(Window.orderBy(key)) - 1).cast("int"))
    return df.join(codes, key)
