"""Relational primitives the pipeline leans on (2.2-2.7 of the inventory).

Each is a thin, explicit composition of DataFrame operators with the pandas
semantics pinned (null keys dropped, explicit tie-breaks, sample std, exact
median). Aggregates are partial/map-side; ordering windows are partitioned by
the group key only where the reference needs a per-group order.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import bin_index
from .quantile import with_quantiles


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """w_dedupe_first: one row per key, the first by an explicit order.

    min_by over a struct keeps this an aggregate (partial, map-side combine)
    instead of a window that would hold a whole hot key in one task.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*keys).distinct()
    ordk = F.struct(*_cols(order))
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.min_by(packed, ordk).alias("_r"))
            .select(*keys, *[F.col("_r." + c).alias(c) for c in others]))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """w_keep_last: the last row per key by an explicit order (max_by)."""
    others = [c for c in df.columns if c not in keys]
    ordk = F.struct(*_cols(order))
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.max_by(packed, ordk).alias("_r"))
            .select(*keys, *[F.col("_r." + c).alias(c) for c in others]))


def dup_mask(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """w_dup_mask: flag rows after the first of their key (row_number > 1)."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("is_dup", (F.row_number().over(w) > 1))


def marked(rows: DataFrame, found: DataFrame, key: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """The rows with ``name``: whether ``found`` has their key (a null matches nothing).

    Rows and keys are sent once, by ``by``, a part of the key, so that a step by ``by`` that
    follows sends them no second time."""
    keys = found.select(*key).dropna().withColumn("_found", F.lit(True))
    both = rows.withColumn("_row", F.lit(True)).unionByName(keys, allowMissingColumns=True).repartition(*by)
    return (both.withColumn(name, F.coalesce(F.max("_found").over(Window.partitionBy(*key)), F.lit(False)))
            .where("_row").drop("_row", "_found"))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """a_value_counts / a_value_counts_multi: counts per value, nulls dropped."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def value_counts_norm(df: DataFrame, col: str) -> DataFrame:
    """a_value_counts_norm: share per value (non-null denominator).

    The total is a second (tiny) aggregate joined back as a scalar subquery,
    not an unpartitioned window over all rows."""
    vc = value_counts(df, col)
    total = vc.select(F.sum("n")).scalar()
    return vc.withColumn("share", F.col("n") / total)


def null_profile(df: DataFrame) -> DataFrame:
    """p_null_profile: one row, null count per column."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])


def dup_count(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """p_dup_count: rows minus distinct rows (or distinct key tuples)."""
    keys = list(keys or df.columns)
    d = df.select(*keys).distinct().select(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", (F.col("n_rows") - d).alias("n_dup"))


def basic_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """a_basic_stats: min/max/mean/exact median/sample std (pandas defaults)."""
    x = F.col(col)
    aggs = [F.count(x).alias("count"), F.min(x).cast("double").alias("min"),
            F.max(x).cast("double").alias("max"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std")]
    return with_quantiles(df.groupBy(*by).agg(*aggs), df, col, {"median": 0.5}, by)


def describe(df: DataFrame, col: str) -> DataFrame:
    """a_describe: count/mean/std/min/25%/50%/75%/max, linear interpolation."""
    x = F.col(col)
    stats = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"),
                   F.stddev_samp(x).alias("std"), F.min(x).cast("double").alias("min"),
                   F.max(x).cast("double").alias("max"))
    return with_quantiles(stats, df, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """a_histogram: equal-width bins over [min, max], last bin closed (numpy).

    min/max come from one partial aggregate (scalar subqueries); binning and
    counting is one more partial aggregate. Empty bins are omitted."""
    x = F.col(col)
    lo = df.select(F.min(x).cast("double")).scalar()
    hi = df.select(F.max(x).cast("double")).scalar()
    b = df.where(x.isNotNull()).select(bin_index(x.cast("double"), lo, hi, bins).alias("bin"),
                                       lo.alias("lo"), hi.alias("hi"))
    return (b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"),
                                 F.first("hi").alias("hi"))
            .select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins)
                    .alias("left"), "n"))


def topk(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    """w_topk / w_limit: first k rows by a total order (tie-broken by caller)."""
    return df.orderBy(*_cols(order)).limit(k)


def max_filter(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """a_max_filter: rows at the (group) maximum, ties kept."""
    if by:
        m = df.groupBy(*by).agg(F.max(col).alias("_m"))
        return df.join(m, list(by)).where(F.col(col) == F.col("_m")).drop("_m")
    return df.where(F.col(col) == df.select(F.max(col)).scalar())


def symdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    """s_symdiff: rows in exactly one input (concat + drop_duplicates(keep=False))."""
    cols = a.columns
    return (a.unionByName(b).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == 1).drop("_n"))


def add_new_terms(sources: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """s_add_new_terms: union sources in priority order; per key the first
    source wins (min priority), as appending only not-yet-present terms."""
    tagged = None
    for i, s in enumerate(sources):
        s = s.withColumn("_prio", F.lit(i))
        tagged = s if tagged is None else tagged.unionByName(s)
    return dedupe_first(tagged, list(key), ["_prio"]).drop("_prio")


def funnel(steps: Sequence[tuple[str, DataFrame]], id_col: str = "pat_deid") -> DataFrame:
    """p_shape / c_funnel: rows and distinct ids per named step, as one table."""
    out = None
    for i, (name, d) in enumerate(steps):
        r = d.agg(F.lit(i).alias("step"), F.lit(name).alias("name"),
                  F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(F.col(id_col)).alias("n_patients"))
        out = r if out is None else out.unionByName(r)
    return out


def pct(col: Column, digits: int = 6) -> Column:
    return F.round(col * 100.0, digits)
