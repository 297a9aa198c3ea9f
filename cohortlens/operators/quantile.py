"""Exact quantiles by rank selection, without sorting a column in one task.

Equal values are counted first, so a value that many rows share is one row. A range of
distinct values that is too long to be ordered at once is cut by splitters taken from its
own values; the counts of the parts say which part holds each wanted rank, and only those
parts are cut again. What is left is short and is ordered by a window.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PARTS = 256             # parts that a range is cut into
MOST_VALUES = 1_000_000  # distinct values ordered by one task


def _narrowed(values: DataFrame, ranks: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Values and ranks after one cut of every range: only parts that hold a rank stay.
    ``below`` counts the rows of the group under the range."""
    fractions = [i / parts for i in range(1, parts)]
    cuts = values.groupBy("g", "range").agg(F.percentile_approx("x", fractions).alias("cuts"))
    cut = values.join(cuts, ["g", "range"]).select(
        "g", "range", "x", "n", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("part"))
    sums = cut.groupBy("g", "range", "part").agg(F.sum("n").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("g", "range").orderBy("part"))
    bounds = sums.select("g", "range", "part", (upto - F.col("rows")).alias("lo"), upto.alias("hi"))
    at = F.col("rank") - F.col("below")
    name = F.concat_ws("/", "range", F.col("part").cast("string"))
    found = cut_lineage(ranks.join(bounds, ["g", "range"]).where((at >= F.col("lo")) & (at < F.col("hi")))
                        .select("g", "rank", name.alias("range"), (F.col("below") + F.col("lo")).alias("below")))
    kept = cut.select("g", "x", "n", name.alias("range")).join(
        found.select("g", "range").distinct(), ["g", "range"], "left_semi")
    return cut_lineage(kept.select("g", "range", "x", "n")), found


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
              most_values: int = MOST_VALUES, parts: int = PARTS) -> DataFrame:
    """One row a group: ``by`` and a double column for each of ``probs``, interpolated
    linearly between the two nearest ranks. Null values don't count; a group of nothing else
    has null quantiles, and so has an empty table without ``by``. Null group keys form a
    group. Every distinct value of a group is counted; only ranges that hold a wanted rank
    are ordered, none longer than ``most_values``."""
    group = F.struct(F.lit(0).alias("all"), *by).alias("g")
    one = df.select(group, F.col(value).cast("double").alias("x"))
    counts = cut_lineage(one.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n")))
    values = counts.where("x is not null").withColumn("range", F.lit("0"))
    totals = values.groupBy("g").agg(F.sum("n").alias("total"))
    wanted = totals.select("g", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("total") - 1)).alias("pos"))
        for name, p in probs.items()])).alias("w")).select(
        "g", "w.name", "w.pos", F.floor("w.pos").alias("lower"), F.ceil("w.pos").alias("upper"))
    ranks = wanted.select("g", F.explode(F.array("lower", "upper")).alias("rank")).distinct().select(
        "g", "rank", F.lit("0").alias("range"), F.lit(0).cast("long").alias("below"))

    def longest() -> int:
        return values.groupBy("g", "range").count().agg(F.max("count")).first()[0] or 0

    while longest() > most_values:
        values, ranks = _narrowed(values, ranks, parts)
    upto = F.sum("n").over(Window.partitionBy("g", "range").orderBy("x"))
    placed = values.select("g", "range", "x", (upto - F.col("n")).alias("lo"), upto.alias("hi"))
    at = F.col("rank") - F.col("below")
    hit = (placed.join(ranks, ["g", "range"]).where((at >= F.col("lo")) & (at < F.col("hi")))
           .groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x")))
    low, high = (F.element_at("x", F.col(c)) for c in ("lower", "upper"))
    between = F.when(F.col("lower") == F.col("upper"), low).otherwise(
        (F.col("upper") - F.col("pos")) * low + (F.col("pos") - F.col("lower")) * high)
    out = wanted.join(hit, "g").select("g", "name", between.alias("q")).groupBy("g").agg(
        *[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in probs])
    groups = counts.select("g").distinct() if by else df.sparkSession.range(1).select(
        F.struct(F.lit(0).alias("all")).alias("g"))
    return groups.join(out, "g", "left").select(*[F.col(f"g.`{b}`").alias(b) for b in by], *probs)


def with_quantiles(stats: DataFrame, df: DataFrame, value: str, probs: Mapping[str, float],
                   by: Sequence[str] = ()) -> DataFrame:
    """``stats`` (aggregates of ``df`` by ``by``) with quantiles of ``value`` beside them."""
    group = F.struct(F.lit(0).alias("all"), *by).alias("_g")
    q = quantiles(df, value, probs, by).select(group, *probs)
    return stats.withColumn("_g", group).join(q, "_g", "left").drop("_g")
