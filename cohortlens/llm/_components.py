"""Connected components of a distributed link table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: every node hands its smallest neighbour (or itself) to its larger
    neighbours, or, in a small star, to itself and its smaller ones."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b: long); the component is the
    smallest id that links reach.

    Large and small stars by turns until nothing changes. A node's neighbours are never
    gathered: minima are partial aggregates, and a hub's rows stay rows of a join that
    Spark can split. Every round is checkpointed to the shared folder."""
    edges = cut_lineage(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())

    def mark(df):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        return row["n"], row["h"]

    now = mark(edges)
    while now[0]:
        edges = cut_lineage(_star(_star(edges, small=False), small=True))
        then, now = now, mark(edges)
        if then == now:
            break
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return cut_lineage(nodes.union(roots))
