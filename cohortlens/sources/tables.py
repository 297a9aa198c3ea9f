"""Table access (io_*): parquet/CSV readers and writers with explicit schemas.

Every reader is lazy: nothing is scanned until an action, so Catalyst can push
filters and column pruning into the parquet scan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")


TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame, min_parts: int | None = None) -> DataFrame:
    """Make sure CPU-heavy text work gets at least one partition per core.

    A scan of a few large row groups can yield fewer partitions than cores
    (one parquet row group is never split); then a round-robin repartition is
    cheaper than running the text operators on one thread. A large input
    already scans into thousands of partitions and is left untouched."""
    sc = df.sparkSession.sparkContext
    want = min_parts or sc.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    # The seed makes a recomputed partition reproduce the same rows. A filter directly
    # on the scan may still be pushed below the exchange.
    return df.repartition(want, F.rand(42))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """io_read_table: full (lazy) table read; pruning/pushdown left to Catalyst."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite", fmt: str = "parquet") -> None:
    """io_write_table / io_split_dirs: overwrite a table, optionally partitioned."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_splits(rows: DataFrame, path: str, by: tuple[str, ...] = ("split", "fold", "role")) -> None:
    """io_split_dirs: one folder for each (split, fold, role). Only the folders that
    ``rows`` has are replaced, so a fold can be written anew beside the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """io_read_csv: CSV with quoted multi-line text fields, explicit schema."""
    return (spark.read.schema(schema).option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """io_write_csv / io_report: header, no index, quoted multi-line text."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("quoteAll", False).csv(path))


class Tables:
    """Lazy accessor for the shared tables of one scale-factor folder plus the
    reference-shaped fixture views derived from them (see ``fixtures``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def memo(self, key: str, fn):
        """Per-instance memo for small driver-side values (e.g. a term list)."""
        k = "memo:" + key
        if k not in self._cache:
            self._cache[k] = fn()
        return self._cache[k]

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in BASE_TABLES:
                df = read_table(self.spark, self.root, name)
                if name in TEXT_TABLES:
                    df = spread(df)
                self._cache[name] = df
            else:
                from . import fixtures
                self._cache[name] = getattr(fixtures, name)(self)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)
