"""Small helpers shared by the training-data operators."""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is; null stays null."""
    return F.translate(text, UPPER, UPPER.lower())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a lineage cut that any
    executor can read after another is lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct column ``row`` beside the given columns, so that
    no column of the input can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[c.alias(n) for n, c in columns.items()])


def byte_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column as (UTF-8 bytes, offsets, is-null), without decoding."""
    col = pc.cast(col, pa.large_string())
    null = np.asarray(pc.is_null(col).to_numpy(zero_copy_only=False), dtype=bool)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[bounds[0]:bounds[-1]], bounds - bounds[0], null


def row_blocks(bounds: np.ndarray, most_bytes: int):
    """(first row, end row) of consecutive blocks of about ``most_bytes`` of text;
    a longer text is a block of its own."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + most_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising mix (multiply and xor-shift rounds), on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeezed(x: np.ndarray) -> bytes:
    """64-bit integers by byte planes, compressed: small numbers take about a byte."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def restored(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()
