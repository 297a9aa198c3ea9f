"""Term matching by an inverted index (t_doc_term, j_term_contains, t_mention_filter).

A text contains a term only if it contains every q-gram of it. So each term is indexed
under its rarest q-gram, the distinct q-grams of a text are equi-joined with the index,
and ``contains`` decides the candidates exactly. A term shorter than q is its own gram.
Grams are runs of UTF-8 bytes, held as integers and found by NumPy inside the tasks.
The vocabulary stays a table of any size: nothing of it becomes a plan literal.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grams import row_blocks, text_bytes
from ..session import cut_lineage

Q = 3
BLOCK = 1 << 20
#: An index of at most this many terms is broadcast, and its grams are sought in the texts;
#: a larger one is joined by shuffle, and the texts are then looked up for the candidates alone.
BROADCAST_TERMS = 100_000


def _found(data: np.ndarray, bounds: np.ndarray, flags: dict) -> np.ndarray:
    """Sorted distinct row << 32 | gram of the rows' bytes. A gram is length << 24 | bytes;
    ``flags`` says of each length which ones count (None: all)."""
    out = [np.zeros(0, np.int64)]
    for n, counts in flags.items():
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, np.int64)
        for i in range(n):
            code = code << 8 | data[i:len(code) + i]
        at = np.arange(len(code)) if counts is None else np.flatnonzero(counts[code])
        row = np.searchsorted(bounds, at, side="right") - 1
        whole = at + n <= bounds[row + 1]
        out.append(np.unique(row[whole] << 32 | n << 24 | code[at[whole]]))
    return np.sort(np.concatenate(out))


def with_grams(rows: DataFrame, sought: dict[int, list[int] | None]) -> DataFrame:
    """The rows with the distinct ``grams`` of their ``_text``, without rows that have none.
    ``sought``: lengths, with the grams of that length that count (None: all)."""
    def run(batches):
        flags = {}
        for n, codes in sought.items():
            flags[n] = None if codes is None else np.zeros(1 << 8 * n, bool)
            if codes is not None:
                flags[n][codes] = True
        for b in batches:
            data, bounds = text_bytes(b.column("_text"))
            for lo, hi in row_blocks(bounds, BLOCK):
                found = _found(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], flags)
                held, first = np.unique(found >> 32, return_index=True)
                ends = pa.array(np.append(first, len(found)).astype(np.int32))
                part = b.slice(lo, hi - lo).take(pa.array(held))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(ends, pa.array(found & 0xFFFFFFFF))], [*part.schema.names, "grams"])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("grams", T.ArrayType(T.LongType()))]))


def term_index(terms: DataFrame) -> DataFrame:
    """(term_id, term, gram): each term under the gram of Q bytes that fewest terms have; a
    shorter term is its own gram."""
    own = F.least(F.octet_length("_text"), F.lit(Q))
    each = (with_grams(terms.select("term_id", F.col("term").alias("_text")), {n: None for n in range(1, Q + 1)})
            .select("term_id", F.col("_text").alias("term"), F.explode("grams").alias("gram"), own.alias("n"))
            .where(F.shiftright("gram", 24) == F.col("n")).drop("n"))
    spread = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return (each.join(spread, "gram").groupBy("term_id", "term")
            .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))


def term_hits(rows: DataFrame, key: Sequence[str], text: str, terms: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """(key..., term_id) for every term of ``terms`` (term_id, term) that the text of a
    row contains, each once. ``key`` names the row; case is folded by the caller. Null
    texts and null or empty terms match nothing."""
    index = cut_lineage(term_index(terms.select("term_id", "term")))
    few = index.count() <= most
    grams = index.select("gram" if few else F.shiftright("gram", 24).alias("n")).distinct().collect()
    sought = {n: [g & 0xFFFFFF for g, in grams if g >> 24 == n] for n in {g >> 24 for g, in grams}} if few else {n: None for n, in grams}
    base = rows.select(*key, F.col(text).alias("_text"))
    each = with_grams(base, sought).select(*key, "_text", F.explode("grams").alias("gram"))
    if few:
        hits = each.join(F.broadcast(index), "gram")
    else:
        hits = each.drop("_text").join(index, "gram").join(base, list(key))
    return hits.where(F.contains("_text", "term")).select(*key, "term_id").distinct()


def mentioning(rows: DataFrame, key: Sequence[str], text: str, terms: DataFrame) -> DataFrame:
    """Keys of the rows whose text contains any term."""
    return term_hits(rows, key, text, terms).select(*key).distinct()
