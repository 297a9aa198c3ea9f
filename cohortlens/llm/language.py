"""8. Language ID with bit-sliced Bloom filters of byte n-grams.

One filter row is a bit mask over languages: the AND of an n-gram's rows is the
set of all languages that contain the n-gram. A text's popcounts per language,
corrected for that language's false-positive rate, decide.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import boxed, byte_column, mix64, row_blocks

SIZES = (3, 5)            # byte n-grams
MAX_DOCS_PER_LANG = 4_000  # expected size of the labelled sample of each language
MIN_SHARE = 1e-4          # an n-gram of a language: at least this share of its n-grams
PROBES = 3
BLOCK = 1 << 18
ROWS = 512                # rows of an Arrow batch taken at once; a long text is still whole
UND = "und"

_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[:65] = _SPACE[91:97] = _SPACE[123:128] = 32
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], dtype=np.uint64)


def packed_grams(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams as integers and their text index; ASCII non-letters count as
    space, and n-grams with two spaces side by side are left out."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    clean = _SPACE[data]
    packed = np.full(m, n, dtype=np.uint64)
    for i in range(n):
        packed = (packed << np.uint64(8)) | clean[i:m + i]
    space = clean == 32
    pair = np.concatenate([[0], np.cumsum(space[1:] & space[:-1])])
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keep = (doc[:m] == doc[n - 1:]) & (pair[n - 1:] == pair[:m])
    return packed[keep], doc[:m][keep]


@dataclass
class Filter:
    """``rows[r]`` holds the language bits of filter row r, 64 languages a word."""
    langs: list[str]
    prior: np.ndarray
    rows: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        out = None
        for seed in _SEEDS[:PROBES]:
            at = (mix64(grams + seed) % np.uint64(len(self.rows))).astype(np.int64)
            out = self.rows[at] if out is None else out & self.rows[at]
        return out

    def false_positive(self) -> np.ndarray:
        """Chance of each language that all probes of an unseen n-gram are set."""
        fill = [np.mean((self.rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))
                for i in range(len(self.langs))]
        return np.asarray(fill) ** PROBES


def build_filter(langs: list[str], prior, grams: np.ndarray, lang: np.ndarray) -> Filter:
    size = 1 << max(10, int(np.ceil(np.log2(8 * max(1, len(grams))))))
    rows = np.zeros((size, (len(langs) + 63) // 64), np.uint64)
    for seed in _SEEDS[:PROBES]:
        at = (mix64(grams + seed) % np.uint64(size)).astype(np.int64)
        np.bitwise_or.at(rows, (at, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
    return Filter(langs, np.asarray(prior, float), rows)


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.cast(col, pa.large_string()))


def _count_batches(batches):
    for b in (b.slice(lo, 4 * ROWS) for b in batches for lo in range(0, b.num_rows, 4 * ROWS)):
        for lang in pc.unique(b.column("lang")).to_pylist():
            part = b.filter(pc.equal(b.column("lang"), lang))
            data, bounds, _ = byte_column(_lower(part.column("text")))
            for n in SIZES:
                found = [np.unique(packed_grams(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], n)[0],
                                   return_counts=True) for lo, hi in row_blocks(bounds, BLOCK)]
                if found:
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * sum(len(g) for g, _ in found), pa.string()),
                        "n": pa.array(np.full(sum(len(g) for g, _ in found), n, np.int32)),
                        "gram": pa.array(np.concatenate([g for g, _ in found]).view(np.int64)),
                        "c": pa.array(np.concatenate([c for _, c in found]).astype(np.int64))})


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None,
        max_docs: int = MAX_DOCS_PER_LANG, min_share: float = MIN_SHARE) -> Filter:
    """Learn the filters from rows with a language.

    Each language gives a hash sample of ``max_docs`` rows in expectation. A language
    keeps the n-grams that make up at least ``min_share`` of its n-grams, so at most
    1/min_share for each n-gram size: that bounds the filter whatever the corpus."""
    df = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"),
                         (key if key is not None else F.xxhash64(F.col(text))).alias("k"))
    df = df.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filter([], np.zeros(0), np.zeros((1024, 1), np.uint64))
    langs = sorted(sizes)
    rate = F.create_map(*[x for v in langs for x in (F.lit(v), F.lit(min(1.0, max_docs / sizes[v])))])
    df = df.where(F.pmod(F.xxhash64(F.lit(8), "k"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))
    counts = (df.select("lang", "text").mapInArrow(_count_batches, "lang string, n int, gram long, c long")
              .groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")))
    total = counts.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    best = (counts.join(F.broadcast(total), ["lang", "n"])  # languages x n-gram sizes rows
            .where(F.col("c") >= F.col("total") * F.lit(min_share)).select("lang", "gram"))
    rows = best.toPandas()
    at = {v: i for i, v in enumerate(langs)}
    return build_filter(langs, [sizes[v] for v in langs], rows["gram"].to_numpy(np.int64).view(np.uint64),
                        rows["lang"].map(at).to_numpy(np.int64))


def _letters(data: np.ndarray, bounds: np.ndarray, col: pa.Array) -> np.ndarray:
    """Whether each text has a letter: ASCII letters from bytes, others by code point."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    run = np.concatenate([[0], np.cumsum(ascii_letter)])
    has = run[bounds[1:]] > run[bounds[:-1]]
    for i in np.flatnonzero(~has & (np.diff(bounds) > 0)):
        has[i] = any(c.isalpha() for c in col[int(i)].as_py())
    return has


def classify(col: pa.Array, model: Filter, wrong: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score (its share of the corrected popcounts) of each text."""
    low = _lower(col)
    data, bounds, _ = byte_column(low)
    n_rows, n_langs = len(col), len(model.langs)
    if not n_langs:
        return [UND] * n_rows, np.zeros(n_rows)
    hits = np.zeros((n_langs, n_rows))
    for lo, hi in row_blocks(bounds, BLOCK):
        for n in SIZES:
            grams, doc = packed_grams(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], n)
            if not len(grams):
                continue
            masks = model.masks(grams)
            total = np.bincount(doc, minlength=hi - lo)
            for i in range(n_langs):
                bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                seen = np.bincount(doc, weights=bit.astype(float), minlength=hi - lo)
                hits[i, lo:hi] += np.maximum(0, seen - total * wrong[i]) / (1 - wrong[i])
    tie = model.prior / (1 + model.prior.sum()) * 1e-9  # equal counts: the more frequent, then the first
    best = np.argmax(hits + tie[:, None], axis=0)
    sums = hits.sum(0)
    score = np.where(sums > 0, hits[best, np.arange(n_rows)] / np.maximum(sums, 1e-300), 0.0)
    letters = _letters(data, bounds, low)
    return ([model.langs[b] if ok else UND for b, ok in zip(best, letters)],
            np.where(letters, score, 0.0))


def identify(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """``row`` (the input row as a struct), ``lang_pred`` and ``score`` for every row.

    Null texts and texts without a letter get ``und`` and score 0; a text whose
    n-grams no language holds gets the most frequent language with score 0. Repeated
    rows get equal answers, an empty table gives no rows, and columns of any name
    stay inside ``row``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, model.false_positive()))

    def run(batches):
        m, wrong = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                row = b.column("row").slice(lo, ROWS)
                pred, score = classify(row.field(at), m, wrong)
                yield pa.RecordBatch.from_arrays(
                    [row, pa.array(pred, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    at = docs.columns.index(text)
    frame = boxed(docs)
    return frame.mapInArrow(run, f"row {frame.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit_documents(docs: DataFrame) -> Filter:
    """Learn from the rows of a ``documents`` table that are not held out."""
    return fit(docs.where(remainder(F.col("doc_id")) != 0), key=F.col("doc_id"))


def op8_language_id(spark, sf_dir) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score.
    A null doc_id is neither held out nor learned from."""
    from ._common import read
    docs = read(spark, sf_dir, "documents")
    model = fit_documents(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", F.coalesce(remainder(F.col("row.doc_id")) == 0, F.lit(False)).alias("held_out"),
                      "lang_pred", "score")
