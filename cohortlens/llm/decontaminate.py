"""9. Benchmark decontamination with training suffix arrays.

Every block of training texts gets a suffix array over its words. Each suffix of
each test item is looked up in it by binary search, and the suffixes found are
extended to their longest verbatim match, with its location.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import boxed, byte_column, row_blocks, written
from ._tokens import ALNUM, Tokens, tokenise

WINDOW = 13
DEPTH = 4              # words that order the suffixes of a shard
SHARD_BYTES = 4 << 20  # text of one suffix array
TEST_BYTES = 64 << 20  # test text broadcast at once; more goes in several passes
PIECE = 1 << 17        # suffixes or candidates that are handled at once

MATCH = "struct<item_id:bigint,item_start:int,doc_start:int,n_words:int>"


@dataclass
class TestBlock:
    """Words of the test items of one pass, and the suffixes that start a window."""
    ids: list
    data: np.ndarray
    bounds: np.ndarray
    suffix: np.ndarray = None
    words: Tokens = None

    def prepare(self, window: int) -> None:
        t = self.words = tokenise(self.data, self.bounds, ALNUM)
        n = np.diff(t.first)
        starts = [np.arange(a, a + max(1, c - window + 1)) for a, c in zip(t.first, n) if c]
        self.suffix = np.concatenate(starts) if starts else np.zeros(0, np.int64)


def suffix_keys(t: Tokens, at: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest order key of suffixes: 16 bits of each of the first words;
    past the end of the text the lowest key has zeros and the highest ones."""
    low, high = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    last = t.first[t.doc[at] + 1] if len(at) else at
    for i in range(depth):
        inside = at + i < last
        part = np.where(inside, t.hash[np.minimum(at + i, len(t.hash) - 1)] >> np.uint64(48), 0).astype(np.uint64) \
            if len(at) else low
        low = (low << np.uint64(16)) | part
        high = (high << np.uint64(16)) | np.where(inside, part, np.uint64(0xFFFF))
    return low, high


def longest_matches(t: Tokens, block: TestBlock, window: int):
    """(text index, item index, word in the text, word in the item, words) of every
    maximal verbatim match that covers a window."""
    none = (np.zeros(0, np.int64),) * 5
    test, suffix = block.words, block.suffix
    if not len(t.hash) or not len(suffix):
        return none
    keys = np.concatenate([suffix_keys(t, np.arange(lo, min(lo + PIECE, len(t.hash))))[0]
                           for lo in range(0, len(t.hash), PIECE)])
    order = np.argsort(keys)  # the suffix array of this shard
    keys = keys[order]
    low, high = suffix_keys(test, suffix)
    left, right = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
    out = []
    # candidates go in slices, so that a frequent opening can't fill the memory
    many = np.cumsum(right - left)
    lo = 0
    while lo < len(suffix):
        before = many[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(many, before + PIECE, "right")))
        n = right[lo:hi] - left[lo:hi]
        s = np.repeat(suffix[lo:hi], n)
        step = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
        p = order[np.repeat(left[lo:hi], n) + step]
        out.append(_extend(t, test, p, s, window))
        lo = hi
    p, s, n = (np.concatenate(x) for x in zip(*out))
    return t.doc[p], test.doc[s], p - t.first[t.doc[p]], s - test.first[test.doc[s]], n


def _extend(t: Tokens, test: Tokens, p, s, window):
    """Keep candidates that match a whole window and that no longer match covers;
    extend them to the right as far as the words agree."""
    p_end, s_end = t.first[t.doc[p] + 1], test.first[test.doc[s] + 1]
    s_first = test.first[test.doc[s]]
    need = np.minimum(window, s_end - s_first)
    keep = p + need <= p_end
    p, s, need, p_end, s_end, s_first = (x[keep] for x in (p, s, need, p_end, s_end, s_first))
    inner = (s > s_first) & (p > t.first[t.doc[p]])
    keep = ~(inner & (t.hash[np.maximum(p - 1, 0)] == test.hash[np.maximum(s - 1, 0)]))
    p, s, need, p_end, s_end = (x[keep] for x in (p, s, need, p_end, s_end))
    length = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    i = 0
    while len(live):
        live = live[(p[live] + i < p_end[live]) & (s[live] + i < s_end[live])]
        live = live[t.hash[p[live] + i] == test.hash[s[live] + i]]
        i += 1
        length[live] = i
    keep = length >= need
    for j in np.flatnonzero(keep):  # hashes found them; the words themselves decide
        a, b, n = p[j], s[j], length[j]
        keep[j] = all(t.word(a + i) == test.word(b + i) for i in range(n))
    return p[keep], s[keep], length[keep]


def scan(col: pa.Array, block: TestBlock, window: int):
    """Per text: number of words, and its matches as rows of ``MATCH``."""
    data, bounds, _ = byte_column(col)
    n_words = np.zeros(len(col), np.int64)
    found: list[list] = [[] for _ in range(len(col))]
    for lo, hi in row_blocks(bounds, SHARD_BYTES):
        t = tokenise(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], ALNUM)
        n_words[lo:hi] = np.diff(t.first)
        for d, item, at, item_at, n in zip(*longest_matches(t, block, window)):
            found[lo + d].append({"item_id": block.ids[item], "item_start": int(item_at),
                                  "doc_start": int(at), "n_words": int(n)})
    return n_words, found


def covered(matches: list) -> int:
    """Words inside any match."""
    total = end = 0
    for a, n in sorted((m["doc_start"], m["n_words"]) for m in matches):
        total += max(0, a + n - max(end, a))
        end = max(end, a + n)
    return total


def test_blocks(benchmark: DataFrame, item: str, text: str, most: int = TEST_BYTES):
    """(is the last, block): the test items in blocks of about ``most`` bytes, one gathered
    after the other. Item hashes deal them out, so each block that is gathered and
    broadcast has a bounded size whatever the table."""
    size = benchmark.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()["n"] or 0
    n = -(-size // most) or 1
    b = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null")
    for i in range(n):
        rows = b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).distinct().toArrow()
        data, bounds, _ = byte_column(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
        block = TestBlock(rows.column("item").to_pylist(), np.array(data), np.array(bounds))
        del rows, data, bounds
        yield i == n - 1, block
        del block


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, test_bytes: int = TEST_BYTES) -> DataFrame:
    """``row`` (the input row as a struct), ``n_words``, ``n_hit`` and ``matches``
    (array of item_id, item_start, doc_start, n_words: maximal verbatim matches that
    cover a window of ``window`` item words, or a whole shorter item).

    Null and empty texts have no words and no matches; items without words match
    nothing; repeated rows get equal answers; a match of an item whose id is null
    counts in n_hit with a null item_id; empty tables work; columns of any name stay
    inside ``row``. No shuffle: a text stays in its task, and blocks of the test set
    pass over it one after the other; the matches of a block are written before the
    next one is gathered."""
    sc = docs.sparkSession.sparkContext
    at = [c.lower() for c in docs.columns].index(text.lower())  # the text travels in the row alone
    frame = boxed(docs).withColumns(
        {"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"),
         "matches": F.array().cast(f"array<{MATCH}>")})
    for last, block in test_blocks(benchmark, item, item_text, test_bytes):
        shared = sc.broadcast(block)
        del block

        def run(batches, shared=shared):
            test = shared.value
            if test.words is None:
                test.prepare(window)
            for b in batches:
                n_words, found = scan(b.column("row").field(at), test, window)
                found = [x + y for x, y in zip(b.column("matches").to_pylist(), found)]
                columns = {"row": b.column("row"), "n_words": pa.array(n_words),
                           "n_hit": pa.array([covered(x) for x in found], pa.int64()),
                           "matches": pa.array(found, b.column("matches").type)}
                yield pa.RecordBatch.from_arrays([columns[c] for c in b.schema.names], b.schema.names)

        frame = frame.mapInArrow(run, frame.schema)
        if not last:
            frame = written(frame, "block-matches")
            shared.destroy()
    return frame


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lies in matches."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    found = find_matches(docs, benchmark, **options)
    return found.where(~contaminated(F.col("n_hit"), F.col("n_words"))).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_decontamination(spark, sf_dir) -> DataFrame:
    """Overlap of every document with the benchmark: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated."""
    from ._common import read
    found = find_matches(read(spark, sf_dir, "documents").select("doc_id", "text"),
                         read(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.filter(
        F.transform("matches", lambda m: m["item_id"].cast("string")), lambda i: i.isNotNull())))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
  FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.s, p.n, x.item_id FROM places p JOIN windows x ON p.g = x.g AND p.n = x.n),
spots AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM hits, unnest(range(s, s + n)) AS t(i) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)
"""
