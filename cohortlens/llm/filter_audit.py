"""13. Filter interaction audit with radix text tries.

Five filters are applied in every order, so it matters which of them a document fails
at all. Four of them look at one text; the fifth, "identical to the text of a smaller
id", looks at the whole table and is answered by compressed (radix) tries:

1. every task inserts its whole texts into a local trie whose terminals hold the
   smallest id, so a text that many rows repeat leaves a task once;
2. those texts are range-partitioned by a prefix that is lengthened wherever too many
   different texts begin alike, and inserted into one trie for each such prefix;
3. a traversal names the id that owns each text. Rows that don't own theirs are
   duplicates; the flag joins the other four as bits of a mask, and masks are counted.

All 120 orders follow from the counts of 32 masks in each part.
"""
from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import read, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
BLANKS = r"[\x20\x09-\x0D]+"
FIRST_PREFIX = 16
PREFIX_GROWTH = 4
#: A prefix is lengthened if more texts than this share of a partition begin with it.
SHARE = 0.25
LEAST_HEAVY = 1000
TRIE_BYTES = 32 << 20


class RadixTrie:
    """A compressed trie over byte strings; a terminal holds the smallest id inserted
    with its text and the text's tag."""

    def __init__(self):
        self.root = [b"", None, None, {}]
        self.bytes = 0

    def insert(self, text: bytes, least: int, tag: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[3].get(text[at])
            if child is None:
                node[3][text[at]] = [text[at:], least, tag, {}]
                self.bytes += len(text) - at + 200
                return
            n = self._common(child[0], text, at)
            if n < len(child[0]):
                stem = [child[0][:n], None, None, {child[0][n]: child}]
                child[0] = child[0][n:]
                node[3][text[at]] = child = stem
            node, at = child, at + n
        if node[1] is None or least < node[1]:
            node[1], node[2] = least, tag

    @staticmethod
    def _common(edge: bytes, text: bytes, at: int) -> int:
        if text.startswith(edge, at):
            return len(edge)
        return len(os.path.commonprefix([edge, text[at:at + len(edge)]])) if len(edge) < 64 else _first_difference(edge, text, at)

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        """(text, smallest id, tag), in byte order."""
        stack = [(b"", self.root)]
        while stack:
            before, (edge, least, tag, children) = stack.pop()
            path = before + edge
            if least is not None:
                yield path, least, tag
            stack.extend((path, children[c]) for c in sorted(children, reverse=True))


def _first_difference(edge: bytes, text: bytes, at: int) -> int:
    lo, hi = 0, min(len(edge), len(text) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if edge[lo:mid] == text[at + lo:at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _rows_of(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            yield from zip(*[c.to_pylist() for c in part.columns])


def _batches_of(rows, names, types, most: int = 8 << 20):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[0]) if isinstance(row[0], bytes) else 64
        if size > most:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _local_tries(batches):
    """Distinct texts of a task (of every ``TRIE_BYTES`` of it) with their smallest id."""
    def rows():
        trie = RadixTrie()
        for text, least, tag in _rows_of(batches):
            trie.insert(text, least, tag)
            if trie.bytes > TRIE_BYTES:
                yield from trie.terminals()
                trie = RadixTrie()
        yield from trie.terminals()
    yield from _batches_of(rows(), ["text", "id", "tag"], [pa.binary(), pa.int64(), pa.int64()])


def _prefix_tries(batches):
    """One trie for each run of rows with the same adaptive prefix: (owner id, tag)."""
    def rows():
        trie, now = RadixTrie(), None
        for prefix, path, text, least, tag in _rows_of(batches):
            if (prefix, path) != now:
                yield from ((i, t) for _, i, t in trie.terminals())
                trie, now = RadixTrie(), (prefix, path)
            trie.insert(text, least, tag)
        yield from ((i, t) for _, i, t in trie.terminals())
    yield from _batches_of(rows(), ["id", "tag"], [pa.int64(), pa.int64()])


def _path(length: int) -> Column:
    return F.xxhash64(F.substring("text", 1, length))


def heavy_prefixes(texts: DataFrame, share: float = SHARE, least: int = LEAST_HEAVY) -> list[tuple[int, list[int]]]:
    """[(prefix length, hashes of the prefixes of that length to be lengthened)].

    Counts different longer texts under each prefix, so copies don't count. At most
    partitions / ``share`` prefixes of a length can pass, whatever the table's size."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(least, int(texts.count() * share / parts))
    out, length, open_ = [], FIRST_PREFIX, texts
    while True:
        counted = (open_.where(F.length("text") > length).select(_path(length).alias("path"), "tag").distinct()
                   .groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
        found = sorted(r["path"] for r in counted.select("path").collect())
        if not found:
            return out
        out.append((length, found))
        open_ = open_.where(_path(length).isin(found))
        length *= PREFIX_GROWTH


def with_prefix(texts: DataFrame, heavy: list[tuple[int, list[int]]]) -> DataFrame:
    """``prefix`` (the first bytes) and ``path`` (hash of the adaptive prefix)."""
    path = _path(FIRST_PREFIX)
    for length, found in heavy:
        path = F.when(path.isin(found) & (path == _path(length)), _path(length * PREFIX_GROWTH)).otherwise(path)
    return texts.select(F.substring("text", 1, FIRST_PREFIX).alias("prefix"), path.alias("path"), "text", "id", "tag")


def text_owners(docs: DataFrame, share: float = SHARE, least: int = LEAST_HEAVY) -> DataFrame:
    """(id, tag): for every different text of ``docs`` (id, text: binary, tag: a hash of
    the text) the smallest id that holds it."""
    texts = docs.where("id is not null").select("text", "id", "tag")
    heavy = heavy_prefixes(texts, share, least)
    local = texts.mapInArrow(_local_tries, "text binary, id long, tag long")
    dealt = with_prefix(local, heavy).repartitionByRange("prefix", "path").sortWithinPartitions("prefix", "path")
    return written(dealt.mapInArrow(_prefix_tries, "id long, tag long"), "text-owners")


def text_mask(text: Column) -> Column:
    """Bits of the four filters that look at one text: A 1, B 2, C 4, D 8."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return F.element_at(F.transform(F.array(words), lambda w: (
        F.when(F.size(w) < 50, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(w)) < 65 * F.size(w), 2).otherwise(0)
        + F.when(100 * upper.cast("long") > 5 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0))), 1)


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(F.col(f"`{key}`").cast("long").alias("id"), whole.alias("text"),
                       F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    tagged = base.select("id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tag"))
    owners = text_owners(tagged).withColumn("owner", F.lit(True))
    marks = written(labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("id")).agg(
        F.max(F.coalesce((F.col(f"`{quality}`") == 1).cast("int"), F.lit(0))).alias("q"),
        F.max(F.coalesce((F.col(f"`{toxic}`") == 1).cast("int"), F.lit(0))).alias("t")), "text-labels")
    rows = base.select("id", F.xxhash64("text").alias("tag"), "part", text_mask(F.col("text")).alias("mask"))
    owned = rows.where("id is not null").join(owners, ["id", "tag"], "left").select(
        "id", "part", (F.col("mask") + F.when(F.col("owner").isNull(), 16).otherwise(0)).alias("mask"))
    known = owned.join(marks, "id", "left").select("part", "mask", "q", "t")
    nameless = rows.where("id is null").select("part", "mask", F.lit(0).alias("q"), F.lit(0).alias("t"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("q", F.lit(0))).cast("long").alias("good"),
        F.sum(F.coalesce("t", F.lit(0))).cast("long").alias("toxic"))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before)."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [(o, s + 1, bit[f], sum(bit[x] for x in o[:s])) for o in ORDERS for s, f in enumerate(o)]


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step from the mask counts.

    ``shapley`` sums what a filter removes over all orders: of the 120 orders, a
    document failing k filters falls to each of them in 120 / k."""
    names = ("filter_order", "step", "bit", "before")
    steps = F.from_json(F.lit(json.dumps([dict(zip(names, x)) for x in _steps()])),
                        "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    each = counts.withColumn("s", F.explode(steps)).select(
        "part", "mask", "n", "good", "toxic", "s.filter_order", "s.step", "s.bit", "s.before")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(when, of="n"):
        return F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * (len(ORDERS) / F.bit_count("mask"))).otherwise(0)).cast("long").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``,
    ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley`` of every part and order.

    A null text is an empty one, a null source the part "". A null id is no id: such a
    row neither is a duplicate nor makes one, and has no label. Repeated rows count each;
    rows of one id with one text are not duplicates of each other. A label repeated for
    an id counts if any of its rows sets it. Empty tables give no rows; other columns
    don't matter. Very long texts are inserted whole; a trie holds the texts of one
    adaptive prefix, and a text that many rows repeat comes once from each task."""
    return audit(mask_counts(docs, labels))


def op13_filter_audit(spark, sf_dir) -> DataFrame:
    """Filter interactions of every document, by source and in all 120 orders."""
    return audit_filters(read(spark, sf_dir, "documents").select("doc_id", "text", "source"),
                         read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS q, max(CAST(toxic = 1 AS INT)) AS t
          FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(q, 0) AS q, coalesce(t, 0) AS t,
         len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM base LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(q) AS good, sum(t) AS tox FROM flags GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order FROM f f1, f f2, f f3, f f4, f f5
  WHERE len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
steps AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS step FROM orders),
each AS (
  SELECT *, contains(failed, substring(filter_order, step, 1)) AS fails,
         len(list_filter(string_split(left(filter_order, step - 1), ''), lambda x: x <> '' AND contains(failed, x))) > 0 AS earlier
  FROM (SELECT *, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
               || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed FROM counts) x, steps),
sums AS (
  SELECT part, filter_order, step, substring(filter_order, step, 1) AS letter,
         coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS kept,
         coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant,
         coalesce(sum(n) FILTER (failed = substring(filter_order, step, 1)), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost,
         coalesce(sum(tox) FILTER (fails AND NOT earlier), 0) AS toxic_lost
  FROM each GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM sums
"""
