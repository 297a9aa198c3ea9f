"""2. N-gram Jaccard join with parity sketches.

Two linked sets share all but a small part of either, so the shingles of each that come
first, in any order common to all sets and one more than may be missing in the other,
have one in common: an equi join on these loses no pair. The order puts shingles that
few sets have first, by counts of a fixed size. Then sketches decide: a text's shingles
flip bits of a sketch, so the Hamming distance of two sketches is at most the symmetric
difference of the sets, which a Jaccard threshold bounds. Candidates are checked with a
sketch of a fixed size and one that grows with the set, and what these leave against the
shingles themselves.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import boxed, byte_column, mix64, row_blocks, written
from ._components import components
from ._tokens import NONSPACE, grams, tokenise

CELLS = 1 << 22     # counts of shingles; they give the order, on which no result depends
SLICE = 1 << 14     # cells that are summed together
COUNT_ROWS = 512    # rows whose shingles are counted at once
CHECK_WORDS = 12    # 64-bit words of the fixed sketch that candidates are checked with first
BLOCK = 1 << 20
KEY_ROWS = 4096     # rows whose keys are combined at once
PIECE_WORDS = 1 << 18  # sketch words of pairs that are compared at once
BROADCAST_IDS = 500_000  # tables of ids with more rows than this are joined by shuffle
BROADCAST_SKETCHES = 100_000  # and fixed sketches of more rows
BROADCAST_WORDS = 1 << 20  # and wide sketches of more words (8 MB) in all


@dataclass(frozen=True)
class Rule:
    """Shingles of ``k`` words; link when num * union <= den * intersection."""
    k: int = 5
    num: int = 80
    den: int = 100

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of two linked sets of ``total`` shingles."""
        return total * (self.den - self.num) // (self.den + self.num)

    def linked(self, a, b, both):
        return self.den * both >= self.num * (a + b - both)


def shingle_sets(col: pa.Array, k: int):
    """Per text, in order: its sorted distinct shingle hashes."""
    data, bounds, _ = byte_column(col)
    for lo, hi in row_blocks(bounds, BLOCK):
        t = tokenise(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], NONSPACE)
        h, doc = grams(t, k)
        ends = np.searchsorted(doc, np.arange(hi - lo + 1))
        count = np.diff(t.first)
        for i in range(hi - lo):
            if 0 < count[i] < k:  # a text of fewer words is one shingle
                one = mix64(t.hash[t.first[i]:t.first[i + 1]] + np.arange(count[i], dtype=np.uint64))
                yield np.array([mix64(one.sum(dtype=np.uint64, keepdims=True) + np.uint64(count[i]))[0]])
            else:
                yield np.unique(h[ends[i]:ends[i + 1]])


def _flip(part: np.ndarray, bit: np.ndarray, parts: int) -> np.ndarray:
    out = np.zeros(parts, np.uint64)
    np.bitwise_xor.at(out, part, np.uint64(1) << bit)
    return out


def cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(65 - CELLS.bit_length())).astype(np.int64)


def sketch_keys(s: np.ndarray, rule: Rule, levels: np.ndarray | None = None) -> np.ndarray:
    """Join keys of a set: its first shingles by the levels of their cells, then by hash, one
    more than a linked set can lack. The level is part of the key, so that shingles in one
    place of the order are one key."""
    lacking = len(s) - -(-len(s) * rule.num // rule.den)
    level = np.zeros(len(s), np.uint64) if levels is None else levels[cells(s)].astype(np.uint64)
    return np.partition((level << np.uint64(56)) | (s >> np.uint64(8)), lacking)[:lacking + 1]


def check_sketch(s: np.ndarray, words: int) -> np.ndarray:
    return _flip((s >> np.uint64(20)) % np.uint64(words), s & np.uint64(63), words)


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """A sketch of one to two bits a shingle, so that it tells long sets apart as well as
    short ones. Its words are a power of two: the halves of the longer of two sketches,
    combined by XOR, are the sketch of half the words."""
    return check_sketch(s, 1 << (max(1, -(-len(s) // 64)) - 1).bit_length())


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = mix64(s + np.uint64(11)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s + np.uint64(29)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def _longs(rows: list) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, n, h1, h2, sketch, wide) of every row."""
    def run(batches):
        for b in batches:
            rows = [(len(s), *(set_hash(s) if len(s) else (0, 0)), check_sketch(s, CHECK_WORDS),
                     wide_sketch(s)) for s in shingle_sets(b.column("text"), rule.k)]
            n, h1, h2 = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n), pa.array(h1), pa.array(h2), *[_longs([r[i] for r in rows]) for i in (3, 4)]],
                ["id", "n", "h1", "h2", "sketch", "wide"])
    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, sketch array<long>, wide array<long>")


def _levels(docs: DataFrame, rule: Rule) -> np.ndarray:
    """A level for each cell of shingles: eight times the logarithm of the number of rows
    with a shingle in it. Each task counts its rows in one array of fixed size; its slices
    are added up in many tasks."""
    def count(batches):
        total = np.zeros(CELLS, np.uint32)
        for b in (b.slice(lo, COUNT_ROWS) for b in batches for lo in range(0, b.num_rows, COUNT_ROWS)):
            sets = list(shingle_sets(b.column("text"), rule.k))
            if sets:
                cell, n = np.unique(cells(np.concatenate(sets)), return_counts=True)
                total[cell] += n.astype(np.uint32)
        at = [lo for lo in range(0, CELLS, SLICE) if total[lo:lo + SLICE].any()]
        packed = [pa.compress(total[lo:lo + SLICE].tobytes(), codec="zstd", asbytes=True) for lo in at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed, pa.binary())], ["at", "counts"])

    def add(table):
        total = np.zeros(SLICE)
        for x in table.column("counts"):
            total += np.frombuffer(pa.decompress(x.as_py(), decompressed_size=4 * SLICE, codec="zstd"), np.uint32)
        level = np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8).tobytes()
        return pa.table({"at": table.column("at").slice(0, 1), "level": pa.array([level], pa.binary())})

    out = np.zeros(CELLS, np.uint8)
    for r in docs.mapInArrow(count, "at long, counts binary").groupBy("at").applyInArrow(add, "at long, level binary").collect():
        out[r["at"]:r["at"] + SLICE] = np.frombuffer(r["level"], np.uint8)
    return out


def _keys(docs: DataFrame, rule: Rule) -> DataFrame:
    """(key, id, hub) of the first shingles of every row. Rows are combined before they
    are shuffled: in each block of rows, equal sets are one, and rows that share a key
    point at the smallest id with it (hub 0: the row stands for the block)."""
    levels = docs.sparkSession.sparkContext.broadcast(_levels(docs, rule))

    def run(batches):
        for b in (b.slice(lo, KEY_ROWS) for b in batches for lo in range(0, b.num_rows, KEY_ROWS)):
            ids = b.column("id").to_numpy(zero_copy_only=False)
            key, own, seen = [], [], set()
            for i, s in zip(ids, shingle_sets(b.column("text"), rule.k)):
                if len(s) and (name := set_hash(s)) not in seen:
                    seen.add(name)
                    key.append(sketch_keys(s, rule, levels.value))
                    own.append(np.full(len(key[-1]), i, np.int64))
            if key:
                yield from _combined(np.concatenate(key), np.concatenate(own))
    return docs.mapInArrow(run, "key long, id long, hub long")


def _combined(key: np.ndarray, own: np.ndarray):
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    opens = np.concatenate([[True], key[1:] != key[:-1]])
    hub = own[np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))]
    keep = opens | (own != hub)  # rows of one id twice under a key are one
    key, own, hub = key[keep], own[keep], np.where(opens, 0, hub)[keep]
    for i in range(0, len(key), 1 << 17):
        part = slice(i, i + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(own[part]),
                                          pa.array(hub[part])], ["key", "id", "hub"])


def _shingles(docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, s): the whole shingle sets, of the rows that a sketch can't decide."""
    def run(batches):
        for b in batches:
            ids, rows = b.column("id").to_numpy(zero_copy_only=False), shingle_sets(b.column("text"), rule.k)
            for lo in range(0, len(ids), 256):
                part = ids[lo:lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array(part), _longs([next(rows) for _ in part])], ["id", "s"])
    return docs.mapInArrow(run, "id long, s array<long>")


def _near_enough(rule: Rule, a: str, b: str) -> Column:
    """Sizes that a link allows, and fixed sketches no further apart than the largest
    symmetric difference of a link."""
    an, bn, apart = F.col(a + "n"), F.col(b + "n"), F.lit(0)
    for i in range(CHECK_WORDS):
        x, y = (F.col(f"{side}sketch")[i] for side in (a, b))
        apart = apart + F.bit_count(x.bitwiseXOR(y))
    return ((F.greatest(an, bn) * rule.num <= F.least(an, bn) * rule.den)
            & (apart * (rule.den + rule.num) <= (an + bn) * (rule.den - rule.num)))


def _folded_apart(x: tuple, y: tuple) -> np.ndarray:
    """Hamming distances of pairs of wide sketches, each side (first word, words, all words).
    The lengths of a pair differ by two at most: the words from ``short`` on fold onto
    those before."""
    short = np.minimum(x[1], y[1])
    opens = np.cumsum(short) - short
    within = np.arange(short.sum()) - np.repeat(opens, short)
    differ = np.zeros(len(within), np.uint64)
    for first, size, words in (x, y):
        at = np.repeat(first, short) + within
        differ ^= words[at]
        longer = np.repeat(size > short, short)
        differ[longer] ^= words[(at + np.repeat(short, short))[longer]]
    return np.add.reduceat(np.bitwise_count(differ).astype(np.int64), opens)


def _wide_enough(pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose wide sketches are no further apart than the largest symmetric
    difference of a link. ``pairs`` has an, bn, awide, bwide and sizes that a link allows."""
    def run(batches):
        for b in batches:
            total = sum(b.column(c).to_numpy(zero_copy_only=False) for c in ("an", "bn"))
            sides, keep = [], np.zeros(b.num_rows, bool)
            for c in ("awide", "bwide"):
                col = b.column(c)
                ends = col.offsets.to_numpy().astype(np.int64)
                sides.append((ends[:-1], np.diff(ends), col.values.to_numpy(zero_copy_only=False).view(np.uint64)))
            words = np.concatenate([[0], np.cumsum(np.minimum(sides[0][1], sides[1][1]))])
            for lo, hi in row_blocks(words, PIECE_WORDS):
                x, y = ((first[lo:hi], size[lo:hi], flat) for first, size, flat in sides)
                keep[lo:hi] = _folded_apart(x, y) * (rule.den + rule.num) <= total[lo:hi] * (rule.den - rule.num)
            yield b.select(["a", "b"]).filter(pa.array(keep))
    return pairs.select("a", "b", "an", "bn", "awide", "bwide").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose shingle sets are linked: a, b. ``pairs`` has an, bn, as, bs."""
    def run(batches):
        for batch in batches:
            keep = []
            columns = [batch.column(c) for c in ("as", "bs")]
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy(zero_copy_only=False) for c in columns)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(rule.linked(len(x), len(y), both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return pairs.select("a", "b", "as", "bs").mapInArrow(run, "a long, b long")


def _sides(sets: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The same rows under the names of the two sides of a pair."""
    return tuple(sets.select(F.col("id").alias(x), *[c if c == "key" else F.col(c).alias(x + c) for c in columns])
                 for x in "ab")


def _after(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, ...) with ``before``, the key of the row's id that precedes it."""
    return rows.withColumn("before", F.lag("key").over(Window.partitionBy("id").orderBy("key")))


def _met(rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) that share a key, lie in different components c and have sketches near
    enough. Rows that share a key and the one before it have met under that one already,
    so a pair comes once from each run of shared keys, not from every key."""
    x, y = _sides(rows, "key", "before", "c", "n", "sketch")
    return x.join(y, "key").where(
        (F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc")) & _near_enough(rule, "a", "b")
        & F.coalesce(F.col("abefore") != F.col("bbefore"), F.lit(True))).select("a", "b")


def _check(pairs: DataFrame, base: DataFrame, wide: tuple[DataFrame, DataFrame], rule: Rule, repeats: bool) -> DataFrame:
    """Links among distinct candidate pairs (a, b): by the wide sketches, then by shingles.
    With ``repeats``, equal rows of an id become one before they are looked up."""
    pairs = written(_wide_enough(pairs.join(wide[0], "a").join(wide[1], "b"), rule).distinct(), "candidate-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    few = pairs.count() <= BROADCAST_IDS
    sought = base.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    if repeats:
        sought = sought.withColumn("t", F.xxhash64("text")).dropDuplicates(["id", "t"]).drop("t")
    sets = _shingles(sought, rule)
    return written(_verified(pairs.join(sets.withColumnsRenamed({"id": "a", "s": "as"}), "a")
                             .join(sets.withColumnsRenamed({"id": "b", "s": "bs"}), "b"), rule), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links reach.

    ``key`` must be a long. Null, empty and blank texts have no shingles and link with
    nothing; a text of fewer words than a shingle is one shingle; rows with a null key
    keep their own null component; repeated rows of a key share its smallest component;
    empty tables give no rows; other columns don't matter.

    Equal sets are one class first, so exact copies cost one row each. Members of a
    shared key are then tested against one id that has it, and against one drawn by hash
    for each key (linear in the members), and only classes that this leaves in different
    components are tested with each other, behind the sketch distance: linked near copies
    are not expanded into pairs. Copies are one row under a key by then, in every block."""
    base = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sets = written(_sets(base, rule), "shingle-sets")
    known = sets.where("n > 0 and id is not null")
    classes = known.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    rep = written(known.join(classes, ["h1", "h2", "n"]).select("id", "rep").distinct(), "shingle-classes")
    rows, words = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("wide")), F.lit(0))).first()
    few = rows <= BROADCAST_IDS
    repeats = not known.groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    sketches = sets.join(rep.where("id = rep").select("id"), "id", "left_semi")
    if repeats:
        sketches = written(sketches.dropDuplicates(["id", "h1", "h2"]), "sketches")

    def small(df):
        return F.broadcast(df) if few else df

    def light(df):
        return F.broadcast(df) if rows <= BROADCAST_SKETCHES else df

    same = Window.partitionBy("key", "hub")
    texts = base.where("text is not null and id is not null")
    # Copies have the keys of their representative; a large table sends them all the same.
    keys = _keys(texts.join(F.broadcast(rep.where("id = rep").select("id")), "id", "left_semi") if few else texts, rule)
    shared = written(keys.withColumn("lo", F.min("id").over(same)).withColumn("hi", F.max("id").over(same))
                     .where("hub <> 0 or lo <> hi").select("key", "id", F.when(
                         F.col("hub") != 0, F.col("hub")).otherwise(F.col("lo")).alias("to"),
                         ((F.col("hub") != 0) & (F.col("id") == F.col("lo"))).alias("heads")), "shared-keys")

    def to_rep(df, column):
        return df.join(small(rep.select(F.col("id").alias(column), F.col("rep").alias("r"))), column).drop(column) \
            .withColumnRenamed("r", column)

    first = to_rep(to_rep(shared.select("id", "to").where("id <> to").distinct(), "id"), "to")
    first = written(first.where("id <> to").select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))
                    .distinct(), "hub-pairs")
    left, right = (light(side) for side in _sides(sketches, "n", "sketch"))
    wide = _sides(sketches, "n", "wide")
    if words <= BROADCAST_WORDS:
        wide = tuple(F.broadcast(side) for side in wide)
    links = _check(first.join(left, "a").join(right, "b").where(_near_enough(rule, "a", "b"))
                   .select("a", "b"), texts, wide, rule, repeats)
    found = components(links)

    # rows of a block's representative may be missing where the block alone shares the key
    every = shared.select("key", F.explode(F.when(F.col("heads"), F.array("id", "to")).otherwise(F.array("id"))).alias("id"))
    alike = Window.partitionBy("key")

    def mixed(rows, found):
        """Rows of the keys whose rows lie in different components, once each, with a row
        (hash, id, c) drawn from those of the key."""
        label = rows.join(small(found), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
        return (label.withColumn("lo", F.min("c").over(alike)).withColumn("hi", F.max("c").over(alike))
                .withColumn("drawn", F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id", "c")).over(alike))
                .where("lo <> hi").select("key", "id", "c", "drawn").dropDuplicates(["key", "id"]))

    apart = written(mixed(to_rep(every, "id"), found), "mixed-keys")
    second = written(apart.where("c <> drawn.c").select(F.least("id", "drawn.id").alias("a"), F.greatest("id", "drawn.id").alias("b"))
                     .distinct().join(first, ["a", "b"], "left_anti"), "drawn-pairs")
    links = links.union(_check(second.join(left, "a").join(right, "b").where(_near_enough(rule, "a", "b"))
                               .select("a", "b"), texts, wide, rule, repeats))
    found = components(links)

    # Sorted by id once: the keys before, and the sketches of a large table.
    rest = _after(mixed(apart.select("key", "id"), found).drop("drawn")).join(light(sketches.select("id", "n", "sketch")), "id")
    more = _met(rest, rule).distinct().join(first.union(second), ["a", "b"], "left_anti")
    copies = rep.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    final = components(links.union(_check(more, texts, wide, rule, repeats)).union(copies))
    return sets.join(final, "id", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One document of each group stays, the one with the smallest key, with all columns.
    Rows of a null key stay, and so do all equal rows of a kept key. Different texts
    under one key are documents of their own: each stays or goes by itself."""
    own = F.xxhash64(F.col(f"`{text}`"))
    several = docs.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("id")).agg(
        F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi")
    if not several.isEmpty():
        return _drop_by_text(docs, key, text, rule)
    found = near_duplicates(docs, key, text, rule)
    gone = found.where("id <> component_id").select("id").distinct()
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[key].cast("long") == gone["id"], "left_anti")


def _drop_by_text(docs: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """The same under a number for each (key, text), in the order of the keys."""
    frame = boxed(docs, id=F.col(f"`{key}`").cast("long"), text=F.col(f"`{text}`")).withColumn(
        "digest", F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    order = written(frame.where("id is not null").select("id", "digest").distinct().orderBy("id", "digest")
                    .withColumn("number", F.monotonically_increasing_id()), "numbers")
    numbered = written(frame.join(order, ["id", "digest"], "left").select("row", "text", "number"), "numbered")
    found = near_duplicates(numbered.where("number is not null"), "number", "text", rule)
    gone = found.where("id <> component_id").select(F.col("id").alias("number")).distinct()
    few = gone.count() <= BROADCAST_IDS
    return numbered.join(F.broadcast(gone) if few else gone, "number", "left_anti").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])


RULE_OP2 = Rule(k=3, num=90, den=100)


def op2_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    """Near-duplicate class of every document: doc_id, n_shingles, component_id."""
    from ._common import read
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), rule=RULE_OP2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
