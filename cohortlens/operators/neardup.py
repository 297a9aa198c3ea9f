"""Near-duplicate sentences of a patient (t_near_dup, t_near_dup_lsh).

The rule is greedy: a sentence stays if none of the patient's earlier kept sentences is
similar (1 - edit distance / longer length >= threshold). A patient's sentences are brought
together in chunks, two at a time, so a patient of any size is spread over many tasks; a task
finds the candidates of its chunks and decides them, and only similar pairs leave it. The
greedy order is then resolved in rounds over the pair table.

Candidates: k edits touch at most k of the longer string's m disjoint q-grams, so m - k of
them survive in the shorter string, each moved by at most k places.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grams import counted_up, mix64, row_blocks, text_points
from ..session import cut_lineage, stored
from .relational import marked

THRESHOLD = 0.8
BLOCK = 1 << 18
SIZES = (4, 3, 2, 1)
#: Characters of a patient that make a chunk. Every two chunks of a patient meet in a task.
CHUNK = 1 << 20
#: Bits of a gram's key that hold a length (a longer one counts as the largest).
LENGTH_BITS = 20
MATCHES = 1 << 20


def budget(length: Column, threshold: float) -> Column:
    """Edits that a pair whose longer string has this length may differ by."""
    return F.floor(length * (1 - threshold) + 1e-9).cast("int")


def _gram_sizes(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edit budgets, and the largest q with more disjoint q-grams than edits (0: only equal strings)."""
    k = np.floor(n * (1 - threshold) + 1e-9).astype(np.int64)
    size = np.zeros(len(n), np.int64)
    for q in reversed(SIZES):
        size = np.where(n // q > k, q, size)
    return k, np.where(k > 0, size, 0)


def _nodes(sentences: DataFrame) -> DataFrame:
    return sentences.select("pat_deid", F.xxhash64("sentence").alias("sid"), "first_at", "sentence",
                            F.length("sentence").alias("n"))


def _dealt(nodes: DataFrame, chunk: int) -> DataFrame:
    """The nodes with the group ``g`` of their patient, their ``part`` and whether the group
    has this part ``alone``. A patient of more than ``chunk`` characters has several parts, dealt
    by the hash of the sentence, and a group for every two of them and for each alone; there are
    at most the characters of all / chunk such patients."""
    large = nodes.groupBy("pat_deid").agg(F.sum("n").alias("_all")).where(F.col("_all") > chunk).select(
        "pat_deid", F.ceil(F.col("_all") / chunk).cast("long").alias("_parts"))
    rows = nodes.join(F.broadcast(large), "pat_deid", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long")))
    rows = rows.withColumn("part", F.pmod("sid", "_parts")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return (rows.withColumn("g", F.least("part", "_with") * F.col("_parts") + F.greatest("part", "_with"))
            .withColumn("alone", F.col("part") == F.col("_with")).drop("_parts", "_with"))


def _grams(text: np.ndarray, first: np.ndarray, group: np.ndarray, count: np.ndarray, step: int, q: int):
    """(row, place, key) of ``count`` q-grams of each row, ``step`` apart. The upper bits of a
    key are a hash of group and gram, the LENGTH_BITS lower ones are empty."""
    own, at = counted_up(count)
    at *= step
    code = np.zeros(len(own), np.uint64)
    for i in range(q):
        code = code * np.uint64(0x9E3779B97F4A7C15) + text[first[own] + at + i] + np.uint64(1)
    key = mix64(code ^ mix64(group.astype(np.uint64) + np.uint64(q))[own])
    return own.astype(np.int32), at.astype(np.int32), key >> np.uint64(LENGTH_BITS) << np.uint64(LENGTH_BITS)


def _near_rows(text: np.ndarray, first: np.ndarray, n: np.ndarray, group: np.ndarray, threshold: float):
    """(row, other row), each pair once: the pairs of a group of which the shorter row has
    enough of the longer one's disjoint grams near their places."""
    k, size = _gram_sizes(n, threshold)
    up_to = np.floor(n / threshold + 1e-9).astype(np.int64)
    sizes = _gram_sizes(np.arange(up_to.max(initial=0) + 1), threshold)[1]
    most = (1 << LENGTH_BITS) - 1
    new = np.flatnonzero(np.diff(group, prepend=-1))
    members, group_first = (np.repeat(x, np.diff(np.append(new, len(n)))) for x in (np.diff(np.append(new, len(n))), new))
    low, high = (np.minimum(x, most).astype(np.uint64) for x in (np.ceil(n * threshold - 1e-9), n))
    for q in SIZES:
        of_size = np.concatenate([[0], np.cumsum(sizes == q)])
        longer, place, key = _grams(text, first, group, np.where(size == q, n // q, 0), q, q)
        if not len(longer):
            continue
        shorter, to, held = _grams(text, first, group, np.where(of_size[up_to + 1] > of_size[n], np.maximum(n - q + 1, 0), 0), 1, q)
        held |= high[shorter]
        order = np.argsort(held, kind="stable")  # a row's equal grams stay beside one another
        held, shorter, to = held[order], shorter[order], to[order]
        begin, count = np.empty((2, len(key)), np.int64)
        order = np.argsort(key)  # searched in order, neighbours are in the cache
        begin[order] = np.searchsorted(held, (key | low[longer])[order])
        count[order] = np.searchsorted(held, (key | high[longer])[order], side="right")
        count -= begin
        ends = np.concatenate([[0], np.cumsum(count)])
        rows = np.append(np.flatnonzero(np.diff(longer, prepend=-1)), len(longer))
        with_matches = longer[rows[:-1]]
        cells = np.concatenate([[0], np.cumsum(members[with_matches])])  # one for each row of the group
        for lo, hi in row_blocks(ends[rows] + cells, MATCHES):
            mine, cell = with_matches[lo:hi], cells[lo:hi] - cells[lo]
            shared = np.zeros(cells[hi] - cells[lo], np.int64)
            base = np.repeat(cell - group_first[mine], np.diff(rows[lo:hi + 1]))
            for i, j in row_blocks(ends[rows[lo]:rows[hi] + 1], MATCHES):
                own, nth = counted_up(count[rows[lo] + i:rows[lo] + j])
                piece = own + (rows[lo] + i)
                at = begin[piece] + nth
                x, y = longer[piece], shorter[at]
                ok = np.flatnonzero((np.abs(to[at] - place[piece]) <= k[x]) & ((n[y] < n[x]) | (y < x)))
                own, y = own[ok], y[ok]
                once = np.ones(len(ok), bool)
                once[1:] = (own[1:] != own[:-1]) | (y[1:] != y[:-1])
                shared += np.bincount(base[i + own[once]] + y[once], minlength=len(shared))
            need = np.repeat(n[mine] // q - k[mine], members[mine])
            found = np.flatnonzero(shared >= need)
            x = np.repeat(mine, members[mine])[found]
            y = found - np.repeat(cell - group_first[mine], members[mine])[found]
            ok = n[y] >= n[x] * threshold - 1e-9
            yield x[ok], y[ok]


def candidates(nodes: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """(pat_deid, first, later, x, y): every pair that may be similar, once and in order,
    with its texts."""
    def near(rows):
        points, bounds = text_points(rows.column("sentence"))
        group = np.cumsum(starts(rows))
        part, alone = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("part", "alone"))
        n = np.diff(bounds)
        for a, b in _near_rows(points.astype(np.uint64), bounds[:-1], n, group, threshold):
            ok = alone[a] | (part[a] != part[b])
            first, later = np.minimum(a, b)[ok], np.maximum(a, b)[ok]
            for lo, hi in row_blocks(np.concatenate([[0], np.cumsum(n[first] + n[later])]), BLOCK):
                i, j = pa.array(first[lo:hi]), pa.array(later[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("pat_deid").take(i), rows.column("sid").take(i), rows.column("sid").take(j),
                     rows.column("sentence").take(i), rows.column("sentence").take(j)], ["pat_deid", "first", "later", "x", "y"])

    def starts(rows):
        new = np.zeros(len(rows), bool)
        for c in ("pat_deid", "g"):
            col = rows.column(c)
            new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        return new

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += pc.sum(pc.binary_length(b.column("sentence"))).as_py() or 0
            if size < BLOCK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(starts(rows)).max(initial=0))
            if last:
                yield from near(rows.slice(0, last))
            held = [rows.slice(last)]
            size = pc.sum(pc.binary_length(held[0].column("sentence"))).as_py()
        if any(len(b) for b in held):
            yield from near(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    nodes = nodes.where("pat_deid is not null and n > 0")
    rows = _dealt(nodes, chunk).repartition("pat_deid", "g").sortWithinPartitions("pat_deid", "g", "first_at", F.desc("sid"))
    rows = rows.select("pat_deid", "g", "part", "alone", "sid", "sentence")
    patient = rows.schema["pat_deid"].dataType.simpleString()
    return rows.mapInArrow(run, f"pat_deid {patient}, first long, later long, x string, y string")


def candidate_pairs(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(pat_deid, a, b): every pair that may be similar, once."""
    return candidates(nodes, threshold).select("pat_deid", F.least("first", "later").alias("a"), F.greatest("first", "later").alias("b"))


def near_pairs(nodes: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """(pat_deid, first, later): every similar pair, decided in the task that found it."""
    allowed = budget(F.greatest(F.length("x"), F.length("y")), threshold)
    return candidates(nodes, threshold, chunk).where(
        F.call_function("levenshtein", F.col("x"), F.col("y"), allowed) >= 0).select("pat_deid", "first", "later")


def minhash_bands(s: Column, n_hash: int = 8, rows: int = 2) -> Column:
    """Band keys of a sentence: min over its 3-character shingles of md5(k|shingle) for
    k < n_hash, ``rows`` hashes a band; a shorter sentence is one shingle."""
    shingles = F.when(F.length(s) < 3, F.array(s)).otherwise(
        F.regexp_extract_all(s, F.lit("(?s)(?=(.{3}))"), F.lit(1)))

    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda g: F.md5(F.concat(F.lit(f"{k}|"), g))))
    low = [least(k) for k in range(n_hash)]
    return F.array(*[F.md5(F.concat_ws("|", F.lit(f"b{b}"), *low[b * rows:(b + 1) * rows]))
                     for b in range(n_hash // rows)])


def _shingles(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the 3-character shingles of the rows, first one of each row); a shorter
    text is one shingle. A code holds three characters of 21 bits, an absent one as 0."""
    n = np.diff(bounds)
    room = np.maximum(n, 3)
    first = np.cumsum(room) - room
    held = np.zeros(room.sum(), np.int64)
    own, at = counted_up(n)
    held[first[own] + at] = text.astype(np.int64) + 1
    own, at = counted_up(room - 2)
    place = first[own] + at
    return held[place] | held[place + 1] << 21 | held[place + 2] << 42, np.cumsum(room - 2) - (room - 2)


def _bands(nodes: DataFrame, n_hash: int, rows: int) -> DataFrame:
    """(pat_deid, sid, band): ``minhash_bands`` as binary, each hash of a shingle computed
    once in a block of sentences."""
    def run(batches):
        for b in batches:
            points, bounds = text_points(b.column("sentence"))
            for lo, hi in row_blocks(bounds, BLOCK):
                codes, first = _shingles(points[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
                kinds, which = np.unique(codes, return_inverse=True)
                texts = ["".join(chr((c >> i & 0x1FFFFF) - 1) for i in (0, 21, 42) if c >> i & 0x1FFFFF) for c in kinds.tolist()]
                low = []
                for k in range(n_hash):
                    digests = [hashlib.md5(f"{k}|{x}".encode()).hexdigest() for x in texts]
                    order = sorted(range(len(digests)), key=digests.__getitem__)
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    low.append([digests[order[r]] for r in np.minimum.reduceat(rank[which], first).tolist()])
                own = pa.array(np.arange(lo, hi))
                for j in range(n_hash // rows):
                    band = [hashlib.md5("|".join([f"b{j}", *x]).encode()).digest() for x in zip(*low[j * rows:(j + 1) * rows])]
                    yield pa.RecordBatch.from_arrays([b.column("pat_deid").take(own), b.column("sid").take(own),
                                                      pa.array(band, pa.binary())], ["pat_deid", "sid", "band"])
    patient = nodes.schema["pat_deid"].dataType.simpleString()
    return nodes.select("pat_deid", "sid", "sentence").where("sentence is not null").mapInArrow(
        run, f"pat_deid {patient}, sid long, band binary")


def band_pairs(nodes: DataFrame, n_hash: int = 8, rows: int = 2) -> DataFrame:
    """(pat_deid, a, b) of sentences of one patient that share a MinHash band."""
    keys = _bands(nodes, n_hash, rows)
    a, b = keys.withColumnRenamed("sid", "a"), keys.withColumnRenamed("sid", "b")
    return a.join(b, ["pat_deid", "band"]).where("a < b").select("pat_deid", "a", "b").distinct()


def similar_pairs(nodes: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(pat_deid, first, later): the candidate pairs within the edit budget, in order."""
    def side(name):
        return nodes.select("pat_deid", F.col("sid").alias(name), F.struct("first_at", "sentence", "n").alias("_" + name))
    both = pairs.join(side("a"), ["pat_deid", "a"]).join(side("b"), ["pat_deid", "b"])
    longer, shorter = F.greatest("_a.n", "_b.n"), F.least("_a.n", "_b.n")
    near = F.call_function("levenshtein", F.col("_a.sentence"), F.col("_b.sentence"), budget(longer, threshold)) >= 0
    before = F.col("_a.first_at") < F.col("_b.first_at")
    return both.where((shorter >= longer * threshold - 1e-9) & near).select(
        "pat_deid", F.when(before, F.col("a")).otherwise(F.col("b")).alias("first"),
        F.when(before, F.col("b")).otherwise(F.col("a")).alias("later"))


def greedy_dropped(edges: DataFrame) -> DataFrame:
    """(pat_deid, sid) of the sentences that the greedy rule drops.

    In each round the sentences without an undecided earlier neighbour are kept and their
    later neighbours dropped. Rounds go on until no pair is undecided; their number is at
    most the longest chain of neighbours, and each is checkpointed."""
    edges = cut_lineage(edges)
    parts = []
    while not edges.isEmpty():
        later = edges.select("pat_deid", F.col("later").alias("first")).distinct()
        heads = edges.select("pat_deid", "first").distinct().join(later, ["pat_deid", "first"], "left_anti")
        gone = cut_lineage(edges.join(heads, ["pat_deid", "first"], "left_semi").select("pat_deid", F.col("later").alias("sid")).distinct())
        parts.append(gone)
        edges = edges.join(heads, ["pat_deid", "first"], "left_anti")
        for end in ("first", "later"):
            edges = edges.join(gone.withColumnRenamed("sid", end), ["pat_deid", end], "left_anti")
        edges = cut_lineage(edges.select("pat_deid", "first", "later"))
    out = edges.select("pat_deid", F.col("later").alias("sid")).limit(0)
    for p in parts:
        out = out.unionByName(p)
    return out


def near_dup(sentences: DataFrame, threshold: float = THRESHOLD, lsh: bool = False) -> DataFrame:
    """The sentences (pat_deid, first_at, sentence), distinct in each patient, that stay.
    ``lsh`` compares only pairs that share a MinHash band instead of all that may be similar."""
    sentences = stored(sentences.select("pat_deid", "first_at", "sentence"), "sentences")
    nodes = _nodes(sentences)
    gone = greedy_dropped(similar_pairs(nodes, band_pairs(nodes), threshold) if lsh else near_pairs(nodes, threshold))
    return marked(nodes, gone, ["pat_deid", "sid"], ["pat_deid"], "gone").where("not gone").select("pat_deid", "first_at", "sentence")
