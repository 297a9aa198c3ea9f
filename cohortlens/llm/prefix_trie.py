"""11. Conversation prefix trie with count-min screening of prefix digests.

A node of the trie is a distinct sequence of first turns. Nearly all conversations
share only a short opening, so

1. turns are ranged by conversation and order; every prefix gets a 128-bit digest, the
   sum of its turns' hashes times powers of two odd numbers. Sums continue over task
   borders, so one conversation may lie in many tasks;
2. prefixes are counted in the cells of a count-min sketch. An estimate of one proves
   that a prefix belongs to one conversation alone: it and all after it are a tail,
   whose nodes are emitted where they are;
3. only the other prefixes are shuffled and grouped exactly by digest.

What a subtree adds up to follows from one number for each conversation: the depth from
which it is the smallest member of its nodes. That depth only has to be summed over a
node's members, so no node waits for its children, and no members are gathered.
"""
from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ._common import mix64, read, written

BLOCK = 20
HEADS = 4
BLANKS = r"[\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
#: Odd multipliers of the two digest sums and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: Cells of a sketch row: about this many for each prefix, and at most MOST_CELLS, so
#: the bitmaps that tasks get stay below 2 rows * MOST_CELLS / 8 = 16 MB.
CELLS_EACH = 4
MOST_CELLS = 1 << 26
LEAST_CELLS = 1 << 15
BITMAP_BITS = 8 * 4096
ENDS_BYTES = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
PREFIX = "c long, d long, d1 long, d2 long, p1 long, p2 long, w long, before long, last boolean"
SUMMARY = "pid int, summary string"


def ordered_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Turns (c, turn, role, text) as narrow rows in order, ranged over the tasks and
    checkpointed: a conversation's block (c - c % block) first, its first conversation
    before the others, then turn, role and text."""
    words = F.size(F.filter(F.split("text", BLANKS), lambda x: x != ""))
    g = F.col("c") - F.col("c") % block
    narrow = turns.select(g.alias("g"), (F.col("c") != g).alias("later"), "c", "turn", "role",
                          F.substring("text", 1, 32).alias("start"), F.xxhash64("role", "text").alias("x1"),
                          F.xxhash64(F.lit(11), "text", "role").alias("x2"), words.cast("long").alias("w"),
                          (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    order = ["g", "later", "c", F.col("turn").asc_nulls_first(), "role", "start"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order, "x1")
    return cut_lineage(ranged.select("g", "c", "x1", "x2", "w", "h"))


def _turn_rows(batches):
    for b in batches:
        yield from zip(*[col.to_pylist() for col in b.columns])


class _Sums:
    """Running state of a conversation: rank, two digest sums, words, the first turns."""

    def __init__(self, c=None, rank=0, sums=(0, 0), words=0, first=()):
        self.c, self.rank, self.sums, self.words, self.first = c, rank, list(sums), words, [tuple(x) for x in first]

    def add(self, x1, x2, w):
        self.rank += 1
        self.sums[0] = (self.sums[0] + x1 * pow(BASES[0], self.rank, 1 << 64)) & MASK
        self.sums[1] = (self.sums[1] + x2 * pow(BASES[1], self.rank, 1 << 64)) & MASK
        self.words += w
        if self.rank < HEADS:
            self.first.append((x1, x2, w))

    def state(self):
        return [self.c, self.rank, self.sums, self.words, self.first]


def _summaries(batches):
    """What later tasks must know of this one: its first conversation, the sums of its
    last, and the first turns of the last block's first conversation."""
    first, last, heads, g = None, None, [], None
    for row_g, c, x1, x2, w, _ in _turn_rows(batches):
        if last is None or c != last.c:
            if last is None:
                first = c
            last = _Sums(c)
        if row_g != g:
            g, heads = row_g, []
        last.add(x1, x2, w)
        if c == g and len(heads) < HEADS - 1:
            heads.append((x1, x2, w))
    if last is not None:
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()),
                               pa.array([json.dumps([first, g, heads, last.state()])])], ["pid", "summary"])


def carried(summaries: list[tuple[int, str]]) -> dict[int, tuple]:
    """(block, its heads, running conversation, next task's first conversation) at the
    start of every task; one short record for each task passes the driver."""
    out, g, heads, now = {}, None, [], _Sums()
    told = [(pid, json.loads(s)) for pid, s in sorted(summaries)]
    for k, (pid, (first, last_g, last_heads, (c, rank, sums, words, own))) in enumerate(told):
        after = told[k + 1][1][0] if k + 1 < len(told) else None
        out[pid] = (g, list(heads), now.state(), after)
        if c == now.c:
            lift = [pow(b, now.rank, 1 << 64) for b in BASES]
            now = _Sums(c, now.rank + rank, [(a + s * f) & MASK for a, s, f in zip(now.sums, sums, lift)],
                        now.words + words, (now.first + [tuple(x) for x in own])[:HEADS - 1])
        else:
            now = _Sums(c, rank, sums, words, own)
        heads = ((heads if last_g == g else []) + last_heads)[:HEADS - 1]
        g = last_g
    return out


def _prefixes(carry: dict[int, tuple]):
    """Rebuilt prefixes of every conversation of a task: the first h turns of the
    block's first conversation, then the own turns after the first h."""
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def digest(turns):
        s = _Sums()
        for x in turns:
            s.add(*x)
        return s

    def rows(batches):
        g, heads, state, after = carry.get(TaskContext.get().partitionId(), (None, [], _Sums().state(), None))
        heads, now = list(heads), _Sums(*state)
        turns, row = _turn_rows(batches), None
        row = next(turns, None)
        while row is not None:
            row_g, c, x1, x2, w, h = row
            row = next(turns, None)
            last = c != (row[1] if row is not None else after)
            if row_g != g:
                g, heads = row_g, []
            if c != now.c:
                now = _Sums(c)
            before = list(now.sums), now.words
            now.add(x1, x2, w)
            if c == g and len(heads) < HEADS - 1:
                heads.append((x1, x2, w))
            head = now.first[:h] if c == g else heads[:h]
            if now.rank == h + 1 or (last and now.rank <= h):
                ends = last and now.rank <= h
                if ends and not head:
                    yield c, 0, 0, 0, 0, 0, 0, 0, True
                for k in range(len(head)):
                    a, b = digest(head[:k]), digest(head[:k + 1])
                    yield (c, k + 1, signed(b.sums[0]), signed(b.sums[1]), signed(a.sums[0]), signed(a.sums[1]),
                           head[k][2], a.words, ends and k + 1 == len(head))
            if now.rank > h:
                base, own = digest(head), digest(now.first[:h])
                lower = [pow(i, h - len(head), 1 << 64) for i in INVERSES]
                d, p = ([signed((base.sums[j] + lower[j] * (s[j] - own.sums[j])) & MASK) for j in (0, 1)]
                        for s in (now.sums, before[0]))
                yield (c, len(head) + now.rank - h, d[0], d[1], p[0], p[1], w, base.words + before[1] - own.words, last)

    kinds = [pa.int64()] * 8 + [pa.bool_()]
    names = [x.split()[0] for x in PREFIX.split(", ")]

    def run(batches):
        held = []
        for r in rows(batches):
            held.append(r)
            if len(held) == 20_000:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)
                held = []
        if held:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)
    return run


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(c, d, digest d1 d2, digest p1 p2 of the prefix before, words of the last turn,
    words before it, is-last) of every rebuilt prefix; depth 0 only if there is no turn."""
    ranged = ordered_turns(turns, block)
    told = [(r["pid"], r["summary"]) for r in ranged.mapInArrow(_summaries, SUMMARY).collect()]
    return written(ranged.mapInArrow(_prefixes(carried(told)), PREFIX), "prefixes")


def _cells(d1, d2, width: int):
    """The two cells of a prefix: one in each row of the sketch."""
    d1, d2 = np.asarray(d1, np.int64).view(np.uint64), np.asarray(d2, np.int64).view(np.uint64)
    return ((mix64(d1) % np.uint64(width)).astype(np.int64),
            (mix64(d2 ^ np.uint64(BASES[0])) % np.uint64(width)).astype(np.int64) + width)


def _cell_counts(width: int):
    def run(batches):
        for b in batches:
            keep = b.column("d").to_numpy() > 0
            both = _cells(b.column("d1").to_numpy()[keep], b.column("d2").to_numpy()[keep], width)
            cell, n = np.unique(np.concatenate(both), return_counts=True)
            yield pa.record_batch([pa.array(cell), pa.array(n.astype(np.int64))], ["cell", "n"])
    return run


def lone_cells(pre: DataFrame, width: int) -> np.ndarray:
    """Bitmap (bytes) of the sketch cells that counted exactly one prefix."""
    cells = pre.select("d", "d1", "d2").mapInArrow(_cell_counts(width), "cell long, n long")
    lone = cells.groupBy("cell").agg(F.sum("n").alias("n")).where("n = 1")
    maps = lone.groupBy(F.floor(F.col("cell") / BITMAP_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("cell") % BITMAP_BITS).alias("bits"))
    out = np.zeros(2 * width // 8, np.uint8)
    for r in maps.collect():  # 2 * width bits in all
        at = r["bucket"] * BITMAP_BITS // 8
        out[at:at + BITMAP_BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _screen(shared, width: int):
    """Add ``single`` (the sketch proves the prefix to be of one conversation) and
    ``tail`` (the prefix before it is proven too)."""
    def proven(d1, d2):
        a, b = (shared.value[cell // 8] >> (cell % 8).astype(np.uint8) for cell in _cells(d1, d2, width))
        return ((a | b) & np.uint8(1)).astype(bool)

    def run(batches):
        for batch in batches:
            d = batch.column("d").to_numpy()
            single = proven(batch.column("d1").to_numpy(), batch.column("d2").to_numpy()) & (d > 0)
            tail = proven(batch.column("p1").to_numpy(), batch.column("p2").to_numpy()) & (d > 1)
            yield pa.record_batch([*batch.columns, pa.array(single | tail), pa.array(tail)],
                                  [*batch.schema.names, "single", "tail"])
    return run


def _chunks(batches):
    """Runs of member ids of one node as comma-joined text of some 64 KB."""
    now, held, size, out = None, [], 0, []

    def close():
        if held:
            out.append((*now, held[0], ",".join(map(str, held))))

    for b in batches:
        for d1, d2, c in zip(*[x.to_pylist() for x in b.columns]):
            if (d1, d2) != now or size > ENDS_BYTES:
                close()
                now, held, size = (d1, d2), [], 0
            held.append(c)
            size += len(str(c)) + 1
        if out:
            yield _chunk_batch(out)
            out = []
    close()
    if out:
        yield _chunk_batch(out)


def _chunk_batch(rows):
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                           ["d1", "d2", "at", "ids"])


def _hashes(batches):
    """SHA-256 over the chunks of each node, in order; only the running hash is held."""
    now, running, out = None, None, []
    for b in batches:
        for d1, d2, _, ids in zip(*[x.to_pylist() for x in b.columns]):
            if (d1, d2) != now:
                if now is not None:
                    out.append((*now, running.hexdigest()))
                now, running = (d1, d2), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
    if now is not None:
        out.append((*now, running.hexdigest()))
    if out:
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))],
                              ["d1", "d2", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) from (d1, d2, c). A node's ids are ranged over many tasks
    and packed there; the hash, which must read them in order, takes the packed runs."""
    dealt = ends.repartitionByRange("d1", "d2", "c").sortWithinPartitions("d1", "d2", "c")
    packed = dealt.mapInArrow(_chunks, "d1 long, d2 long, at long, ids string")
    return (packed.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "at")
            .mapInArrow(_hashes, "d1 long, d2 long, ends_sha256 string"))


def build(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each trie node: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``.

    A null role or text is an empty one; turns of one number (null first) go by role,
    then text; repeated rows are turns of their own; an empty text is a turn. Rows with a
    null conversation belong to none. Empty tables give no rows; other columns don't
    matter; texts of any length become hashes where they are read. One conversation may
    hold any share of the turns, and one prefix any share of the conversations."""
    spark = turns.sparkSession
    base = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    pre = prefixes(base, block)
    width = LEAST_CELLS
    while width < min(CELLS_EACH * pre.count(), MOST_CELLS):
        width *= 2
    shared = spark.sparkContext.broadcast(lone_cells(pre, width))
    screened = pre.mapInArrow(_screen(shared, width), PREFIX + ", single boolean, tail boolean")
    tails = screened.where("tail").select("c", "d", "last")
    rest = written(screened.where("not tail"), "shared-prefixes")
    heads, common = rest.where("single and d > 0"), rest.where("not single and d > 0")

    nodes = written(common.groupBy("d1", "d2").agg(
        F.min("c").alias("c"), F.min_by("before", "c").alias("before"), F.count(F.lit(1)).alias("n_convs"), F.min("d").alias("d"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("last").alias("leaf")), "nodes")
    # The depth from which a conversation is the smallest member of its nodes, the words
    # before it, and whether its last node is a leaf; past the end if it is never that.
    found = (nodes.select("c", "d", "before", "leaf")
             .unionByName(heads.select("c", "d", "before", F.lit(True).alias("leaf")))
             .unionByName(rest.where("last and not single").select(
                 "c", F.greatest(F.col("d") + 1, F.lit(2)).cast("long").alias("d"), (F.col("before") + F.col("w")).alias("before"), F.lit(False).alias("leaf"))))
    own = written(found.groupBy("c").agg(F.min("d").alias("own"), F.min_by("before", "d").alias("owned"),
                                       F.max("leaf").alias("leaf")), "owners")

    deeper = F.col("own") > F.col("d")
    sums = common.join(own, "c").groupBy("d1", "d2").agg(
        F.sum(F.when(deeper, F.col("owned") - F.col("before")).otherwise(0)).alias("saved_tokens"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum((~F.col("last") & (F.col("own") <= F.col("d") + 1)).cast("long")).alias("n_children"))
    ends = end_hashes(common.where("last").select("d1", "d2", "c"))

    # Nodes and first tail nodes look up their parent: absent, it is a tail of the same conversation.
    least = own.agg(F.min("c")).first()[0]
    if least is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                         "n_leaves long, saved_tokens long, ends_sha256 string")
    alone = F.sha2(F.col("c").cast("string").cast("binary"), 256)
    grouped = nodes.join(sums, ["d1", "d2"]).join(ends, ["d1", "d2"], "left").select(
        "c", "d", "p1", "p2", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tail_columns = [one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"),
                    none.alias("saved_tokens"), F.when(F.col("last"), alone).otherwise(F.lit(NO_ENDS)).alias("ends_sha256")]
    asking = written(grouped.unionByName(heads.select("c", "d", "p1", "p2", *tail_columns)), "asking")
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("c").alias("parent"))
    first = asking.where("d = 1").select("*", F.lit(least).cast("long").alias("parent"))
    known = asking.where("d > 1").join(parents, ["p1", "p2"], "left").unionByName(first)
    below = known.select("c", "d", F.coalesce("parent", "c").alias("parent"), "n_convs", "n_children", "n_leaves",
                         "saved_tokens", "ends_sha256").unionByName(
        tails.select("c", "d", F.col("c").alias("parent"), *tail_columns))

    childless = F.sum((F.col("own") == 1).cast("long"))
    top = own.agg(F.min("c").alias("c"), none.alias("d"), F.lit(None).cast("long").alias("parent"),
                  F.count(F.lit(1)).alias("n_convs"), childless.alias("n_children"),
                  F.greatest(F.sum(F.col("leaf").cast("long")), one).alias("n_leaves"), F.sum("owned").alias("saved_tokens"))
    turnless = end_hashes(rest.where("d = 0").select(F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), "c"))
    at_root = turnless.first()  # one hash
    top = top.withColumn("ends_sha256", F.lit(at_root["ends_sha256"] if at_root else NO_ENDS))
    return below.unionByName(top).select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    """The prefix trie of all rebuilt conversations, one row for each node."""
    return build(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list({'role': role, 'text': text} ORDER BY r) AS own FROM turns GROUP BY c),
sums AS (
  SELECT c, own, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda s, x:
           list_reduce(list_prepend(xor(s, x), range(8)), lambda a, i:
             CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) % 4 AS h
  FROM lists),
built AS (
  SELECT s.c, list_concat(coalesce(b.own, [])[1:s.h], s.own[s.h + 1:]) AS t
  FROM sums s LEFT JOIN lists b ON b.c = s.c - s.c % 20),
members AS (
  SELECT c, unnest(range(0, len(t) + 1)) AS d, t FROM built),
keyed AS (SELECT c, d, t[1:d] AS k, t[1:d - 1] AS pk, len(t) = d AS ends,
                 len(list_filter(string_split_regex(coalesce(t[d].text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w
          FROM members),
nodes AS (
  SELECT d, k, min(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(w) AS saves,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM keyed GROUP BY d, k),
children AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(x.n_children, 0) AS n_children FROM nodes n LEFT JOIN children x ON x.d = n.d AND x.k = n.k),
up AS (SELECT unnest(range(0, d + 1)) AS d, k, n_children, saves FROM full_nodes),
subtree AS (SELECT d, k[1:d] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saves) AS saved_tokens
            FROM up GROUP BY d, k[1:d])
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtree s ON s.d = n.d AND s.k = n.k
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.pk
"""
