"""11. Conversation prefix trie against a brute-force trie."""
import hashlib
import json
import zlib
from collections import defaultdict

import pytest

from cohortlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, d1 int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    out = set()
    for k, own_members in members.items():
        below = [x for x in members if x[:len(k)] == k]
        ends = ",".join(str(c) for c in own_members if len(built[c]) == len(k))
        out.add((own_members[0], len(k), members[k[:-1]][0] if k else None, len(own_members), kids[k],
                 sum(kids[x] == 0 for x in below), sum((len(members[x]) - 1) * len((x[-1][1] if x else "").encode().split()) for x in below),
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows, **more):
    df = prefix_trie.build(spark.createDataFrame(rows, SCHEMA), **more)
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                       "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got))
    return set(got)


def cases():
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"hello {c % 3} {t % 2}", 7) for c in range(45) for t in range(c % 6)]
    rows += [(100 + c, t, "user", "the same opening line", 7) for c in range(60) for t in range(3)]
    rows += [(-7, 0, None, None, 7), (-7, None, "user", "null turn first", 7), (-7, 5, "user", "", 7), (-20, 0, "a", "b c", 7)]
    rows += [(301, 1, "user", "x y", 7)] * 3 + [(None, 0, "user", "no conversation", 7)]
    rows += [(400, 0, "user", "long " * 50_000, 7), (401, 0, "user", "long " * 50_000 + "!", 7)]
    return rows


def test_trie_equals_brute_force_with_odd_rows(spark):
    rows = cases()
    assert trie(spark, rows) == brute(rows)


def test_collisions_in_the_sketch_only_cost_shuffle(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", prefix_trie.BITMAP_BITS)
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", 1)
    monkeypatch.setattr(prefix_trie, "_cells", lambda d1, d2, width: (
        prefix_trie.np.asarray(d1) % 7, prefix_trie.np.asarray(d2) % 5 + width))
    rows = cases()[:200]
    assert trie(spark, rows) == brute(rows)


def test_one_conversation_over_many_tasks(spark):
    rows = [(20, t, "user", f"turn {t % 11}", 7) for t in range(900)] + [(21, t, "user", f"turn {t % 11}", 7) for t in range(700)]
    rows += [(c, t, "user", f"{c} {t}", 7) for c in range(22, 60) for t in range(4)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("conv_id", "c").select("c", "turn", "role", "text")
        ranged = prefix_trie.ordered_turns(df)
        told = [tuple(r) for r in ranged.mapInArrow(prefix_trie._summaries, prefix_trie.SUMMARY).collect()]
        assert sum(json.loads(s)[3][0] in (20, 21) for _, s in told) >= 3
        assert trie(spark, rows) == brute(rows)
    finally:
        spark.conf.set(key, before)


def test_turnless_conversations_and_empty_table(spark):
    lone = [c for c in range(2000, 2400) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 1][:3]
    rows = [(c, 0, "user", "only turn", 7) for c in lone]
    want = brute(rows)
    assert len(want) == 1 and trie(spark, rows) == want
    assert trie(spark, []) == set()


@pytest.mark.parametrize("ids", [[1], [5, 7, 123456789012]])
def test_end_hashes_join_ids_in_order(spark, ids, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_BYTES", 4)
    df = spark.createDataFrame([(1, 2, c) for c in reversed(ids)], "d1 long, d2 long, c long")
    assert prefix_trie.end_hashes(df).first()["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
