"""13. Filter audit against brute force; the tries on hostile texts."""
import itertools
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import filter_audit as A

DOCS = "doc_id long, text string, source string, mask int"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, source, *_ in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search("[#$%&*|]", text)), i is not None and i > least[text])) if x}
        parts[source or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                earlier = [r for r in rows if f in r[0] and r[0] & set(order[:step - 1])]
                left = [r for r in left if f not in r[0]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(earlier), sum(r[0] == {f} for r in rows),
                                          sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audited(spark, docs, labels):
    df = A.audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in df.collect()}


def prose(seed, n, share=1.0):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(int(n * share) + 1)}" for _ in range(n))


def test_audit_equals_brute_force(spark):
    texts = [prose(i, 80, 5) for i in range(12)] + [prose(3, 80, 5)] * 40 + [prose(9, 60, .2), "", None, "short", "ABC DEF " * 30,
             prose(5, 70, 9) + " #", prose(5, 70, 9).upper(), "x" * 300_000, "x" * 300_000 + "y", "same start " * 2000 + "1", "same start " * 2000 + "2"]
    docs = [(i, t, None if i % 7 == 0 else f"s{i % 3}", 5) for i, t in enumerate(texts)]
    docs += [(3, texts[3], "", 5), (None, texts[3], "s1", 5), (None, texts[3], None, 5), (2, texts[3], "s1", 5), (docs[20][0], "other", "s2", 5)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 40)] + [(5, None, 1), (5, 1, None), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "a", "s", 0)], []) == brute([(1, "a", "s")], [])


def test_prefixes_grow_until_few_texts_share_one(spark):
    start = "one very common opening passage " * 9
    docs = [(i, start + prose(i, 30, 40)) for i in range(400)] + [(1000 + i, start + prose(0, 30, 40)) for i in range(400)]
    df = spark.createDataFrame(docs, "id long, text string").selectExpr("id", "cast(text as binary) text", "xxhash64(text) tag")
    heavy = A.heavy_prefixes(df, least=20)
    assert [n for n, _ in heavy] == [16, 64, 256] and all(len(found) == 1 for _, found in heavy)
    dealt = A.with_prefix(df, heavy).groupBy("path").count().collect()
    assert len(dealt) > 300
    assert {r["id"] for r in A.text_owners(df, least=20).collect()} == set(range(400))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab\n", max_size=90).map(str.encode), st.integers(0, 50)), max_size=40))
def test_trie_holds_smallest_ids_in_byte_order(rows):
    trie, want = A.RadixTrie(), {}
    for text, i in rows:
        trie.insert(text, i, hash(text))
        want[text] = min(i, want.get(text, i))
    found = list(trie.terminals())
    assert [x[0] for x in found] == sorted(want)
    assert {x[0]: x[1] for x in found} == want and all(x[2] == hash(x[0]) for x in found)
