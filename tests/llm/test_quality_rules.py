"""12. Quality rules against a brute-force scorer and planted junk."""
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import quality_rules as Q

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_base(text):
    text, w = text or "", words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def prose(rng, vocabulary, n):
    p = 1 / np.arange(1, len(vocabulary) + 1)
    return " ".join(rng.choice(vocabulary, n, p=p / p.sum()))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    english = [f"{a}{b}" for a in ("the", "an", "of", "re", "ti", "on") for b in ("", "er", "ing", "ble", "ha", "st", "ou")]
    french = [f"{a}{b}" for a in ("le", "é", "qu", "ré", "oi", "eau") for b in ("", "eur", "è", "ç", "aux", "ment", "ai")]
    rows = [(i, prose(rng, english if i % 3 else french, int(rng.integers(60, 400))), "en" if i % 3 else "fr", 1) for i in range(240)]
    odd = ["", None, "   \n \n", "a b a b a b", "x y z\nx y z\n\n\nq", "one", "ab " * 70, "é ü\tß\x0bñ",
           prose(rng, english, 90) + "\n" + "same line here\n" * 40, prose(rng, english, 30_000),
           "THE! THER? " + " ".join(w.upper() + "$$" for w in prose(rng, english, 120).split()),
           "| " + " | ".join(f"q{i}z" for i in range(200)), "zz 11 " * 3 + " ".join(f"{i}" for i in range(400))]
    rows += [(1000 + i, t, "en" if i % 2 else None, 2) for i, t in enumerate(odd)]
    rows += [(None, rows[0][1], "en", 3), (1, rows[1][1], "fr", 3), (1, rows[1][1], "fr", 3)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, id int")


def test_base_counts_equal_brute_force(spark, corpus):
    rows, df = corpus
    found = sorted(Q.quality(df).collect(), key=str)
    assert len(found) == len(rows)
    by_id = {r["id"]: r for r in found}
    for i, text, *_ in rows:
        if len(text or "") < 20_000:
            r, want = by_id[i], brute_base(text)
            assert tuple(r[c] for c in BASE) == want, text
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["base_failed"] and r["kept"])


def test_distances_equal_brute_force(spark, corpus):
    rows, df = corpus
    refs = Q.references(df)
    assert [r.lang for r in refs] == ["en", "fr"]

    def hist(text, ref):
        h, c = np.zeros(len(ref.words)), np.zeros(len(Q.CLASSES))
        for w in text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split():
            t = Q.tokenise(np.frombuffer(w, np.uint8), np.array([0, len(w)]), Q.NONSPACE).hash.view(np.int64)[0]
            at = np.flatnonzero(ref.hashes == t)
            h[at[0] if len(at) else len(ref.hashes) + t % Q.BINS] += 1
        for ch in text:
            c[Q.CLASS_OF[ch.encode()[0]]] += 1
        return h, c

    def distance(p, q):
        p, m = p / p.sum(), (p / p.sum() + q) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))

    got = {r["id"]: r for r in Q.quality(df.where("id = 1")).collect()}
    mine = Q.references(df.where("id = 1"))
    for i, text, *_ in rows[:12]:
        found = {}
        for ref in mine:
            h, c = hist(text, ref)
            dw, dc = distance(h, ref.words), distance(c, ref.chars)
            allow = lambda limit, q, n: math.sqrt(limit ** 2 + Q.CHANCE * (np.count_nonzero(q) - 1) / (8 * n * math.log(2)))
            ow, oc = dw / allow(Q.WORD_LIMIT, ref.words, h.sum()), dc / allow(Q.CHAR_LIMIT, ref.chars, c.sum())
            found[ref.lang] = (max(ow, oc), ow + oc, ref.lang, dc, dw)
        best = min(found.values())
        assert got[i]["nearest"] == best[2]
        assert abs(got[i]["js_chars"] - best[3]) < 1e-9 and abs(got[i]["js_words"] - best[4]) < 1e-9
        assert got[i]["kept"] == (best[0] <= 1 and not got[i]["base_failed"])


def test_clean_stays_and_junk_goes(spark, corpus):
    rows, df = corpus
    found = {r["id"]: r for r in Q.quality(df).where("id is not null").collect()}
    kept = {i: r["kept"] for i, r in found.items()}
    assert all(kept[i] for i in range(240))
    assert not any(kept[1000 + i] for i in (0, 1, 2, 3, 4, 5, 6, 10, 11, 12))
    # a very long text of 42 words repeats nearly every window
    assert found[1009]["n_words"] == 30_000 and found[1009]["base_failed"] and found[1009]["js_words"] < 0.2


def test_wrong_label_costs_nothing_and_no_reference_decides_nothing(spark, corpus):
    rows, df = corpus
    wrong = Q.quality(df.where("id = 3")).collect()
    assert len(wrong) == 3 and all(r["nearest"] is None and r["kept"] for r in wrong)
    assert Q.quality(df.limit(0)).collect() == []
    swapped = df.withColumn("lang", F.when(F.col("doc_id") == 4, "fr").otherwise(F.col("lang")))
    assert {r["id"]: r["nearest"] for r in Q.quality(swapped).collect()}[4] == "en"
