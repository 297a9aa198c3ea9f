"""Training-data operators against brute force and hand-made edge cases."""
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import (decontaminate, embeddings, language, license, line_dedup, lm_score, mixing, ngram_join,
                            page_text, sharding)

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def prose(seed, n, size=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(i)}" for i in rng.integers(0, size, n))


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# 1 license scan

def test_license_scan_counts_all_places(spark):
    texts = ["x CC BY y cc-by", "All rights reserved. all RIGHTS reserved", None, "", "cc", "cc cc by",
             "GNU General Public License", "general public the license", "été cc by"]
    df = docs_of(spark, texts).select("doc_id", "text")
    found = {}
    t, s = license.scan(df)
    rows = t.join(s.where("is_base").drop("n_words"), "key", "left").select("row.doc_id", "n_words", "start", "label").collect()
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["start"], r["label"]))
    for i, text in enumerate(texts):
        w = alnum(text)
        want = sorted((j, label) for phrase, label in license.BASE.items() for j in range(len(w))
                      if w[j:j + len(phrase.split())] == phrase.split())
        assert sorted(x for x in found[i] if x[0] is not None) == want
        assert {r["n_words"] for r in rows if r["doc_id"] == i} == {len(w)}


def test_license_span_survives_an_inserted_word(spark):
    words = license.TEMPLATES[6][1].split()
    edited = " ".join(words[:8] + ["really"] + words[8:])
    _, s = license.scan(docs_of(spark, ["intro " + edited, "redistribution and use"]).select("doc_id", "text"))
    rows = [r for r in s.collect() if r["label"] == "bsd"]
    assert [(r["key"]["id"], r["start"]) for r in rows] == [("0", 1)] and 0.6 <= rows[0]["cover"] < 1


def test_license_clashing_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "cc by", "a", 5), (1, "cc by", "a", 5), (None, "cc by", "b", 6)],
                               "doc_id long, text string, label string, p int")
    t, s = license.scan(df)
    assert t.count() == 3 and s.where("is_base").count() == 2
    t, s = license.scan(df.limit(0))
    assert t.count() == 0 and s.count() == 0


# 2 n-gram Jaccard join

def brute_components(texts, k, num, den):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("rule", [ngram_join.Rule(), ngram_join.RULE_OP2])
def test_ngram_join_equals_brute_force(spark, rule):
    rng = np.random.default_rng(rule.k)
    texts = [None, "", " \t ", "one", "ONE", "one two", "a b c", "A B C"]
    for g in range(6):  # chains of edits: neighbours link, ends may not
        words = prose(g, int(rng.integers(8, 300))).split()
        for _ in range(12):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = f"e{int(rng.integers(1000))}"
    texts += [prose(99, 60) + f" tail{i}" for i in range(20)] + [prose(99, 60)] * 10
    found = ngram_join.near_duplicates(docs_of(spark, texts), rule=rule).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(
        texts, rule.k, rule.num, rule.den)


def test_sketch_keys_lose_no_linked_pair():
    rng = np.random.default_rng(1)
    for rule in (ngram_join.Rule(), ngram_join.RULE_OP2):
        for _ in range(300):
            n = int(rng.integers(1, 200))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            cut = int(rng.integers(0, rule.most_apart(2 * n) + 1))
            b = np.unique(np.concatenate([a[cut // 2:], rng.integers(0, 2**63, cut - cut // 2, dtype=np.uint64)]))
            if len(b) and rule.linked(len(a), len(b), len(np.intersect1d(a, b))):
                assert set(ngram_join.sketch_keys(a, rule)) & set(ngram_join.sketch_keys(b, rule))


def test_join_keys_are_few_rare_and_lose_no_linked_pair():
    """A fifth of the shingles and one; none that every set has, where others are enough;
    and whatever the levels are, linked sets share a key."""
    rng, rule = np.random.default_rng(5), ngram_join.Rule()
    passage = rng.integers(0, 2**63, 600, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)])) for _ in range(9)]
    levels = np.zeros(ngram_join.CELLS, np.uint8)
    np.add.at(levels, np.concatenate([ngram_join.cells(s) for s in sets]), 1)
    keys = [ngram_join.sketch_keys(s, rule, levels) for s in sets]
    assert all(len(k) == 201 for k in keys)
    assert len(np.unique(np.concatenate(keys))) == 9 * 201
    for n in range(1, 120):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        levels = rng.integers(0, 256, ngram_join.CELLS).astype(np.uint8)
        for b in (a[: -(-4 * len(a) // 5)], np.concatenate([a, rng.integers(0, 2**63, len(a) // 4, dtype=np.uint64)])):
            assert rule.linked(len(a), len(b), len(np.intersect1d(a, b)))
            assert set(ngram_join.sketch_keys(a, rule, levels)) & set(ngram_join.sketch_keys(np.unique(b), rule, levels))


def test_levels_count_the_rows_of_a_cell(spark):
    text = prose(3, 200, 5000)
    df = docs_of(spark, [text] * 15 + [prose(4, 200, 5000), None, ""]).selectExpr("doc_id id", "text")
    levels = ngram_join._levels(df.repartition(3), ngram_join.Rule())
    common, rare = (next(ngram_join.shingle_sets(pa.array([t]), 5)) for t in (text, prose(4, 200, 5000)))
    assert set(levels[ngram_join.cells(common)]) == {32} and set(levels[ngram_join.cells(rare)]) == {8}
    assert not ngram_join._levels(df.limit(0), ngram_join.Rule()).any()


def test_decontamination_sends_a_text_once(spark):
    """The text reaches the task in its row, in whatever case its column is named, not beside it as well."""
    docs = spark.createDataFrame([(1, prose(1, 40)), (2, None)], "doc_id long, Text string")
    bench = spark.createDataFrame([(7, prose(1, 40))], "item_id long, text string")
    found = decontaminate.find_matches(docs, bench)
    assert found.columns == ["row", "n_words", "n_hit", "matches"]
    read = re.search(r"MapInArrow.*\n.*?Project \[(.*)\]", found._jdf.queryExecution().optimizedPlan().toString())
    assert read and len(re.findall(r"(?i)text#", read[1])) == 1
    assert {r["row"]["doc_id"]: r["n_hit"] for r in found.collect()} == {1: 40, 2: 0}


def test_ngram_join_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, prose(1, 50), 1), (3, prose(1, 50), 1), (3, prose(1, 50), 1), (4, prose(1, 50), 2)],
                               "doc_id long, text string, key int")
    rows = [(r["id"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()]
    assert sorted(rows, key=str) == sorted([(None, None), (3, 3), (3, 3), (4, 3)], key=str)
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in ngram_join.drop_near_duplicates(df).collect()) == [0, 3, 3]


def test_texts_of_one_key_are_dropped_one_by_one(spark):
    rows = [(1, prose(1, 50), "a"), (2, prose(1, 50), "b"), (2, prose(2, 50), "c"), (3, prose(2, 50), "d"), (None, prose(1, 50), "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    out = ngram_join.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r["row"] for r in out.collect()) == ["a", "c", "e"]


# 3 embeddings

def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 32))
    v = np.vstack([centre[i % 6] + 0.12 * rng.standard_normal(32) for i in range(1200)] + [rng.standard_normal((100, 32))])
    v = np.vstack([v, v[:5], 3 * v[:1]])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31]
    rows += [(5000 + i, b) for i, b in enumerate(bad)]
    found = {r["id"]: r for r in embeddings.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T) >= 0.9
    np.fill_diagonal(link, False)
    true, got = link.sum(1), np.array([found[i]["n_links"] for i in range(len(v))])
    assert (got <= true).all() and got.sum() >= 0.95 * true.sum()
    assert all(found[5000 + i]["n_links"] == 0 and found[5000 + i]["component_id"] == 5000 + i for i in range(len(bad)))
    assert found[1300]["component_id"] == found[0]["component_id"]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(empty).count() == 0


def test_embedding_estimate_is_unbiased_and_bounded():
    u = embeddings.unit(np.random.default_rng(5).standard_normal((400, 64)))
    i, j = np.triu_indices(400, 1)
    codes = embeddings.Codes(u)
    assert (codes.upper(i, j) >= (u[i] * u[j]).sum(1)).mean() > 0.9999
    dots = (codes.signs[i] * codes.rotated[j]).reshape(len(i), codes.count, 64).sum(2) / codes.factor[i]
    assert abs((dots.mean(1) - (u[i] * u[j]).sum(1)).mean()) < 0.002


# 4 LM scores

def test_lm_score_prefers_the_target(spark):
    good, other = [prose(i, 200, 50) for i in range(20)], [prose(100 + i, 200, 5000) for i in range(20)]
    df = docs_of(spark, good + other + [None, "", "...", good[0]])
    target = df.where("doc_id < 20")
    models = lm_score.fit(df, target, lm_score.vocabulary(df))
    rows = {r["row"]["doc_id"]: r for r in lm_score.score(df, models).collect()}
    assert max(rows[i]["score"] for i in range(20)) < min(rows[i]["score"] for i in range(20, 40))
    assert all(rows[i]["n_tokens"] == 0 and rows[i]["score"] is None for i in (40, 41, 42))
    assert rows[43]["score"] == rows[0]["score"] and rows[0]["n_tokens"] == 200
    base = len(models.vocab) + 2  # the probabilities after a word sum to one
    for before in (0, 3, base - 1):
        p = np.exp(-models.losses(np.full(base - 1, before), np.arange(base - 1)))
        assert np.allclose(p.sum(1), 1, atol=1e-6)
    empty = df.limit(0)
    assert lm_score.score(empty, lm_score.fit(empty, empty, lm_score.vocabulary(empty))).count() == 0


def test_lm_score_keeps_rare_words_and_bigrams(spark):
    """Losses equal those of models that keep everything, in texts where no share would."""
    common = " ".join(["a b"] * 150_000)
    texts = [common, "rare words only here", "rare words elsewhere a b", "rare words only here"]
    df = docs_of(spark, texts)
    good = {1, 2}
    models = lm_score.fit(df, df.where("doc_id in (1, 2)"), lm_score.vocabulary(df))
    words = sorted({w for t in texts for w in alnum(t)})

    def losses(chosen, text):
        one, two, after = {}, {}, {}
        for t in chosen:
            for b, w in zip([None] + alnum(t), alnum(t)):
                one[w], two[b, w], after[b] = one.get(w, 0) + 1, two.get((b, w), 0) + 1, after.get(b, 0) + 1
        n = sum(one.values())
        out = 0.0
        for b, w in zip([None] + alnum(text), alnum(text)):
            context = max(one.get(b, 0), after.get(b, 0), 1e-9)
            p1 = (one.get(w, 0) + lm_score.ADD) / (n + lm_score.ADD * (len(words) + 1))
            out -= math.log(lm_score.MIX * two.get((b, w), 0) / context + (1 - lm_score.MIX * after.get(b, 0) / context) * p1)
        return out / len(alnum(text))
    strange = docs_of(spark, ["rare new a", "only b rare"])
    for frame, own, fitted in ((df, texts, True), (df, texts, False), (strange, ["rare new a", "only b rare"], False)):
        rows = {r["row"]["doc_id"]: r for r in lm_score.score(frame, models, fitted=fitted).collect()}
        for i, t in enumerate(own):
            assert abs(rows[i]["target_ce"] - losses([texts[j] for j in good], t)) < 1e-8
            assert abs(rows[i]["background_ce"] - losses(texts, t)) < 1e-8

    own = {r["row"]["doc_id"]: r for r in lm_score.score_own(df, F.col("doc_id").isin(1, 2), keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert own[i]["n_tokens"] == len(alnum(t))
        assert abs(own[i]["target_ce"] - losses([texts[j] for j in good], t)) < 1e-8
        assert abs(own[i]["background_ce"] - losses(texts, t)) < 1e-8


def test_lm_score_own_equals_the_tables(spark, monkeypatch):
    """Spans and buckets of any size give the scores of the tables; null, empty and repeated
    rows, null targets and clashing column names."""
    texts = [prose(i % 30, 60 + i, 40 + i) for i in range(90)] + [None, "", " .,- ", "single", "single", "Ärger Größe 東京"]
    base = docs_of(spark, texts).union(docs_of(spark, texts).limit(3))
    df = base.selectExpr("doc_id", "text", "doc_id as id", "'x' as row", "1 as n_tokens", "2 as target", "3 as bucket").repartition(4)
    chosen = F.when(F.col("doc_id") != 7, F.col("doc_id") % 3 == 0)

    def rounded(rows):
        return sorted((r["row"]["doc_id"], r["n_tokens"], *[None if r[c] is None else round(r[c], 8) for c in
                       ("target_ce", "background_ce", "score")]) for r in rows.collect())
    models = lm_score.fit(df, df.where(chosen), lm_score.vocabulary(df))
    want = rounded(lm_score.score(df, models, fitted=True))
    assert len(want) == len(texts) + 3 and want[93][1:] == (0, None, None, None)
    assert rounded(lm_score.score_own(df, chosen)) == want
    monkeypatch.setattr(lm_score, "SPAN", 3000)
    monkeypatch.setattr(lm_score, "ENTRIES", 100)
    assert rounded(lm_score.score_own(df, chosen)) == want
    assert lm_score.score_own(df, chosen).first()["row"]["bucket"] == 3
    assert lm_score.score_own(df.limit(0), chosen).count() == 0
    assert all(r["target_ce"] is not None for r in lm_score.score_own(df, F.lit(False)).collect() if r["n_tokens"])


# 5 mixing

def test_mixing_draws_from_poisson(spark):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"),
                               F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, None).otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "source string, weight double")
    out = mixing.mix(df, weights=weights).select("row.doc_id", "row.source", "rate", "copy", "n_copies", "place").toPandas()
    assert set(out["source"]) == {"a", "b"}  # the null source has no weight
    assert abs((out["source"] == "a").mean() - 2 / 3) < 0.03 and abs(len(out) / n - 1) < 0.05
    assert (out.groupby("doc_id")["copy"].count() == out.groupby("doc_id")["n_copies"].first()).all()
    one = out[out["source"] == "a"].groupby("doc_id")["n_copies"].first()
    rate = float(out[out["source"] == "a"]["rate"].iloc[0])
    assert abs((one == 1).sum() / (n / 4) - rate * math.exp(-rate)) < 0.03
    assert out["place"].is_monotonic_increasing
    again = mixing.mix(df.repartition(5), weights=weights).select("row.doc_id", "place").toPandas()
    assert list(again["doc_id"]) == list(out["doc_id"])
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [3.0, 499.0, 501.0, 1000.0, 10000.0])
def test_mixing_draws_large_rates(spark, rate):
    n = 400
    df = spark.range(n).select("id", F.lit(rate).alias("rate")).withColumn("parts", mixing.parts(F.col("rate")))
    drawn = mixing.drawn_copies(F.col("cdf"), F.col("parts"), F.lit("s"), F.col("id"))
    k = np.array([r[0] for r in df.withColumn("cdf", mixing.cumulative(F.col("rate") / F.col("parts"))).select(drawn).collect()])
    assert abs(k.mean() - rate) < 5 * math.sqrt(rate / n)
    assert 0.7 * rate < k.var() < 1.4 * rate  # a Poisson number's variance is its mean


def test_mixing_tells_rows_of_one_key_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 64)
    rows = [(None, f"t{i}", "a") for i in range(400)] + [(None, "same", "a")] * 400 + [(7, f"t{i}", "a") for i in range(400)]
    rows += [(100 + i, "x" * 2000, "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 0.002), ("b", 1.0)], "source string, weight double")
    out = mixing.mix(df, weights=weights).select("row.doc_id", "row.text", "row.source", "rate", "place").toPandas()
    a = out[out["source"] == "a"]
    rate = float(a["rate"].iloc[0])
    for part in (a[a["doc_id"].isna() & (a["text"] != "same")], a[a["text"] == "same"], a[a["doc_id"] == 7]):
        assert abs(len(part) - 400 * rate) < 5 * math.sqrt(400 * rate)
    assert a["place"].is_unique
    again = mixing.mix(df.repartition(5), weights=weights).select("row.text", "place").toPandas()
    assert list(again["text"]) == list(out["text"]) and list(again["place"]) == list(out["place"])
    unique = mixing.mix(df.where("doc_id >= 100")).select("row.doc_id", "n_copies").distinct().collect()
    for r in unique:  # unique keys draw as before
        u = int(hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["n_copies"] == sum(u >= c for c in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)]))


# 6 sharding

@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p) == list(range(n)) and list(sharding.permute(p, n, back=True)) == list(range(n))
    shard, slot = sharding.locate(n - 1, n, 4)
    assert sharding.row_at(shard, slot, n, 4) == n - 1


def test_shards_are_even_without_gaps(spark):
    rows = [(i % 50, None if i % 7 == 0 else "t", i % 3) for i in range(333)] + [(None, None, None)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.shard_rows(df, ["doc_id"], 5).select("row.*", "row_number", F.col("shard").alias("to"), "slot").toPandas()
    assert sorted(out["row_number"]) == list(range(433))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("to"))
    assert out.groupby("to").size().max() - out.groupby("to").size().min() <= 1
    assert all(sharding.locate(r.row_number, 433, 5) == (r.to, r.slot) for r in out.head(20).itertuples())
    again = sharding.shard_rows(df.repartition(7), ["doc_id"], 5).select("row.doc_id", "shard", "slot").toPandas()
    key = ["to", "slot"]
    assert list(out.sort_values(key)["doc_id"].fillna(-1)) == list(
        again.rename(columns={"shard": "to"}).sort_values(key)["doc_id"].fillna(-1))
    assert sharding.shard_rows(df.limit(0), ["doc_id"], 5).count() == 0


def test_sharding_spreads_rows_of_one_key(spark):
    """Rows of null keys with different contents fall in many buckets; copies stay one."""
    rows = [(None, f"t{i}") for i in range(3000)] + [(None, "same")] * 500 + [(i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    named = df.where("doc_id is null").select(F.xxhash64("doc_id").alias("k"), F.xxhash64("text").alias("h"))
    assert named.select(F.shiftrightunsigned(F.xxhash64("k", "h"), 48)).distinct().count() > 2500
    out = sharding.shard_rows(df, ["doc_id"], 7).select("row_number", "shard", "slot", "row.text").toPandas()
    assert sorted(out["row_number"]) == list(range(6500)) and np.ptp(out["shard"].value_counts().to_numpy()) <= 1
    same = sorted(out[out["text"] == "same"]["row_number"])
    assert same == list(range(same[0], same[0] + 500))
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


# 7 pages

def test_page_text_reads_the_article(spark):
    html = ("<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body><nav>menu</nav>"
            "<div class='ad'>buy<div>more</div></div><article><h1>Big &amp;  bold</h1><p>one<br>two<p>three\n four</p>"
            "<div id=comments><p>me too</p></div></article><footer>&copy;</footer></body></html>")
    pages = [(1, "https://h/1", html), (2, "https://h/2", None), (3, None, ""), (4, "https://h/4", html[:html.index("four")]),
             (1, "https://h/1", html)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = {(r["page_id"]): (r["text"], r["n_chars"]) for r in page_text.extract(df).collect()}
    want = "Big & bold\n\none two\n\nthree four"
    assert rows[1] == (want, len(want)) and rows[2] == ("", 0) and rows[3] == ("", 0)
    assert rows[4][0] == "Big & bold\n\none two\n\nthree"
    assert page_text.extract(df).count() == 5 and page_text.extract(df.limit(0)).count() == 0


def test_suffix_array_removes_shared_runs_of_open_pages():
    notice = "please accept all of our very fine cookies before reading"
    pages = [f"<body><div>{notice}</div><div>{prose(i, 30)}</div></body>" for i in range(5)]
    out = page_text.main_texts(pages)
    assert [t for t, _ in out] == [prose(i, 30) for i in range(5)] and all(n == 10 for _, n in out)
    assert page_text.main_texts(pages[:2])[0][0].startswith(notice)  # two pages are no evidence


def test_page_names_match_whole_and_spare_the_article():
    def text(html):
        return [t for _, t in page_text.page_blocks(html)]
    for name in ("layout has-sidebar", "no-sidebar", "with-header", "comments-open", "sidebar", "layout ad"):
        assert text(f"<body><div class='{name}'><nav>go</nav><article><p>one<p>two</article></div></body>") == ["one", "two"]
    assert text("<form><header>top</header><main>one</main></form>") == ["one"]
    long = "a long text that makes up most of the page"
    assert text(f"<div class=notice>{long}</div><div class=ad>buy</div>") == [long]
    assert text(f"<p class=notice>buy now<p>{long}<p>two") == [long, "two"]
    assert text(f"<ul><li class=ad>buy<li>{long}</ul><div>two</div>") == [long, "two"]
    assert text(f"<p><b>{long}<br><p class=ad><b>buy<p>two</b>") == [long, "two"]
    assert text(f"<div class='ad'>buy<div>more</div></div>{long}<script>var x='<article>'</script>") == [long]


@pytest.mark.parametrize("few", [0, 1000])
def test_page_runs_are_shared_over_the_whole_host(spark, monkeypatch, few):
    monkeypatch.setattr(page_text, "BROADCAST_RUNS", few)
    notice = "please accept all of our very fine cookies before reading"
    pages = [f"<div>{notice if i % 300 == 0 else 'x'}</div><div>{prose(i, 12, 10**6)}</div>" for i in range(900)]
    rows = [(i, f"https://h/{i}", h) for i, h in enumerate(pages)]
    rows += [(1000 + i, f"https://{h}/{i}", f"<div>{notice}</div>") for i, h in enumerate("ab")]
    rows += [(2000, "https://c/1", "<p>" + prose(7, 40))] * 2 + [(2001 + i, f"https://c/{i}", "<p>" + prose(7, 40)) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    out = [(r["page_id"], r["text"], r["n_shared"]) for r in page_text.extract(df).collect()]
    assert len(out) == len(rows)
    got = {i: (t, n) for i, t, n in out}
    want = page_text.main_texts(pages)
    assert all(got[i] == want[i] for i in range(900)) and got[300] == (prose(300, 12, 10**6), 10)
    assert got[1000] == got[1001] == (notice, 0)  # one page of each host
    assert all(t == prose(7, 40) and n == 0 for i, t, n in out if i >= 2000)  # copies are one page


def test_shared_words_equals_brute_force():
    rng = np.random.default_rng(2)
    streams = [[str(x) for x in rng.integers(0, 3, int(n))] for n in rng.integers(0, 40, 8)]
    got = page_text.shared_words(streams, run=4, min_pages=3)
    for i, s in enumerate(streams):
        want = np.zeros(len(s), bool)
        for a in range(len(s) - 3):
            if sum(any(o[j:j + 4] == s[a:a + 4] for j in range(len(o) - 3)) for o in streams) >= 3:
                want[a:a + 4] = True
        assert (got[i] == want).all()


# 8 language

def test_language_id_learns_and_rejects(spark):
    words = {"xx": "lala lolo lulu lele".split(), "yy": "krat kront krisp krumm".split()}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k], 40)), k, "s", 0) for i, k in enumerate(["xx", "yy"] * 60)]
    rows += [(900, None, "xx", "s", 0), (901, "123 ... !", None, "s", 0), (902, "", "yy", "s", 0), (903, "lala LOLO", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["row"]["doc_id"]: r for r in language.identify(df, language.fit_documents(df)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(120))
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language.fit(df.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.limit(0), none).count() == 0


def test_bloom_masks_hold_every_language():
    grams = np.arange(3000, dtype=np.uint64)
    model = language.build_filter([f"l{i:03}" for i in range(70)], np.ones(70), grams, (grams % np.uint64(70)).astype(np.int64))
    masks = model.masks(grams)
    at = (grams % np.uint64(70)).astype(int)
    assert all((int(masks[g, at[g] // 64]) >> int(at[g] % 64)) & 1 for g in range(3000))
    assert (model.false_positive() < 0.01).all()


# 9 decontamination

def brute_hits(text, items):
    w, hit, ids = alnum(text), set(), set()
    for i, t in items:
        x = alnum(t)
        n = min(13, len(x))
        for s in range(len(x) - n + 1 if x else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == x[s:s + n]:
                    hit.update(range(p, p + n))
                    ids.add(i)
    return len(w), len(hit), ids


@pytest.mark.parametrize("test_bytes", [64 << 20, 300])
def test_decontamination_equals_brute_force(spark, test_bytes):
    items = [(i, prose(i, n, 60)) for i, n in enumerate([5, 13, 14, 40, 1, 60])] + [(7, None), (8, ""), (9, "x y x y x y x y x y x y x y x y")]
    texts = [prose(50, 30, 60) + " " + items[3][1][:90] + " " + prose(51, 9, 60), items[5][1].upper(), items[0][1], "",
             None, "w1 w2", items[4][1] * 3, "x y " * 40, " ".join(t or "" for _, t in items), prose(60, 400, 60)]
    b = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, texts).withColumn("matches", F.lit(1))
    found = decontaminate.find_matches(df, b, test_bytes=test_bytes).collect()
    for r in found:
        want = brute_hits(texts[r["row"]["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], {m["item_id"] for m in r["matches"]}) == want
        for m in r["matches"]:  # locations are right
            a, b_ = alnum(texts[r["row"]["doc_id"]]), alnum(dict(items)[m["item_id"]])
            assert a[m["doc_start"]:m["doc_start"] + m["n_words"]] == b_[m["item_start"]:m["item_start"] + m["n_words"]]
    assert decontaminate.decontaminate(df, b).columns == df.columns
    assert decontaminate.find_matches(df.limit(0), b).count() == 0
    assert decontaminate.find_matches(df, b.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_holds_one_block_at_a_time(spark, monkeypatch):
    import weakref
    made, make = [], decontaminate.TestBlock.__init__

    def watched(self, *args):
        assert all(r() is None for r in made)
        made.append(weakref.ref(self))
        make(self, *args)
    items = spark.createDataFrame([(i, prose(i, 20)) for i in range(6)], "item_id long, text string")
    monkeypatch.setattr(decontaminate.TestBlock, "__init__", watched)
    docs = docs_of(spark, [prose(i, 20) for i in range(6)] + ["none"])
    rows = decontaminate.find_matches(docs, items, test_bytes=200).collect()
    assert len(made) > 1 and sorted(r["n_hit"] for r in rows) == [0] + [20] * 6


# 10 lines

def test_line_dedup_equals_brute_force(spark):
    long = ["  " + prose(i, 12, 50).title() + "\t" for i in range(4)]
    rng = np.random.default_rng(4)
    texts = [None, "", "\n", "short\nshort"]
    texts += ["\n".join(long[int(j)] if j < 4 else prose(1000 + 10 * i + int(j), 15) for j in rng.integers(0, 8, 6)) for i in range(60)]
    got = {r["id"]: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        assert (got[i]["kept"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    empty = docs_of(spark, ["a"]).limit(0)
    assert line_dedup.dedup_lines(empty).count() == 0
    null_id = spark.createDataFrame([(None, long[0])] * 6, "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(null_id).collect()} == {0}


def test_runs_compact_by_level(spark, tmp_path):
    runs = line_dedup.Runs(spark, str(tmp_path), fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1, 100 - i), (i, 2, 1, 50)], "h1 long, h2 long, n long, keeper long"))
    assert sorted(level for level, _ in runs.runs) == [0, 2]
    total = {(r["h1"], r["h2"]): (r["n"], r["keeper"]) for r in runs.totals().collect()}
    assert total[(1, 1)] == (5, 100) and len(total) == 6


# pipeline

def test_pipeline_keeps_what_it_should(spark):
    import __spark_entry__
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    item = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    frame, names = docs, dict(corpus_pipeline.STAGES)
    frame = names["language"](spark, frame, sf)
    kept = {r["doc_id"] for r in frame.collect()}
    assert kept == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    order = sorted(kept)
    frame = names["near duplicates"](spark, frame, sf)
    group = brute_components([texts[i] for i in order], 5, 80, 100)
    unique = {order[i] for i, (_, c) in group.items() if c == i}
    assert {r["doc_id"] for r in frame.collect()} == unique
    frame = names["decontamination"](spark, frame, sf)
    hits = {i: brute_hits(texts[i], item) for i in unique}
    clean = {i for i, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
    assert {r["doc_id"] for r in frame.collect()} == clean and frame.columns == docs.columns
    frame = names["mixing"](spark, frame, sf)
    mixed = sorted(r["doc_id"] for r in frame.collect())
    size = {}
    rows = {r["doc_id"]: r for r in docs.collect()}
    for i in clean:
        size[rows[i]["source"]] = size.get(rows[i]["source"], 0) + len((texts[i] or "").encode()) + 1
    want = []
    for i in clean:
        s = size[rows[i]["source"]]
        rate = round(math.sqrt(s) / sum(map(math.sqrt, size.values())) * sum(size.values()) / s, 9)
        u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want += [i] * k
    assert mixed == sorted(want)
    out = names["sharding"](spark, frame, sf).toPandas()
    assert sorted(out["doc_id"]) == mixed
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert "pipeline" in __spark_entry__.queries()


def test_op6_digest(spark):
    from cohortlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op6_sharding"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert len(out) == len(texts)


def test_llm_oracles_agree(spark):
    import duckdb

    from cohortlens.llm.queries import ORACLE, QUERIES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLE.items():
        got, want = QUERIES[name](spark, sf).toPandas(), con.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        a, b = (sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in f[columns].itertuples(index=False))
                for f in (got, want))
        assert a == b, name


@pytest.mark.parametrize("n", [1, 40, 63, 64, 65, 127, 129, 900, 1030, 5000])
def test_wide_sketches_keep_links(spark, n):
    """Linked sets pass, also where their sketches differ in length; unrelated sets don't."""
    rng, rule = np.random.default_rng(n), ngram_join.Rule()
    one = rng.integers(1, 2**63, n, dtype=np.uint64)
    more = np.concatenate([one, rng.integers(1, 2**63, n // 4, dtype=np.uint64)])
    other = rng.integers(1, 2**63, n, dtype=np.uint64)
    assert rule.linked(len(one), len(more), n)
    rows = [(at, 9, len(a), len(b), *[[int(w) for w in f(s).view(np.int64)] for s in (a, b)
                                      for f in (ngram_join.wide_sketch, lambda s: ngram_join.check_sketch(s, 12))])
            for at, (a, b) in enumerate(((one, more), (more, one), (one, other)))]
    df = spark.createDataFrame(rows, "a long, b long, an long, bn long, awide array<long>, asketch array<long>, "
                                     "bwide array<long>, bsketch array<long>").coalesce(1)
    near = {r["a"] for r in df.where(ngram_join._near_enough(rule, "a", "b")).select("a").collect()}
    wide = {r["a"] for r in ngram_join._wide_enough(df, rule).collect()}
    assert {0, 1} <= near and {0, 1} <= wide
    assert n < 40 or 2 not in wide


def test_ngram_join_repeated_rows_verify_no_more_than_one(spark, monkeypatch):
    """300 equal rows of one id and a near copy: as many pairs are verified as for one row."""
    checked = []
    plain = ngram_join._verified

    def counted(pairs, rule):
        checked.append(pairs.count())
        return plain(pairs, rule)
    monkeypatch.setattr(ngram_join, "_verified", counted)
    text = prose(3, 300, 5000)
    near = text.replace("w1 ", "other ", 1) + " end"
    once = spark.createDataFrame([(1, text), (2, near), (3, prose(4, 200, 5000))], "doc_id long, text string")
    many = once.union(spark.createDataFrame([(1, text)] * 300 + [(2, near)] * 50, once.schema))
    want = {(r["id"], r["component_id"]) for r in ngram_join.near_duplicates(once).collect()}
    before = sum(checked)
    checked.clear()
    got = ngram_join.near_duplicates(many).collect()
    assert {(r["id"], r["component_id"]) for r in got} == want == {(1, 1), (2, 1), (3, 3)}
    assert len(got) == 353 and sum(checked) == before


def test_near_copies_are_not_expanded_into_pairs(spark, monkeypatch):
    """240 near copies, about half of their pairs linked: members are brought together by
    few of them, and the classes are those of brute force."""
    checked = []
    plain = ngram_join._check

    def counted(pairs, *more):
        checked.append(pairs.count())
        return plain(pairs, *more)
    monkeypatch.setattr(ngram_join, "_check", counted)
    rng, words, texts = np.random.default_rng(12), prose(12, 150, 5000).split(), []
    for i in range(240):
        copy = list(words)
        for at in rng.integers(0, 150, 2 + i % 4):
            copy[int(at)] = f"e{int(rng.integers(10**6))}"
        texts.append(" ".join(copy))
    rule = ngram_join.Rule(3, 85, 100)
    found = ngram_join.near_duplicates(docs_of(spark, texts), rule=rule).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(texts, rule.k, rule.num, rule.den)
    assert sum(checked) <= 10 * len(texts), checked


def test_pairs_meet_once_in_a_run_of_shared_keys(spark, monkeypatch):
    """Long texts that share half of their shingles meet under few of their keys, and behind
    the whole fixed sketch: no folded one lets them through from every key."""
    conditions = []
    plain = ngram_join._met

    def counted(rows, rule):
        conditions.append((rows.count(), plain(rows, rule).count()))
        return plain(rows, rule)
    monkeypatch.setattr(ngram_join, "_met", counted)
    half = prose(13, 1500, 10**6)
    texts = [half + " " + prose(100 + i, 1500, 10**6) for i in range(20)]
    texts += [prose(7, 100, 5000) + f" x{i}" * (i % 2) for i in range(4)]
    got = ngram_join.near_duplicates(docs_of(spark, texts)).collect()
    assert {r["id"]: r["component_id"] for r in got} == {i: min(i, 20) for i in range(24)}
    assert sum(n for _, n in conditions) <= 20 * 19 // 2


def test_runs_of_shared_keys_lose_no_pair(spark):
    """Each pair that shares a key comes out, once from each run of shared keys."""
    rng = np.random.default_rng(14)
    has = {i: sorted(set(rng.choice(60, 25).tolist())) for i in range(12)}
    rows = spark.createDataFrame([(k, i, i, 10, [0] * ngram_join.CHECK_WORDS) for i, ks in has.items() for k in ks],
                                 "key long, id long, c long, n long, sketch array<long>")
    got = [tuple(r) for r in ngram_join._met(ngram_join._after(rows), ngram_join.Rule()).collect()]
    both = {(a, b): set(has[a]) & set(has[b]) for a in has for b in has if a < b}
    assert set(got) == {p for p, keys in both.items() if keys}
    assert len(got) < sum(map(len, both.values()))


@pytest.mark.parametrize("d", [1, 7, 64, 100])
def test_stored_codes_bound_like_the_full_ones(d):
    u = embeddings.unit(np.random.default_rng(8).standard_normal((300, d)))
    codes = embeddings.Codes(u)
    stored = embeddings.PackedCodes(codes.packed(), d)
    i, j = np.triu_indices(300, 1)
    upper = stored.upper(i, j)
    assert (upper >= (u[i] * u[j]).sum(1)).mean() > 0.9999
    assert abs((upper - codes.upper(i, j)).mean()) < 0.02 and abs(upper - codes.upper(i, j)).max() < 0.2


def test_pairs_of_groups_are_all_and_only_those():
    g = np.array([1, 1, 1, 4, 5, 5, 5, 5, 9, 9])
    side = np.array([0, 0, 0, 0, 1, 1, 2, 2, 1, 1])
    got = {p for i, j in embeddings._pairs(g, side) for p in zip(i.tolist(), j.tolist())}
    assert got == {(0, 1), (0, 2), (1, 2), (4, 6), (4, 7), (5, 6), (5, 7)}
