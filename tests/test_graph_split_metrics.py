import random
from collections import Counter

from pyspark.sql import functions as F

from cohortlens.operators import graph as G
from cohortlens.operators import metrics as M
from cohortlens.operators import split as S


def doc_rows(spark, lists):
    docs = spark.createDataFrame([(i,) for i, _ in lists], "note_id long")
    rows = [(i, p, x) for i, xs in lists for p, x in enumerate(xs)]
    return spark.createDataFrame(rows, "note_id long, pos int, term_id int"), docs


def test_window_counts(spark):
    terms, docs = doc_rows(spark, [(i, list(range(n))) for i, n in enumerate([0, 1, 20, 21, 25])])
    got = {r[0]: r[1] for r in G.windows(terms, docs).groupBy("note_id").count().collect()}
    assert [got[i] for i in range(5)] == [1, 1, 1, 2, 6]
    assert G.n_windows(terms, docs).first()[0] == 11


def test_position_counts_equal_the_windows(spark):
    """Frequencies and pairs from positions are those of the windows themselves."""
    rng = random.Random(2)
    lists = [(i, rng.sample(range(60), rng.randrange(0, 45))) for i in range(30)]
    terms, docs = doc_rows(spark, lists)
    freq, pairs = Counter(), Counter()
    for r in G.windows(terms, docs, 7).collect():
        freq.update(r["window"])
        pairs.update((a, b) for a in r["window"] for b in r["window"] if a != b)
    assert {r["term"]: r["freq"] for r in G.window_freq(terms, 7).collect()} == freq
    assert {(r["i"], r["j"]): r["count"] for r in G.pair_count(terms, 7).collect()} == pairs


def test_pmi_symmetric_positive(spark):
    terms, docs = doc_rows(spark, [(0, [0, 1]), (1, [0, 1]), (2, [2]), (3, [])])
    p = {(r.i, r.j): r.weight for r in G.pmi(terms, docs).collect()}
    assert p and all(w > 0 for w in p.values())
    assert all(abs(p[(i, j)] - p[(j, i)]) < 1e-12 for i, j in p)
    assert (0, 2) not in p   # never co-occur


def test_folds_disjoint_complete_and_stable(spark):
    ids = spark.range(0, 103).select(F.col("id").alias("pat_deid"),
                                     (F.col("id") % 3).cast("string").alias("label_key"))
    a = {(r[0], r[1]) for r in S.stratified_kfold(ids, "pat_deid", ["label_key"], 4)
         .select("pat_deid", "fold").collect()}
    b = {(r[0], r[1]) for r in S.stratified_kfold(ids, "pat_deid", ["label_key"], 4)
         .select("pat_deid", "fold").collect()}
    assert a == b and len(a) == 103 and len({p for p, _ in a}) == 103


def test_rank_matches_row_number(spark):
    from pyspark.sql import Window
    ids = spark.range(0, 500).select(F.col("id").alias("pat_deid"),
                                     (F.col("id") % 2).alias("k"))
    r = S.stratum_rank(ids, "pat_deid", ["k"], 42)
    w = Window.partitionBy("k").orderBy(F.md5(F.concat(F.col("pat_deid").cast("string"),
                                                       F.lit("42"))), "pat_deid")
    ref = ids.withColumn("rn", F.row_number().over(w))
    bad = r.join(ref, ["pat_deid", "k"]).where(F.col("rank") != F.col("rn")).count()
    assert bad == 0


def test_split_sizes_and_tiny_strata(spark):
    ids = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 51 else "c") for i in range(53)],
                                "pat_deid long, label_key string")
    sp = S.stratified_split(ids, "pat_deid", ["label_key"], 0.06)
    n = {r[0]: r[1] for r in sp.where("split = 'test'").groupBy("label_key").count().collect()}
    assert n.get("a") == 3 and "b" not in n and "c" not in n


def scored(spark, rows):
    return spark.createDataFrame(rows, "id long, class string, y int, score double")


def test_auc_ties_and_absent_class(spark):
    s = scored(spark, [(1, "a", 1, 0.5), (2, "a", 0, 0.5), (3, "a", 1, 0.5),
                       (1, "b", 1, 0.9), (2, "b", 1, 0.1)])
    got = {r[0]: r[1] for r in M.auc(s).collect()}
    assert got["a"] == 0.5 and got["b"] is None


def test_report_zero_division(spark):
    s = scored(spark, [(1, "a", 1, 0.1), (2, "a", 0, 0.2), (1, "b", 1, 0.9), (2, "b", 0, 0.8)])
    rep = {r["label"]: r for r in M.report(s).collect()}
    assert rep["a"]["precision"] == 0.0 and rep["a"]["recall"] == 0.0
    assert rep["b"]["precision"] == 0.5 and rep["b"]["recall"] == 1.0


def test_roc_and_auc_of_logits_with_one_hot_score(spark):
    rng = random.Random(4)
    rows = [(i, "a", int(rng.random() < .4), 3.5 if i % 2 else rng.gauss(0, 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, class string, y int, score double")
    pos, neg = [r[3] for r in rows if r[2]], [r[3] for r in rows if not r[2]]
    want = sum((p > n) + .5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(M.auc(df).first()["auc"] - want) < 1e-9
    for r in M.roc(df).where("threshold is not null").collect()[::97]:
        assert abs(r["tpr"] - sum(p >= r["threshold"] for p in pos) / len(pos)) < 1e-9
        assert abs(r["fpr"] - sum(n >= r["threshold"] for n in neg) / len(neg)) < 1e-9


def test_layers_of_the_neighbour_sample(spark):
    edges = [(s, 0, "in", 1.0) for s in range(1, 60)] + [(s + 100, s, "co-occur", 1.0) for s in range(1, 60)] * 1
    edges += [(s + 200, s, "co-occur", 1.0) for s in range(1, 60)] + [(5, 3, "other", 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, etype string, weight double")
    got = G.layered_sample(df, df.where("dst = 0").select("dst"), {"in": 4, "co-occur": 1}).collect()
    one = [r for r in got if r["layer"] == 1]
    assert len(one) == 4 and {r["dst"] for r in one} == {0}
    two = [r for r in got if r["layer"] == 2]
    assert len(two) == 4 and {r["dst"] for r in two} == {r["src"] for r in one} and {r["etype"] for r in two} == {"co-occur"}


def test_a_rewritten_fold_leaves_the_others(spark, tmp_path):
    from cohortlens.sources.tables import write_splits
    rows = [(i, "train", f, "val" if i % 2 == f else "train") for i in range(10) for f in range(2)]
    df = spark.createDataFrame(rows, "pat_deid long, split string, fold int, role string")
    path = str(tmp_path / "splits")
    write_splits(df, path)
    write_splits(df.where("fold = 1").withColumn("pat_deid", F.col("pat_deid") + 100), path)
    back = {tuple(r) for r in spark.read.parquet(path).select("pat_deid", "split", "fold", "role").collect()}
    assert back == {(i + 100 * f, s, f, r) for i, s, f, r in rows}


def test_no_row_is_scored_by_its_own_training_fold(spark):
    """Texts that only a model that saw them could score: out of fold they carry nothing."""
    from cohortlens.operators import ml
    rng = random.Random(8)
    rows = [(i, " ".join(f"u{i}w{j}" for j in range(6)), int(rng.random() < .5)) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    scored = ml.baseline(docs, labels, ["quality"])
    assert scored.count() == 80 and scored.select("id").distinct().count() == 80
    assert sorted(r["fold"] for r in scored.select("fold").distinct().collect()) == [0, 1, 2]
    auc = M.auc(scored.select("id", "class", "y", "score")).first()["auc"]
    assert auc < 0.75  # a model that had seen its rows would reach 1


def test_neighbours_of_whole_vectors_match_brute_force(spark):
    rng = random.Random(9)
    vecs = {i: [rng.choice([rng.uniform(-2, 2), 0.0]) for _ in range(5)] for i in range(12)}
    vecs[3] = [None, 1.0, None, 2.0, 0.5]
    vecs[4] = None
    edges = [(rng.randrange(14), rng.choice([0, rng.randrange(12)]), rng.choice("ab"), rng.uniform(-1, 1))
             for _ in range(90)]
    nodes = G.node_vectors(spark.createDataFrame(list(vecs.items()), "id long, v array<double>"), "id", "v")
    e = spark.createDataFrame(edges, "src long, dst long, etype string, weight double").repartition(3)
    found, deg = {}, Counter()
    for s, d, t, w in edges:
        if s in vecs:
            deg[d, t] += 1
            for i, x in enumerate(vecs[s] or []):
                if x is not None:
                    found.setdefault((d, t, i), []).append(w * x)

    def rows(df):
        return {(r["dst"], r["etype"], r["dim"]): r["value"] for r in G.by_dim(df, "dst", "etype").collect()}

    def same(got, want):
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)

    mean = G.neighbor_mean(e, nodes, 5)
    same(rows(mean), {k: sum(m) / len(m) for k, m in found.items()})
    same(rows(G.neighbor_max(e, nodes, 5)), {k: max(m) for k, m in found.items()})
    same(rows(G.neighbor_gcn(e, nodes, ["a", "b"], 5)),
         {(n, t, i): (sum(found.get((n, t, i), [])) + x) / (deg[n, t] + 1)
          for n, v in vecs.items() for t in "ab" for i, x in enumerate(v or []) if x is not None})
    same(rows(G.zero_degree(mean, nodes, ["a", "b"], 5)),
         {(n, t, i): sum(found.get((n, t, i), [0.0])) / len(found.get((n, t, i), [0.0]))
          for n in vecs for t in "ab" for i in range(5)})
    total = Counter()
    for (d, t, i), m in found.items():
        total[d, i] += sum(m) / len(m)
    got = {(r["dst"], r["dim"]): r["value"] for r in G.by_dim(G.relation_sum(mean, 5), "dst").collect()}
    same(got, total)


def test_validation_split_is_stratified_and_apart_from_the_test(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(3000)]
    ids = spark.createDataFrame(rows, "pat_deid long, label_key string")
    out = S.train_val_test(ids, "pat_deid", ["label_key"], 0.06, 0.2).collect()
    assert len(out) == 3000 and all((r["split"] == "test") == (r["part"] == "test") for r in out)
    n = {(k, p): sum(r["label_key"] == k and r["part"] == p for r in out) for k in "ab" for p in ("train", "val", "test")}
    assert n == {("a", "test"): 120, ("a", "val"): 376, ("a", "train"): 1504,
                 ("b", "test"): 60, ("b", "val"): 188, ("b", "train"): 752}
