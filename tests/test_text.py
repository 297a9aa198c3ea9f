import random
import string

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import match as M
from cohortlens.operators import neardup as ND
from cohortlens.operators import relational as R
from cohortlens.operators import text as T
from cohortlens.operators import vocab as V
from cohortlens.plans import q_text as Q
from cohortlens.operators.cohort import dx_short_expr, note_window
from cohortlens.plans.q_cohort import anchor_sym
from cohortlens.session import stored
from cohortlens.sources.tables import Tables

SENT = "pat_deid long, first_at int, sentence string"


def edits(a, b):
    """Edit distance, by the recursion on the last characters."""
    memo = {}

    def d(i, j):
        if not i or not j:
            return i + j
        if (i, j) not in memo:
            memo[i, j] = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        return memo[i, j]
    return d(len(a), len(b))


def similar(a, b):
    return edits(a, b) <= (max(len(a), len(b)) + 1e-9) // 5


def edited(rng, x):
    w = list(x)
    for _ in range(rng.randrange(1, 2 + len(w) // 4)):
        at = rng.randrange(len(w))
        w[at:at + 1] = rng.choice([[], [rng.choice("abcdé😀 ")], [w[at], rng.choice("abc ")]])
        w = w or ["a"]
    return "".join(w)


def test_near_dup_keeps_no_similar_pair_and_drops_only_similar_ones(spark):
    rng, rows = random.Random(3), []
    for pat in range(6):
        seen = {}
        for i in range(40):
            x = edited(rng, rng.choice(list(seen))) if seen and rng.random() < .6 else "".join(
                rng.choice("abcdefgh ü") for _ in range(rng.randrange(2, 45)))
            seen.setdefault(x, i)
        rows += [(pat, i, x) for x, i in seen.items()]
    kept = {(r["pat_deid"], r["first_at"]) for r in ND.near_dup(spark.createDataFrame(rows, SENT)).collect()}
    assert len(kept) < len(rows)
    for pat, i, x in rows:
        earlier = [y for p, j, y in rows if p == pat and j < i and (p, j) in kept]
        assert ((pat, i) in kept) == (not any(similar(x, y) for y in earlier))


def test_near_dup_chain_keeps_a_and_c(spark):
    a, b, c = "abcdefghij", "abcdefghzz", "abcdefzzzz"   # a~b, b~c, a!~c
    df = spark.createDataFrame([(1, 0, a), (1, 1, b), (1, 2, c), (2, 0, c), (2, 1, b)], SENT)
    assert {(r[0], r[1]) for r in ND.near_dup(df).collect()} == {(1, 0), (1, 2), (2, 0)}


def test_near_dup_of_one_large_patient_runs_on_many_tasks(spark):
    words = spark.range(0, 4000).select(F.lit(1).cast("long").alias("pat_deid"), F.col("id").cast("int").alias("first_at"),
                                        F.substring(F.md5(F.col("id").cast("string")), 1, 30).alias("sentence"))
    copies = words.where("first_at < 300").select("pat_deid", (F.col("first_at") + 5000).alias("first_at"),
                                                  F.concat("sentence", F.lit("zz")).alias("sentence"))
    nodes = ND._nodes(words.unionByName(copies))
    tasks = ND.candidate_pairs(nodes).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 4 or spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    left = ND.near_dup(words.unionByName(copies))
    assert left.where("first_at >= 5000").count() == 0 and left.count() > 3900


def test_lsh_compares_only_pairs_of_one_band(spark):
    a, b = "the patient reports severe pain today", "the patient reports severe pain todax"
    nodes = ND._nodes(spark.createDataFrame([(1, 0, a), (1, 1, b), (1, 2, "entirely other words here"), (2, 0, b)], SENT))
    pairs = ND.band_pairs(nodes).collect()
    assert len(pairs) == 1 and pairs[0]["pat_deid"] == 1
    # every hash function is its own: the bands of a sentence differ
    assert all(len(set(r[0])) == 4 for r in nodes.select(ND.minhash_bands(F.col("sentence"))).collect())
    kept = {r["first_at"] for r in ND.near_dup(spark.createDataFrame([(1, 0, a), (1, 1, b)], SENT), lsh=True).collect()}
    assert kept == {0}


@pytest.mark.parametrize("most", [M.BROADCAST_TERMS, 10])
def test_sixty_thousand_terms_match_brute_force(spark, most):
    rng = random.Random(11)
    letters = string.ascii_lowercase + "éß "
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(84_000)})
    assert len(terms) >= 60_000
    texts = ["".join(rng.choice(letters + ".") for _ in range(rng.randint(0, 160))) for _ in range(25)] + [None, "", "é", "😀ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    vocab = spark.createDataFrame([*enumerate(terms), (-1, None), (-2, "")], "term_id int, term string")
    hits = M.term_hits(rows, ["id"], "text", vocab, most=most)
    assert "Literal" not in hits._jdf.queryExecution().toString() and len(hits._jdf.queryExecution().toString()) < 60_000
    got = sorted(map(tuple, hits.collect()))
    assert got == sorted((i, k) for i, t in enumerate(texts) if t for k, w in enumerate(terms) if w in t)


def lines_of(spark, xs, hit="hit"):
    return spark.createDataFrame([(1, i, x, hit in x) for i, x in enumerate(xs)], "pat_deid long, i int, x string, hit boolean")


def test_trim_neighbourhoods(spark):
    s = ["hit one", "b1", "b2", "b3", "b4", "b5", "b6", "hit two"]
    notes = [(1, ". ".join(s), "2024-01-01"), (2, "no match here. at all", "2024-01-01"), (3, ". ".join(s[:3]), "2024-01-02")]
    df = T.sentences(spark.createDataFrame(notes, "pat_deid long, note string, effective_time string"))
    terms = spark.createDataFrame([("hit", "hit")], "term_id string, term string")
    got = {}
    for r in T.trim(df, terms).orderBy("pat_deid", "idx").collect():
        got.setdefault(r["pat_deid"], []).append(r["sentence"])
    assert got == {1: ["hit one", "b1", "b2", "b5", "b6", "hit two"], 3: s[:3]}
    assert T.trim(df, None).count() == df.count()
    assert T.trim(df, terms.limit(0)).count() == 0


def test_shorten_gaps(spark):
    lines = ["pre", "hit a", "x1", "x2", "hit b", "y1", "y2", "y3", "hit c", "post"]
    g = T.shorten_gaps(lines_of(spark, lines)).orderBy("i").collect()
    # gap 3 (a->b): nothing; gap 4 (b->c): deletes y2 only (b+2 .. c-2)
    assert [r["x"] for r in g] == ["pre", "hit a", "x1", "x2", "hit b", "y1", "y3", "hit c", "post"]
    assert [r["i"] for r in g] == list(range(9))


def test_shorten_budget_drops_longest_plus_two(spark):
    sents = ["hit " + "w " * 3, "a " * 6, "b " * 5, "c " * 5, "d " * 2, "e"]
    # total words = 4 + 6 + 5 + 5 + 2 + 1 = 23; budget 22 -> excess 1:
    # one sentence needed, the reference drops three (longest first, ties by position)
    kept = T.shorten_budget(lines_of(spark, sents), max_length=22).where("not dropped").orderBy("i").collect()
    assert [r["x"] for r in kept] == [sents[0], sents[4], sents[5]]
    assert T.shorten_budget(lines_of(spark, sents), max_length=23).where("dropped").count() == 0


def test_patient_sentences_keep_the_first_place(spark):
    rows = [(1, "k2", 2, 0, "b"), (1, "k1", 1, 1, "b"), (1, "k1", 1, 0, "a"), (1, "k3", 1, 0, "a"), (2, "k1", 1, 0, "a")]
    df = spark.createDataFrame(rows, "pat_deid long, note_key string, effective_time int, idx int, sentence string")
    notes = {r[0]: r[1] for r in T.patient_note(T.patient_sentences(df)).collect()}
    assert notes == {1: "a[SEP]b", 2: "a"}


def test_minimal_terms_property(spark):
    df = spark.createDataFrame([("pain",), ("low back pain",), ("PAIN",), ("nan",), (None,),
                                (" ha ",), ("ha",)], "term string")
    got = sorted(r[0] for r in V.minimal_terms(df, "term").collect())
    assert got == ["ha", "pain"]
    plan = V.minimal_terms(df, "term")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    grouped = spark.createDataFrame([("a", "pain"), ("b", "back pain"), ("b", "ache"), ("b", "headache")], "g string, term string")
    assert {tuple(r) for r in V.minimal_terms(grouped, "term", by=["g"]).collect()} == {("a", "pain"), ("b", "back pain"), ("b", "ache")}


def test_no_note_outside_its_window_enters_the_chain(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    notes = Q.wnotes(t)
    assert notes.count() > 0
    late = notes.join(anchor_sym(t).withColumnRenamed("hosp_admsn_time", "last"), "pat_deid").where(
        (F.col("encounter_date") > F.col("last")) | (F.col("encounter_date") < F.col("che_tx_date")))
    assert late.count() == 0
    assert {r[0] for r in notes.select("note_desc").distinct().collect()} <= set(Q.NOTE_TYPES_KEEP)


def test_mention_filter_and_trim_take_all_notes(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    want = {r[0] for r in t.notes.where(Q.F.lower("note").rlike("|".join(Q.SQL_TERMS))).select(F.md5("note")).collect()}
    inside = {r[0] for r in Q.wnotes(t).select(F.md5("note")).collect()}
    assert {r[0] for r in Q.t_mention_filter(t).select(F.md5("note")).collect()} == want
    assert {r["note_key"] for r in Q.t_trim(t).collect()} == want and want - inside


def test_cohort_chain_is_computed_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for df in (Q.t1(t), Q.mentions(t), anchor_sym(t)):
        assert not [f for f in df.inputFiles() if f.endswith(("events.parquet", "documents.parquet"))]


def test_labels_are_found_in_a_name_evaluated_once(spark):
    df = spark.createDataFrame([("Anemia and fever",), (None,), ("well",), ("gastritis",)], "dx_name string")
    rows = df.select(dx_short_expr().alias("x"))
    assert [r[0] for r in rows.collect()] == ["FEVER", None, None, "EMESIS"]
    assert rows._jdf.queryExecution().analyzed().toString().count("upper(dx_name") == 1


def test_note_window_keeps_the_first_of_equal_texts_and_null_ones(spark):
    anchor = spark.createDataFrame([(1, 0, 9)], "pat_deid long, che_tx_date int, hosp_admsn_time int")
    rows = [(1, 5, "a", 3, 0, "x"), (1, 4, "a", 3, 0, "x"), (1, 4, "a", 3, 0, "x"), (1, 6, None, 2, 0, "x"),
            (1, 7, None, 1, 0, "x"), (1, 8, "b", 10, 0, "x")]
    got = note_window(anchor, spark.createDataFrame(
        rows, "pat_deid long, note_id long, note string, encounter_date int, effective_time int, note_desc string"))
    assert sorted(r["note_id"] for r in got.collect()) == [4, 7]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [" in x and " note#" in x.split("]")[0] for x in plan.splitlines())


def test_grams_are_integers_and_sought_ones_alone_leave_the_texts(spark):
    rows = spark.createDataFrame([(1, "xéyabcabc"), (2, None), (3, "c"), (4, "")], "id int, _text string")
    code = int.from_bytes(b"abc", "big")
    assert [(r["id"], r["grams"]) for r in M.with_grams(rows, {3: [code]}).collect()] == [(1, [3 << 24 | code])]
    assert {r["id"]: len(r["grams"]) for r in M.with_grams(rows, {1: None}).collect()} == {1: 7, 3: 1}


def test_bands_of_blocks_equal_the_expression(spark):
    texts = ["", "a", "é\U0001f600", "abc", "the patient reports pain", "abcabcabc \U0001f600ü"]
    nodes = ND._nodes(spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], SENT))
    got, want = {}, {}
    for r in ND._bands(nodes, 8, 2).collect():
        got.setdefault(r["sid"], set()).add(r["band"].hex())
    for r in nodes.select("sid", ND.minhash_bands(F.col("sentence")).alias("b")).collect():
        want[r["sid"]] = set(r["b"])
    assert got == want


def test_candidates_join_on_one_integer(spark):
    nodes = ND._nodes(spark.createDataFrame([(1, 0, "abcdefghij"), (None, 1, "abcdefghij"), (1, 2, "abcdefghix"), (2, 0, "abcdefghiy")], SENT))
    pairs = ND.candidate_pairs(nodes)
    assert pairs.join(nodes.select("pat_deid", F.col("sid").alias("a")), ["pat_deid", "a"]).join(
        nodes.select("pat_deid", F.col("sid").alias("b")), ["pat_deid", "b"]).count() == 1
    assert "regexp" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_minimal_terms_read_their_source_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert not V.minimal_terms(t.note_ngrams, "term").inputFiles()


def test_notes_without_patient_or_time_are_filtered_and_trimmed(spark):
    notes = spark.createDataFrame([(None, "a hit. b. cc", "t1"), (1, "a hit. b. cc", None), (1, "a hit. b. cc", None), (1, None, "t1")],
                                  "pat_deid long, note string, effective_time string")
    terms = spark.createDataFrame([("hit", "hit")], "term_id string, term string")
    kept = T.mention_filter(notes, terms)
    assert {(r[0], r[2]) for r in kept.collect()} == {(None, "t1"), (1, None)} and kept.count() == 2
    assert T.trim(T.sentences(kept), terms).count() == 4


def syllables(rng, n):
    return "".join(rng.choice(["th", "er", "on", "the ", "tion", "ha", "ing ", "and "]) for _ in range(n))


def test_sentences_that_share_a_common_start_alone_are_no_candidates(spark):
    rng = random.Random(8)
    xs = ["and the " + "".join(rng.choice(string.ascii_lowercase) for _ in range(80)) for _ in range(200)]
    pairs = ND.candidate_pairs(ND._nodes(spark.createDataFrame([(1, i, x) for i, x in enumerate([*xs, xs[0] + "x"])], SENT)))
    assert 1 <= pairs.count() < 100  # of 20,100
    # the pairs are not shuffled: the only join is that with the large patients
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.mark.parametrize("chunk", [ND.CHUNK, 3000, 300])
def test_near_pairs_of_a_patient_in_chunks_equal_brute_force(spark, chunk):
    rng, rows = random.Random(9), [(None, 0, "abcdefghij"), (None, 1, "abcdefghix"), (7, 0, ""), (7, 1, None), (7, 2, "ab")]
    for pat in range(2):
        seen = {}
        for i in range(50):
            x = edited(rng, rng.choice(list(seen))) if seen and rng.random() < .5 else syllables(rng, rng.randrange(1, 14))
            seen.setdefault(x, i)
        rows += [(pat, i, x) for x, i in seen.items()]
    nodes = ND._nodes(spark.createDataFrame(rows, SENT))
    at = {(r["pat_deid"], r["sid"]): r["first_at"] for r in nodes.collect()}
    got = sorted((r["pat_deid"], at[r["pat_deid"], r["first"]], at[r["pat_deid"], r["later"]]) for r in ND.near_pairs(nodes, chunk=chunk).collect())
    want = sorted((p, i, j) for p, i, x in rows for r, j, y in rows if p == r and p is not None and i < j and x and y and similar(x, y))
    assert got == want and len(got) > 20


def test_small_patients_of_one_task_are_not_mixed(spark):
    rows = [(p, i, x) for p in range(3000) for i, x in enumerate([f"patient {p % 7} has pain since monday " + "é" * 60, f"patient {p % 7} had pain since monday " + "é" * 60])]
    nodes = ND._nodes(spark.createDataFrame(rows, SENT).coalesce(1))
    pairs = ND.near_pairs(nodes).collect()
    assert len(pairs) == 3000 and len({r["pat_deid"] for r in pairs}) == 3000


def test_marked_rows_match_by_value_and_a_null_key_matches_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (None, 1, "d"), (2, None, "e")], "k int, i int, x string")
    found = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None), (9, 9)], "k int, i int")
    got = R.marked(rows, found, ["k", "i"], ["k"], "hit")
    assert sorted((r["x"], r["hit"]) for r in got.collect()) == [("a", True), ("b", True), ("c", False), ("d", False), ("e", False)]


def test_a_sentence_is_sent_once_by_each_step(spark):
    notes = spark.createDataFrame([(1, "a hit. b. cc", "t1")], "pat_deid long, note string, effective_time string")
    terms = spark.createDataFrame([("hit", "hit")], "term_id string, term string")
    rows = T.sentences(notes)

    def exchanges(df):
        return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert len(exchanges(T.patient_sentences(rows))) == 1
    # the rows by note; the grams' hits by their key twice (term and row)
    trimmed = exchanges(T.trim(rows, terms))
    assert len([x for x in trimmed if "idx#" not in x]) == 1
    texts = spark.createDataFrame([(1, "a hit\nb")], "pat_deid long, txt string")
    lines = exchanges(T.shorten_gaps(T.text_sentences(texts, "txt", terms)))
    assert len([x for x in lines if " i#" not in x]) == 1
    # a frame to the end of a patient would be summed up anew for each line
    assert "unboundedfollowing" not in T.shorten_gaps(lines_of(spark, ["a"]))._jdf.queryExecution().optimizedPlan().toString().lower()
    # what stays of a patient is not sent again to be joined
    kept = ND.near_dup(spark.createDataFrame([(1, 0, "abcdefghij"), (1, 1, "abcdefghix")], SENT))
    assert len(exchanges(T.joined(kept, "\n", "txt"))) == 1


@pytest.mark.parametrize("name, kept", [("p_clean_text_notes", {"reduced-texts"}),
                                        ("t_shorten_budget", {"reduced-texts", "long-texts", "short-lines"}),
                                        ("t_dataset_select", {"reduced-texts", "long-texts", "short-lines"}),
                                        ("t_length_report", {"reduced-texts", "long-texts", "short-lines"})])
def test_texts_between_steps_are_kept_as_parquet(spark, monkeypatch, name, kept):
    seen, stored, cut = [], Q.stored, Q.cut_lineage

    def no_text(df):
        assert not {"sentence_list", "x", "txt"} & set(df.columns)
        return cut(df)
    monkeypatch.setattr(Q, "stored", lambda df, what: seen.append(what) or stored(df, what))
    monkeypatch.setattr(Q, "cut_lineage", no_text)
    Q.__dict__[name](Tables(spark, "/root/testdata/sf0.001"))
    assert kept <= set(seen)


def test_stored_texts_are_packed_tightly(spark):
    df = stored(spark.createDataFrame([(i, syllables(random.Random(i), 40)) for i in range(50)], "i int, x string"), "packed")
    assert all(".zstd." in f for f in df.inputFiles()) and df.count() == 50
