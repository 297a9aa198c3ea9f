"""Text operators (t_*): mentions, trimming, patient notes, near-duplicate removal,
shortening, final notes.

Notes become rows of sentences early, and stay rows: mentions come from the term index
(``match``), neighbourhoods are an equi join on positions, a patient's distinct sentences
are grouped by (patient, sentence hash), near duplicates are a pair table (``neardup``),
and shortening is a window over a patient's sentences. Only the text that a query returns
is put together again, in the end.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEP, sentence_split, word_count_clean
from .match import mentioning, term_hits
from .relational import marked

FIRST_ORDER = ("effective_time", "note_key")


def fold_column(name: str, fold: str) -> Column:
    return F.upper(name) if fold == "upper" else F.lower(name)


def folded_terms(lexicon: DataFrame, term: str = "term", term_id: str = "term_id", fold: str = "lower") -> DataFrame:
    """(term_id, term) with the terms' case folded as the texts' will be."""
    return lexicon.select(F.col(term_id).alias("term_id"), fold_column(term, fold).alias("term"))


def _hits(rows: DataFrame, key: Sequence[str], text: str, terms: DataFrame, fold: str = "lower") -> DataFrame:
    folded = rows.select(*key, fold_column(text, fold).alias("_folded"))
    return term_hits(folded, key, "_folded", terms)


def doc_terms(notes: DataFrame, lexicon: DataFrame, id_col: str = "note_id", text_col: str = "note",
              fold: str = "upper") -> DataFrame:
    """t_doc_term: (note, pos, term_id) for every lexicon term contained in the note, in
    lexicon order (by term_id)."""
    hits = _hits(notes, [id_col], text_col, folded_terms(lexicon, fold=fold), fold)
    w = Window.partitionBy(id_col).orderBy("term_id")
    return hits.select(id_col, (F.row_number().over(w) - 1).alias("pos"), "term_id")


def _whose() -> Column:
    """Patient and time of a note as one join key; a missing one is a value like any other."""
    return F.xxhash64("pat_deid", F.lit("at"), "effective_time")


def mention_filter(notes: DataFrame, terms: DataFrame) -> DataFrame:
    """t_mention_filter: notes with a mention; distinct (patient, note, time). Terms are
    lower-case; an empty vocabulary matches no note."""
    rows = notes.select("pat_deid", "note", "effective_time", F.md5("note").alias("note_key"), _whose().alias("_at"))
    key = ["note_key", "_at"]
    found = mentioning(rows.withColumn("note", F.lower("note")), key, "note", terms)
    # Repeats go by the join's own key, so a text is shuffled once and is no key itself.
    return rows.join(found, key, "left_semi").dropDuplicates([*key, "pat_deid", "effective_time"]).select(
        "pat_deid", "note", "effective_time")


def sentences(notes: DataFrame) -> DataFrame:
    """(pat_deid, note_key, effective_time, idx, sentence) of every note."""
    split = notes.withColumn("note_key", F.md5("note"))
    return split.select("pat_deid", "note_key", "effective_time", F.posexplode(sentence_split("note")).alias("idx", "sentence"))


def trim(rows: DataFrame, terms: DataFrame | None, n: int = 2) -> DataFrame:
    """t_trim / w_neighborhood: the sentences within n places of a mentioning one;
    ``terms`` None keeps every sentence (the reference's with_vocabulary=False)."""
    if terms is None:
        return rows
    columns, key = rows.columns, ["note_key", "_at", "idx"]
    rows = rows.withColumn("_at", _whose())
    hit = mentioning(rows.withColumn("sentence", F.lower("sentence")), key, "sentence", terms)
    near = Window.partitionBy(*key[:2]).orderBy("idx").rangeBetween(-n, n)
    rows = marked(rows, hit, key, key[:2], "_hit")
    return rows.withColumn("_near", F.max("_hit").over(near)).where("_near").select(*columns)


def patient_sentences(trimmed: DataFrame, order: Sequence[str] = FIRST_ORDER) -> DataFrame:
    """(pat_deid, sentence, first_at): a patient's distinct sentences with the place of
    their first occurrence (time, md5 of the note as a stable tie-break, position).

    Rows are grouped by (patient, sentence), so a sentence is sent once, by the one grouping."""
    key = F.struct(*[F.col(c) for c in order], F.col("idx"))
    return trimmed.where("pat_deid is not null").groupBy("pat_deid", "sentence").agg(F.min(key).alias("first_at"))


def joined(rows: DataFrame, sep: str, out: str, key: str = "pat_deid", order: str = "first_at", text: str = "sentence",
           *more: Column) -> DataFrame:
    """The texts of a key in order, joined: the output format of the patient notes."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(key).agg(held.alias("_s"), *more).withColumn(
        out, F.array_join(F.transform("_s", lambda x: x["t"]), sep)).drop("_s")


def patient_note(rows: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """t_patient_note: a patient's distinct sentences joined by '[SEP]'; with outcomes,
    patients without a sentence keep a null text."""
    agg = joined(rows, SEP, "sentence_list").select("pat_deid", "sentence_list")
    return agg if outcomes is None else agg.join(outcomes, "pat_deid", "right")


def text_sentences(df: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(pat_deid, i, x, hit): the lines of a patient's text and whether each mentions a term."""
    rows = df.select("pat_deid", F.posexplode(F.split(F.col(text_col), "\n\n|\n")).alias("i", "x"))
    hits = mentioning(rows.withColumn("x", F.lower("x")), ["pat_deid", "i"], "x", terms)
    return marked(rows, hits, ["pat_deid", "i"], ["pat_deid"], "hit")


def shorten_gaps(lines: DataFrame) -> DataFrame:
    """t_shorten_gaps / w_gap_delete: between consecutive mentioning lines y < z with
    z - y > 3, lines y+2 .. z-2 go. One pass forwards and one backwards carry the mention
    before and after each line along; ``i`` is numbered anew."""
    w = Window.partitionBy("pat_deid").orderBy("i")
    at = F.when(F.col("hit"), F.col("i"))
    back = Window.partitionBy("pat_deid").orderBy(F.desc("i"))
    last = F.last(at, ignorenulls=True)
    before, after = (last.over(x.rowsBetween(Window.unboundedPreceding, -1)) for x in (w, back))
    kept = lines.withColumn("_y", before).withColumn("_z", after).where(
        F.col("hit") | F.col("_y").isNull() | F.col("_z").isNull() | (F.col("_z") - F.col("_y") <= 3)
        | (F.col("i") < F.col("_y") + 2) | (F.col("i") > F.col("_z") - 2))
    return kept.withColumn("i", F.row_number().over(w) - 1).drop("_y", "_z")


def shorten_budget(lines: DataFrame, max_length: int = 512, overshoot: int = 2) -> DataFrame:
    """t_shorten_budget / w_cumsum_budget: adds ``dropped``. If the lines are still over
    the budget, the longest lines without a mention go (then the earliest): as many as
    cover the excess, and ``overshoot`` more (2 as the reference). ``i`` numbers the lines."""
    rows = lines.withColumn("_n", word_count_clean("x"))
    whole = Window.partitionBy("pat_deid")
    rows = rows.withColumn("_excess", F.sum("_n").over(whole) - max_length)
    order = Window.partitionBy("pat_deid", "hit").orderBy(F.desc("_n"), "i")
    rows = (rows.withColumn("_r", F.row_number().over(order))
            .withColumn("_cum", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    short = F.sum((F.col("_cum") < F.col("_excess")).cast("int")).over(Window.partitionBy("pat_deid", "hit"))
    return rows.withColumn("dropped", ~F.col("hit") & (F.col("_excess") > 0) & (F.col("_r") <= short + 1 + overshoot)).drop(
        "_n", "_excess", "_r", "_cum")
