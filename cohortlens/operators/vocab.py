"""Vocabulary operators (v_*): assemble, occurrence, minimal terms, review
drop, cross-class assignment, profile.

Terms are matched through the inverted index of ``match``, against notes or against
each other, so neither a vocabulary nor the notes have a size limit.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .relational import add_new_terms
from .match import term_hits

CLASSES = ["class_1", "class_2", "class_3", "class_4"]


def assemble(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """v_assemble: union of (name, diagnose) sources in priority order,
    lower-cased; per class the first source that has a term wins and tags TYPE."""
    tagged = [s.select(F.lower("name").alias("name"), "diagnose", F.lit(tag).alias("type"))
              .where(F.col("name").isNotNull()) for tag, s in sources]
    return add_new_terms(tagged, ["diagnose", "name"])


def single_label_notes(notes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Notes of patients with exactly one class, tagged with that class."""
    cls = F.coalesce(*[F.when(F.col(c) == 1, F.lit(c)) for c in CLASSES])
    return (notes.join(outcomes.where(F.col("total") == 1), "pat_deid")
            .select("note_id", "note", cls.alias("diagnose")))


def occurrence(vocab: DataFrame, notes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """v_occurrence: per class, number of notes of that class's single-label
    patients containing the term (upper-cased containment); zero rows dropped.

    Notes are matched against the distinct terms once, with their class carried along."""
    v = vocab.select("name", "diagnose").distinct()
    terms = v.select(F.col("name").alias("term_id"), F.upper("name").alias("term")).distinct()
    sl = single_label_notes(notes, outcomes).withColumn("note", F.upper("note"))
    hits = term_hits(sl, ["note_id", "diagnose"], "note", terms)
    counts = hits.groupBy(F.col("term_id").alias("name"), "diagnose").agg(F.count_distinct("note_id").alias("occurence"))
    return v.join(counts, ["name", "diagnose"]).select("name", "diagnose", "occurence")


def minimal_terms(terms: DataFrame, col: str = "name", by: Sequence[str] = ()) -> DataFrame:
    """v_minimal_terms / j_term_nested: lower-case, drop 'nan'/null, unique, then drop
    every term that contains another term (within ``by`` groups). Terms are matched
    against each other through the index; an equi anti join drops the containing ones."""
    t = cut_lineage(terms.select(*by, F.lower(col).alias("name"))
                    .where(F.col("name").isNotNull() & (F.col("name") != "nan")).distinct())
    names = t.select("name").distinct()
    nested = (term_hits(names.withColumn("text", F.col("name")), ["name"], "text",
                        names.select(F.col("name").alias("term_id"), F.col("name").alias("term")))
              .where(F.col("name") != F.col("term_id")))
    if not by:
        return t.join(nested, "name", "left_anti")
    inner = t.withColumnRenamed("name", "term_id")
    outer = t.join(nested, "name").join(inner, [*by, "term_id"], "left_semi")
    return t.join(outer, [*by, "name"], "left_anti")


def feedback_drop(vocab: DataFrame, reviewed: DataFrame) -> DataFrame:
    """v_feedback_drop: remove reviewed (class, term) pairs."""
    return vocab.join(reviewed.select("name", "diagnose"), ["name", "diagnose"], "left_anti")


def cross_class(occ: DataFrame, class_sizes: DataFrame) -> DataFrame:
    """v_cross_class: a term listed under several classes goes to the class with
    the highest share of that class's notes containing it (ties: class name)."""
    s = occ.join(class_sizes, "diagnose").withColumn(
        "share", F.col("occurence") / F.col("n_notes"))
    w = Window.partitionBy("name").orderBy(F.desc("share"), "diagnose")
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def class_sizes(notes: DataFrame, outcomes: DataFrame) -> DataFrame:
    return (single_label_notes(notes, outcomes).groupBy("diagnose")
            .agg(F.count(F.lit(1)).alias("n_notes")))


def profile(vocab: DataFrame) -> DataFrame:
    """v_profile: vocabulary size per class and per (class, type)."""
    a = vocab.groupBy("diagnose").agg(F.lit("ALL").alias("type"), F.count(F.lit(1)).alias("n"))
    b = vocab.groupBy("diagnose", "type").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)
