"""Cohort operators (c_*): follow-up window, day-0 rule, symptom labels,
ACU anchor, note window, note-type routing.

All are per-patient aggregates + joins on the patient id; aggregates are
partial (map-side) so a patient holding a third of all rows does not land in
one task before the shuffle, and the joins are left to AQE (runtime broadcast
when the small side turns out small, skew-split otherwise).
"""
from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.timex import floor_days, ts_literal

# Fixed values (must equal the reference): symptom label -> upper-case
# fragments searched in DX_NAME, listed in the reference's assignment order;
# a later label overwrites an earlier one.
DX_RULES = [
    ("ANEMIA", ["ANEM", "RED CELL"]),
    ("DEHYDRATION", ["DEHY", "HYPERNAT"]),
    ("DIARRHEA", ["DIAR"]),
    ("NAUSEA", ["NAUS"]),
    ("EMESIS", ["EMES", "VOMIT", "GASTROENTER", "GASTRIT"]),
    ("FEVER", ["FEVER", "FEBRILE", "HYPERTHERM", "PYREX"]),
    ("NEUTROPENIA", ["NEUT", "PANCY", "AGRAN"]),
    ("PAIN", ["PAIN", "HEADACH", "ALGIA", "DYSURIA", "DYNIA", "ACHE", "PRESSURE",
              "DISCOMFORT", "CRAMP", "TIGHTNESS", "RADICULOPATHY", "TENDERNES",
              "ABDOMINAL CRIS"]),
    ("PNEUMONIA", ["PNEUMO", "CONSOLID"]),
    ("SEPSIS", ["SEPS", "INFLAM", "CANDIDEMIA", "SEPTIC"]),
]

# Adverse-event class of each symptom label.
AE_CLASSES = [
    ("CLASS_1", ["PAIN"]),
    ("CLASS_2", ["NAUSEA", "EMESIS", "DEHYDRATION", "DIARRHEA"]),
    ("CLASS_3", ["ANEMIA"]),
    ("CLASS_4", ["FEVER", "NEUTROPENIA", "SEPSIS", "PNEUMONIA"]),
]
ED = "Emergency Services"
INPATIENT = "Inpatient"


def enrich_left(events: DataFrame, other: DataFrame, keys: list[str],
                cols: list[str]) -> DataFrame:
    """j_left_multikey / j_left_sixkey (c_enrich_*): left equi join on several
    keys (null keys never match) then DISTINCT, as the warehouse SQL does."""
    o = other.select(*keys, *cols)
    return events.join(o, on=keys, how="left").distinct()


def followup(enc: DataFrame, start: str = "2013-01-01 00:00:00", max_days: int = 30,
             t_event: str = "hosp_admsn_time", t_start: str = "che_tx_date") -> DataFrame:
    """c_followup_30d: offset in floored days; start on/after ``start`` and
    offset <= max_days. No lower bound: events before treatment stay."""
    return (enc.withColumn("che_to_hosp", floor_days(t_event, t_start))
            .where((F.col(t_start) >= ts_literal(start)) & (F.col("che_to_hosp") <= max_days)))


def day0_patients(op: DataFrame) -> DataFrame:
    """a_having_sum_zero: per patient, some offset = 0 and offsets sum to 0,
    with the flag whether that patient has an ED row."""
    return (op.groupBy("pat_deid")
            .agg(F.sum("che_to_hosp").alias("offset_sum"),
                 F.max((F.col("che_to_hosp") == 0).cast("int")).alias("has_day0"),
                 F.max((F.col("pt_class") == ED).cast("int")).alias("has_ed"))
            .where((F.col("has_day0") == 1) & (F.col("offset_sum") == 0)))


def exclude_day0_ed(op: DataFrame) -> DataFrame:
    """c_exclude_day0_ed: drop every row of patients whose offsets sum to 0,
    contain a 0, and include an Emergency Services row."""
    bad = day0_patients(op).where(F.col("has_ed") == 1).select("pat_deid")
    return op.join(bad, "pat_deid", "left_anti")


def _holds_any(x, frags: Iterable[str]):
    return functools.reduce(operator.or_, [x.contains(f) for f in frags])


def dx_short_expr(col: str = "dx_name"):
    """c_dx_short label: CASE in reverse assignment order (last rule wins)."""
    def label_of(name):
        e = F.lit(None).cast("string")
        for label, frags in DX_RULES:  # earlier rules are the inner (lower-priority) ones
            e = F.when(_holds_any(name, frags), F.lit(label)).otherwise(e)
        return e
    return let(F.upper(col), label_of)  # the name, often a long CASE, is evaluated once


def dx_short(df: DataFrame, col: str = "dx_name") -> DataFrame:
    """c_dx_short: distinct rows, add dx_short, drop unlabelled rows."""
    return (df.distinct().withColumn("dx_short", dx_short_expr(col))
            .where(F.col("dx_short").isNotNull()))


def ae_class_expr(col: str = "dx_short"):
    e = F.lit(None).cast("string")
    for cls, labels in AE_CLASSES:  # later class wins, as the reference's .loc order
        e = F.when(_holds_any(F.col(col), labels), F.lit(cls)).otherwise(e)
    return e


def acu_anchor(op: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """c_acu_anchor: last admission per patient (one row per patient), left
    joined to the cohort table."""
    last = op.groupBy("pat_deid").agg(F.max("hosp_admsn_time").alias("hosp_admsn_time"))
    return last if cohort is None else last.join(cohort, "pat_deid", "left")


def notes_in_window(anchor: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows of ``notes`` whose encounter_date lies in [che_tx_date, last admission]."""
    return (anchor.select("pat_deid", "che_tx_date", F.col("hosp_admsn_time").alias("anchor_time"))
            .join(notes, "pat_deid")
            .where((F.col("encounter_date") <= F.col("anchor_time"))
                   & (F.col("encounter_date") >= F.col("che_tx_date"))))


def note_window(anchor: DataFrame, notes: DataFrame) -> DataFrame:
    """c_note_window: notes with encounter_date in [che_tx_date, last admission]
    (equi join on patient + range residual), one row per (patient, note text), the
    earliest (encounter_date, note_id). Texts are told apart by their hash, so they are
    no aggregation key and are shuffled once, to be chosen."""
    cols = ["pat_deid", "note_id", "note", "encounter_date", "effective_time", "note_desc"]
    rows = notes_in_window(anchor, notes).select(
        *cols, F.coalesce(F.md5("note"), F.lit("")).alias("_h"), F.struct("encounter_date", "note_id").alias("_first"))
    first = rows.groupBy("pat_deid", "_h").agg(F.min("_first").alias("_first"))
    key = ["pat_deid", "_h", "_first"]
    return rows.join(first, key, "left_semi").dropDuplicates(key).select(
        "pat_deid", "note", "note_id", "encounter_date", "effective_time", "note_desc")


def has_note(events: DataFrame, notes_in_window: DataFrame) -> DataFrame:
    """c_has_note: re-restrict events to patients with >= 1 note (semi join)."""
    return events.join(notes_in_window.select("pat_deid"), "pat_deid", "left_semi")


def ed_hosp_sets(events: DataFrame) -> DataFrame:
    """c_ed_hosp_sets: per patient, ED-only / inpatient-only / both."""
    f = (events.groupBy("pat_deid")
         .agg(F.max((F.col("pt_class") == ED).cast("int")).alias("ed"),
              F.max((F.col("pt_class") == INPATIENT).cast("int")).alias("hosp")))
    grp = (F.when((F.col("ed") == 1) & (F.col("hosp") == 1), "both")
           .when(F.col("ed") == 1, "ed_only").when(F.col("hosp") == 1, "hosp_only"))
    return f.select("pat_deid", grp.alias("visit_group")).where(F.col("visit_group").isNotNull())


def note_type_route(notes: DataFrame, events: DataFrame,
                    ed_type: str = "ED Provider Notes", hosp_type: str = "H&P") -> DataFrame:
    """c_note_type_route: ED notes for ED patients, H&P notes for inpatients."""
    ed_ids = events.where(F.col("pt_class") == ED).select("pat_deid")
    hosp_ids = events.where(F.col("pt_class") == INPATIENT).select("pat_deid")
    a = notes.where(F.col("note_desc") == ed_type).join(ed_ids, "pat_deid", "left_semi")
    b = notes.where(F.col("note_desc") == hosp_type).join(hosp_ids, "pat_deid", "left_semi")
    return a.unionByName(b)


def note_type_list(notes: DataFrame, types: Iterable[str]) -> DataFrame:
    """c_note_type_list: keep note types in a list."""
    return notes.where(F.col("note_desc").isin(list(types)))
