"""Outcome operators (o_*): multi-label adverse-event tables per patient.

One partial aggregate per table (group by patient); the class pivot uses
fixed values so no extra pass discovers the pivot columns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cohort import AE_CLASSES, ae_class_expr
from .relational import dedupe_first

CLASS_COLS = [c.lower() for c, _ in AE_CLASSES]
EVENT_ORDER = ["hosp_admsn_time", "enc_id"]


def symptom_unique(sym: DataFrame, order=EVENT_ORDER) -> DataFrame:
    """o_symptom_unique: one row per (patient, dx_short), earliest event kept."""
    return dedupe_first(sym, ["pat_deid", "dx_short"], order)


def ae_class(sym_unique: DataFrame, order=EVENT_ORDER) -> DataFrame:
    """o_ae_class: dx_short -> ae_class; one row per (patient, class)."""
    return dedupe_first(sym_unique.withColumn("ae_class", ae_class_expr("dx_short")),
                        ["pat_deid", "ae_class"], order)


def _flags(df: DataFrame) -> DataFrame:
    cls = ae_class_expr("dx_short")
    return df.select("pat_deid", *[(cls == c.upper()).cast("int").alias(c) for c in CLASS_COLS])


def _per_patient_sum(df: DataFrame) -> DataFrame:
    s = _flags(df).groupBy("pat_deid").agg(
        *[F.sum(c).cast("int").alias(c) for c in CLASS_COLS])
    return s.withColumn("total", sum(F.col(c) for c in CLASS_COLS).cast("int"))


def table_1(classes: DataFrame) -> DataFrame:
    """o_table_1: binary class flags, sorted lower-case class list, total."""
    f = (classes.groupBy("pat_deid")
         .agg(*[F.max((F.col("ae_class") == c.upper()).cast("int")).alias(c) for c in CLASS_COLS],
              F.array_sort(F.collect_set(F.lower("ae_class"))).alias("classes")))
    return f.withColumn("total", sum(F.col(c) for c in CLASS_COLS).cast("int"))


def table_2(sym_unique: DataFrame) -> DataFrame:
    """o_table_2: number of distinct symptoms per class, total."""
    return _per_patient_sum(sym_unique)


def table_3(sym: DataFrame) -> DataFrame:
    """o_table_3: number of events per class, total."""
    return _per_patient_sum(sym)
