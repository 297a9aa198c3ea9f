"""Report operators (r_*, a_table_one): patient/stats tables, characterization.

All are grouped aggregates plus joins on the patient id; the class-stratified
percentages use a window partitioned by class over already-aggregated counts
(a handful of rows per class), never over raw rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import word_count
from ..session import cut_lineage
from .quantile import quantiles

# Fixed values (must equal the reference): many-to-one recodes applied to
# every string column before characterization.
RECODE_TO_OTHER = ["Other", "Hawaiian or Pacific Islander",
                   "Ethnic group not given - patient refused", "Native American", "Unknown",
                   "Patient Refused"]

# Fixed values (must equal the reference): the order of levels in table one.
LEVEL_ORDER = {"race": ["Asian", "White", "Black", "Other"],
               "ethnic_group": ["Hispanic/Latino", "Non-Hispanic/Non-Latino", "Other"],
               "insurance_payor": ["MEDICARE", "PRIVATE", "MediCal_MEDICAID"],
               "stage_four": ["1.0", "2.0", "3.0", "4.0"]}

STAT_MEASURES = ["note_count", "avg_word_count_note", "class_count",
                 "distinct_symptom_count", "symptom_count"]


def replace_all(df: DataFrame, values: list[str], to: str = "Other") -> DataFrame:
    """p_replace_map: recode listed values to one value on all string columns."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(values), F.lit(to)).otherwise(c).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def patient_table(notes: DataFrame, classes: DataFrame, sym_unique: DataFrame,
                  sym: DataFrame) -> DataFrame:
    """r_patient_table: per patient note count, mean words per note, class,
    distinct-symptom and symptom counts. Without notes the count is missing, so that
    means and minima skip it, as the source's left merge does."""
    n = notes.groupBy("pat_deid").agg(F.count(F.lit(1)).alias("note_count"),
                                      F.avg(word_count("note")).alias("avg_word_count_note"))
    k = classes.groupBy("pat_deid").agg(F.count(F.lit(1)).alias("class_count"))
    u = sym_unique.groupBy("pat_deid").agg(F.count(F.lit(1)).alias("distinct_symptom_count"))
    s = sym.groupBy("pat_deid").agg(F.count(F.lit(1)).alias("symptom_count"))
    return (k.join(n, "pat_deid", "left").join(u, "pat_deid").join(s, "pat_deid")
            .select("pat_deid", "note_count", "avg_word_count_note", "class_count", "distinct_symptom_count",
                    "symptom_count"))


def stats_table(pt: DataFrame) -> DataFrame:
    """r_stats_table: one row with mean/median/min/max of each measure + totals. The patient
    table is written once; the medians are selected by rank, all measures in one pass."""
    pt = cut_lineage(pt)
    long = pt.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                                         for m in STAT_MEASURES])).alias("m")).select("m.*")
    medians = quantiles(long, "value", {"median": 0.5}, ["measure"]).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"{m}_median") for m in STAT_MEASURES])
    aggs = []
    for m in STAT_MEASURES:
        aggs += [F.avg(m).alias(f"{m}_mean"),
                 F.min(m).cast("double").alias(f"{m}_min"),
                 F.max(m).cast("double").alias(f"{m}_max")]
    aggs += [F.count(F.lit(1)).alias("n_patients"),
             F.sum("note_count").cast("bigint").alias("n_notes")]
    one = F.lit(0).alias("_one")
    return pt.agg(*aggs).withColumn("_one", one).join(medians.withColumn("_one", one), "_one").drop("_one")


def characterize(classes: DataFrame, patients: DataFrame) -> DataFrame:
    """r_characterize: demographics of each (patient, class), recoded."""
    j = classes.select("pat_deid", "ae_class").join(patients, "pat_deid")
    return replace_all(j, RECODE_TO_OTHER)


def characterize_cohort(classes: DataFrame, patients: DataFrame) -> DataFrame:
    """r_characterize (cohort version): drop the class, distinct rows."""
    return characterize(classes, patients).drop("ae_class").distinct()


def table_one(classes: DataFrame, patients: DataFrame,
              categorical=("race", "ethnic_group", "cancer_group", "stage_four", "insurance_payor"),
              single_level: dict | None = None, numeric=("age_at_dx",), order: dict | None = None) -> DataFrame:
    """a_table_one: per class (and 'ALL'): n and % of non-null rows for each
    categorical level; mean and SD for numeric columns. ``single_level`` keeps
    one level of a binary variable (the reference shows one SEX row). Levels stand at a
    ``position``: those of ``order`` first, others found behind them in their own order;
    every class has a row for every level, with 0 where it has none."""
    single_level = single_level if single_level is not None else {"sex": "Female"}
    order = order if order is not None else LEVEL_ORDER
    by_class = characterize(classes, patients)
    overall = characterize_cohort(classes, patients).withColumn("ae_class", F.lit("ALL"))
    j = cut_lineage(by_class.unionByName(overall))
    variables = [*single_level, *categorical]
    levels = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables])
    counts = (j.select("ae_class", F.explode(levels).alias("x")).select("ae_class", "x.*").where("level is not null")
              .groupBy("ae_class", "variable", "level").agg(F.count(F.lit(1)).alias("n")))
    counts = cut_lineage(counts)  # a row for each class and level
    given = j.sparkSession.createDataFrame(
        [(v, x, i) for v, xs in order.items() if v in variables for i, x in enumerate(xs)],
        "variable string, level string, given int")
    every = counts.select("variable", "level").distinct().join(given, ["variable", "level"], "full")
    every = every.withColumn("position", F.row_number().over(
        Window.partitionBy("variable").orderBy(F.col("given").asc_nulls_last(), "level"))).drop("given")
    names = j.select(F.collect_set("ae_class")).scalar()
    grid = every.withColumn("ae_class", F.explode(names))
    total = F.sum("n").over(Window.partitionBy("ae_class", "variable"))
    cat = (grid.join(counts, ["ae_class", "variable", "level"], "left").na.fill(0, ["n"])
           .withColumn("pct", F.round(100.0 * F.col("n") / F.nullif(total, F.lit(0)), 6)))
    for v, level in single_level.items():
        cat = cat.where((F.col("variable") != v) | (F.col("level") == level))
    missing = F.lit(None).cast("double")
    cat = cat.select("ae_class", "variable", "position", "level", "n", "pct", missing.alias("mean"), missing.alias("sd"))
    values = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in numeric])
    num = j.select("ae_class", F.explode(values).alias("x")).select("ae_class", "x.*").groupBy("ae_class", "variable").agg(
        F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("level"), F.count("value").alias("n"),
        missing.alias("pct"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    return cat.unionByName(num)
