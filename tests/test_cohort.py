import datetime as dt

from pyspark.sql import functions as F

from cohortlens.operators import cohort as C
from cohortlens.operators import outcome as O

BASE = dt.datetime(2024, 1, 1, 8)


def enc(spark, rows):
    """rows: (pat, enc_id, day offset, pt_class, dx_name)."""
    data = [(e, p, BASE + dt.timedelta(days=d, hours=1), BASE + dt.timedelta(days=d, hours=5),
             BASE, cls, dx) for p, e, d, cls, dx in rows]
    return spark.createDataFrame(
        data, "enc_id long, pat_deid long, hosp_admsn_time timestamp_ntz, "
              "hosp_dischrg_time timestamp_ntz, che_tx_date timestamp_ntz, pt_class string, dx_name string")


def test_day0_rule(spark):
    ed, ip = C.ED, C.INPATIENT
    rows = [(1, 1, 0, ed, "Pain"),                                   # {0}
            (2, 2, 0, ed, "Pain"), (2, 3, 0, ip, "Pain"),            # {0,0}
            (3, 4, 0, ed, "Pain"), (3, 5, -1, ip, "Pain"), (3, 6, 1, ip, "Pain"),  # {0,-1,1}
            (4, 7, 0, ed, "Pain"), (4, 8, 5, ip, "Pain"),            # {0,5}: kept
            (5, 9, 0, ip, "Pain")]                                   # day-0 inpatient only: kept
    op = C.followup(enc(spark, rows))
    kept = {r[0] for r in C.exclude_day0_ed(op).select("pat_deid").distinct().collect()}
    assert kept == {4, 5}


def test_dx_short_precedence(spark):
    rows = [(1, 1, 1, C.ED, "Sepsis due to pneumonia"), (1, 2, 1, C.ED, "Febrile neutropenia"),
            (1, 3, 1, C.ED, None), (1, 4, 1, C.ED, "Essential hypertension")]
    got = {r[0]: r[1] for r in C.dx_short(enc(spark, rows)).select("enc_id", "dx_short").collect()}
    assert got == {1: "SEPSIS", 2: "NEUTROPENIA"}


def test_outcome_tables_worked_example(spark):
    # nausea x3 + vomiting x2: table 1 -> 1, table 2 -> 2, table 3 -> 5 in class_2
    rows = [(1, i, 1, C.ED, "Nausea") for i in range(3)] + \
           [(1, 10 + i, 2, C.ED, "Vomiting") for i in range(2)]
    sym = C.dx_short(enc(spark, rows))
    su = O.symptom_unique(sym)
    t1 = O.table_1(O.ae_class(su)).collect()[0]
    t2 = O.table_2(su).collect()[0]
    t3 = O.table_3(sym).collect()[0]
    assert (t1["class_2"], t2["class_2"], t3["class_2"]) == (1, 2, 5)
    assert t1["classes"] == ["class_2"] and t1["total"] == 1


def test_table_one_keeps_the_given_order_and_empty_levels(spark):
    from cohortlens.operators import report as RP
    classes = spark.createDataFrame([(1, "CLASS_1"), (2, "CLASS_1"), (2, "CLASS_2"), (3, "CLASS_2")],
                                    "pat_deid long, ae_class string")
    patients = spark.createDataFrame(
        [(1, "Female", 50.0, "White", "x"), (2, "Male", 60.0, "Unknown", "x"), (3, "Female", 70.0, None, "y")],
        "pat_deid long, sex string, age_at_dx double, race string, grp string")
    rows = RP.table_one(classes, patients, categorical=("race", "grp")).collect()
    got = {(r["ae_class"], r["variable"], r["level"]): (r["position"], r["n"], r["pct"]) for r in rows}
    races = [x for _, x in sorted((v[0], k[2]) for k, v in got.items() if k[:2] == ("CLASS_1", "race"))]
    assert races == ["Asian", "White", "Black", "Other"]
    assert got["CLASS_1", "race", "Asian"] == (1, 0, 0.0) and got["CLASS_2", "race", "Other"] == (4, 1, 100.0)
    assert got["ALL", "sex", "Female"] == (1, 2, 66.666667) and ("ALL", "sex", "Male") not in got
    assert got["CLASS_1", "grp", "y"] == (2, 0, 0.0)
    age = {r["ae_class"]: (r["n"], r["mean"]) for r in rows if r["variable"] == "age_at_dx"}
    assert age == {"CLASS_1": (2, 55.0), "CLASS_2": (2, 65.0), "ALL": (3, 60.0)}


def test_left_joins_leave_rows_and_missing_keys_unmatched(spark):
    import __spark_entry__ as E
    for name, col, key in (("j_left_multikey", "tax_before", "l_returnflag"), ("j_left_sixkey", "flag", "event_type")):
        rows = E.queries()[name](spark, "/root/testdata/sf0.001").collect()
        assert any(r[col] is None and r[key] is not None for r in rows) and any(r[col] is not None for r in rows)
        missing = [r[col] for r in rows if r[key] is None]
        assert missing and set(missing) == {None}
