"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned and fully executed into Spark's no-op sink (no driver
collect), after one warm-up query. Prints ONE JSON line on stdout.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.plans import QUERIES  # noqa: E402
from cohortlens.session import local_session  # noqa: E402
from cohortlens.sources.tables import Tables  # noqa: E402

HEADLINE = [
    "o_table_1",          # cohort -> day-0 rule -> symptom labels -> outcome table
    "c_note_window",      # equi + range join of notes to the follow-up window
    "r_stats_table",      # per-patient report aggregates
    "t_doc_term",         # note x lexicon matching
    "t_patient_note",     # trim + per-patient ordered dedupe
    "t_near_dup",         # greedy near-duplicate fold
    "t_final_notes",      # the whole preprocessing chain incl. shortening
    "v_occurrence",       # vocabulary occurrence on single-label notes
    "x_stratified_kfold", # exact distributed stratified ranks
    "g_pmi",              # windows -> pair counts -> PMI
    "g_neighbor_mean",    # neighbour aggregate of whole vectors
    "m_auc",              # ROC-AUC with tie handling
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="cohortlens-bench")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = only or HEADLINE
    # warm-up: JVM, parquet footers, codegen caches
    QUERIES["m_confusion"](Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        df = QUERIES[name](Tables(spark, sf_dir))
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
