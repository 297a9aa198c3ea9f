import tempfile
import uuid

from pyspark.sql import functions as F

from cohortlens.functions.text import word_count_clean
from cohortlens.streaming import run_incremental


def test_incremental_word_counts(spark):
    src = tempfile.mkdtemp(prefix="cl-src-")
    out = tempfile.mkdtemp(prefix="cl-out-") + "/sink"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.write.mode("overwrite").parquet(src + "/part1")
    q = run_incremental(spark, src + "/part1", docs.schema,
                        lambda b: b.select("doc_id", word_count_clean("text").alias("n")), out,
                        name=f"test-wc-{uuid.uuid4().hex}")  # fresh stream state per run
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == docs.count()
    assert got.where(F.col("n").isNull()).count() == docs.where(F.col("text").isNull()).count()
