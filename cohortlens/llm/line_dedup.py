"""10. Line dedup with levelled sorted runs of line hashes.

Documents come in batches, largest ids first. A batch's distinct line hashes are
merge-joined with the runs written so far: hashes that no run has are fresh, and
the batch names their keeper; the others add to a count. Each batch adds one run
sorted by hash, and runs of one level are compacted into one of the next.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, scratch

BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 4
RUN_SCHEMA = "h1 long, h2 long, n long, keeper long"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANK)))


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, t, pos, h1, h2) of every line long enough; 128 bits stand for its key."""
    each = docs.select("id", "t", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = each.withColumn("k", line_key(F.col("line"))).where(F.length("k") >= min_chars)
    return key.select("id", "t", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))


@dataclass
class Runs:
    """Sorted runs in the shared folder: (level, path)."""
    spark: SparkSession
    root: str
    fanout: int = FANOUT
    runs: list[tuple[int, str]] = field(default_factory=list)
    written: int = 0

    def read(self) -> DataFrame:
        paths = [p for _, p in self.runs]
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)

    def _write(self, df: DataFrame, level: int) -> None:
        path = f"{self.root}/run-{self.written:05d}-level-{level}"
        df.select("h1", "h2", "n", "keeper").sortWithinPartitions("h1", "h2").write.parquet(path)
        self.written += 1
        self.runs.append((level, path))

    def add(self, batch: DataFrame) -> None:
        """Merge-join a batch (h1, h2, n, keeper) with the runs and write its own run.
        A hash has its keeper in the one record that was fresh, so the join is 1 : 1."""
        known = self.read().where("keeper is not null").select("h1", "h2", F.lit(True).alias("known"))
        out = batch.join(known, ["h1", "h2"], "left") if self.runs else batch.withColumn("known", F.lit(None))
        self._write(out.withColumn("keeper", F.when(F.col("known").isNull(), F.col("keeper"))), 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(full := [p for at, p in self.runs if at == level]) >= self.fanout:
            merged = merge_records(self.spark.read.schema(RUN_SCHEMA).parquet(*full))
            self.runs = [(at, p) for at, p in self.runs if at != level]
            self._write(merged, level + 1)
            level += 1

    def totals(self) -> DataFrame:
        """One record for each hash over all runs."""
        return self.read() if len(self.runs) == 1 else merge_records(self.read())


def merge_records(records: DataFrame) -> DataFrame:
    return records.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def batch_edges(docs: DataFrame, batches: int) -> list[tuple[int, int]]:
    """Id ranges [from, to), largest ids first; the filter reaches the Parquet scan."""
    lo, hi = docs.agg(F.min("id"), F.max("id")).first()
    if lo is None:
        return []
    step = (hi - lo) // batches + 1
    return [(lo + i * step, min(hi + 1, lo + (i + 1) * step)) for i in reversed(range(batches)) if lo + i * step <= hi]


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``id``, ``kept`` (the text without dropped lines), ``n_lines``, ``n_dropped`` of every row.

    A line's key is the line stripped of ASCII blanks with A-Z lowered. A key of
    ``min_chars`` code points or more that ``min_docs`` ids have stays only in the
    largest of them. A null or empty text is one empty line; lines of rows with a null
    id stay and don't count; repeated rows of an id count once and lose the same lines;
    empty tables give no rows; other columns don't matter. A frequent line is counted
    by partial aggregates and its rows are rows of a join that Spark can split."""
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"),
                       F.xxhash64(F.col(f"`{text}`")).alias("t"))
    runs = Runs(spark, scratch(spark, "line-runs"))
    for lo, hi in batch_edges(base, batches):
        part = hashed_lines(base.where((F.col("id") >= lo) & (F.col("id") < hi)), min_chars)
        runs.add(part.select("h1", "h2", "id").distinct().groupBy("h1", "h2")
                 .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")))
    often = runs.totals().where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    dropped = (hashed_lines(base.where("id is not null"), min_chars).join(often, ["h1", "h2"])
               .where("id <> keeper").groupBy("id", "t").agg(F.collect_set("pos").alias("gone")))
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return base.join(dropped, ["id", "t"], "left").select(
        "id", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op10_line_dedup(spark, sf_dir) -> DataFrame:
    """Line dedup of every document: doc_id, n_lines, n_dropped, kept_sha256."""
    from ._common import read
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
