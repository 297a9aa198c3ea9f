"""5. Mixing sources to target weights by Poisson replication.

A document of a source with mean target repetition rate r is written k times, k
drawn from Poisson(r) by inverting its distribution at a uniform number hashed from
the document, so any task draws the same k again; a large rate is a sum of such draws. Copies are shuffled globally by a
second hash. DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"
ALPHA = 0.5               # target weight of a source: its size to this power
BROADCAST_SOURCES = 50_000  # more sources than this are joined by shuffle
BROADCAST_KEYS = 1_000_000  # more repeated keys than this are joined by shuffle
PIECE = 10_000              # equal rows of a task, while they are numbered
SALTS = 64
MOST_RATE = 500.0         # a larger rate is a sum of draws up to this one: exp(-rate) must not underflow


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the parts (null counts as \\N)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """P(k <= 0), P(k <= 1), ... of Poisson(rate), past the point where it rounds to 1."""
    most = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.lit(0.0).alias("sum"), F.exp(-rate).alias("p"), F.array().cast("array<double>").alias("c"))
    return F.aggregate(
        F.sequence(F.lit(0), most), start,
        lambda a, k: F.struct((a["sum"] + a["p"]).alias("sum"), (a["p"] * rate / (k + 1)).alias("p"),
                              F.concat(a["c"], F.array(a["sum"] + a["p"])).alias("c")),
        lambda a: a["c"])


def copies(u: Column, cdf: Column) -> Column:
    """Inverse of the distribution: the number of cumulative values up to u."""
    return F.size(F.filter(cdf, lambda c: c <= u))


def parts(rate: Column) -> Column:
    """Number of equal draws that a rate is split into; 1 up to ``MOST_RATE``."""
    return F.greatest(F.ceil(rate / MOST_RATE), F.lit(1)).cast("int")


def drawn_copies(cdf: Column, n_parts: Column, *seed: Column) -> Column:
    """Poisson count: the sum of independent draws of one distribution, the first seeded
    by ``seed`` alone and the others by ``seed`` and their number."""
    more = F.aggregate(F.sequence(F.lit(1), n_parts - 1), F.lit(0),
                       lambda a, i: a + copies(uniform(*seed, F.lit("part"), i), cdf))
    return copies(uniform(*seed), cdf) + F.when(n_parts > 1, more).otherwise(0)


def source_rates(docs: DataFrame, source: str, size: Column, weights: DataFrame | None = None,
                 alpha: float = ALPHA) -> DataFrame:
    """Mean repetition rate of each source: target share x total size / own size.

    ``weights`` (source, weight) names the targets; without it a source weighs its
    size to the power ``alpha``. The output has the size of the input in expectation.
    Sources that weights leave out, or of size 0, have rate 0 and 1. Rates are
    rounded to 9 places, so that sums in another order give the same."""
    # split by document before summing: one source may hold a third of all rows
    sizes = (docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size).alias("own")))
    if weights is None:
        w = sizes.withColumn("weight", F.pow(F.col("own").cast("double"), F.lit(alpha)))
    else:
        w = sizes.join(weights.groupBy("source").agg(F.sum("weight").alias("weight")),
                       sizes["source"].eqNullSafe(weights["source"]), "left").select(
            sizes["source"], "own", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = w.agg(F.sum("own").alias("all_own"), F.sum("weight").alias("all_weight"))  # one row
    return w.join(F.broadcast(total)).select(
        "source", F.when(F.col("own") == 0, F.lit(1.0)).otherwise(
            F.round(F.col("weight") / F.col("all_weight") * F.col("all_own") / F.col("own"), 9)).alias("rate"))


def told_apart(boxed: DataFrame) -> DataFrame:
    """``row``, ``from`` and a ``key`` (string) that no two rows share: the key itself, or for
    a null or repeated one the key, a hash of the row and a number among equal rows.

    Equal rows are counted, not gathered: a count is dealt out again in pieces, so a row
    that makes up much of the table is many tasks."""
    keys = boxed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or key is null").select("key")
    plain = boxed.select("row", "from", F.col("key").cast("string").alias("key"))
    if keys.isEmpty():
        return plain
    named = keys.where("key is not null")
    few = named.count() <= BROADCAST_KEYS
    named = F.broadcast(named) if few else named
    shared = boxed.where("key is null").unionByName(boxed.join(named, "key", "left_semi"))
    content = F.md5(F.to_json(F.struct("row")).cast("binary"))
    counted = shared.groupBy("row", "key", "from").agg(F.count(F.lit(1)).alias("c"))
    pieces = counted.withColumn("hash", content).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(PIECE).cast("long")))).repartition("hash", "first")
    each = pieces.withColumn("number", F.explode(
        F.sequence("first", F.least(F.col("c"), F.col("first") + PIECE) - 1)))
    name = F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("\\N")), "hash", "number")
    return (boxed.where("key is not null").join(named, "key", "left_anti")
            .select("row", "from", F.col("key").cast("string").alias("key"))
            .unionByName(each.select("row", "from", name.alias("key"))))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: DataFrame | None = None, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """``row`` (the input row as a struct), ``rate``, ``copy`` (from 0), ``n_copies`` and
    ``place`` (the number that orders the shuffled output), sorted by place.

    A size is a text's UTF-8 bytes plus 1, so null and empty texts take part. A null
    source is a source of its own; an empty table gives no rows; columns of any name stay
    inside ``row``. A row of a null or repeated key draws by its key, its content and a
    number among equal rows, so each draws and is placed for itself. Every source, whatever
    its size, is dealt row by row: the rates join by broadcast while sources are few, else
    by salted shuffle."""
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1
    rates = source_rates(docs, source, size, weights, alpha).withColumn("parts", parts(F.col("rate"))).withColumn(
        "cdf", cumulative(F.col("rate") / F.col("parts")))
    boxed = told_apart(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                   F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("from")))
    if docs.select(F.approx_count_distinct(F.col(f"`{source}`"))).first()[0] <= BROADCAST_SOURCES:
        joined = boxed.join(F.broadcast(rates), F.col("from").eqNullSafe(F.col("source")))
    else:
        dealt = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = boxed.withColumn("s", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(
            dealt, F.col("from").eqNullSafe(F.col("source")) & (F.col("s") == F.col("salt")))
    n = drawn_copies(F.col("cdf"), F.col("parts"), F.lit(seed), F.col("key"))
    drawn = joined.withColumn("n_copies", n).where("n_copies > 0")
    each = drawn.select("row", "rate", "n_copies", "key",
                        F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    placed = each.withColumn("place", uniform(F.lit(seed), F.lit("place"), F.col("key"), F.col("copy")))
    return placed.select("row", "rate", "copy", "n_copies", "place").orderBy("place")


def op5_mixing(spark, sf_dir) -> DataFrame:
    """Documents replicated to target weights of their sources and shuffled:
    doc_id, text, lang, source, n_chars, rate, copy, n_copies, place."""
    from ._common import read
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(docs).select("row.*", "rate", "copy", "n_copies", "place")


SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0) + 1) AS own FROM documents GROUP BY source),
weights AS (SELECT source, own, power(CAST(own AS DOUBLE), 0.5) AS weight FROM sizes),
rates AS (
  SELECT source, round(weight / (SELECT sum(weight) FROM weights) * (SELECT sum(own) FROM weights) / own, 9) AS rate
  FROM weights),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms
  WHERE k < ceil(rate + 10 * sqrt(rate) + 20)),
drawn AS (
  SELECT d.*, CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '\N')), 1, 13)) AS BIGINT)
              / 4503599627370496.0 AS u FROM documents d),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.rate, CAST(count(*) AS INTEGER) AS n_copies
  FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.c <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, rate, CAST(i AS INTEGER) AS copy, n_copies,
       CAST(('0x' || substr(md5('mix-1:place:' || coalesce(CAST(doc_id AS VARCHAR), '\N') || ':' || i), 1, 13)) AS BIGINT)
       / 4503599627370496.0 AS place
FROM counted, unnest(range(0, n_copies)) AS t(i)
"""
