"""4. LM scoring by cross-entropy difference.

Two bigram models over one vocabulary, one of target documents and one of all, score
each word; a document's score is the mean difference of its losses (low: like the
target). Every word and bigram is counted and kept, whatever its count. ``fit`` and
``score`` keep the counts as tables, to score any texts; ``score_own`` scores the texts
that the models count, by one exchange of counts.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import boxed, byte_column, mix64, restored, row_blocks, squeezed, written
from ._tokens import ALNUM, Tokens, tokenise

HOT_SHARE = 2e-6          # bigrams of this share (at most 5e5) are looked up without a shuffle
MIX = 0.7                 # weight of the bigram estimate
ADD = 0.5                 # added to every unigram count
BLOCK = 1 << 20
START = 1                 # stands for the word before a text
UNIT = 1 << 32            # losses are summed as integers of 1 / UNIT nats, so in any order
SPAN = 8 << 20            # bytes of text whose words are numbered together
ENTRIES = 1 << 20         # words of texts for each bucket of hashes
WORD = np.uint64(0x5851F42D4C957F2D)  # tells a word's key from its hash
BROADCAST_IDS = 1_000_000  # more target ids than this are joined by shuffle
BROADCAST_WORDS = 1_000_000  # more distinct words than this are joined by shuffle


def _blocks(col: pa.Array):
    data, bounds, _ = byte_column(col)
    for lo, hi in row_blocks(bounds, BLOCK):
        yield lo, hi, tokenise(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], ALNUM)


def _pairs(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of (word before, word, both) of every word."""
    before = np.concatenate([t.hash[:1], t.hash[:-1]])
    before[t.first[:-1][np.diff(t.first) > 0]] = START
    return before, t.hash, _code(before, t.hash)


def _code(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _pair_counts(batches):
    for b in batches:
        found = []
        for _, _, t in _blocks(b.column("text")):
            before, word, code = _pairs(t)
            _, at, n = np.unique(code, return_index=True, return_counts=True)
            found.append((before[at], word[at], n))
        if found:
            before, word, n = (np.concatenate(x) for x in zip(*found))
            _, at, to = np.unique(_code(before, word), return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [_signed(before[at]), _signed(word[at]), pa.array(np.bincount(to, n, len(at)).astype(np.int64))],
                ["before", "word", "c"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word before, word, count) of all texts; a pair may come in several rows, to be summed."""
    return docs.select("text").mapInArrow(_pair_counts, "before long, word long, c long")


@dataclass
class Models:
    """Both models as tables. ``pairs``: before, word, background, target (counts);
    ``words``: word, background, target and, as a word before, next_background, next_target."""
    pairs: DataFrame
    words: DataFrame
    n_words: int
    total: dict[str, int]

    @property
    def vocab(self) -> range:
        """The words by number, in the order of their hashes."""
        return range(self.n_words)

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """``before``, ``word`` and the negative log probabilities ``loss_target`` and
        ``loss_background`` of pairs with their counts; both models interpolate the same
        way, and a word they lack has count 0."""
        few = self.n_words <= BROADCAST_WORDS
        words = F.broadcast(self.words) if few else self.words
        names = ("target", "background")
        first = words.select(F.col("word").alias("before"),
                             *[F.greatest(m, f"next_{m}").cast("double").alias(f"all_{m}") for m in names],
                             *[F.col(f"next_{m}") for m in names])
        second = words.select("word", *[F.col(m).alias(f"one_{m}") for m in names])

        def loss(m: str) -> Column:
            context = F.greatest(F.coalesce(F.col(f"all_{m}"), F.lit(0.0)), F.lit(1e-9))
            single = (F.coalesce(F.col(f"one_{m}"), F.lit(0)) + ADD) / (self.total[m] + ADD * (self.n_words + 1))
            rest = 1 - MIX * F.coalesce(F.col(f"next_{m}"), F.lit(0)) / context
            return -F.log(MIX * F.col(m) / context + rest * single)

        return pairs.join(first, "before", "left").join(second, "word", "left").select(
            "before", "word", *[loss(m).alias(f"loss_{m}") for m in names])

    def losses(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """[2, words] negative log probabilities by word numbers, ``n_words`` for a word that
        the models lack and ``n_words`` + 1 for the start of a text. Collects the words: for
        looking into small models."""
        spark = self.pairs.sparkSession
        known = sorted(r["word"] for r in self.words.where(F.col("word") != START).select("word").collect())
        names = np.array([w % 2**64 for w in known] + [2, START], np.uint64).view(np.int64)
        rows = spark.createDataFrame([(i, int(names[b]), int(names[w])) for i, (b, w) in enumerate(zip(before, ids))],
                                     "at long, before long, word long")
        pairs = rows.join(self.pairs, ["before", "word"], "left").na.fill(0, ["target", "background"])
        out = rows.join(self.estimated(pairs.drop("at").distinct()), ["before", "word"]).orderBy("at").toPandas()
        return out[["loss_target", "loss_background"]].to_numpy().T


def fit(docs: DataFrame, target: DataFrame, vocab: DataFrame) -> Models:
    """Count words and bigrams of ``target`` (column text) and, from ``vocab``, of all ``docs``."""
    none = F.lit(0).cast("long")
    both = vocab.select("before", "word", F.col("c").alias("background"), none.alias("target")).union(
        vocabulary(target).select("before", "word", none, "c"))
    sums = [F.sum("background").alias("background"), F.sum("target").alias("target")]
    pairs = written(both.groupBy("before", "word").agg(*sums), "lm-pairs")
    single = pairs.groupBy("word").agg(*sums)
    ahead = pairs.groupBy("before").agg(*sums)
    words = written(single.select("word", "background", "target", none.alias("next_background"), none.alias("next_target"))
                    .union(ahead.select("before", none, none, "background", "target"))
                    .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("background", "target", "next_background", "next_target")]),
                    "lm-words")
    total = words.agg(F.coalesce(F.sum("background"), none).alias("background"),
                      F.coalesce(F.sum("target"), none).alias("target"),
                      F.count(F.when(F.col("word") != START, 1)).alias("n")).first()
    return Models(pairs, words, total["n"], {m: total[m] for m in ("target", "background")})


def score(docs: DataFrame, models: Models, text: str = "text", fitted: bool = False) -> DataFrame:
    """``row`` (the input row as a struct), ``n_tokens``, ``target_ce``, ``background_ce`` and
    ``score`` (their difference, in nats a word). Texts without words, null ones too, have
    n_tokens 0 and null losses; repeated rows get equal scores; columns of any name stay
    inside ``row``.

    The bigrams of a share of ``HOT_SHARE`` or more, a bounded number, are looked up in a
    broadcast table; all others are joined by shuffle with the models' tables. ``fitted``
    says that the models counted all of these texts, so that no pair is unknown to them."""
    frame = written(boxed(docs, text=F.col(f"`{text}`"), id=F.monotonically_increasing_id()), "lm-docs")
    names = ("target", "background")
    least = max(2, models.total["background"] * HOT_SHARE)
    hot = models.estimated(models.pairs.where(F.col("background") >= least)).toPandas()
    first, second = (hot[c].to_numpy(np.int64).view(np.uint64) for c in ("before", "word"))
    codes = _code(first, second)
    order = np.argsort(codes)
    fixed = np.rint(hot[["loss_target", "loss_background"]].to_numpy(float).T * UNIT).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((codes[order], first[order], second[order], fixed[:, order]))

    def counted(batches):
        codes, first, second, fixed = shared.value
        for b in batches:
            ids = b.column("id").to_numpy()
            for lo, hi, t in _blocks(b.column("text")):
                before, word, code = _pairs(t)
                at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                hit = np.zeros(len(code), bool)
                if len(codes):
                    hit = (codes[at] == code) & (first[at] == before) & (second[at] == word)
                rare = np.flatnonzero(~hit)
                _, one, n = np.unique(mix64(code[rare] + t.doc[rare].astype(np.uint64)), return_index=True, return_counts=True)
                one = rare[one]
                # one row of known losses for each text with hot words, under a key without a partner
                many = np.bincount(t.doc[hit], minlength=hi - lo)
                of = np.flatnonzero(many)
                known = np.zeros((2, hi - lo), np.int64)
                for m in (0, 1):
                    np.add.at(known[m], t.doc[hit], fixed[m][at[hit]])
                key = ids[lo:hi][of]
                blank = np.arange(len(one) + len(of)) < len(one)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[lo:hi][t.doc[one]], key])),
                     pa.array(np.concatenate([before[one].view(np.int64), key])),
                     pa.array(np.concatenate([word[one].view(np.int64), key])),
                     pa.array(np.concatenate([n, many[of]])),
                     *(pa.array(np.concatenate([np.zeros(len(one), np.int64), k[of]]), mask=blank) for k in known)],
                    ["id", "before", "word", "n", *names])

    found = frame.select("id", "text").mapInArrow(counted, "id long, before long, word long, n long, target long, background long")
    table = models.estimated(models.pairs.where(F.col("background") < least))
    if not fitted:
        pairs = found.where("target IS NULL").select("before", "word").distinct()
        none = F.lit(0).cast("long")
        new = pairs.join(models.pairs, ["before", "word"], "left_anti").select(
            "before", "word", none.alias("background"), none.alias("target"))
        table = table.unionByName(models.estimated(new))
    sums = found.join(table, ["before", "word"], "left").groupBy("id").agg(
        F.sum("n").alias("n"), *[F.sum(F.coalesce(F.col(m), F.round(F.col(f"loss_{m}") * UNIT).cast("long") * F.col("n"))).alias(m)
                                 for m in names])
    ce = [(F.col(m) / F.lit(float(UNIT)) / F.col("n")).alias(f"{m}_ce") for m in names]
    return frame.select("id", "row").join(sums, "id", "left").select(
        "row", F.coalesce("n", F.lit(0).cast("long")).alias("n_tokens"), *ce).withColumn(
        "score", F.col("target_ce") - F.col("background_ce"))


def _numbered(batches):
    """Documents without their texts; the first one of a span holds its words: their
    hashes, every word's number and the words of each document."""
    for b in batches:
        data, bounds, _ = byte_column(b.column("text"))
        flags = np.asarray(b.column("target").fill_null(False).to_numpy(zero_copy_only=False), bool)
        for lo, hi in row_blocks(bounds, SPAN):
            t = tokenise(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], ALNUM)
            words, at = np.unique(t.hash, return_inverse=True)
            lengths = np.diff(t.first).astype(np.int64)
            size = hi - lo
            rest = [None] * (size - 1)
            held = len(at) > 0
            ids = b.column("id").slice(lo, size)
            yield pa.RecordBatch.from_arrays(
                [ids, b.column("row").slice(lo, size), pa.array(lengths), pa.array(np.where(flags[lo:hi], lengths, 0)),
                 *(pa.array([n] + rest if held else [None] * size, pa.int64()) for n in (size, len(words))),
                 *(pa.array([squeezed(x)] + rest if held else [None] * size, pa.binary())
                   for x in (words.view(np.int64), at, lengths, flags[lo:hi]))],
                ["id", "row", "n_tokens", "n_target", "n_docs", "n_words", "words", "at", "lengths", "flags"])


@dataclass
class _Span:
    """Words (then the start of a text) and bigrams of a span as entries under 63-bit keys,
    odd for words: ``counts`` are background, target and, of a word as the one before, next
    background and next target. ``pair`` gives every word's bigram, ``order`` sorts keys."""
    keys: np.ndarray
    counts: np.ndarray
    order: np.ndarray
    before: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    first: np.ndarray


def _span(row: dict) -> _Span:
    n = row["n_words"]
    words = np.append(restored(row["words"], n).view(np.uint64), np.uint64(START))
    lengths = restored(row["lengths"], row["n_docs"])
    first = np.concatenate([[0], np.cumsum(lengths)])
    at = restored(row["at"], int(first[-1]))
    flag = np.repeat(restored(row["flags"], len(lengths)), lengths).astype(float)
    ahead = np.concatenate([[n], at[:-1]])
    ahead[first[:-1][lengths > 0]] = n
    both, pair = np.unique(ahead * (n + 1) + at, return_inverse=True)
    before, word = np.divmod(both, n + 1)
    none = np.zeros(len(both))

    def count(x, size):
        return [np.bincount(x, minlength=size), np.bincount(x, flag, size)]
    keys = np.concatenate([mix64(words ^ WORD) | np.uint64(1), _code(words[before], words[word]) & ~np.uint64(1)])
    counts = np.concatenate([np.stack(count(at, n + 1) + count(ahead, n + 1)),
                             np.stack(count(pair, len(both)) + [none, none])], 1).astype(np.int64)
    return _Span(keys, counts, np.argsort(keys, kind="stable"), before, word, pair, first)


def _rows(table) -> list[dict]:
    """Rows of an Arrow table or batch, one at a time."""
    for i in range(table.num_rows):
        yield {c: table.column(c)[i].as_py() for c in table.schema.names}


def _sent(bits: int):
    """Keys and counts of spans by bucket, the highest bits of a key."""
    def send(batches):
        for b in batches:
            for row in _rows(b):
                s = _span(row)
                keys, counts = s.keys[s.order], s.counts[:, s.order]
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
                parts = list(zip(cut[:-1], cut[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut[:-1]]), pa.array([row["id"]] * len(parts), pa.int64()),
                     pa.array(np.diff(cut)),
                     pa.array([squeezed(np.diff(keys[lo:hi], prepend=np.uint64(0)).view(np.int64)) for lo, hi in parts]),
                     pa.array([squeezed(counts[:, lo:hi].ravel()) for lo, hi in parts])],
                    ["bucket", "id", "n", "keys", "counts"])
    return send


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts, 1)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[:, order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(counts, start, axis=1)


def _answered(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Corpus counts of the entries of one bucket, in the order in which each span sent them;
    one more row has the number of different words. Spans are unpacked one by one, so a
    bucket needs its packed rows and its different keys."""
    def keys_of(row):
        return np.cumsum(restored(row["keys"], row["n"]).view(np.uint64), dtype=np.uint64)
    keys, counts, waiting = [], [], 0
    for row in _rows(table.select(["n", "keys", "counts"])):
        keys.append(keys_of(row))
        counts.append(restored(row["counts"], 4 * row["n"]).reshape(4, -1))
        waiting += row["n"]
        if waiting > 2 * ENTRIES:
            one, sums = _summed(keys, counts)
            keys, counts, waiting = [one], [sums], 0
    known, sums = _summed(keys, counts)
    found = [squeezed(sums[:, np.searchsorted(known, keys_of(row))].ravel()) for row in _rows(table.select(["n", "keys"]))]
    words = int(((known & np.uint64(1)) == 1)[sums[0] > 0].sum())
    return pa.table({"id": pa.concat_arrays([*table.column("id").chunks, pa.array([None], pa.int64())]),
                     "bucket": pa.concat_arrays([*table.column("bucket").chunks, pa.array([key[0].as_py()], pa.int64())]),
                     "n": pa.concat_arrays([*table.column("n").chunks, pa.array([0], pa.int64())]),
                     "sums": pa.array(found + [None], pa.binary()),
                     "words": pa.array([None] * len(found) + [words], pa.int64())})


def score_own(docs: DataFrame, target: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``score`` of documents by models of themselves: the background model counts all of
    them, the target model those where ``target`` is true (null: false). ``row`` holds the
    columns ``keep`` (all if not given).

    Words and bigrams of a span of texts are counted there and cross the shuffle once, under
    a 64-bit hash, without their documents; the corpus counts come back in the order in which
    they were sent, so they need no keys, and the span scores its own documents. Nothing is
    left out, and a frequent word is one entry a span. Two words or bigrams of one hash count
    as one (expected for fewer than one pair in 10^8 different ones). Texts without words,
    null ones too, have n_tokens 0 and null losses; repeated rows get equal scores."""
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    frame = docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                        target.cast("boolean").alias("target"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("row", frame.schema["row"].dataType)]
                          + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_target", "n_docs", "n_words")]
                          + [T.StructField(c, T.BinaryType()) for c in ("words", "at", "lengths", "flags")])
    packed = written(frame.mapInArrow(_numbered, schema), "lm-docs")
    none = F.lit(0).cast("long")
    total = packed.agg(*[F.coalesce(F.sum(c), none).alias(m) for c, m in (("n_tokens", "background"), ("n_target", "target"))]).first()
    spans = packed.where("n_words is not null").select("id", "n_docs", "n_words", "words", "at", "lengths", "flags")
    bits = max(0, (total["background"] // ENTRIES).bit_length())
    answers = written(spans.mapInArrow(_sent(bits), "bucket long, id long, n long, keys binary, counts binary")
                      .groupBy("bucket").applyInArrow(_answered, "id long, bucket long, n long, sums binary, words long"),
                      "lm-counts")
    n_words = answers.agg(F.coalesce(F.sum("words"), none)).first()[0]
    names = ("target", "background")

    def scored(own: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(_rows(own))
        s = _span(row)
        counts = np.empty_like(s.counts)
        parts = sorted(_rows(answers), key=lambda r: r["bucket"])
        counts[:, s.order] = np.concatenate([restored(r["sums"], 4 * r["n"]).reshape(4, -1) for r in parts], 1)
        words, pairs = counts[:, :row["n_words"] + 1], counts[:, row["n_words"] + 1:]
        out = {"id": row["id"] + np.arange(row["n_docs"])}
        for m, at in (("target", 1), ("background", 0)):
            context = np.maximum(np.maximum(words[at], words[2 + at])[s.before], 1e-9)
            single = (words[at] + ADD)[s.word] / (total[m] + ADD * (n_words + 1))
            loss = -np.log(MIX * pairs[at] / context + (1 - MIX * words[2 + at][s.before] / context) * single)
            upto = np.concatenate([[0], np.cumsum(np.rint(loss * UNIT).astype(np.int64)[s.pair])])
            out[m] = upto[s.first[1:]] - upto[s.first[:-1]]
        return pa.table(out)

    sums = spans.groupBy("id").cogroup(answers.where("id is not null").select("id", "bucket", "n", "sums").groupBy("id")).applyInArrow(
        scored, "id long, target long, background long")
    ce = [F.when(F.col("n_tokens") > 0, F.col(m) / F.lit(float(UNIT)) / F.col("n_tokens")).alias(f"{m}_ce") for m in names]
    return packed.select("id", "row", "n_tokens").join(sums, "id", "left").select("row", "n_tokens", *ce).withColumn(
        "score", F.col("target_ce") - F.col("background_ce"))


def op4_lm_score(spark, sf_dir) -> DataFrame:
    """Cross-entropy difference of every document between documents labelled of good
    quality and all documents: doc_id, n_tokens, target_ce, background_ce, score."""
    from ._common import read
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    good = read(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    few = good.count() <= BROADCAST_IDS
    good = good.withColumn("target", F.lit(True))
    docs = docs.join(F.broadcast(good) if few else good, "doc_id", "left")
    return score_own(docs, F.col("target"), keep=["doc_id"]).select(
        "row.doc_id", "n_tokens", "target_ce", "background_ce", "score")
