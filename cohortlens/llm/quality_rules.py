"""12. Quality rules with distribution divergence.

Every language of the table has two reference histograms, counted over all its
documents that pass the base rules: character classes, and words (its most common ones
each, the others in hashed bins). A document is as far from a language as the larger of
its two Jensen-Shannon distances, each measured against its own limit, and is judged by
the language that it is nearest to, so a wrong label costs nothing. Short texts are
noisy: below a minimum length a histogram decides nothing, and above it the distance
that chance alone makes at this length is allowed on top of the limit.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import byte_column, mix64, read, row_blocks, written
from ._tokens import NONSPACE, Tokens, grams, tokenise

MIN_WORDS = 50
COMMON = 48
BINS = 16
#: Jensen-Shannon distance allowed (0 to 1), and how many times the divergence expected by chance.
CHAR_LIMIT = 0.26
WORD_LIMIT = 0.4
CHANCE = 1.25
MIN_CHARS = 200
MIN_JUDGED_WORDS = 50
#: A language needs this many words to be a reference.
MIN_REFERENCE_WORDS = 2000
HELD_WORDS = 2_000_000
BLOCK_BYTES = 4 << 20
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "break", "stop", "quote", "symbol", "other ASCII", "beyond ASCII")


def _class_table() -> np.ndarray:
    table = np.full(256, 8, np.uint8)
    table[128:] = 9
    for k, chars in ((0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" "),
                     (4, b"\t\n\x0b\x0c\r"), (5, b".,;:!?"), (6, b"'\"()-"), (7, b"#*$%&|<>@+=/\\^_~`[]{}")):
        table[list(chars)] = k
    return table


CLASS_OF = _class_table()
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
CONTINUES = (np.arange(256) & 0xC0) == 0x80
NOT_BREAK = np.arange(256) != 10
SAME = np.arange(256, dtype=np.uint8)


@dataclass
class Measured:
    """Per text of a block: the base counts and the two histograms' raw material."""
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    classes: np.ndarray
    words: Tokens

    @property
    def failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > 50 * self.n_words)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(key: np.ndarray) -> np.ndarray:
    """Which entries of ``key`` have an equal one."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def repeated_words(t: Tokens) -> np.ndarray:
    """Per text: words inside three-word windows that the text has twice or more."""
    covered = np.zeros(len(t.hash), bool)
    gram, doc = grams(t, 3)
    if len(gram):
        at = np.flatnonzero(t.doc[:len(t.doc) - 2] == t.doc[2:])[_again(gram ^ mix64(doc.astype(np.uint64)))]
        for k in range(3):
            covered[at + k] = True
    return _per_text(covered, t.first)


def repeated_lines(data: np.ndarray, bounds: np.ndarray, words: Tokens) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    lines = tokenise(data, bounds, NOT_BREAK, SAME)
    full = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    doc = lines.doc[full]
    key = lines.hash[full] ^ mix64(doc.astype(np.uint64))
    kept = np.unique(key, return_index=True)[1]
    n = len(bounds) - 1
    return np.bincount(doc, minlength=n) - np.bincount(doc[kept], minlength=n)


def measure(data: np.ndarray, bounds: np.ndarray) -> Measured:
    """All counts of the texts ``data[bounds[i]:bounds[i+1]]``, without a loop over words."""
    cased = tokenise(data, bounds, NONSPACE, SAME)
    n, whole = len(bounds) - 1, ~CONTINUES[data]
    texts = np.repeat(np.arange(n, dtype=np.int64) * len(CLASSES), np.diff(bounds))
    classes = np.bincount((texts + CLASS_OF[data])[whole], minlength=n * len(CLASSES)).reshape(n, -1)
    return Measured(np.diff(cased.first), _per_text(whole & NONSPACE[data], bounds), _per_text(IS_SYMBOL[data], bounds),
                    repeated_lines(data, bounds, cased), repeated_words(cased), classes, tokenise(data, bounds, NONSPACE))


def _blocks(batch):
    """(first row, end row, measured) of blocks of some 4 MB; a null text is empty."""
    flat, bounds, _ = byte_column(batch.column("text"))
    for lo, hi in row_blocks(bounds, BLOCK_BYTES):
        yield lo, hi, measure(flat[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])


def _corpus_counts(batches):
    """(lang, kind, key, n): character classes (0), word hashes (1) and hashed bins (2)
    of a task's documents that pass the base rules."""
    chars: dict[str, np.ndarray] = {}
    words: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(which, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def close():
        for lang, parts in words.items():
            keys, n = merged(parts)
            bins = np.bincount(keys % BINS, weights=n, minlength=BINS).astype(np.int64)
            for kind, k, x in ((1, keys, n), (2, np.arange(BINS), bins), (0, np.arange(len(CLASSES)), chars[lang])):
                yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(np.full(len(k), kind, np.int32)),
                                       pa.array(k.astype(np.int64)), pa.array(x)], ["lang", "kind", "key", "n"])
        chars.clear()
        words.clear()

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lo, hi, m in _blocks(batch):
            good = ~m.failed
            for lang in set(langs[lo:hi][good]):
                own = good & (langs[lo:hi] == lang)
                keys, n = np.unique(m.words.hash.view(np.int64)[own[m.words.doc]], return_counts=True)
                chars[lang] = chars.get(lang, 0) + m.classes[own].sum(axis=0)
                words.setdefault(lang, []).append((keys, n))
                if len(words[lang]) > 16:
                    words[lang] = [merged(words[lang])]
            if sum(len(k) for parts in words.values() for k, _ in parts) > HELD_WORDS:
                yield from close()
    yield from close()


@dataclass(frozen=True)
class Reference:
    lang: str
    chars: np.ndarray
    hashes: np.ndarray
    words: np.ndarray


def references(docs: DataFrame, lang: str = "lang", text: str = "text", common: int = COMMON) -> list[Reference]:
    """The histograms of every language, from all its documents that pass the base rules;
    ``common`` words and a few sums for each language reach the driver."""
    counted = written(docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
                      .mapInArrow(_corpus_counts, "lang string, kind int, key long, n long")
                      .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "word-counts")
    top = counted.where("kind = 1").withColumn("r", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("r") <= common).drop("r")
    found: dict[str, dict] = {}
    for r in counted.where("kind <> 1").unionByName(top).collect():
        found.setdefault(r["lang"], {0: {}, 1: {}, 2: {}})[r["kind"]][r["key"]] = r["n"]
    out = []
    for name, kinds in sorted(found.items()):
        hashes = np.array(sorted(kinds[1]), np.int64)
        words = np.array([kinds[1][h] for h in hashes.tolist()] + [kinds[2].get(k, 0) for k in range(BINS)], float)
        np.subtract.at(words, len(hashes) + hashes % BINS, words[:len(hashes)])
        if words.sum() >= MIN_REFERENCE_WORDS:
            chars = np.array([kinds[0].get(k, 0) for k in range(len(CLASSES))], float)
            out.append(Reference(name, chars / chars.sum(), hashes, words / words.sum()))
    return out


def js_divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0), np.where(q > 0, q * np.log2(q / m), 0)
    return np.maximum(0.0, a.sum(axis=1) + b.sum(axis=1)) / 2


def excess(counts: np.ndarray, reference: np.ndarray, limit: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, distance over what the limit and chance allow) of each row; 0 below ``least``."""
    n = counts.sum(axis=1)
    long = n >= max(least, 1)
    size = np.maximum(n, 1)
    js = np.where(long, js_divergence(counts / size[:, None], reference), 0)
    chance = CHANCE * (np.count_nonzero(reference) - 1) / (8 * size * math.log(2))
    return np.sqrt(js), np.sqrt(js / (limit * limit + chance))


class Judge:
    """All references; words are looked up once for all languages."""

    def __init__(self, refs: list[Reference]):
        self.refs = refs
        self.hashes = np.unique(np.concatenate([r.hashes for r in refs])) if refs else np.zeros(0, np.int64)
        self.places = []
        for r in refs:
            place = np.searchsorted(r.hashes, self.hashes)
            known = r.hashes[np.minimum(place, len(r.hashes) - 1)] == self.hashes
            own = np.where(known, place, len(r.hashes) + self.hashes % BINS)
            self.places.append(np.concatenate([own, len(r.hashes) + np.arange(BINS)]))

    def __call__(self, m: Measured) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: nearest language, its two distances, within the limits."""
        n = len(m.n_words)
        if not self.refs:
            return [None] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        keys, width = m.words.hash.view(np.int64), len(self.hashes) + BINS
        place = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        column = np.where(self.hashes[place] == keys, place, len(self.hashes) + keys % BINS)
        tally = np.bincount(m.words.doc * width + column, minlength=n * width).reshape(n, width).astype(float)
        worst, total, chars, words = [], [], [], []
        for r, places in zip(self.refs, self.places):
            hist = np.zeros((len(r.words), n))
            np.add.at(hist, places, tally.T)
            c, over_c = excess(m.classes, r.chars, CHAR_LIMIT, MIN_CHARS)
            w, over_w = excess(hist.T, r.words, WORD_LIMIT, MIN_JUDGED_WORDS)
            worst.append(np.maximum(over_c, over_w))
            total.append(over_c + over_w)
            chars.append(c)
            words.append(w)
        worst, rows = np.array(worst), np.arange(n)
        # the smaller excess, then the smaller sum, then the first name
        best = np.lexsort((np.broadcast_to(np.arange(len(self.refs))[:, None], worst.shape), np.array(total), worst), axis=0)[0]
        return ([self.refs[b].lang for b in best], np.array(chars)[best, rows], np.array(words)[best, rows],
                worst[best, rows] <= 1)


SCHEMA = ("id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, nearest string, js_chars double, js_words double")


def _judged(refs: list[Reference]):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        judge = Judge(refs)
        for batch in batches:
            for lo, hi, m in _blocks(batch):
                lang, c, w, good = judge(m)
                counts = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)
                yield pa.record_batch([batch.column("id").slice(lo, hi - lo), *[pa.array(x.astype(np.int64)) for x in counts],
                                       pa.array(m.failed), pa.array(good & ~m.failed), pa.array(lang, pa.string()),
                                       pa.array(c), pa.array(w)], names)
    return run


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: the base counts, ``base_failed``, ``kept``, the
    nearest language and the two distances.

    A null or empty text has no words and fails; a null language gives to no reference;
    null keys and repeated rows are judged like others; without any reference the base
    rules decide alone; between equally near languages the first name decides; empty
    tables give no rows; other columns don't matter. Very long texts are read whole, one
    at a time. A language of any share is counted in tasks before rows are shuffled."""
    refs = references(docs, lang, text)
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_judged(refs), SCHEMA)


def op12_quality_rules(spark, sf_dir) -> DataFrame:
    """Quality verdict of every document: base counts, rules, divergence."""
    out = quality(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.withColumnRenamed("id", "doc_id")
