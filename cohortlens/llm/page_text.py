"""7. Main text of web pages, with the runs of words that pages of a host share.

Markup tells most parts of a page apart: menus, adverts and the like are named, and
an article is too. Runs of words are hashed and the distinct pages of a host that have
them counted over the whole host; ``shared_words`` says the same of a few pages by a
suffix array. Blocks that the markup leaves open (pages without an article) lose covered boilerplate and
keep their unique runs; blocks of an article are the text and stay.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import mix64, restored, squeezed, written
from ._tokens import grams, tokenise

BETWEEN = np.arange(256) != 0x20  # bytes of words
AS_IS = np.arange(256, dtype=np.uint8)
CHUNK_PAGES = 256        # pages worked on at a time
CHUNK_BYTES = 32 << 20
RUN_WORDS = 8            # shortest shared substring
MIN_PAGES = 3            # distinct pages that share it
FLUSH_RUNS = 1 << 20     # runs of pages packed at a time
SCREEN_RUNS = 1 << 21    # runs of a bucket in the screening, on average
SPARE_BITS = 8           # a run's shortened hash has so many bits more than their number
BROADCAST_RUNS = 2_000_000  # more shared runs, or copies of pages, are joined by shuffle

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIP = frozenset("head script style noscript template svg math iframe object nav header footer aside form "
                 "button select textarea menu dialog".split())
BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd div section article main blockquote pre figure figcaption "
                  "table thead tbody tfoot tr td th caption hr address details summary body html".split()) | SKIP
MAIN = frozenset(("article", "main"))
NAMED = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|"
                   r"sidebar|menu|nav\w*|breadcrumbs?|header|footer|comments?|replies|respond|disqus|share|social|"
                   r"related|newsletter|subscribe|signup|login)")
#: Left out whatever they hold; other skipped elements are kept if an article lies in them.
NEVER = frozenset("head script style noscript template svg math iframe object button select textarea menu".split())
#: Elements whose end tag may be left out, and the start tags that then end them.
IMPLIED = {"p": BLOCK - NEVER - {"html", "body"}, "li": {"li"}, "td": {"td", "th", "tr", "tbody", "tfoot", "thead"},
           "th": {"td", "th", "tr", "tbody", "tfoot", "thead"}, "tr": {"tr", "tbody", "tfoot", "thead"},
           "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}}
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
BROKEN_END = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?$")


class Skipped:
    """An element that tag or name rule out, and what lies in it."""

    def __init__(self, named: bool, never: bool):
        self.named, self.never, self.main, self.chars = named, never, False, 0


class Blocks(HTMLParser):
    """Collects (inside an article, text, skipped elements around) of the blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts = [], []
        self.open: list[tuple[str, Skipped | None]] = []
        self.count = Counter()  # open elements by tag
        self.around: list[Skipped] = []  # open ones that are skipped
        self.chars = 0

    def _close_block(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append((any(self.count[tag] for tag in MAIN), text, tuple(self.around)))
            if not any(s.never for s in self.around):
                self.chars += len(text)
                for s in self.around:
                    s.chars += len(text)

    def _end(self, at: int):
        """Close the open element ``at`` and all inside it."""
        if any(tag in BLOCK or s for tag, s in self.open[at:]):
            self._close_block()
        for tag, s in self.open[at:]:
            self.count[tag] -= 1
            if s:
                self.around.pop()
        del self.open[at:]

    def _end_implied(self, tag: str):
        ended = None
        for at in range(len(self.open) - 1, -1, -1):
            inner = self.open[at][0]
            if tag in IMPLIED.get(inner, ()):
                ended = at
            elif inner in BLOCK and inner not in IMPLIED:
                break
        if ended is not None:
            self._end(ended)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "hr":
                self._end_implied(tag)
                self._close_block()
            elif tag == "br":
                self.parts.append(" ")
            return
        self._end_implied(tag)
        named = tag not in ("html", "body") and tag not in MAIN and any(
            (k in ("class", "id") and v and any(NAMED.fullmatch(x) for x in v.lower().split()))
            or (k == "role" and v and v.lower() in ROLES)
            or k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        skip = Skipped(named and tag not in SKIP, tag in NEVER) if tag in SKIP or named else None
        if tag in BLOCK or named:
            self._close_block()
        if tag in MAIN:
            for s in self.around:
                s.main = True
        if tag in BLOCK or tag in IMPLIED or skip or self.count[tag]:
            self.open.append((tag, skip))
            self.count[tag] += 1
            if skip:
                self.around.append(skip)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.count[tag]:
            self._end(next(at for at in range(len(self.open) - 1, -1, -1) if self.open[at][0] == tag))
        elif tag in BLOCK:
            self._close_block()

    def handle_data(self, data):
        self.parts.append(data)

    def kept(self) -> list[tuple[bool, str]]:
        """Blocks that no skipped element around them rules out. One that holds an article
        rules out nothing, nor does one that a name alone marks if it holds most of the text."""
        self._close_block()
        return [(inside, text) for inside, text, around in self.blocks if not any(
            s.never or not (s.main or (s.named and 2 * s.chars > self.chars)) for s in around)]


def page_blocks(html: str | None) -> list[tuple[bool, str]]:
    """Blocks of a page in order. Text that breaks off in a tag ends before the tag."""
    parser = Blocks()
    parser.feed(BROKEN_END.sub("", html or ""))
    parser.close()
    blocks = parser.kept()
    if any(inside for inside, _ in blocks):
        return [b for b in blocks if b[0]]
    return blocks


def shared_words(streams: list[list[str]], run: int = RUN_WORDS, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For every stream, whether each word lies in a substring of ``run`` words or more
    that at least ``min_pages`` streams have.

    The suffixes of the concatenated streams are ranked by prefix doubling up to depth
    ``run`` (equal ranks: equal prefixes); neighbours of equal rank in the sorted array
    are one repeated substring. Each stream ends in a word of its own, so no substring
    crosses pages."""
    ids: dict[str, int] = {}
    size = [len(s) for s in streams]
    ends = np.cumsum([n + 1 for n in size])
    text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    at = 0
    for i, s in enumerate(streams):
        text[at:at + size[i]] = [ids.setdefault(w, len(ids)) for w in s]
        text[at + size[i]] = -1 - i
        at += size[i] + 1
    if not len(text):
        return [np.zeros(0, bool) for _ in streams]
    page = np.repeat(np.arange(len(streams)), np.array(size) + 1)
    _, rank = np.unique(text, return_inverse=True)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        _, rank = np.unique(rank.astype(np.int64) * (len(text) + 1) + after, return_inverse=True)
        depth += step
    order = np.lexsort((page, rank))  # the suffix array, pages in order within equal prefixes
    r, p = rank[order], page[order]
    first = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
    pages = np.bincount(r, weights=first, minlength=int(rank.max()) + 1)
    often = pages[rank] >= min_pages
    last = np.repeat(ends, np.array(size) + 1) - 1  # the stream's own end word
    often &= np.arange(len(text)) + run <= last
    cover = np.zeros(len(text) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return [inside[e - n - 1:e - 1] for e, n in zip(ends, size)]


def without(blocks: list[tuple[bool, str]], words: list[list[str]], cover: np.ndarray) -> str:
    """Text of a page from its blocks, their words and which of these are shared."""
    kept, at = [], 0
    for (inside, text), w in zip(blocks, words):
        own = cover[at:at + len(w)]
        at += len(w)
        if inside or not own.any():
            kept.append(text)
        elif not own.all():  # an open block keeps its unique runs
            kept.append(" ".join(x for x, c in zip(w, own) if not c))
    return "\n\n".join(kept)


def main_texts(pages: list[str | None]) -> list[tuple[str, int]]:
    """(text, words shared with other pages) of a few distinct pages of one host, by one
    suffix array: what ``extract`` gives for a host of any size."""
    blocks = [page_blocks(h) for h in pages]
    words = [[t.split(" ") for _, t in b] for b in blocks]
    shared = shared_words([[w for block in page for w in block] for page in words])
    return [(without(page, tokens, cover), int(cover.sum())) for page, tokens, cover in zip(blocks, words, shared)]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _pieces(pdf: pd.DataFrame, size: pd.Series):
    """Consecutive parts of a batch of bounded rows and bytes."""
    part = np.maximum(np.arange(len(pdf)) // CHUNK_PAGES, size.cumsum().to_numpy() // CHUNK_BYTES)
    for _, piece in pdf.groupby(part, sort=True):
        yield piece


def _keys_of(piece: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of every page, and for every run of ``RUN_WORDS`` words inside a page the
    hash of (host, run), the page and the place of its first word among all words. A block's
    words lie between single spaces."""
    texts = [" ".join(b).encode("utf-8", "surrogatepass") for b in piece["block"]]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    t = tokenise(np.array(bytearray(b"".join(texts)), np.uint8), bounds, BETWEEN, AS_IS)
    run, page = grams(t, RUN_WORDS)
    n = max(0, len(t.doc) - RUN_WORDS + 1)
    at = np.flatnonzero(t.doc[:n] == t.doc[len(t.doc) - n:])
    own = pd.util.hash_array(piece["host"].to_numpy(object))
    return t.first, mix64(run + mix64(own[page])), page, at


def _size(pdf: pd.DataFrame) -> pd.Series:
    return pdf["block"].map(lambda b: sum(map(len, b)))


def _page_runs(pdfs):
    """(page, run), once for each run of a page."""
    for pdf in pdfs:
        for piece in _pieces(pdf, _size(pdf)):
            _, keys, page, _ = _keys_of(piece)
            both = pd.DataFrame({"id": piece["id"].to_numpy()[page], "run": keys.view(np.int64)})
            yield both.drop_duplicates()


def _run_counts(screen):
    """Rows of (run, pages) of the runs whose shortened hash is in ``screen``: (bits, their
    sorted values as a broadcast); all runs without it."""
    def count(pdfs):
        for both in _page_runs(pdfs):
            run = both["run"].to_numpy()
            if screen:
                bits, known = screen
                short = run.view(np.uint64) >> np.uint64(64 - bits)
                place = np.minimum(np.searchsorted(known.value, short), max(0, len(known.value) - 1))
                run = run[known.value[place] == short] if len(known.value) else run[:0]
            run, n = np.unique(run, return_counts=True)
            yield pd.DataFrame({"run": run, "n": n})
    return count


def _shortened(bits: int, bucket_bits: int):
    """Shortened hashes of the runs of many pages, each as often as pages have it but no more
    often than decides, by bucket: sorted, as packed differences."""
    def pack(waiting):
        runs = np.sort(np.concatenate(waiting).view(np.uint64) >> np.uint64(64 - bits))
        if len(runs) > MIN_PAGES:
            runs = runs[np.concatenate([np.ones(MIN_PAGES, bool), runs[MIN_PAGES:] != runs[:-MIN_PAGES]])]
        bucket = (runs >> np.uint64(bits - bucket_bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bucket_bits))
        return pd.DataFrame({"bucket": bucket[cut[:-1]], "n": np.diff(cut), "runs": [
            squeezed(np.diff(runs[lo:hi], prepend=np.uint64(0)).view(np.int64)) for lo, hi in zip(cut[:-1], cut[1:])]})

    def send(pdfs):
        waiting, size = [], 0
        for both in _page_runs(pdfs):
            waiting.append(both["run"].to_numpy())
            size += len(waiting[-1])
            if size >= FLUSH_RUNS:
                yield pack(waiting)
                waiting, size = [], 0
        if size:
            yield pack(waiting)
    return send


def _repeated(table: pa.Table) -> pa.Table:
    """The shortened hashes of a bucket that enough pages have."""
    runs = np.concatenate([np.cumsum(restored(b.as_py(), n.as_py()).view(np.uint64), dtype=np.uint64)
                           for b, n in zip(table.column("runs"), table.column("n"))])
    one, n = np.unique(runs, return_counts=True)
    return pa.table({"run": one[n >= MIN_PAGES].view(np.int64)})


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text``, ``n_chars`` (code points), ``n_shared`` (words in substrings
    shared with other pages of the host) of every row.

    A null or empty page has an empty text; rows without a host form a host of their
    own; rows of a host with equal blocks count as one page and give equal texts; an empty
    table gives no rows; other columns don't matter. The pages that have a run of words
    are counted over the whole host, whatever its size, by an aggregate over hashes of
    (host, run). Shortened hashes are counted first, as packed sorted differences of about two
    bytes a run: only runs whose shortened hash enough pages have can be shared, and these
    alone are counted by their whole hash. The shared runs are broadcast while they are few,
    else joined by shuffle (and then counted without the screening)."""
    spark = pages.sparkSession
    base = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"),
                        host_of(F.col(f"`{url}`")).alias("host"), F.monotonically_increasing_id().alias("id"))

    def parse(pdfs):
        for pdf in pdfs:
            for piece in _pieces(pdf, pdf["html"].map(lambda h: len(h) if isinstance(h, str) else 0)):
                blocks = [page_blocks(h if isinstance(h, str) else None) for h in piece["html"]]
                yield piece.drop(columns="html").assign(
                    inside=[[i for i, _ in b] for b in blocks], block=[[t for _, t in b] for b in blocks],
                    n_words=[sum(t.count(" ") + 1 for _, t in b) for b in blocks],
                    digest=[hashlib.md5("\n".join(f"{i:d}{t}" for i, t in b).encode("utf-8", "surrogatepass")).hexdigest()
                            for b in blocks])

    kind = dict(base.dtypes)
    parsed = written(base.mapInPandas(parse, f"key {kind['key']}, url string, host string, id long, "
                                             "inside array<boolean>, block array<string>, n_words long, digest string"), "pages")
    same = ["host", "digest"]
    first = parsed.groupBy(same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = parsed.select(*same, "id").join(first, same).where("id > first").select("id")
    later = F.broadcast(later) if later.count() <= BROADCAST_RUNS else later
    distinct = parsed.join(later, "id", "left_anti")
    n_words = distinct.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    bucket_bits = (n_words // SCREEN_RUNS).bit_length()
    bits = min(63, max(1, n_words.bit_length()) + SPARE_BITS)
    repeated = written(distinct.select("id", "host", "block")
                       .mapInPandas(_shortened(bits, bucket_bits), "bucket long, n long, runs binary")
                       .groupBy("bucket").applyInArrow(_repeated, "run long"), "page-screen")
    screen = None
    if repeated.count() <= BROADCAST_RUNS:
        known = np.sort(repeated.toPandas()["run"].to_numpy(np.int64).view(np.uint64))
        screen = bits, spark.sparkContext.broadcast(known)
    counts = distinct.select("id", "host", "block").mapInPandas(_run_counts(screen), "run long, n long")
    shared = written(counts.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_PAGES).select("run"), "page-runs")
    few = shared.count() <= BROADCAST_RUNS
    if few:
        runs = spark.sparkContext.broadcast(np.sort(shared.toPandas()["run"].to_numpy(np.int64)))
        found = parsed.withColumn("runs", F.lit(None).cast("array<long>"))
    else:
        own = parsed.select("id", "host", "block").mapInPandas(_page_runs, "id long, run long")
        found = parsed.join(own.join(shared, "run", "left_semi").groupBy("id").agg(F.collect_list("run").alias("runs")),
                            "id", "left")

    def finish(pdfs):
        for pdf in pdfs:
            for piece in _pieces(pdf, _size(pdf)):
                first, keys, page, at = _keys_of(piece)
                keys = keys.view(np.int64)
                if few:
                    place = np.minimum(np.searchsorted(runs.value, keys), max(0, len(runs.value) - 1))
                    hit = runs.value[place] == keys if len(runs.value) else np.zeros(len(keys), bool)
                else:
                    hit = np.zeros(len(keys), bool)
                    edge = np.searchsorted(page, np.arange(len(piece) + 1))
                    for i, r in enumerate(piece["runs"]):
                        if r is not None:
                            hit[edge[i]:edge[i + 1]] = np.isin(keys[edge[i]:edge[i + 1]], r)
                cover = np.zeros(int(first[-1]) + 1, np.int64)
                np.add.at(cover, at[hit], 1)
                np.add.at(cover, at[hit] + RUN_WORDS, -1)
                cover = np.cumsum(cover)[:-1] > 0
                covers = [cover[lo:hi] for lo, hi in zip(first[:-1], first[1:])]
                texts = [without(list(zip(i, b)), [t.split(" ") for t in b], c) if c.any() and not all(i) else "\n\n".join(b)
                         for i, b, c in zip(piece["inside"], piece["block"], covers)]
                yield pd.DataFrame({"key": piece["key"], "url": piece["url"], "text": texts,
                                    "n_chars": [len(t) for t in texts], "n_shared": [int(c.sum()) for c in covers]})

    return found.select("id", "key", "url", "host", "inside", "block", "runs").mapInPandas(
        finish, f"key {kind['key']}, url string, text string, n_chars long, n_shared long").select(
        F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars", "n_shared")


def op7_page_text(spark, sf_dir) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars, n_shared."""
    from ._common import read
    return extract(read(spark, sf_dir, "pages"))
