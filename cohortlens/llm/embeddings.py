"""3. Embedding near-dedup with binary codes of randomised rotations.

Vectors are rotated at random and their signs kept as bits. Bands of bits, as many as
the wanted recall asks for at the threshold, bring near vectors into one bucket. Codes
and their correction factors are stored once with each vector and go to the buckets in
its place. They give an unbiased estimate of the inner product and a confidence bound;
the vectors of rows whose bound reaches the threshold with some other follow, and only
such pairs are computed exactly. Only exact values make links.
"""
from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import mix64, written
from ._components import components

THRESHOLD = 0.9
MISS = 0.03           # chance that a pair at the threshold itself shares no band
EXTRA_BITS = 4        # bits of a band beyond log2(rows)
ESTIMATE_ROTATIONS = 2
SIGMAS = 5.0
BLOCK = 512           # vectors of a bucket that one group holds of either side
PAIRS = 1 << 14       # pairs compared at a time
PLANES = 4            # bits of a rounded component of the rotated vector
SEED = 20240229


def band_shape(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a band, bands): bits grow with log2 of the rows, so that chance buckets
    stay small, and bands with them, so that recall stays."""
    bits = min(60, max(6, math.ceil(math.log2(max(2, n))) + EXTRA_BITS))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


@functools.lru_cache(maxsize=4)
def rotations(d: int, count: int) -> np.ndarray:
    """``count`` random orthogonal d x d matrices side by side."""
    rng = np.random.default_rng([SEED, d])
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        out.append(q * np.sign(np.diag(r)))
    return np.hstack(out)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def sign_string(u: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The packed signs that all bands take their bits from, one row a vector."""
    return np.packbits(u @ rotations(u.shape[1], -(-bits * bands // u.shape[1])) > 0, axis=1, bitorder="little")


def band_values(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The bands' bits of packed signs as integers, one column a band."""
    out = np.empty((len(signs), bands), np.uint64)
    weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    loose = np.unpackbits(signs, axis=1, count=bits * bands, bitorder="little")
    for b in range(bands):
        out[:, b] = loose[:, b * bits:(b + 1) * bits].astype(np.uint64) @ weight
    return out


def _bound(dots: np.ndarray, f: np.ndarray, d: int, noise: np.ndarray | float = 0.0) -> np.ndarray:
    """Upper confidence bound from <code, rotated> and the code's factor, a column a
    rotation: their quotients' mean is unbiased, and what the code leaves of a unit vector
    spreads each by about sqrt((1 - f^2) / f^2 / (d - 1)); ``noise`` is the deviation that
    rounding adds to the dot product."""
    spread = np.sqrt(np.maximum(0, 1 - f * f) / max(1, d - 1) + noise * noise) / f
    return (dots / f).mean(1) + SIGMAS * spread.mean(1) / math.sqrt(f.shape[1])


def _words(loose: np.ndarray) -> np.ndarray:
    """Booleans of the last axis packed to 64-bit words."""
    fill = [(0, 0)] * (loose.ndim - 1) + [(0, -loose.shape[-1] % 64)]
    return np.packbits(np.pad(loose, fill), axis=-1, bitorder="little").view(np.uint64)


class Codes:
    """Sign codes over a few rotations and their correction factors."""

    def __init__(self, u: np.ndarray, count: int = ESTIMATE_ROTATIONS):
        self.count, self.d = count, u.shape[1]
        self.rotated = u @ rotations(self.d, count)
        self.signs = np.where(self.rotated > 0, 1.0, -1.0) / math.sqrt(self.d)
        self.factor = (self.signs * self.rotated).reshape(len(u), count, self.d).sum(2)

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper confidence bound of the inner products of rows i and j."""
        dots = (self.signs[i] * self.rotated[j]).reshape(len(i), self.count, self.d).sum(2)
        return _bound(dots, self.factor[i], self.d)

    def packed(self) -> np.ndarray:
        """The rows of ``PackedCodes``: the rotated vector is rounded to ``PLANES`` bits a
        component, up or down at random, so that the estimate stays unbiased."""
        x = self.rotated.reshape(-1, self.count, self.d)
        low = x.min(2).astype(np.float32)
        step = ((x.max(2) - low) / (2 ** PLANES - 1)).astype(np.float32)
        rng = np.random.default_rng([SEED, self.d, self.count])
        level = np.floor((x - low[:, :, None]) / np.where(step > 0, step, 1)[:, :, None] + rng.random(x.shape))
        level = np.clip(level, 0, 2 ** PLANES - 1).astype(np.uint8)
        planes = np.stack([x > 0, *[level >> p & 1 == 1 for p in range(PLANES)]], axis=2)
        scales = np.stack([self.factor.astype(np.float32), low, step], axis=2)
        return np.hstack([y.reshape(len(x), -1).view(np.uint8) for y in (_words(planes), np.ascontiguousarray(scales))])


class PackedCodes:
    """Stored codes: for each rotation a word row of signs, ``PLANES`` word rows of the
    rounded rotated vector, and the correction factor, lowest value and step."""

    def __init__(self, rows: np.ndarray, d: int, count: int = ESTIMATE_ROTATIONS):
        self.d, split = d, count * (1 + PLANES) * -(-d // 64) * 8
        words = np.ascontiguousarray(rows[:, :split]).view(np.uint64).reshape(len(rows), count, 1 + PLANES, -1)
        self.signs, self.planes = words[:, :, 0], words[:, :, 1:]
        scales = np.ascontiguousarray(rows[:, split:]).view(np.float32).reshape(len(rows), count, 3).astype(np.float64)
        self.factor, self.low, self.step = scales[:, :, 0], scales[:, :, 1], scales[:, :, 2]
        weight = 1 << np.arange(PLANES)
        self.ones = np.bitwise_count(self.signs).sum(2, dtype=np.int64)
        self.levels = np.bitwise_count(self.planes).sum(3, dtype=np.int64) @ weight

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper confidence bound of the inner products of rows i and j, by popcounts."""
        both = sum(np.bitwise_count(self.signs[i] & self.planes[j, :, p]).sum(2, dtype=np.int64) << p
                   for p in range(PLANES))
        dots = self.low[j] * (2 * self.ones[i] - self.d) + self.step[j] * (2 * both - self.levels[j])
        return _bound(dots / math.sqrt(self.d), self.factor[i], self.d, self.step[j] / 2) + 1e-6


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(col: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in col]


def _fixed(col: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as a matrix of bytes."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _encoded(classes: DataFrame, bits: int, bands: int) -> DataFrame:
    """(id, w, d, code, signs): what is stored of every class beside its vector."""
    def run(batches):
        for b in batches:
            ids, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "w"))
            vectors = _vectors(b.column("v"))
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                u = unit(np.stack([vectors[i] for i in at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(w[at]), pa.array(np.full(len(at), d, np.int32)),
                     _binary(Codes(u).packed()), _binary(sign_string(u, bits, bands))], ["id", "w", "d", "code", "signs"])
    return classes.mapInArrow(run, "id long, w long, d int, code binary, signs binary")


def _keys_of(codes: DataFrame, bits: int, bands: int) -> DataFrame:
    """(id, band, key) of every class and band; the key also holds the dimension."""
    def run(batches):
        for b in batches:
            ids, sizes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "d"))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                keys = band_values(_fixed(b.column("signs").take(pa.array(at))), bits, bands)
                keys = mix64(keys + np.uint64(int(d) << 44)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(at))),
                     pa.array(keys.ravel())], ["id", "band", "key"])
    return codes.select("id", "d", "signs").mapInArrow(run, "id long, band int, key long")


def _whole_groups(batches):
    """Tables of whole groups of one dimension, from rows that come sorted by group."""
    def by_dimension(t):
        d = t["d"].to_numpy()
        for x in np.unique(d):
            yield int(x), t.take(pa.array(np.flatnonzero(d == x))).combine_chunks()

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        g = t["g"].to_numpy()
        cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
        if cut:
            yield from by_dimension(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield from by_dimension(held)


def _pairs(g: np.ndarray, side: np.ndarray):
    """(i, j) of all pairs to compare, some ``PAIRS`` at a time. Rows of side 0 are one
    block with itself; sides 1 and 2, in this order, are two blocks against each other."""
    n = len(g)
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[start, n])
    end = np.repeat(start + size, size)
    second = np.repeat(start + np.add.reduceat((side < 2).astype(np.int64), start), size)
    first = np.where(side == 0, np.arange(n) + 1, np.where(side == 1, second, end))
    count = end - first
    total = np.r_[0, np.cumsum(count)]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1)
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        if len(i):
            yield i, np.arange(len(i)) + np.repeat(first[lo:hi] - (np.cumsum(c) - c), c)
        lo = hi


def _screened(grouped: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``grouped`` whose bound reaches the threshold with some row of their
    group: only their vectors are fetched."""
    def run(batches):
        for d, t in _whole_groups(batches):
            codes = PackedCodes(_fixed(t["code"]), d)
            some = np.zeros(t.num_rows, bool)
            for i, j in _pairs(t["g"].to_numpy(), t["side"].to_numpy()):
                near = codes.upper(i, j) >= threshold
                some[i[near]] = some[j[near]] = True
            yield from t.filter(pa.array(some)).select(["g", "band", "side", "id"]).to_batches()
    return grouped.mapInArrow(run, "g long, band int, side int, id long")


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n links with the components of links (a, b): each row to its smallest."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _compared(grouped: DataFrame, bits: int, bands: int, threshold: float) -> DataFrame:
    """(id, links, to): linked weight of every row of a group, and spanning links. A pair
    counts in the first band that it shares; its bound and then its exact cosine must
    reach the threshold."""
    def run(batches):
        for d, t in _whole_groups(batches):
            n, ids, weights, band = t.num_rows, *(t[c].to_numpy() for c in ("id", "w", "band"))
            codes, values = PackedCodes(_fixed(t["code"]), d), band_values(_fixed(t["signs"]), bits, bands)
            u = unit(np.stack(_vectors(t["v"])))
            links, a, b = np.zeros(n), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i, j in _pairs(t["g"].to_numpy(), t["side"].to_numpy()):
                near = codes.upper(i, j) >= threshold
                i, j = i[near], j[near]
                new = (values[i] == values[j]).argmax(1) == band[i]
                i, j = i[new], j[new]
                exact = (u[i] * u[j]).sum(1) >= threshold
                i, j = i[exact], j[exact]
                if len(i):
                    links += np.bincount(i, weights[j], n) + np.bincount(j, weights[i], n)
                    a, b = _spanning(np.r_[a, i], np.r_[b, j], n)
            some = np.flatnonzero(links)
            if len(some):
                to = np.arange(n)
                to[a] = b
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[some], links[some].astype(np.int64), ids[to[some]])], ["id", "links", "to"])
    return grouped.mapInArrow(run, "id long, links long, to long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``id``, ``n_links`` and ``component_id`` of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and vectors of different lengths not with each other. Equal vectors are one
    class with a weight, so exact copies cost one row; a row with a null key keeps a
    null component; repeated rows of a key count as copies; empty tables give no rows.
    A large bucket is dealt over blocks of ``BLOCK`` vectors a side, and a block returns
    counts and spanning links, never its pairs."""
    base = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    fit = base.where(usable(F.col("v")) & F.col("id").isNotNull())
    classes = written(fit.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "vector-classes")
    bits, bands = band_shape(classes.count(), threshold, miss)

    codes = written(_encoded(classes, bits, bands), "vector-codes")

    keys = _keys_of(codes, bits, bands)
    sizes = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(sizes, ["band", "key"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = shared.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id", "band"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    grouped = dealt.select("id", "band", F.xxhash64("band", "key", lo, hi).alias("g"),
                           F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1)
                           .otherwise(2).alias("side"))

    def in_groups(df):
        return df.repartition("g").sortWithinPartitions("g", "side", "id")

    near = _screened(in_groups(grouped.join(codes.select("id", "d", "code"), "id")), threshold)
    near = near.join(codes, "id").join(classes.select("id", "v"), "id")
    found = written(_compared(in_groups(near), bits, bands, threshold), "vector-links")

    copies = base.join(classes.select(F.col("v"), F.col("id").alias("rep"), "w"), "v").where("id is not null") \
        .select("id", "rep", "w")
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    label = components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    each = copies.join(counts, "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"),
        F.min(F.coalesce("component", "rep")).alias("component_id"))
    return base.select("id").join(each, "id", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op3_embedding_near_dedup(spark, sf_dir) -> DataFrame:
    """Near-duplicate vectors: vec_id, n_links, component_id, kept."""
    from ._common import read
    found = near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

