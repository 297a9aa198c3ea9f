"""Graph operators (g_*): doc-term incidence, sliding windows, window
frequencies, pair counts, PMI, heterogeneous edge table, neighbour aggregates.

Edges stay COO tables (src, dst, weight) — never dense V x V / D x V matrices.
Window and pair counts follow from the positions of terms in a doc, so no window is
ever expanded into its pairs. Neighbour aggregates explode feature
vectors to (node, dim) rows so every reduction is a partial aggregate keyed by
(dst, dim): a node with a huge in-degree is spread over many tasks.
"""
from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WINDOW = 20


def doc_word_edges(doc_terms: DataFrame, id_col: str = "note_id") -> DataFrame:
    """g_doc_word: binary note-term edges with weight 1.0."""
    return doc_terms.select(F.col(id_col).alias("doc"), F.col("term_id").alias("term"),
                            F.lit(1.0).alias("weight")).distinct()


def _in_doc(id_col: str):
    return Window.partitionBy(id_col).orderBy("pos")


def windows(doc_terms: DataFrame, docs: DataFrame, size: int = WINDOW, id_col: str = "note_id") -> DataFrame:
    """g_windows / w_sliding: windows of ``size`` over each doc's terms (id, pos, term_id),
    stride 1; a doc of <= size terms (none included) is one window. Each position
    collects only its own window."""
    w = _in_doc(id_col)
    rows = (doc_terms.withColumn("window", F.collect_list("term_id").over(w.rowsBetween(0, size - 1)))
            .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(id_col)))
            .where(F.col("pos") <= F.greatest(F.col("_n") - size, F.lit(0)))
            .select(id_col, F.col("pos").cast("int").alias("w"), "window"))
    bare = docs.select(id_col).join(doc_terms.select(id_col), id_col, "left_anti")
    return rows.unionByName(bare.select(id_col, F.lit(0).alias("w"), F.array().cast("array<int>").alias("window")))


def _sized(doc_terms: DataFrame, size: int, id_col: str) -> DataFrame:
    """Adds ``_last``, the number of the doc's last window."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    return doc_terms.withColumn("_last", F.greatest(n - size, F.lit(0)))


def window_freq(doc_terms: DataFrame, size: int = WINDOW, id_col: str = "note_id") -> DataFrame:
    """g_window_freq: number of windows containing each term, from its position alone:
    windows pos - size + 1 to pos, as far as they exist."""
    n = F.least("pos", "_last") - F.greatest(F.col("pos") - size + 1, F.lit(0)) + 1
    return (_sized(doc_terms, size, id_col).groupBy(F.col("term_id").alias("term"))
            .agg(F.sum(n).cast("long").alias("freq")))


def pair_count(doc_terms: DataFrame, size: int = WINDOW, id_col: str = "note_id") -> DataFrame:
    """g_pair_count / j_pair_window: windows containing an ordered pair (i, j), i != j,
    counted in both directions. The windows that hold positions p < q start at
    q - size + 1 to p, so a pair row needs no window rows; a term pairs with the
    size - 1 terms after it."""
    after = F.collect_list(F.struct(F.col("term_id").alias("j"), F.col("pos").alias("q"))).over(
        _in_doc(id_col).rowsBetween(1, size - 1))
    pairs = _sized(doc_terms, size, id_col).withColumn("_after", after).select(
        F.col("term_id").alias("i"), "pos", "_last", F.explode("_after").alias("b"))
    n = F.least("pos", "_last") - F.greatest(F.col("b.q") - size + 1, F.lit(0)) + 1
    once = (pairs.where(F.col("i") != F.col("b.j")).groupBy("i", F.col("b.j").alias("j"))
            .agg(F.sum(n).cast("long").alias("count")))
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return (once.select("count", F.explode(both).alias("p")).groupBy(F.col("p.i").alias("i"), F.col("p.j").alias("j"))
            .agg(F.sum("count").alias("count")))


def n_windows(doc_terms: DataFrame, docs: DataFrame, size: int = WINDOW, id_col: str = "note_id") -> DataFrame:
    """One row: the number of windows of all docs, with one for each doc without a term."""
    per = doc_terms.groupBy(id_col).agg(F.greatest(F.count(F.lit(1)) - size, F.lit(0)).alias("_more"))
    more = per.select(F.coalesce(F.sum("_more"), F.lit(0))).scalar()
    return docs.select((F.count(F.lit(1)) + more).cast("double").alias("n_windows"))


def pmi(doc_terms: DataFrame, docs: DataFrame, size: int = WINDOW, id_col: str = "note_id") -> DataFrame:
    """g_pmi: ln(c * N / (f_i * f_j)) for pairs with PMI > 0; N counts every window,
    including the single window of an empty doc."""
    total = n_windows(doc_terms, docs, size, id_col).scalar()
    f = window_freq(doc_terms, size, id_col)
    fi = f.select(F.col("term").alias("i"), F.col("freq").alias("fi"))
    fj = f.select(F.col("term").alias("j"), F.col("freq").alias("fj"))
    p = (pair_count(doc_terms, size, id_col).join(fi, "i").join(fj, "j")
         .withColumn("weight", F.log(F.col("count") * total / (F.col("fi") * F.col("fj")))))
    return p.where(F.col("weight") > 0).select("i", "j", "weight")


def nonzero(matrix_rows: DataFrame, row_col: str = "row", vec_col: str = "values") -> DataFrame:
    """g_nonzero: dense rows (row, array) -> COO (row, col, weight) for w != 0."""
    return (matrix_rows.select(row_col, F.posexplode(vec_col).alias("col", "weight"))
            .where(F.col("weight") != 0))


def hetero_graph(doc_word: DataFrame, word_word: DataFrame, contains: bool = True) -> DataFrame:
    """g_hetero_graph: one edge table with an etype column:
    ('dic','in','post') = term -> doc, ('dic','co-occur','dic') = PMI edges,
    optional ('post','contains','dic') = the reversed 'in' edges."""
    e_in = doc_word.select(F.col("term").alias("src"), F.col("doc").alias("dst"),
                           F.lit("in").alias("etype"), "weight")
    e_co = word_word.select(F.col("i").alias("src"), F.col("j").alias("dst"),
                            F.lit("co-occur").alias("etype"), "weight")
    out = e_in.unionByName(e_co)
    if contains:
        out = out.unionByName(doc_word.select(F.col("doc").alias("src"), F.col("term").alias("dst"),
                                              F.lit("contains").alias("etype"), "weight"))
    return out


def node_vectors(nodes: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(node, vec): features as one array of doubles a node."""
    return nodes.select(F.col(id_col).alias("node"), F.col(vec_col).cast("array<double>").alias("vec"))


def _reduced(edges: DataFrame, vectors: DataFrame, dims: int, reducer) -> DataFrame:
    """u_mul_e messages reduced by element: (dst, etype, deg, vec). A vector crosses the
    join whole, with one row an edge; its elements are ``dims`` aggregates of one group,
    combined before the shuffle, so a node of many in-edges is no hot task. A null vector,
    a null element or one past the vector's end takes no part."""
    pairs = edges.select("src", "dst", "etype", "weight").join(
        vectors.select(F.col("node").alias("src"), "vec"), "src")
    return pairs.groupBy("dst", "etype").agg(
        F.count(F.lit(1)).alias("deg"),
        F.array(*[reducer(F.col("weight") * F.get("vec", F.lit(i))) for i in range(dims)]).alias("vec"))


def by_dim(vectors: DataFrame, *keys: str) -> DataFrame:
    """(*keys, dim, value) rows of reduced vectors, without elements that no message has."""
    return vectors.select(*keys, F.posexplode("vec").alias("dim", "value")).where("value is not null")


def neighbor_mean(edges: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """g_neighbor_mean: (dst, etype, deg, vec), mean of weighted messages over in-edges per
    relation."""
    return _reduced(edges, vectors, dims, F.avg)


def neighbor_gcn(edges: DataFrame, vectors: DataFrame, etypes: list[str], dims: int) -> DataFrame:
    """g_neighbor_gcn: (sum of messages + own feature) / (in-degree + 1), for every node
    and relation; a node without in-edges keeps its own feature."""
    s = _reduced(edges, vectors, dims, F.sum).withColumnRenamed("vec", "sums")
    own = vectors.select(F.col("node").alias("dst"), "vec", F.explode(F.array(*[F.lit(e) for e in etypes])).alias("etype"))
    sums = F.coalesce("sums", F.array_repeat(F.lit(None).cast("double"), dims))
    mixed = F.transform("vec", lambda x, i: (F.coalesce(F.get(sums, i), F.lit(0.0)) + x) / (F.coalesce("deg", F.lit(0)) + 1))
    return own.join(s, ["dst", "etype"], "left").select("dst", "etype", mixed.alias("vec"))


def neighbor_max(edges: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """g_neighbor_max: element-wise max of the messages (pool reducer)."""
    return _reduced(edges, vectors, dims, F.max)


def zero_degree(reduced: DataFrame, nodes: DataFrame, etypes: list[str], dims: int) -> DataFrame:
    """g_zero_degree: nodes without in-edges of a relation get zero vectors. The (node,
    etype) frame is generated per node (explode), not crossed."""
    full = (nodes.select(F.col("node").alias("dst")).distinct()
            .withColumn("etype", F.explode(F.array(*[F.lit(e) for e in etypes]))))
    zeros = F.array_repeat(F.lit(0.0), dims)
    filled = F.transform(F.coalesce("vec", zeros), lambda x: F.coalesce(x, F.lit(0.0)))
    return full.join(reduced, ["dst", "etype"], "left").select("dst", "etype", filled.alias("vec"))


def relation_sum(reduced: DataFrame, dims: int) -> DataFrame:
    """g_relation_sum: sum of the per-relation results (aggregate='sum')."""
    return reduced.groupBy("dst").agg(F.array(*[F.sum(F.get("vec", F.lit(i))) for i in range(dims)]).alias("vec"))


def fanout_sample(edges: DataFrame, k: int | dict[str, int], seed: int = 42, dst: str = "dst",
                  etype: str = "etype", src: str = "src", salts: int = 64) -> DataFrame:
    """w_fanout_sample: keep <= k in-neighbours per (node, relation), the k smallest by
    md5(src || seed); a dict gives each relation its own k (0 for those left out). Exact
    two-stage top-k: first per (node, relation, salt) so a node with a huge in-degree is
    split over ``salts`` tasks, then over the <= salts*k survivors of each node."""
    key = F.md5(F.concat(F.col(src).cast("string"), F.lit(str(seed))))
    most = F.lit(k) if isinstance(k, int) else F.lit(0)
    for name, n in ({} if isinstance(k, int) else k).items():
        most = F.when(F.col(etype) == name, n).otherwise(most)
    e = edges.withColumn("_k", key).withColumn("_s", F.abs(F.xxhash64(src)) % salts).withColumn("_m", most)
    w1 = Window.partitionBy(dst, etype, "_s").orderBy("_k", src)
    first = e.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= F.col("_m"))
    w2 = Window.partitionBy(dst, etype).orderBy("_k", src)
    return (first.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= F.col("_m"))
            .drop("_r", "_k", "_s", "_m"))


def layered_sample(edges: DataFrame, seeds: DataFrame, k: int | dict[str, int], layers: int = 2,
                   seed: int = 42) -> DataFrame:
    """Neighbour sampling over several layers: the sampled in-edges of the seeds (``dst``),
    then those of the nodes reached, and so on. Each layer is checkpointed, so the next
    joins a written frontier; a node reached twice is one in the frontier."""
    frontier, out = seeds.select("dst").distinct(), None
    for layer in range(1, layers + 1):
        found = cut_lineage(fanout_sample(edges.join(frontier, "dst", "left_semi"), k, seed)
                            .select(F.lit(layer).alias("layer"), "src", "dst", "etype", "weight"))
        out = found if out is None else out.unionByName(found)
        frontier = found.select(F.col("src").alias("dst")).distinct()
    return out
