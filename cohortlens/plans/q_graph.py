"""Registered graph queries (2.11 g_*, w_sliding, j_pair_window)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import text as T
from ..session import checkpoint_dir, cut_lineage
from ..sources import tables as IO
from .q_split import LK, split_table
from .q_text import DOC_TERM_SQL, doc_terms, wnotes
from .registry import query

W = G.WINDOW


def terms(t):
    """Terms of every note, written once for the several counts made of them."""
    return t.memo("graph_terms", lambda: cut_lineage(doc_terms(t)))


def doc_word(t):
    return G.doc_word_edges(doc_terms(t))


def wins(t):
    return G.windows(terms(t), t.notes, W)


TL = ("dt as (" + DOC_TERM_SQL + "),\ntl as (select n.note_id, coalesce(list(d.term_id order by d.term_id) "
      "filter (where d.term_id is not null), []) as terms from {notes} n left join dt d on n.note_id = d.note_id "
      "group by n.note_id)")
WINS = f"""wins as (select note_id, w, terms[start + 1: start + {W}] as win from
  (select note_id, terms, unnest(range(0, greatest(len(terms) - {W}, 0) + 1)) as start,
          generate_subscripts(range(0, greatest(len(terms) - {W}, 0) + 1), 1) - 1 as w from tl) z)"""
FREQ = """freq as (select term, count(*) as freq from
  (select unnest(list_distinct(win)) as term from wins) u group by term)"""
PAIRS = """pairs as (select a.t as i, b.t as j, count(*) as count from
  (select note_id, w, unnest(win) as t from wins) a join
  (select note_id, w, unnest(win) as t from wins) b
  on a.note_id = b.note_id and a.w = b.w and a.t <> b.t group by a.t, b.t)"""
PMI = """pmi as (select p.i, p.j, ln(p.count * (select count(*) from wins)::double / (fi.freq * fj.freq)) as weight
  from pairs p join freq fi on p.i = fi.term join freq fj on p.j = fj.term)"""
BASE = "with " + TL.replace("{notes}", "notes") + ",\n" + WINS + ",\n" + FREQ + ",\n" + PAIRS + ",\n" + PMI + "\n"
DW = ("dw as (select distinct note_id as doc, unnest(terms) as term, 1.0 as weight from tl)")


@query("g_windows", BASE + "select note_id, w, len(win) as n_terms, "
       "array_to_string(win, ',') as win from wins")
def g_windows(t):
    return wins(t).select("note_id", "w", F.size("window").alias("n_terms"),
                          F.array_join(F.transform("window", lambda x: x.cast("string")), ",")
                          .alias("win"))


@query("w_sliding", BASE + "select count(*) as n_windows, count(distinct note_id) as n_docs, "
       "cast(sum(len(win)) as bigint) as n_slots from wins")
def w_sliding(t):
    return wins(t).agg(F.count(F.lit(1)).alias("n_windows"),
                       F.count_distinct("note_id").alias("n_docs"),
                       F.sum(F.size("window")).cast("bigint").alias("n_slots"))


@query("g_window_freq", BASE + "select * from freq")
def g_window_freq(t):
    return G.window_freq(terms(t), W)


@query("g_pair_count", BASE + "select * from pairs")
def g_pair_count(t):
    return G.pair_count(terms(t), W)


@query("j_pair_window", BASE + "select count(*) as n_pairs, cast(sum(count) as bigint) as n_window_pairs "
       "from pairs")
def j_pair_window(t):
    p = G.pair_count(terms(t), W)
    return p.agg(F.count(F.lit(1)).alias("n_pairs"),
                 F.sum("count").cast("bigint").alias("n_window_pairs"))


@query("g_pmi", BASE + "select i, j, round(weight, 6) as weight from pmi where weight > 0")
def g_pmi(t):
    return G.pmi(terms(t), t.notes, W).withColumn("weight", F.round("weight", 6))


@query("g_doc_word", BASE.rstrip() + ",\n" + DW + "\nselect * from dw")
def g_doc_word(t):
    return doc_word(t)


@query("g_nonzero", BASE + "select note_id as row, unnest(terms) as col, 1.0 as weight from tl")
def g_nonzero(t):
    v = t.note_terms.count()
    held = doc_terms(t).groupBy(F.col("note_id").alias("row")).agg(F.array_sort(F.collect_set("term_id")).alias("_t"))
    # A row is built from the zeros before each term and after the last one.
    before = F.concat(F.array(F.lit(-1)), F.slice("_t", F.lit(1), F.size("_t") - 1))
    upto = F.zip_with("_t", before, lambda a, b: F.concat(F.array_repeat(F.lit(0.0), a - b - 1), F.array(F.lit(1.0))))
    rest = F.array_repeat(F.lit(0.0), F.lit(v - 1) - F.array_max("_t"))
    dense = held.select("row", F.concat(F.flatten(upto), rest).alias("values"))
    return G.nonzero(dense)


@query("g_hetero_graph", BASE.rstrip() + ",\n" + DW + """
select term as src, doc as dst, 'in' as etype, weight from dw
union all select i, j, 'co-occur', round(weight, 6) from pmi where weight > 0
union all select doc, term, 'contains', weight from dw""")
def g_hetero_graph(t):
    g = G.hetero_graph(G.doc_word_edges(terms(t)), G.pmi(terms(t), t.notes, W))
    return g.withColumn("weight", F.round("weight", 6))


# g_save: PMI edges of the training notes alone, and each split's own note-term edges.
SAVE_SQL = (LK.rstrip() + ",\ntrain_notes as (select * from wnotes where pat_deid in (select pat_deid from sp where split = 'train')),\n"
            + TL.replace("{notes}", "train_notes") + ",\n" + WINS + ",\n" + FREQ + ",\n" + PAIRS + ",\n" + PMI + """
select 'pmi' as part, 'train' as split, count(*) as n_edges, round(sum(weight), 4) as weight from pmi where weight > 0 having count(*) > 0
union all select 'doc_word', sp.split, count(*), cast(count(*) as double) from dt join wnotes n on dt.note_id = n.note_id
join sp on n.pat_deid = sp.pat_deid group by sp.split""")


@query("g_save", SAVE_SQL)
def g_save(t):
    root = f"{checkpoint_dir(t.spark).rstrip('/')}/graph/{uuid.uuid4().hex}"
    notes = cut_lineage(wnotes(t).join(split_table(t).select("pat_deid", "split"), "pat_deid"))
    found = cut_lineage(T.doc_terms(notes, t.note_terms))
    train = notes.where("split = 'train'")
    IO.write_table(G.pmi(found.join(train.select("note_id"), "note_id", "left_semi"), train, W), root + "/pmi")
    IO.write_table(G.doc_word_edges(found).join(notes.select(F.col("note_id").alias("doc"), "split"), "doc"),
                   root + "/doc_word", partition_by=["split"])
    a = t.spark.read.parquet(root + "/pmi").select(F.lit("pmi").alias("part"), F.lit("train").alias("split"), "weight")
    b = t.spark.read.parquet(root + "/doc_word").select(F.lit("doc_word").alias("part"), "split", "weight")
    return a.unionByName(b).groupBy("part", "split").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("weight"), 4).alias("weight"))


DIMS = 64


def vectors(t):
    return G.node_vectors(t.embeddings, "vec_id", "embedding")


def by_dim(reduced, *keys):
    return G.by_dim(reduced, *keys).withColumn("value", F.round("value", 6))


FEATS = ("feats as (select vec_id as node, generate_subscripts(embedding, 1) - 1 as dim, "
         "cast(unnest(embedding) as double) as x from embeddings)")
MSG = ("msg as (select e.dst, e.etype, f.dim, e.weight * f.x as m from graph_edges e "
       "join feats f on e.src = f.node)")
GBASE = "with " + FEATS + ",\n" + MSG + "\n"


@query("g_neighbor_mean", GBASE + "select dst, etype, dim, round(avg(m), 6) as value from msg "
       "group by dst, etype, dim")
def g_neighbor_mean(t):
    return by_dim(G.neighbor_mean(t.graph_edges, vectors(t), DIMS), "dst", "etype")


ETYPES = ["co-occur", "in"]


@query("g_neighbor_gcn", GBASE + """select f.node as dst, f.etype, f.dim,
  round((coalesce(s.s, 0.0) + f.x) / (coalesce(d.deg, 0) + 1), 6) as value
from (select node, dim, x, unnest(['co-occur', 'in']) as etype from feats) f
left join (select dst, etype, dim, sum(m) as s from msg group by dst, etype, dim) s
  on s.dst = f.node and s.etype = f.etype and s.dim = f.dim
left join (select dst, etype, count(*) as deg from graph_edges group by dst, etype) d
  on d.dst = f.node and d.etype = f.etype""")
def g_neighbor_gcn(t):
    return by_dim(G.neighbor_gcn(t.graph_edges, vectors(t), ETYPES, DIMS), "dst", "etype")


@query("g_neighbor_max", GBASE + "select dst, etype, dim, round(max(m), 6) as value from msg "
       "group by dst, etype, dim")
def g_neighbor_max(t):
    return by_dim(G.neighbor_max(t.graph_edges, vectors(t), DIMS), "dst", "etype")


@query("g_zero_degree", GBASE + """, agg as (select dst, etype, dim, avg(m) as value from msg
  group by dst, etype, dim)
select n.node as dst, et.etype, d.dim, round(coalesce(a.value, 0.0), 6) as value
from (select distinct node from feats) n, (select unnest(['co-occur', 'in']) as etype) et,
     (select unnest(range(0, 64)) as dim) d
left join agg a on a.dst = n.node and a.etype = et.etype and a.dim = d.dim""")
def g_zero_degree(t):
    mean = G.neighbor_mean(t.graph_edges, vectors(t), DIMS)
    return by_dim(G.zero_degree(mean, vectors(t), ETYPES, DIMS), "dst", "etype")


@query("g_relation_sum", GBASE + """select dst, dim, round(sum(value), 6) as value from
  (select dst, etype, dim, avg(m) as value from msg group by dst, etype, dim) a group by dst, dim""")
def g_relation_sum(t):
    mean = G.neighbor_mean(t.graph_edges, vectors(t), DIMS)
    return by_dim(G.relation_sum(mean, DIMS), "dst")
