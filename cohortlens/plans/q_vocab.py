"""Registered vocabulary queries (2.9 v_*, a_doc_freq, j_term_*, s_add_new_terms)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import relational as R
from ..operators import vocab as V
from .q_cohort import sym
from .q_relational import t1
from .q_text import DOC_TERM_SQL, WBASE, doc_terms, wnotes
from ..sources.fixtures import note_ngrams
from .registry import query
from .sqlfrag import AE_CASE, SYMS, chain

CLASSES = V.CLASSES


def seed_vocab(t):
    return t.lexicon.select(F.col("term").alias("name"), F.col("class").alias("diagnose"))


def dx_vocab(t):
    """Clinician-style terms: the diagnosis names of labelled events, by class."""
    s = sym(t)
    return (s.select(F.lower("dx_name").alias("name"),
                     F.lower(C.ae_class_expr()).alias("diagnose")).distinct())


def associated_vocab(t):
    """Associated phrases: the word pairs that many notes share."""
    pairs = note_ngrams(t).where("n_words = 2").select(F.col("term").alias("name"))
    return pairs.withColumn("diagnose", F.concat(F.lit("class_"), (1 + F.length("name") % 4).cast("string")))


def abbrev_vocab(t):
    """First letters of diagnosis names of two words or more."""
    w = F.split(F.col("name"), "[^a-z]+")
    return (dx_vocab(t).where(F.size(w) > 1)
            .select(F.concat_ws("", F.transform(w, lambda x: F.substring(x, 1, 1))).alias("name"), "diagnose").distinct())


def additional_vocab(t):
    """Further terms: the single words that many notes share."""
    return t.note_terms.select(F.col("term").alias("name"), F.col("class").alias("diagnose"))


def assembled(t):
    return V.assemble([("seed", seed_vocab(t)), ("clinician", dx_vocab(t)), ("snomedct_us", associated_vocab(t)),
                       ("abbreviation", abbrev_vocab(t)), ("additional", additional_vocab(t))])


ASSEMBLE_SQL = chain(*SYMS) + f""", dxv as (select distinct lower(dx_name) as name, lower({AE_CASE}) as diagnose from sym),
src as (
  select lower(term) as name, class as diagnose, 'seed' as type, 0 as prio from lexicon
  union all select name, diagnose, 'clinician', 1 from dxv
  union all select lower(term), 'class_' || (1 + length(term) % 4), 'snomedct_us', 2 from note_ngrams where n_words = 2
  union all select lower(array_to_string(list_transform(string_split_regex(name, '[^a-z]+'), lambda w: w[1]), '')),
    diagnose, 'abbreviation', 3 from dxv where len(string_split_regex(name, '[^a-z]+')) > 1
  union all select lower(term), class, 'additional', 4 from note_terms),
asm as (select name, diagnose, type from src where name is not null
  qualify row_number() over (partition by diagnose, name order by prio) = 1)
"""


@query("v_assemble", ASSEMBLE_SQL + "select * from asm")
def v_assemble(t):
    return assembled(t)


@query("s_add_new_terms", ASSEMBLE_SQL + "select diagnose, count(*) as n_terms, "
       "count(*) filter (where type <> 'seed') as n_added from asm group by diagnose")
def s_add_new_terms(t):
    a = assembled(t)
    return a.groupBy("diagnose").agg(F.count(F.lit(1)).alias("n_terms"),
                                     F.sum((F.col("type") != "seed").cast("long")).alias("n_added"))


@query("v_profile", ASSEMBLE_SQL + """select diagnose, 'ALL' as type, count(*) as n from asm
  group by diagnose union all select diagnose, type, count(*) from asm group by diagnose, type""")
def v_profile(t):
    return V.profile(assembled(t))


SL = WBASE + """, sl as (select n.note_id, n.note, case when t1.class_1 = 1 then 'class_1'
    when t1.class_2 = 1 then 'class_2' when t1.class_3 = 1 then 'class_3' else 'class_4' end as diagnose
  from wnotes n join t1 on n.pat_deid = t1.pat_deid
  where t1.class_1 + t1.class_2 + t1.class_3 + t1.class_4 = 1)
"""
OCC = """occ as (select v.name, v.diagnose, count(distinct sl.note_id) as occurence
  from {vocab} v join sl on v.diagnose = sl.diagnose
   and contains(upper(replace(sl.note, 'ß', 'SS')), upper(v.name)) group by v.name, v.diagnose)"""
LEXV = "(select term as name, class as diagnose from lexicon)"
ALLV = ("(select term as name, unnest(['class_1', 'class_2', 'class_3', 'class_4']) as diagnose "
        "from lexicon)")


@query("v_occurrence", SL + ", " + OCC.format(vocab=LEXV) + " select * from occ")
def v_occurrence(t):
    return V.occurrence(seed_vocab(t), wnotes(t), t1(t))


# Candidate terms are the frequent words and word pairs of the documents.
@query("v_minimal_terms", "select distinct term as name from note_ngrams a where not exists "
       "(select 1 from note_ngrams b where b.term <> a.term and contains(a.term, b.term))")
def v_minimal_terms(t):
    return V.minimal_terms(t.note_ngrams, "term")


@query("j_term_nested", "select distinct n_words, term as name from note_ngrams a where not exists "
       "(select 1 from note_ngrams b where b.n_words = a.n_words and b.term <> a.term and contains(a.term, b.term))")
def j_term_nested(t):
    return V.minimal_terms(t.note_ngrams, "term", by=["n_words"])


@query("v_feedback_drop", SL + ", " + OCC.format(vocab=LEXV) + """, reviewed as
  (select name, diagnose from occ where occurence < 20)
  select * from occ where (name, diagnose) not in (select name, diagnose from reviewed)""")
def v_feedback_drop(t):
    occ = V.occurrence(seed_vocab(t), wnotes(t), t1(t))
    reviewed = occ.where(F.col("occurence") < 20)
    return V.feedback_drop(occ, reviewed)


@query("v_cross_class", SL + ", " + OCC.format(vocab=ALLV) + """, sizes as
  (select diagnose, count(*) as n_notes from sl group by diagnose)
  select o.name, o.diagnose, o.occurence, s.n_notes, o.occurence / s.n_notes as share
  from occ o join sizes s on o.diagnose = s.diagnose
  qualify row_number() over (partition by o.name order by o.occurence / s.n_notes desc,
                             o.diagnose) = 1""")
def v_cross_class(t):
    allv = seed_vocab(t).select("name", F.explode(F.array(*[F.lit(c) for c in CLASSES]))
                                .alias("diagnose"))
    occ = V.occurrence(allv, wnotes(t), t1(t))
    return V.cross_class(occ, V.class_sizes(wnotes(t), t1(t)))


@query("a_doc_freq", "select term_id, count(distinct note_id) as n_notes from (" + DOC_TERM_SQL
       + ") d group by term_id")
def a_doc_freq(t):
    return doc_terms(t).groupBy("term_id").agg(F.count_distinct("note_id").alias("n_notes"))


@query("j_term_contains", "select note_id, term_id from (" + DOC_TERM_SQL + ") d")
def j_term_contains(t):
    return doc_terms(t).select("note_id", "term_id")

