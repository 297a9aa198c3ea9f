"""Reference-shaped views derived from the shared synthetic tables.

The reference's clinical tables are private; these views give them the same
shape (FIXTURES.md §3). Each view exists twice: as a Spark DataFrame builder
(used by the operators) and as SQL text (inlined as CTEs by the oracle). Both
are derived from the base tables, so their size grows with the scale factor.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let


def ntz(ts: str) -> Column:
    return F.lit(ts).cast("timestamp_ntz")


def plus(base: Column, days=None, hours=None, minutes=None) -> Column:
    z = F.lit(0)
    return base + F.make_dt_interval(
        days if days is not None else z, hours if hours is not None else z,
        minutes if minutes is not None else z, F.lit(0))


def _n_patients(t) -> Column:
    # scalar subquery, evaluated once by Spark (no driver round trip)
    return t.events.select(F.countDistinct("user_id")).scalar()


# The reference's note types.
NOTE_TYPES = {0: "ED Provider Notes", 1: "H&P", 2: "Discharge Summary",
              3: "Progress Notes"}


def notes(t) -> DataFrame:
    d = t.documents
    code = F.expr("substring(source, 4)").cast("int") % 5
    desc = F.lit("Telephone Encounter")
    for k in sorted(NOTE_TYPES, reverse=True):
        desc = F.when(code == k, F.lit(NOTE_TYPES[k])).otherwise(desc)
    minute = ((F.col("doc_id") * 43) % 43200).cast("int")
    base = ntz("2024-01-01 00:00:00")
    return d.select(
        F.col("doc_id").alias("note_id"),
        (F.col("doc_id") % _n_patients(t)).alias("pat_deid"),
        F.col("text").alias("note"),
        desc.alias("note_desc"),
        plus(base, minutes=minute).alias("encounter_date"),
        plus(base, minutes=minute + 90).alias("effective_time"))


def treatments(t) -> DataFrame:
    base = ntz("2023-12-05 08:00:00")
    return (t.events.select(F.col("user_id").alias("pat_deid")).distinct()
            .select("pat_deid",
                    plus(base, days=(F.col("pat_deid") % 40).cast("int")).alias("che_tx_date")))


DX_BY_CODE = ["Acute abdominal pain", "Headache", "Nausea with vomiting", "Dehydration",
              "Diarrhea, unspecified", "Anemia in neoplastic disease", "Febrile neutropenia",
              "Sepsis due to pneumonia", "Fever, unspecified", "Pneumonia", "Gastritis",
              "Essential hypertension"]


def encounters(t) -> DataFrame:
    """Every event is an encounter. Patients whose id ends in 3 are seen on the day of
    treatment only (their admissions fall on it), in one kind of visit each. A patient has
    one to five diagnoses, so all combinations of classes occur."""
    tr = t.treatments
    user, nth = F.col("user_id"), F.col("event_id") % (1 + F.col("user_id") % 5)
    code = ((user * 7 + nth * (2 + F.floor(user / 5) % 11)) % 13).cast("int")
    dx = F.lit(None).cast("string")
    for k in reversed(range(len(DX_BY_CODE))):
        dx = F.when(code == k, F.lit(DX_BY_CODE[k])).otherwise(dx)
    day0 = F.col("user_id") % 10 == 3
    admitted = F.when(day0, plus(F.col("che_tx_date"), hours=(F.col("event_id") % 12).cast("int"))).otherwise(F.col("ts"))
    stay = F.when(day0, F.lit(1)).otherwise(1 + F.col("event_id") % 96).cast("int")
    pt = (F.when(day0, F.when(F.col("user_id") % 20 == 3, "Emergency Services").otherwise("Inpatient"))
          .when(F.col("event_type").isin("error", "purchase"), "Emergency Services")
          .when(F.col("event_type").isin("click", "view"), "Inpatient")
          .otherwise("Outpatient"))
    return (t.events.join(tr, t.events.user_id == tr.pat_deid)
            .select(F.col("event_id").alias("enc_id"), F.col("user_id").alias("pat_deid"),
                    admitted.alias("hosp_admsn_time"), plus(admitted, hours=stay).alias("hosp_dischrg_time"),
                    "che_tx_date", pt.alias("pt_class"), dx.alias("dx_name")))


# Fixed values of the fixture.
RACES = {0: "Asian", 1: "White", 2: "Black", 3: "Native American", 4: "Unknown"}


ETHNIC_GROUPS = {0: "Hispanic/Latino", 1: "Non-Hispanic/Non-Latino", 2: "Non-Hispanic/Non-Latino", 3: "Unknown",
                 4: "Patient Refused"}
PAYORS = {0: "MEDICARE", 1: "PRIVATE"}


def _coded(code: Column, values: dict) -> Column:
    out = F.lit(None).cast("string")
    for k in sorted(values, reverse=True):
        out = F.when(code == k, F.lit(values[k])).otherwise(out)
    return out


def patients(t) -> DataFrame:
    """Ethnic group and payor are missing for some; no patient has the third payor."""
    c = t.customer
    code = (F.col("c_custkey") % 6).cast("int")
    race = F.lit(None).cast("string")
    for k in sorted(RACES, reverse=True):
        race = F.when(code == k, F.lit(RACES[k])).otherwise(race)
    return (c.select(F.col("c_custkey").alias("pat_deid"),
                    F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("sex"),
                    F.round(18 + F.abs("c_acctbal") / 150, 0).alias("age_at_dx"),
                    race.alias("race"),
                    F.col("c_mktsegment").alias("cancer_group"),
                    (1 + F.col("c_nationkey") % 4).cast("double").alias("stage_four"),
                    _coded(F.col("c_custkey") % 7, ETHNIC_GROUPS).alias("ethnic_group"),
                    _coded(F.col("c_nationkey") % 3, PAYORS).alias("insurance_payor")))


# Test lexicon (fixed values of the fixture, FIXTURES.md §3).
LEXICON = [(0, "sting", "class_1"), (1, "ach", "class_1"), (2, "naus", "class_2"),
           (3, "tens", "class_1"), (4, " ha ", "class_1"), (5, "pale", "class_3"),
           (6, "sore", "class_1"), (7, "tingl", "class_1"), (8, "oral", "class_4"),
           (9, "tion", "class_2"), (10, "eau", "class_3"), (11, "ering", "class_4"),
           (12, "steri", "class_4"), (13, "er", "class_4")]


def lexicon(t) -> DataFrame:
    return t.spark.createDataFrame(LEXICON, "term_id int, term string, class string")


# Words of the notes; a blank, a line break or one of .,;:!? ends a word.
WORD_END = r"[\x20\x09-\x0D.,;:!?]+"


def _words():
    return F.filter(F.split(F.lower("text"), WORD_END), lambda w: F.length(w) >= 3)


def _frequent(t, grams, n_words: int, share: int) -> DataFrame:
    """(term, n_words, n_docs) of the n-grams that one of ``share`` documents has."""
    total = t.documents.select(F.count(F.lit(1))).scalar()
    each = t.documents.select(F.explode(F.array_distinct(grams)).alias("term"))
    return (each.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") * share >= total)
            .select("term", F.lit(n_words).alias("n_words"), "n_docs"))


def note_ngrams(t) -> DataFrame:
    """(term, n_words, n_docs): the words of three letters or more, and pairs of them, of
    a fiftieth of the documents or more. Their number is bounded by fifty times the mean
    number of different n-grams of a document, whatever the table's size."""
    pairs = let(_words(), lambda w: F.zip_with(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b)))
    return _frequent(t, _words(), 1, 50).unionByName(_frequent(t, pairs, 2, 50))


def note_terms(t) -> DataFrame:
    """(term_id, term, class): the single words of a twentieth of the documents or more,
    numbered in order; a few hundred at any size of the table."""
    return _frequent(t, _words(), 1, 20).select(
        (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"), "term",
        F.concat(F.lit("class_"), (1 + F.length("term") % 4).cast("string")).alias("class"))


def scored(t) -> DataFrame:
    j = t.documents.join(t.labels, "doc_id")
    n = F.col("n_chars").cast("double")
    q = j.select(F.col("doc_id").alias("id"), F.lit("quality").alias("class"),
                 F.col("quality").alias("y"),
                 F.round(1.0 / (1.0 + F.exp((1500 - n) / 1000.0)), 6).alias("score"))
    x = j.select(F.col("doc_id").alias("id"), F.lit("toxic").alias("class"),
                 F.col("toxic").alias("y"),
                 F.round(1.0 / (1.0 + F.exp((n - 2500) / 1000.0)), 6).alias("score"))
    return q.unionByName(x)


def graph_edges(t) -> DataFrame:
    e = t.embeddings
    n = e.select(F.count("*")).scalar()
    a = e.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % n).alias("dst"),
                 F.lit("co-occur").alias("etype"), (1 + F.col("vec_id") % 3).cast("double").alias("weight"))
    b = e.select(F.col("vec_id").alias("src"), (F.col("vec_id") % 50).alias("dst"),
                 F.lit("in").alias("etype"), F.lit(1.0).alias("weight"))
    return a.unionByName(b)


def chunks(t) -> DataFrame:
    return t.embeddings.select((F.col("vec_id") % 100).alias("note_id"),
                               F.floor(F.col("vec_id") / 100).alias("chunk"),
                               "embedding", "label")


# ---------------------------------------------------------------- oracle SQL
FIXTURE_SQL = {
    "notes": """select doc_id as note_id,
       doc_id % (select count(distinct user_id) from events) as pat_deid,
       text as note,
       case cast(substring(source, 4) as int) % 5
            when 0 then 'ED Provider Notes' when 1 then 'H&P'
            when 2 then 'Discharge Summary' when 3 then 'Progress Notes'
            else 'Telephone Encounter' end as note_desc,
       timestamp '2024-01-01 00:00:00' + cast((doc_id * 43) % 43200 as int) * interval '1' minute as encounter_date,
       timestamp '2024-01-01 00:00:00' + cast((doc_id * 43) % 43200 + 90 as int) * interval '1' minute as effective_time
from documents""",
    "treatments": """select distinct user_id as pat_deid,
       timestamp '2023-12-05 08:00:00' + cast(user_id % 40 as int) * interval '1' day as che_tx_date
from events""",
    "encounters": """select e.event_id as enc_id, e.user_id as pat_deid,
       case when e.user_id % 10 = 3 then t.che_tx_date + cast(e.event_id % 12 as int) * interval '1' hour
            else e.ts end as hosp_admsn_time,
       case when e.user_id % 10 = 3 then t.che_tx_date + cast(e.event_id % 12 + 1 as int) * interval '1' hour
            else e.ts + cast(1 + e.event_id % 96 as int) * interval '1' hour end as hosp_dischrg_time,
       t.che_tx_date,
       case when e.user_id % 20 = 3 then 'Emergency Services' when e.user_id % 10 = 3 then 'Inpatient'
            when e.event_type in ('error', 'purchase') then 'Emergency Services'
            when e.event_type in ('click', 'view') then 'Inpatient'
            else 'Outpatient' end as pt_class,
       case cast((e.user_id * 7 + (e.event_id % (1 + e.user_id % 5)) * (2 + (e.user_id // 5) % 11)) % 13 as int)
            when 0 then 'Acute abdominal pain' when 1 then 'Headache'
            when 2 then 'Nausea with vomiting' when 3 then 'Dehydration'
            when 4 then 'Diarrhea, unspecified' when 5 then 'Anemia in neoplastic disease'
            when 6 then 'Febrile neutropenia' when 7 then 'Sepsis due to pneumonia'
            when 8 then 'Fever, unspecified' when 9 then 'Pneumonia'
            when 10 then 'Gastritis' when 11 then 'Essential hypertension'
            else null end as dx_name
from events e join treatments t on e.user_id = t.pat_deid""",
    "patients": """select c_custkey as pat_deid,
       case when c_custkey % 2 = 0 then 'Female' else 'Male' end as sex,
       round(18 + abs(c_acctbal) / 150, 0) as age_at_dx,
       case cast(c_custkey % 6 as int) when 0 then 'Asian' when 1 then 'White' when 2 then 'Black'
            when 3 then 'Native American' when 4 then 'Unknown' else null end as race,
       c_mktsegment as cancer_group,
       cast(1 + c_nationkey % 4 as double) as stage_four,
       case c_custkey % 7 when 0 then 'Hispanic/Latino' when 1 then 'Non-Hispanic/Non-Latino'
            when 2 then 'Non-Hispanic/Non-Latino' when 3 then 'Unknown' when 4 then 'Patient Refused'
            else null end as ethnic_group,
       case c_nationkey % 3 when 0 then 'MEDICARE' when 1 then 'PRIVATE' else null end as insurance_payor
from customer""",
    "lexicon": """select * from (values (0, 'sting', 'class_1'), (1, 'ach', 'class_1'), (2, 'naus', 'class_2'),
                      (3, 'tens', 'class_1'), (4, ' ha ', 'class_1'), (5, 'pale', 'class_3'),
                      (6, 'sore', 'class_1'), (7, 'tingl', 'class_1'), (8, 'oral', 'class_4'),
                      (9, 'tion', 'class_2'), (10, 'eau', 'class_3'), (11, 'ering', 'class_4'),
                      (12, 'steri', 'class_4'), (13, 'er', 'class_4')) t(term_id, term, class)""",
    "note_ngrams": r"""select term, n_words, count(*) as n_docs from (
  select distinct d, unnest(w) as term, 1 as n_words from note_words
  union all select distinct d, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 from note_words) g
group by term, n_words having count(*) * 50 >= (select count(*) from documents)""",
    "note_words": r"""select row_number() over () as d, list_filter(
  string_split_regex(lower(text), '[\x20\x09-\x0D.,;:!?]+'), lambda x: length(x) >= 3) as w from documents""",
    "note_terms": """select cast(row_number() over (order by term) - 1 as int) as term_id, term,
  'class_' || (1 + length(term) % 4) as class from note_ngrams
  where n_words = 1 and n_docs * 20 >= (select count(*) from documents)""",
    "scored": """select d.doc_id as id, 'quality' as class, l.quality as y,
       round(1.0 / (1.0 + exp((1500 - cast(d.n_chars as double)) / 1000.0)), 6) as score
from documents d join labels l on d.doc_id = l.doc_id
union all
select d.doc_id, 'toxic', l.toxic,
       round(1.0 / (1.0 + exp((cast(d.n_chars as double) - 2500) / 1000.0)), 6)
from documents d join labels l on d.doc_id = l.doc_id""",
    "graph_edges": """select vec_id as src, (vec_id * 7 + 3) % (select count(*) from embeddings) as dst, 'co-occur' as etype,
       cast(1 + vec_id % 3 as double) as weight from embeddings
union all
select vec_id, vec_id % 50, 'in', cast(1.0 as double) from embeddings""",
    "chunks": """select vec_id % 100 as note_id, cast(floor(vec_id / 100) as bigint) as chunk,
       embedding, label from embeddings""",
}
FIXTURE_DEPS = {"encounters": ["treatments"], "note_terms": ["note_ngrams", "note_words"], "note_ngrams": ["note_words"]}
_ORDER = ["note_words", "note_ngrams", "note_terms", "treatments", "notes", "encounters", "patients", "lexicon", "scored",
          "graph_edges", "chunks"]


def with_fixtures(body: str) -> str:
    """Prefix an oracle query with the fixture views it names, as CTEs."""
    used = {n for n in FIXTURE_SQL if re.search(rf"\b{n}\b", body)}
    for n in list(used):
        used.update(FIXTURE_DEPS.get(n, []))
    ctes = [f"{n} as ({FIXTURE_SQL[n]})" for n in _ORDER if n in used]
    b = body.strip()
    if not ctes:
        return b
    if re.match(r"(?is)^with\s", b):
        return "with " + ",\n".join(ctes) + ",\n" + b[4:].lstrip()
    return "with " + ",\n".join(ctes) + "\n" + b
