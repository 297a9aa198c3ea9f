"""Registered cohort / outcome / report queries (2.8) over the fixture views."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import outcome as O
from ..operators import relational as R
from ..operators import report as RP
from ..session import stored
from .registry import ORACLE, query
from .sqlfrag import (ANCHOR, CLS, COHORT, NOTEWIN, OP30, SYMS, SYMU, chain, DX_CASE,
                      FLOOR_DAYS)


# ------------------------------------------------------------ chain helpers
def op30(t):
    return C.followup(t.encounters)


def opx(t):
    return C.exclude_day0_ed(op30(t))


def sym(t):
    """Labelled events, written once for all steps that start from them."""
    return t.memo("sym", lambda: stored(C.dx_short(opx(t)), "labelled-events"))


def noted(t):
    """Labelled events of patients with a note in their window; ids and times of the
    notes decide, their texts are not read."""
    return C.has_note(sym(t), C.notes_in_window(anchor_sym(t), t.notes.select("pat_deid", "encounter_date")))


def symu(t):
    """Outcomes count only patients with a note in their window."""
    return t.memo("symu", lambda: stored(O.symptom_unique(noted(t)), "symptoms"))


def anchor_sym(t):
    """ACU anchor of the patients with >= 1 labelled symptom, with che_tx_date."""
    return t.memo("anchor_sym", lambda: stored(C.acu_anchor(opx(t), t.treatments).join(
        sym(t).select("pat_deid"), "pat_deid", "left_semi"), "anchors"))


def notewin(t):
    return C.note_window(anchor_sym(t), t.notes)


ANCHOR_SYM = """anchor as (select pat_deid, max(hosp_admsn_time) as hosp_admsn_time from opx
  where pat_deid in (select pat_deid from sym) group by pat_deid)"""
NOTES_CHAIN = SYMS + [ANCHOR_SYM, NOTEWIN]


# ------------------------------------------------------------ minimum slice
@query("c_followup_30d", chain(OP30) + "select * from op30")
def c_followup_30d(t):
    return op30(t)


@query("c_exclude_day0_ed", chain(*COHORT) + "select * from opx")
def c_exclude_day0_ed(t):
    return opx(t)


@query("a_having_sum_zero", chain(OP30, COHORT[1]) + "select * from day0")
def a_having_sum_zero(t):
    return C.day0_patients(op30(t))


@query("c_dx_short", chain(*SYMS) + "select * from sym")
def c_dx_short(t):
    return sym(t)


@query("o_symptom_unique", chain(*SYMS, SYMU) + "select * from symu")
def o_symptom_unique(t):
    return symu(t)


@query("o_ae_class", chain(*SYMS, SYMU, CLS) + "select * from cls")
def o_ae_class(t):
    return O.ae_class(symu(t))


def _tbl(src: str, agg: str) -> str:
    cols = ", ".join(f"cast({agg.format(c=c)} as int) as {c.lower()}" for c, _ in C.AE_CLASSES)
    tot = " + ".join(agg.format(c=c) for c, _ in C.AE_CLASSES)
    return f"select pat_deid, {cols}, cast({tot} as int) as total from {src} group by pat_deid"


T1_SQL = (chain(*SYMS, SYMU, CLS)
          + "select pat_deid, class_1, class_2, class_3, class_4, "
            "array_to_string(classes, '|') as classes, total from ("
          + _tbl("cls", "max(cast(ae_class = '{c}' as int))").replace(
              " from cls", ", list_sort(list(distinct lower(ae_class))) as classes from cls")
          + ") z")


@query("o_table_1", T1_SQL)
def o_table_1(t):
    out = O.table_1(O.ae_class(symu(t)))
    return out.withColumn("classes", F.array_join("classes", "|"))


AE_FLAG = "cast((" + "{case}" + ") = '{c}' as int)"


def _sum_sql(src: str) -> str:
    from .sqlfrag import AE_CASE
    return _tbl(src, "sum(" + AE_FLAG.replace("{case}", AE_CASE.replace("{", "{{").replace("}", "}}")) + ")")


@query("o_table_2", chain(*SYMS, SYMU) + _sum_sql("symu"))
def o_table_2(t):
    return O.table_2(symu(t))


@query("o_table_3", chain(*SYMS, SYMU, "noted as (select * from sym where pat_deid in (select pat_deid from symu))")
       + _sum_sql("noted"))
def o_table_3(t):
    return O.table_3(noted(t))


@query("c_acu_anchor", chain(*COHORT, ANCHOR)
       + "select a.*, t.che_tx_date from anchor a left join treatments t on a.pat_deid = t.pat_deid")
def c_acu_anchor(t):
    return C.acu_anchor(opx(t), t.treatments)


@query("w_keep_last", chain(*COHORT)
       + "select * from opx qualify row_number() over (partition by pat_deid "
         "order by hosp_admsn_time desc, enc_id desc) = 1")
def w_keep_last(t):
    return R.keep_last(opx(t), ["pat_deid"], ["hosp_admsn_time", "enc_id"])


@query("c_note_window", chain(*NOTES_CHAIN) + "select * from notewin")
def c_note_window(t):
    return notewin(t)


@query("j_range_window", chain(*NOTES_CHAIN)
       + "select distinct n.pat_deid, n.note_id, n.encounter_date from "
         "(select a.pat_deid, a.hosp_admsn_time as anchor_time, t.che_tx_date from anchor a "
         "join treatments t on a.pat_deid = t.pat_deid) a join notes n on a.pat_deid = n.pat_deid "
         "where n.encounter_date between a.che_tx_date and a.anchor_time")
def j_range_window(t):
    a = anchor_sym(t).withColumnRenamed("hosp_admsn_time", "anchor_time")
    n = t.notes
    return (a.join(n, "pat_deid")
            .where(F.col("encounter_date").between(F.col("che_tx_date"), F.col("anchor_time")))
            .select("pat_deid", "note_id", "encounter_date").distinct())


@query("c_has_note", chain(*NOTES_CHAIN)
       + "select * from sym where pat_deid in (select pat_deid from notewin)")
def c_has_note(t):
    return C.has_note(sym(t), notewin(t))


@query("c_funnel", chain(*NOTES_CHAIN) + """
select 0 as step, 'encounters' as name, count(*) as n_rows, count(distinct pat_deid) as n_patients from encounters
union all select 1, 'followup_30d', count(*), count(distinct pat_deid) from op30
union all select 2, 'exclude_day0_ed', count(*), count(distinct pat_deid) from opx
union all select 3, 'symptom', count(*), count(distinct pat_deid) from sym
union all select 4, 'note_window', count(*), count(distinct pat_deid) from notewin
union all select 5, 'has_note', count(*), count(distinct pat_deid) from sym
  where pat_deid in (select pat_deid from notewin)""")
def c_funnel(t):
    s, nw = sym(t), notewin(t)
    return R.funnel([("encounters", t.encounters), ("followup_30d", op30(t)),
                     ("exclude_day0_ed", opx(t)), ("symptom", s), ("note_window", nw),
                     ("has_note", C.has_note(s, nw))])


@query("c_ed_hosp_sets", """
select pat_deid, case when ed = 1 and hosp = 1 then 'both' when ed = 1 then 'ed_only'
  when hosp = 1 then 'hosp_only' end as visit_group
from (select pat_deid, max(cast(pt_class = 'Emergency Services' as int)) as ed,
             max(cast(pt_class = 'Inpatient' as int)) as hosp from encounters group by pat_deid) f
where ed = 1 or hosp = 1""")
def c_ed_hosp_sets(t):
    return C.ed_hosp_sets(t.encounters)


@query("c_note_type_route", """
select * from notes where note_desc = 'ED Provider Notes'
  and pat_deid in (select pat_deid from encounters where pt_class = 'Emergency Services')
union all
select * from notes where note_desc = 'H&P'
  and pat_deid in (select pat_deid from encounters where pt_class = 'Inpatient')""")
def c_note_type_route(t):
    return C.note_type_route(t.notes, t.encounters)


NOTE_TYPES_KEEP = ["ED Provider Notes", "H&P", "Discharge Summary"]


@query("c_note_type_list", "select * from notes where note_desc in "
       "('ED Provider Notes', 'H&P', 'Discharge Summary')")
def c_note_type_list(t):
    return C.note_type_list(t.notes, NOTE_TYPES_KEEP)


# c_enrich_*: the warehouse-side joins that add discharge time / diagnosis source.
ENR_L = "select enc_id, pat_deid, hosp_admsn_time, pt_class, dx_name, che_tx_date from encounters"
ENR_R = ("select pat_deid, hosp_admsn_time, pt_class, dx_name, hosp_dischrg_time "
         "from encounters")


@query("c_enrich_discharge", f"""
select distinct l.*, r.hosp_dischrg_time from ({ENR_L}) l left join ({ENR_R}) r
  on l.pat_deid = r.pat_deid and l.hosp_admsn_time = r.hosp_admsn_time
 and l.pt_class = r.pt_class and l.dx_name = r.dx_name""")
def c_enrich_discharge(t):
    e = t.encounters
    left = e.select("enc_id", "pat_deid", "hosp_admsn_time", "pt_class", "dx_name", "che_tx_date")
    return C.enrich_left(left, e, ["pat_deid", "hosp_admsn_time", "pt_class", "dx_name"],
                         ["hosp_dischrg_time"])


SRC_CASE = ("case pt_class when 'Emergency Services' then 'ADMIT' when 'Inpatient' then 'ENCOUNTER' "
            "else 'PROBLEM LIST' end")


@query("c_enrich_source", f"""
select distinct l.*, r.source from encounters l left join
  (select pat_deid, enc_id, dx_name, pt_class, hosp_admsn_time, che_tx_date, {SRC_CASE} as source
   from encounters) r
  on l.pat_deid = r.pat_deid and l.enc_id = r.enc_id and l.dx_name = r.dx_name
 and l.pt_class = r.pt_class and l.hosp_admsn_time = r.hosp_admsn_time
 and l.che_tx_date = r.che_tx_date""")
def c_enrich_source(t):
    e = t.encounters
    src = (F.when(F.col("pt_class") == C.ED, "ADMIT").when(F.col("pt_class") == C.INPATIENT, "ENCOUNTER")
           .otherwise("PROBLEM LIST"))
    right = e.withColumn("source", src)
    keys = ["pat_deid", "enc_id", "dx_name", "pt_class", "hosp_admsn_time", "che_tx_date"]
    return C.enrich_left(e, right, keys, ["source"])


# ------------------------------------------------------------ reports
@query("r_patient_table", chain(*NOTES_CHAIN, SYMU, CLS) + """
select c.pat_deid, n.note_count, n.avg_word_count_note,
       k.class_count, u.distinct_symptom_count, s.symptom_count
from (select distinct pat_deid from cls) c
left join (select pat_deid, count(*) as note_count,
                  avg(len(string_split(note, ' '))) as avg_word_count_note
           from notewin group by pat_deid) n on c.pat_deid = n.pat_deid
join (select pat_deid, count(*) as class_count from cls group by pat_deid) k on c.pat_deid = k.pat_deid
join (select pat_deid, count(*) as distinct_symptom_count from symu group by pat_deid) u
  on c.pat_deid = u.pat_deid
join (select pat_deid, count(*) as symptom_count from sym group by pat_deid) s
  on c.pat_deid = s.pat_deid""")
def r_patient_table(t):
    return RP.patient_table(notewin(t), O.ae_class(symu(t)), symu(t), sym(t))


STATS_SQL = chain(*NOTES_CHAIN, SYMU, CLS) + """, pt as (
select c.pat_deid, n.note_count, n.avg_word_count_note,
       k.class_count, u.distinct_symptom_count, s.symptom_count
from (select distinct pat_deid from cls) c
left join (select pat_deid, count(*) as note_count,
                  avg(len(string_split(note, ' '))) as avg_word_count_note
           from notewin group by pat_deid) n on c.pat_deid = n.pat_deid
join (select pat_deid, count(*) as class_count from cls group by pat_deid) k on c.pat_deid = k.pat_deid
join (select pat_deid, count(*) as distinct_symptom_count from symu group by pat_deid) u
  on c.pat_deid = u.pat_deid
join (select pat_deid, count(*) as symptom_count from sym group by pat_deid) s
  on c.pat_deid = s.pat_deid)
select """ + ", ".join(
    f"avg({m}) as {m}_mean, median({m}) as {m}_median, cast(min({m}) as double) as {m}_min, "
    f"cast(max({m}) as double) as {m}_max"
    for m in RP.STAT_MEASURES) + """, count(*) as n_patients,
  cast(sum(note_count) as bigint) as n_notes from pt"""


@query("r_stats_table", STATS_SQL)
def r_stats_table(t):
    pt = RP.patient_table(notewin(t), O.ae_class(symu(t)), symu(t), sym(t))
    return RP.stats_table(pt)


RECODE_SQL = ", ".join(f"'{v}'" for v in RP.RECODE_TO_OTHER)


def _rc(c):
    return f"case when {c} in ({RECODE_SQL}) then 'Other' else {c} end as {c}"


CHAR_SQL = f"""charz as (select c.pat_deid, {_rc('c.ae_class').replace(' as c.ae_class', ' as ae_class')},
  {_rc('p.sex').replace(' as p.sex', ' as sex')}, p.age_at_dx, {_rc('p.race').replace(' as p.race', ' as race')},
  {_rc('p.cancer_group').replace(' as p.cancer_group', ' as cancer_group')}, p.stage_four,
  {_rc('p.ethnic_group').replace(' as p.ethnic_group', ' as ethnic_group')},
  {_rc('p.insurance_payor').replace(' as p.insurance_payor', ' as insurance_payor')}
  from cls c join patients p on c.pat_deid = p.pat_deid)"""


@query("r_characterize", chain(*SYMS, SYMU, CLS, CHAR_SQL) + "select * from charz")
def r_characterize(t):
    return RP.characterize(O.ae_class(symu(t)), t.patients)


@query("r_characterize_cohort", chain(*SYMS, SYMU, CLS, CHAR_SQL)
       + "select distinct pat_deid, sex, age_at_dx, race, cancer_group, stage_four, ethnic_group, insurance_payor from charz")
def r_characterize_cohort(t):
    return RP.characterize_cohort(O.ae_class(symu(t)), t.patients)


TABLE_ONE_SQL = chain(*SYMS, SYMU, CLS, CHAR_SQL) + """, j as (
  select * from charz union all
  select distinct pat_deid, 'ALL' as ae_class, sex, age_at_dx, race, cancer_group, stage_four, ethnic_group,
    insurance_payor from charz),
cnt as (select ae_class, variable, level, count(*) as n from (""" + " union all ".join(
    f"select ae_class, '{v}' as variable, cast({v} as varchar) as level from j" for v in
    ["sex", "race", "ethnic_group", "cancer_group", "stage_four", "insurance_payor"]) + """) x
  where level is not null group by all),
given(variable, level, g) as (values ('race', 'Asian', 0), ('race', 'White', 1), ('race', 'Black', 2),
  ('race', 'Other', 3), ('ethnic_group', 'Hispanic/Latino', 0), ('ethnic_group', 'Non-Hispanic/Non-Latino', 1),
  ('ethnic_group', 'Other', 2), ('insurance_payor', 'MEDICARE', 0), ('insurance_payor', 'PRIVATE', 1),
  ('insurance_payor', 'MediCal_MEDICAID', 2), ('stage_four', '1.0', 0), ('stage_four', '2.0', 1),
  ('stage_four', '3.0', 2), ('stage_four', '4.0', 3)),
lev as (select variable, level, cast(row_number() over (partition by variable order by min(g) nulls last, level) as int)
    as position from (select variable, level, null as g from cnt union all select * from given) u
  group by variable, level),
full_cnt as (select c.ae_class, l.variable, l.position, l.level, coalesce(cnt.n, 0) as n from lev l
  cross join (select distinct ae_class from j) c left join cnt
  on cnt.ae_class = c.ae_class and cnt.variable = l.variable and cnt.level = l.level)
select * from (select *, round(100.0 * n / nullif(sum(n) over (partition by ae_class, variable), 0), 6) as pct,
  cast(null as double) as mean, cast(null as double) as sd from full_cnt) f
where variable <> 'sex' or level = 'Female'
union all select ae_class, 'age_at_dx', null, null, count(age_at_dx), null, round(avg(age_at_dx), 6),
  round(stddev_samp(age_at_dx), 6) from j group by ae_class"""


@query("a_table_one", TABLE_ONE_SQL)
def a_table_one(t):
    return RP.table_one(O.ae_class(symu(t)), t.patients)


# The written report is table one read back.
ORACLE["io_report"] = ORACLE["a_table_one"]
