"""Oracle SQL fragments (DuckDB dialect) shared by several registered queries.

They restate the cohort chain in plain SQL so each oracle query is
self-contained; fixture views are added by ``with_fixtures``.
"""
# Fixed values, written out here so that the SQL does not share the operators' own lists:
# symptom label -> fragments of the diagnosis name, and class -> labels.
DX_RULES = [
    ("ANEMIA", ["ANEM", "RED CELL"]),
    ("DEHYDRATION", ["DEHY", "HYPERNAT"]),
    ("DIARRHEA", ["DIAR"]),
    ("NAUSEA", ["NAUS"]),
    ("EMESIS", ["EMES", "VOMIT", "GASTROENTER", "GASTRIT"]),
    ("FEVER", ["FEVER", "FEBRILE", "HYPERTHERM", "PYREX"]),
    ("NEUTROPENIA", ["NEUT", "PANCY", "AGRAN"]),
    ("PAIN", ["PAIN", "HEADACH", "ALGIA", "DYSURIA", "DYNIA", "ACHE", "PRESSURE", "DISCOMFORT",
        "CRAMP", "TIGHTNESS", "RADICULOPATHY", "TENDERNES", "ABDOMINAL CRIS"]),
    ("PNEUMONIA", ["PNEUMO", "CONSOLID"]),
    ("SEPSIS", ["SEPS", "INFLAM", "CANDIDEMIA", "SEPTIC"]),
]
AE_CLASSES = [
    ("CLASS_1", ["PAIN"]),
    ("CLASS_2", ["NAUSEA", "EMESIS", "DEHYDRATION", "DIARRHEA"]),
    ("CLASS_3", ["ANEMIA"]),
    ("CLASS_4", ["FEVER", "NEUTROPENIA", "SEPSIS", "PNEUMONIA"]),
]


def _any(col: str, frags) -> str:
    return "(" + " or ".join(f"contains({col}, '{f}')" for f in frags) + ")"


DX_CASE = ("case " + " ".join(
    f"when {_any('upper(dx_name)', frags)} then '{label}'" for label, frags in reversed(DX_RULES))
    + " end")
AE_CASE = ("case " + " ".join(
    f"when {_any('dx_short', labels)} then '{cls}'" for cls, labels in reversed(AE_CLASSES))
    + " end")

FLOOR_DAYS = ("cast(floor((epoch_us(hosp_admsn_time) - epoch_us(che_tx_date)) / 86400000000.0)"
              " as bigint)")

OP30 = f"""op30 as (
  select * from (select *, {FLOOR_DAYS} as che_to_hosp from encounters) x
  where che_tx_date >= timestamp '2013-01-01 00:00:00' and che_to_hosp <= 30)"""
DAY0 = """day0 as (
  select pat_deid, sum(che_to_hosp) as offset_sum,
         max(cast(che_to_hosp = 0 as int)) as has_day0,
         max(cast(pt_class = 'Emergency Services' as int)) as has_ed
  from op30 group by pat_deid
  having max(cast(che_to_hosp = 0 as int)) = 1 and sum(che_to_hosp) = 0)"""
OPX = """opx as (select * from op30 where pat_deid not in
  (select pat_deid from day0 where has_ed = 1))"""
SYM = f"""sym as (select *, {DX_CASE} as dx_short from (select distinct * from opx) d
  where ({DX_CASE}) is not null)"""
SYMU = """symu as (select * from sym where pat_deid in (
  select n.pat_deid from (select pat_deid, max(hosp_admsn_time) as last_time from opx
                          where pat_deid in (select pat_deid from sym) group by pat_deid) a
  join treatments t on a.pat_deid = t.pat_deid join notes n on a.pat_deid = n.pat_deid
  where n.encounter_date <= a.last_time and n.encounter_date >= t.che_tx_date)
  qualify row_number() over
  (partition by pat_deid, dx_short order by hosp_admsn_time, enc_id) = 1)"""
CLS = f"""cls as (select * from (select *, {AE_CASE} as ae_class from symu) s qualify row_number()
  over (partition by pat_deid, ae_class order by hosp_admsn_time, enc_id) = 1)"""
ANCHOR = """anchor as (select pat_deid, max(hosp_admsn_time) as hosp_admsn_time from opx
  group by pat_deid)"""
NOTEWIN = """notewin as (
  select * from (select distinct n.pat_deid, n.note_id, n.note, n.encounter_date,
                        n.effective_time, n.note_desc
                 from (select a.pat_deid, a.hosp_admsn_time as anchor_time, t.che_tx_date
                       from anchor a join treatments t on a.pat_deid = t.pat_deid) a
                 join notes n on a.pat_deid = n.pat_deid
                 where n.encounter_date <= a.anchor_time and n.encounter_date >= a.che_tx_date) d
  qualify row_number() over (partition by pat_deid, note order by encounter_date, note_id) = 1)"""


def chain(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


COHORT = [OP30, DAY0, OPX]
SYMS = COHORT + [SYM]
