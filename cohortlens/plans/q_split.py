"""Registered split queries (2.10 x_*) over the outcome table of the cohort."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import split as S
from ..operators import text as T
from ..operators import vocab as V
from ..session import checkpoint_dir, cut_lineage, stored
from ..sources import tables as IO
from .q_relational import LABEL_KEY, SPLIT_SQL, t1
from .q_text import WBASE, wnotes
from .registry import query

SEED = 42
TEST_FRAC = 0.06
VAL_FRAC = 0.2
K = 4


def labelled(t):
    o = t.memo("labelled", lambda: cut_lineage(t1(t)))
    key = F.concat_ws("", *[F.col(f"class_{i}").cast("string") for i in range(1, 5)])
    return o.select("pat_deid", key.alias("label_key"))


def split_table(t):
    """Train/test split of the outcome patients, stratified on the label key."""
    return S.stratified_split(labelled(t), "pat_deid", ["label_key"], TEST_FRAC, SEED)


def train_ids(t):
    return split_table(t).where(F.col("split") == "train")


H = "md5(cast(pat_deid as varchar) || '42'), pat_deid"
LK = WBASE + f""", lk as (select pat_deid, {LABEL_KEY} as label_key from t1),
sp as (select pat_deid, label_key, case when rk <= round(n * {TEST_FRAC}) then 'test' else 'train'
         end as split from (select *, row_number() over (partition by label_key order by {H}) as rk,
         count(*) over (partition by label_key) as n from lk) r),
kf as (select pat_deid, label_key, cast((row_number() over (partition by label_key order by {H}) - 1)
         % {K} as int) as fold from sp where split = 'train')
"""


PARTS = f"""tv as (select pat_deid, label_key, split, case when split = 'test' then 'test'
         when rk <= round(n * {VAL_FRAC}) then 'val' else 'train' end as part from (select *,
         row_number() over (partition by label_key, split order by {H}) as rk,
         count(*) over (partition by label_key, split) as n from sp) r)
"""


def parts(t):
    return S.train_val_test(labelled(t), "pat_deid", ["label_key"], TEST_FRAC, VAL_FRAC, SEED)


@query("x_stratified_split", LK + ", " + PARTS + "select * from tv")
def x_stratified_split(t):
    return parts(t)


@query("x_random_split", LK + f"""select pat_deid, case when rk <= round(n * {VAL_FRAC}) then 'val'
  else 'train' end as split from (select pat_deid, row_number() over (order by {H}) as rk,
  count(*) over () as n from sp where split = 'train') r""")
def x_random_split(t):
    tr = train_ids(t).select("pat_deid")
    return S.stratified_split(tr, "pat_deid", [], VAL_FRAC, SEED, names=("train", "val"))


def kfold(t):
    return S.stratified_kfold(train_ids(t).drop("split"), "pat_deid", ["label_key"], K, SEED)


@query("x_stratified_kfold", LK + "select * from kf")
def x_stratified_kfold(t):
    return kfold(t)


@query("x_fold_expand", LK + f"""select pat_deid, fold, fold_i,
  case when fold = fold_i then 'val' else 'train' end as role
  from kf, (select unnest(range(0, {K})) as fold_i) f""")
def x_fold_expand(t):
    return S.fold_expand(kfold(t), K).select("pat_deid", "fold", "fold_i", "role")


@query("x_apply_split", LK + """select n.note_id, n.pat_deid, t1.class_1, t1.class_2, t1.class_3,
  t1.class_4 from wnotes n join t1 on n.pat_deid = t1.pat_deid
  where n.pat_deid in (select pat_deid from sp where split = 'test')""")
def x_apply_split(t):
    ids = split_table(t).where(F.col("split") == "test")
    out = S.apply_split(wnotes(t).select("note_id", "pat_deid"), t1(t).drop("classes", "total"), ids)
    return out


def split_rows(t):
    """(pat_deid, label_key, note_id, split, fold, role): fold -1 holds every patient as train,
    val or test, the others the train patients as val or train; patients without a note keep
    a null one."""
    sp = cut_lineage(parts(t).select("pat_deid", "label_key", "split", "part"))
    one = sp.select("pat_deid", "label_key", "split", F.lit(-1).alias("fold"), F.col("part").alias("role"))
    sp = sp.drop("part")
    folds = S.fold_expand(S.stratified_kfold(sp.where("split = 'train'"), "pat_deid", ["label_key"], K, SEED), K)
    rows = one.unionByName(folds.select("pat_deid", "label_key", "split", F.col("fold_i").alias("fold"), "role"))
    return rows.join(wnotes(t).select("pat_deid", "note_id"), "pat_deid", "left")


@query("io_split_dirs", LK + ", " + PARTS + f"""select r.pat_deid, r.label_key, n.note_id, r.split, r.fold, r.role from
  (select pat_deid, label_key, split, -1 as fold, part as role from tv
   union all select pat_deid, label_key, 'train', fold_i, case when fold = fold_i then 'val' else 'train' end
   from kf, (select unnest(range(0, {K})) as fold_i) f) r left join wnotes n on r.pat_deid = n.pat_deid""")
def io_split_dirs(t):
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/splits/{uuid.uuid4().hex}"
    IO.write_splits(split_rows(t), path)
    return t.spark.read.parquet(path)


# x_train_only_vocab: the vocabulary is refit on the train split only (terms that occur in
# train notes of their class) and written as a table; both splits then go through the
# mention filter, trimming and the patient notes with it. An empty vocabulary mentions
# nothing, so no patient has a note.
TRAIN_VOCAB = """, sl as (select n.note_id, n.note, case when t1.class_1 = 1 then 'class_1'
    when t1.class_2 = 1 then 'class_2' when t1.class_3 = 1 then 'class_3' else 'class_4' end as diagnose
  from wnotes n join t1 on n.pat_deid = t1.pat_deid
  where t1.class_1 + t1.class_2 + t1.class_3 + t1.class_4 = 1
    and n.pat_deid in (select pat_deid from sp where split = 'train')),
occ as (select distinct lower(v.term) as name from lexicon v join sl on v.class = sl.diagnose
   and contains(upper(replace(sl.note, 'ß', 'SS')), upper(v.term))),
ment as (select distinct pat_deid, note, effective_time, md5(note) as note_key from wnotes
  where exists (select 1 from occ where contains(lower(note), occ.name))),
sen as (select pat_deid, note_key, effective_time, unnest(l) as sentence, generate_subscripts(l, 1) - 1 as idx
  from (select *, """ + SPLIT_SQL.replace("{x}", "note") + """ as l from ment) z),
hit as (select distinct s.pat_deid, s.note_key, s.effective_time, s.idx from sen s join occ on contains(lower(s.sentence), occ.name)),
tr as (select distinct s.* from sen s join hit h on s.pat_deid = h.pat_deid and s.note_key = h.note_key
  and s.effective_time = h.effective_time and abs(s.idx - h.idx) <= 2),
ps as (select * from tr qualify row_number() over (partition by pat_deid, sentence order by effective_time, note_key, idx) = 1)
select ps.pat_deid, sp.split, string_agg(ps.sentence, '[SEP]' order by ps.effective_time, ps.note_key, ps.idx) as sentence_list
from ps join sp on ps.pat_deid = sp.pat_deid group by ps.pat_deid, sp.split"""


@query("x_train_only_vocab", LK + TRAIN_VOCAB)
def x_train_only_vocab(t):
    ids = cut_lineage(split_table(t).select("pat_deid", "split"))
    train = wnotes(t).join(ids.where("split = 'train'"), "pat_deid", "left_semi")
    seed = t.lexicon.select(F.col("term").alias("name"), F.col("class").alias("diagnose"))
    fitted = V.occurrence(seed, train, t1(t)).select(F.lower("name").alias("term")).distinct()
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/vocabulary/{uuid.uuid4().hex}"
    IO.write_table(fitted.select(F.col("term").alias("term_id"), "term"), path)
    terms = t.spark.read.schema("term_id string, term string").parquet(path)
    rows = T.trim(T.sentences(stored(T.mention_filter(wnotes(t), terms), "mentions")), terms)
    return T.patient_note(T.patient_sentences(rows)).join(ids, "pat_deid").select("pat_deid", "split", "sentence_list")
