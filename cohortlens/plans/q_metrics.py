"""Registered scored-table and ML-data queries (2.12 m_*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import metrics as M
from ..operators import ml as ML
from .q_split import kfold
from .q_split import LK
from .registry import query

PRED = "case when score > 0.5 then 1 else 0 end"
CONF = f"""conf as (select class, cast(sum(case when y = 0 and {PRED} = 0 then 1 else 0 end) as bigint) as tn,
  cast(sum(case when y = 0 and {PRED} = 1 then 1 else 0 end) as bigint) as fp,
  cast(sum(case when y = 1 and {PRED} = 0 then 1 else 0 end) as bigint) as fn,
  cast(sum(case when y = 1 and {PRED} = 1 then 1 else 0 end) as bigint) as tp from scored group by class)"""


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("m_confusion", "with " + CONF + " select * from conf")
def m_confusion(t):
    return M.confusion(t.scored)


REPORT_SQL = "with " + CONF + """,
per as (select class as label,
  case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision,
  case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall,
  case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end as f1,
  tp + fn as support from conf),
tot as (select sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn from conf),
smp as (select id, sum(y * """ + PRED + """)::double as inter, sum(""" + PRED + """)::double as npred,
  sum(y)::double as ntrue from scored group by id)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
  support from (
select * from per
union all select 'micro avg', case when tp + fp > 0 then tp / (tp + fp) else 0.0 end,
  case when tp + fn > 0 then tp / (tp + fn) else 0.0 end,
  case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end,
  cast(tp + fn as bigint) from tot
union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per
union all select 'weighted avg', sum(precision * support) / sum(support),
  sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from per
union all select 'samples avg', avg(case when npred > 0 then inter / npred else 0.0 end),
  avg(case when ntrue > 0 then inter / ntrue else 0.0 end),
  avg(case when ntrue + npred > 0 then 2 * inter / (ntrue + npred) else 0.0 end),
  cast(sum(ntrue) as bigint) from smp) z"""


@query("m_report", REPORT_SQL)
def m_report(t):
    return r6(M.report(t.scored), "precision", "recall", "f1")


@query("m_hamming", f"select round(avg(case when {PRED} <> y then 1.0 else 0.0 end), 6) as hamming_loss "
       "from scored")
def m_hamming(t):
    return r6(M.hamming(t.scored), "hamming_loss")


@query("m_subset_acc", f"select round(avg(ok), 6) as subset_accuracy from (select id, "
       f"min(case when {PRED} = y then 1.0 else 0.0 end) as ok from scored group by id) z")
def m_subset_acc(t):
    return r6(M.subset_accuracy(t.scored), "subset_accuracy")


@query("m_accuracy_avg", "with " + CONF + """, per as (select class, (tp + tn) / (tn + fp + fn + tp) as acc,
  tp + fn as support, tn + fp + fn + tp as n, tp + tn as ok from conf)
select round(sum(ok) / sum(n), 6) as micro, round(avg(acc), 6) as macro,
  round(sum(acc * support) / sum(support), 6) as weighted from per""")
def m_accuracy_avg(t):
    return r6(M.accuracy_avg(t.scored), "micro", "macro", "weighted")


CUM = """d as (select class, score, sum(y) as pos, sum(1 - y) as neg from scored group by class, score),
c as (select *, sum(pos) over (partition by class order by score desc) - pos as pos_above,
  sum(neg) over (partition by class order by score desc) - neg as neg_above from d),
tot as (select class, sum(y) as P, sum(1 - y) as N from scored group by class)"""


@query("m_roc", "with " + CUM + """ select c.class, c.score as threshold,
  round((neg_above + neg) / nullif(N, 0), 6) as fpr, round((pos_above + pos) / nullif(P, 0), 6) as tpr
  from c join tot on c.class = tot.class
  union all select class, cast(null as double), 0.0, 0.0 from tot""")
def m_roc(t):
    return r6(M.roc(t.scored), "fpr", "tpr")


@query("m_auc", "with " + CUM + """ select c.class, round(case when max(P) > 0 and max(N) > 0 then
  sum(pos * (N - neg_above - neg + 0.5 * neg)) / (max(P) * max(N)) end, 6) as auc
  from c join tot on c.class = tot.class group by c.class""")
def m_auc(t):
    return r6(M.auc(t.scored), "auc")


@query("m_bce", """select round(avg(w * (1.5 * y * (greatest(-x, 0) + ln(1 + exp(-abs(x))))
  + (1 - y) * (greatest(x, 0) + ln(1 + exp(-abs(x)))))), 6) as bce
from (select y, (score - 0.5) * 10 as x, case when class = 'toxic' then 2.0 else 1.0 end as w
      from scored) z""")
def m_bce(t):
    s = t.scored.withColumn("logit", (F.col("score") - 0.5) * 10)
    return r6(M.bce(s, "logit", {"toxic": 2.0}, pos_weight=1.5), "bce")


WORDS = f"list_filter(string_split_regex(note, '{WS}'), lambda w: length(w) > 0)"


@query("m_chunk", f"""select note_id, chunk, len(words) as n_words, md5(array_to_string(words, ' ')) as digest
from (select note_id, generate_subscripts(st, 1) - 1 as chunk, w[unnest(st) * 512 + 1: unnest(st) * 512 + 512] as words
      from (select note_id, {WORDS} as w, range(0, greatest(cast(ceil(len({WORDS}) / 512) as int), 1)) as st
            from notes) a) b""")
def m_chunk(t):
    c = M.chunk(t.notes.select("note_id", "note"), 512)
    return c.select("note_id", "chunk", F.size("words").alias("n_words"),
                    F.md5(F.array_join("words", " ")).alias("digest"))


@query("m_truncate", f"""select note_id, md5(array_to_string({WORDS}[1:512], ' ')) as digest,
  len({WORDS}[1:512]) as n_words from notes""")
def m_truncate(t):
    tr = M.truncate(t.notes.select("note_id", "note"), 512)
    return tr.select("note_id", F.md5("note").alias("digest"),
                     F.size(M.words("note")).alias("n_words"))


CH = "(select vec_id % 100 as note_id, embedding, label from embeddings)"


@query("m_chunk_mean", f"""select note_id, generate_subscripts(embedding, 1) - 1 as dim,
  unnest(embedding) as x from {CH} c""".replace("select note_id,", "select note_id, dim, round(avg(cast(x as double)), 6) as value from (select note_id,", 1)
       + ") z group by note_id, dim")
def m_chunk_mean(t):
    return r6(M.chunk_mean(t.chunks), "value")


@query("m_masked_mean", f"""select note_id, dim, round(sum(cast(x as double) * m) / greatest(sum(m), 1e-9), 6) as value
from (select note_id, case when label >= 5 then 1.0 else 0.0 end as m,
             generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding) as x from {CH} c) z
group by note_id, dim""")
def m_masked_mean(t):
    c = t.chunks.withColumn("m", F.when(F.col("label") >= 5, 1.0).otherwise(0.0))
    return r6(M.masked_mean(c, "m"), "value")


@query("m_label_max", f"""select note_id, k, max(case when label = k then 1 else 0 end) as value
from (select note_id, label, unnest(range(0, 10)) as k from {CH} c) z group by note_id, k""")
def m_label_max(t):
    c = t.chunks.withColumn("labels", F.transform(F.sequence(F.lit(0), F.lit(9)),
                                                  lambda k: F.when(F.col("label") == k, 1).otherwise(0)))
    return M.label_max(c, "labels")


GRID_LR = [1e-5, 3e-5, 5e-5]
GRID_BATCH = [16, 32]


@query("m_param_grid", LK + """select fold, lr, batch from (select distinct fold from kf) f,
  (select unnest([1e-5, 3e-5, 5e-5]) as lr) a, (select unnest([16, 32]) as batch) b""")
def m_param_grid(t):
    return ML.param_grid(kfold(t), {"lr": GRID_LR, "batch": GRID_BATCH})


@query("m_baseline")
def m_baseline(t):
    return ML.baseline(t.documents, t.labels, ["quality", "toxic"])


@query("m_cv_baseline")
def m_cv_baseline(t):
    return ML.cv_baseline(t.documents, t.labels, "quality", k=3)
