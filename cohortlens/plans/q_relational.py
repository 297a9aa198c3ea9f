"""Registered primitive queries (2.1-2.7): io, projections, filters, joins,
aggregations, windows and set operations, each over the shared tables or the
fixture views derived from them."""
from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.mathx import predict, safe_div, sigmoid
from ..functions.timex import abs_duration_hours, floor_days, ts_literal
from ..operators import cohort as C
from ..operators import relational as R
from ..operators import report as RP
from ..session import checkpoint_dir, stored
from ..sources import tables as IO
from .q_cohort import sym, symu
from .registry import query
from .sqlfrag import AE_CASE, CLS, DX_CASE, SYMS, SYMU, chain

LEX_TERMS = ["sting", "ach", "naus", "tens", " ha ", "pale", "sore", "tingl", "oral", "tion",
             "eau", "ering", "steri", "er"]


def scratch(t, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    return f"{checkpoint_dir(t.spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


def _sql_list(xs):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


# ------------------------------------------------------------------ 2.1 io
@query("io_read_table", "select * from orders")
def io_read_table(t):
    return IO.read_table(t.spark, t.root, "orders")


@query("io_write_table", "select * from notes")
def io_write_table(t):
    p = scratch(t, "notes")
    IO.write_table(t.notes, p)
    return t.spark.read.parquet(p)


@query("io_sql", chain(*SYMS) + """, anchor as (select pat_deid, max(hosp_admsn_time) as hosp_admsn_time
  from opx group by pat_deid)
select distinct a.pat_deid, n.note_id, n.encounter_date, n.note_desc
from anchor a join treatments t on a.pat_deid = t.pat_deid join notes n on a.pat_deid = n.pat_deid
where n.encounter_date <= a.hosp_admsn_time and n.encounter_date >= t.che_tx_date""")
def io_sql(t):
    """The warehouse note-window SQL, run by Spark SQL on the frames; it leaves no view."""
    from .q_cohort import opx
    return t.spark.sql("""
        SELECT DISTINCT a.pat_deid, n.note_id, n.encounter_date, n.note_desc
        FROM {anchor} a JOIN {treatments} t ON a.pat_deid = t.pat_deid
        JOIN {notes} n ON a.pat_deid = n.pat_deid
        WHERE n.encounter_date <= a.hosp_admsn_time AND n.encounter_date >= t.che_tx_date""",
                       anchor=C.acu_anchor(opx(t)), treatments=t.treatments, notes=t.notes)


NOTE_CSV_SCHEMA = "note_id long, pat_deid long, note string, note_desc string"


@query("io_read_csv", "select note_id, pat_deid, note, note_desc from notes")
def io_read_csv(t):
    p = scratch(t, "notes_csv")
    (t.notes.select("note_id", "pat_deid", "note", "note_desc").write.mode("overwrite")
     .option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(p))
    return IO.read_csv(t.spark, p, NOTE_CSV_SCHEMA)


@query("io_write_csv", "select note_desc, count(*) as n from notes where note_desc is not null group by note_desc")
def io_write_csv(t):
    p = scratch(t, "vc_csv")
    IO.write_csv(R.value_counts(t.notes, "note_desc"), p)
    return IO.read_csv(t.spark, p, "note_desc string, n long")


@query("io_lexicon", "select l.term_id, l.term as lexicon, e.embedding as feature from lexicon l "
       "left join embeddings e on l.term_id = e.vec_id")
def io_lexicon(t):
    """Lexicon with feature vectors as parquet (term_id, lexicon, feature)."""
    lex = t.lexicon.join(t.embeddings, F.col("term_id") == F.col("vec_id"), "left")
    p = scratch(t, "lexicon")
    IO.write_table(lex.select("term_id", F.col("term").alias("lexicon"),
                              F.col("embedding").alias("feature")), p)
    return t.spark.read.parquet(p)


@query("io_edges", "select src as row, dst as col, weight from graph_edges")
def io_edges(t):
    p = scratch(t, "edges")
    IO.write_table(t.graph_edges.select(F.col("src").alias("row"), F.col("dst").alias("col"),
                                        "weight"), p)
    return t.spark.read.parquet(p)


@query("io_report")
def io_report(t):
    from ..operators import outcome as O
    p = scratch(t, "table_one")
    IO.write_csv(RP.table_one(O.ae_class(symu(t)), t.patients), p)
    return IO.read_csv(t.spark, p, "ae_class string, variable string, position int, level string, n long, "
                                   "pct double, mean double, sd double")


# ------------------------------------------------------------------ 2.2 projections
@query("p_rename_case", "select " + ", ".join(
    f"{c} as {c.upper()}" for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                    "o_orderdate", "o_orderpriority"]) + " from orders")
def p_rename_case(t):
    o = t.orders
    return o.toDF(*[c.upper() for c in o.columns])


@query("p_select_drop", "select l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount "
       "from lineitem")
def p_select_drop(t):
    return (t.lineitem.drop("l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_suppkey",
                            "l_linenumber")
            .select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"))


@query("p_rename", "select doc_id as note_id, text as note, source from documents")
def p_rename(t):
    return (t.documents.select("doc_id", "text", "source")
            .withColumnRenamed("doc_id", "note_id").withColumnRenamed("text", "note"))


@query("p_floor_days", """select enc_id,
  cast(floor((epoch_us(hosp_admsn_time) - epoch_us(che_tx_date)) / 86400000000.0) as bigint) as che_to_hosp,
  cast(floor((epoch_us(che_tx_date) - epoch_us(hosp_dischrg_time)) / 86400000000.0) as bigint) as back_days
from encounters""")
def p_floor_days(t):
    return t.encounters.select("enc_id",
                               floor_days("hosp_admsn_time", "che_tx_date").alias("che_to_hosp"),
                               floor_days("che_tx_date", "hosp_dischrg_time").alias("back_days"))


@query("p_abs_duration", """select pt_class,
  round(avg(abs(epoch_us(hosp_admsn_time) - epoch_us(hosp_dischrg_time)) / 3.6e9), 6) as mean_hours,
  round(max(abs(epoch_us(hosp_admsn_time) - epoch_us(hosp_dischrg_time)) / 3.6e9), 6) as max_hours
from encounters group by pt_class""")
def p_abs_duration(t):
    d = abs_duration_hours("hosp_admsn_time", "hosp_dischrg_time")
    return t.encounters.groupBy("pt_class").agg(F.round(F.avg(d), 6).alias("mean_hours"),
                                                F.round(F.max(d), 6).alias("max_hours"))


@query("p_date_literal", "select * from encounters where hosp_admsn_time >= "
       "timestamp '2024-01-15 00:00:00'")
def p_date_literal(t):
    return t.encounters.where(F.col("hosp_admsn_time") >= ts_literal("2024-01-15 00:00:00"))


@query("p_contains_any", "select note_id, (" + " or ".join(
    f"contains(upper(note), '{x.upper()}')" for x in LEX_TERMS) + ") as hit from notes")
def p_contains_any(t):
    return t.notes.select("note_id", TX.contains_any_ci("note", LEX_TERMS).alias("hit"))


@query("p_find", "select enc_id, dx_name, contains(upper(dx_name), 'NAUS') as nausea "
       "from encounters where dx_name is not null")
def p_find(t):
    return t.encounters.where(F.col("dx_name").isNotNull()).select(
        "enc_id", "dx_name", F.upper("dx_name").contains("NAUS").alias("nausea"))


@query("p_case_last_wins", f"select enc_id, dx_name, {DX_CASE} as dx_short from encounters")
def p_case_last_wins(t):
    return t.encounters.select("enc_id", "dx_name", C.dx_short_expr().alias("dx_short"))


ONE_HOT_SQL = chain(*SYMS) + "select enc_id, pat_deid, dx_short, " + ", ".join(
    f"case when ({AE_CASE}) = '{c}' then 1 else 0 end as {c.lower()}"
    for c in ["CLASS_1", "CLASS_2", "CLASS_3", "CLASS_4"]) + " from sym"


def _one_hot(t):
    cls = C.ae_class_expr()
    return sym(t).select("enc_id", "pat_deid", "dx_short",
                         *[F.when(cls == c, 1).otherwise(0).alias(c.lower())
                           for c in ["CLASS_1", "CLASS_2", "CLASS_3", "CLASS_4"]])


@query("p_one_hot", ONE_HOT_SQL)
def p_one_hot(t):
    return _one_hot(t)


@query("p_row_sum", "select enc_id, class_1 + class_2 + class_3 + class_4 as total from ("
       + ONE_HOT_SQL.replace("with ", "with oh as (with ", 1) + ") select * from oh) x")
def p_row_sum(t):
    return _one_hot(t).select("enc_id", (F.col("class_1") + F.col("class_2") + F.col("class_3")
                                         + F.col("class_4")).alias("total"))


_RC = _sql_list(RP.RECODE_TO_OTHER)


@query("p_replace_map", "select pat_deid, " + ", ".join(
    f"case when {c} in ({_RC}) then 'Other' else {c} end as {c}"
    for c in ["sex", "race", "cancer_group", "ethnic_group", "insurance_payor"]) + ", age_at_dx, stage_four from patients")
def p_replace_map(t):
    return RP.replace_all(t.patients, RP.RECODE_TO_OTHER)


@query("p_word_count", "select note_id, len(string_split(note, ' ')) as word_count from notes")
def p_word_count(t):
    return t.notes.select("note_id", TX.word_count("note").alias("word_count"))


PUNCT_SQL = TX.PUNCT.replace("'", "''").replace("\t", "' || chr(9) || '").replace(
    "\n", "' || chr(10) || '")
WCC = ("len(list_filter(string_split_regex({x}, ' |\\n'), "
       "lambda w: not contains('" + PUNCT_SQL + "', w) and w <> ' '))")


@query("p_word_count_clean", "select note_id, " + WCC.replace("{x}", "note") + " as n_words from notes")
def p_word_count_clean(t):
    return t.notes.select("note_id", TX.word_count_clean("note").alias("n_words"))


CLEAN_PHRASES = ["general hospital and clinics", "city cancer center"]


def clean_sql(x: str, phrases=CLEAN_PHRASES) -> str:
    for p in phrases:
        x = f"regexp_replace({x}, '{TX.re_escape(p)}', '', 'gi')"
    x = f"replace(replace({x}, '¿', ''), '#', '')"
    x = f"regexp_replace({x}, 'm\\.d\\.', 'md', 'g')"
    x = f"regexp_replace({x}, 'dr\\.', 'doctor', 'g')"
    x = f"regexp_replace({x}, 'http\\S+', '', 'g')"
    return f"regexp_replace({x}, 'w{{3}}\\S+', '', 'g')"


@query("p_clean_text", f"select note_id, {clean_sql('note')} as note from notes")
def p_clean_text(t):
    return t.notes.select("note_id", TX.clean_text("note", CLEAN_PHRASES).alias("note"))


WS = TX.WS
SPLIT_SQL = ("list_filter(list_transform(string_split_regex({x}, '\\.{ws}|\\n|{ws}{ws}{ws}'), "
             "lambda s: regexp_replace(s, '^{ws}+|{ws}+$', '', 'g')), lambda s: length(s) >= 2)"
             ).replace("{ws}", WS)


@query("p_sentence_split", "select note_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) "
       "as sentence from (select note_id, " + SPLIT_SQL.replace("{x}", "note") + " as l from notes) z")
def p_sentence_split(t):
    return t.notes.select("note_id", F.posexplode(TX.sentence_split("note")).alias("pos", "sentence"))


@query("p_join_split_sep", "select note_id, array_to_string(l, '[SEP]') as joined, "
       "len(string_split(array_to_string(l, '[SEP]'), '[SEP]')) as n_back from (select note_id, "
       + SPLIT_SQL.replace("{x}", "note") + " as l from notes) z where len(l) > 0")
def p_join_split_sep(t):
    s = t.notes.select("note_id", TX.sentence_split("note").alias("l")).where(F.size("l") > 0)
    j = TX.join_sep("l")
    return s.select("note_id", j.alias("joined"), F.size(TX.split_sep(j)).alias("n_back"))


@query("p_fillna", "select pat_deid, coalesce(race, 'Unknown') as race, "
       "coalesce(race, cancer_group) as race_or_group from patients")
def p_fillna(t):
    p = t.patients
    return p.select("pat_deid", "race", F.coalesce("race", "cancer_group").alias("race_or_group")
                    ).na.fill({"race": "Unknown"})


@query("p_ratio", "select c_custkey, c_acctbal / nullif(c_nationkey, 0) as ratio from customer")
def p_ratio(t):
    return t.customer.select("c_custkey", safe_div("c_acctbal", "c_nationkey").alias("ratio"))


@query("p_dropna", "select * from patients where race is not null and ethnic_group is not null "
       "and insurance_payor is not null")
def p_dropna(t):
    return t.patients.na.drop(how="any")


@query("p_null_profile", "select " + ", ".join(
    f"cast(sum(cast({c} is null as bigint)) as bigint) as {c}"
    for c in ["enc_id", "pat_deid", "hosp_admsn_time", "hosp_dischrg_time", "che_tx_date",
              "pt_class", "dx_name"]) + " from encounters")
def p_null_profile(t):
    return R.null_profile(t.encounters)


@query("p_dup_count", "select count(*) as n_rows, count(*) - (select count(*) from "
       "(select distinct pat_deid, note from notes) d) as n_dup from notes")
def p_dup_count(t):
    return R.dup_count(t.notes, ["pat_deid", "note"])


T1_BASE = chain(*SYMS, SYMU, CLS) + """, t1 as (select pat_deid, """ + ", ".join(
    f"max(cast(ae_class = 'CLASS_{i}' as int)) as class_{i}" for i in range(1, 5)) + \
    " from cls group by pat_deid)\n"


def t1(t):
    from ..operators import outcome as O
    return t.memo("t1", lambda: stored(O.table_1(O.ae_class(symu(t))), "outcomes"))


LABEL_KEY = "concat_ws('', class_1, class_2, class_3, class_4)"


@query("p_label_key", T1_BASE + f"select pat_deid, {LABEL_KEY} as label_key from t1")
def p_label_key(t):
    return t1(t).select("pat_deid", F.concat_ws("", *[F.col(f"class_{i}").cast("string")
                                                    for i in range(1, 5)]).alias("label_key"))


@query("p_label_encode", T1_BASE + f"""select pat_deid, label_key,
  cast(dense_rank() over (order by label_key) - 1 as int) as label
from (select pat_deid, {LABEL_KEY} as label_key from t1) z""")
def p_label_encode(t):
    from ..operators.split import label_encode
    return label_encode(p_label_key(t), "label_key")


@query("p_sigmoid_threshold", """select id, class, round(1 / (1 + exp(-(score * 4 - 2))), 6) as prob,
  case when 1 / (1 + exp(-(score * 4 - 2))) > 0.5 then 1 else 0 end as pred from scored""")
def p_sigmoid_threshold(t):
    p = sigmoid(F.col("score") * 4 - 2)
    return t.scored.select("id", "class", F.round(p, 6).alias("prob"), predict(p).alias("pred"))


@query("p_shape", """select 'notes' as name, count(*) as n_rows, 6 as n_cols,
  count(distinct pat_deid) as n_patients from notes
union all select 'encounters', count(*), 7, count(distinct pat_deid) from encounters
union all select 'patients', count(*), 8, count(distinct pat_deid) from patients""")
def p_shape(t):
    out = None
    for name in ["notes", "encounters", "patients"]:
        d = t.table(name)
        r = d.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(d.columns)).alias("n_cols"),
                  F.count_distinct("pat_deid").alias("n_patients"))
        out = r if out is None else out.unionByName(r)
    return out


# ------------------------------------------------------------------ 2.3 filters
@query("f_compare", "select l_orderkey, l_linenumber, l_quantity from lineitem where "
       "l_quantity > 30 and l_discount <= 0.05 and l_shipdate >= timestamp '1995-01-01 00:00:00'")
def f_compare(t):
    return (t.lineitem.where((F.col("l_quantity") > 30) & (F.col("l_discount") <= 0.05)
                             & (F.col("l_shipdate") >= ts_literal("1995-01-01 00:00:00")))
            .select("l_orderkey", "l_linenumber", "l_quantity"))


@query("f_isin", "select * from orders where o_orderpriority in ('1-URGENT', '2-HIGH') "
       "and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def f_isin(t):
    ids = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("o_custkey"))
    return (t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .join(ids, "o_custkey", "left_semi"))


@query("f_not_isin", "select * from notes where pat_deid not in (select pat_deid from "
       "encounters where pt_class = 'Emergency Services')")
def f_not_isin(t):
    ed = t.encounters.where(F.col("pt_class") == C.ED).select("pat_deid")
    return t.notes.join(ed, "pat_deid", "left_anti")


@query("f_regex_search", "select note_id, pat_deid from notes where regexp_matches(lower(note), '"
       + "|".join(TX.re_escape(x) for x in LEX_TERMS) + "')")
def f_regex_search(t):
    pat = "|".join(TX.re_escape(x) for x in LEX_TERMS)
    return t.notes.where(F.lower("note").rlike(pat)).select("note_id", "pat_deid")


@query("f_phrase_exclude", "select note_id, pat_deid from notes "
       "where not contains(lower(note), 'license')")
def f_phrase_exclude(t):
    return t.notes.where(~F.lower("note").contains("license")).select("note_id", "pat_deid")


@query("f_single_label", T1_BASE + "select * from t1 where class_1 + class_2 + class_3 + class_4 = 1")
def f_single_label(t):
    return t1(t).where(F.col("total") == 1).drop("classes", "total")


# ------------------------------------------------------------------ 2.4 joins
# Each line looks for the line before it in its order, of the same flag and status; many
# have none, and the flag N counts as missing, which matches nothing.
@query("j_left_multikey", """select distinct l.l_orderkey, l.l_linenumber, nullif(l.l_returnflag, 'N') as l_returnflag,
  l.l_linestatus, l.l_quantity, r.tax_before
from lineitem l left join (select l_orderkey, l_linenumber + 1 as l_linenumber,
  nullif(l_returnflag, 'N') as l_returnflag, l_linestatus, l_tax as tax_before from lineitem) r
on l.l_orderkey = r.l_orderkey and l.l_linenumber = r.l_linenumber
and nullif(l.l_returnflag, 'N') = r.l_returnflag and l.l_linestatus = r.l_linestatus""")
def j_left_multikey(t):
    keys = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    li = t.lineitem.withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    before = li.withColumn("l_linenumber", F.col("l_linenumber") + 1).withColumnRenamed("l_tax", "tax_before")
    return C.enrich_left(li.select(*keys, "l_quantity"), before, keys, ["tax_before"])


# A second record of the events names another user for every third one, and the type
# error is missing on both sides.
@query("j_left_sixkey", """select distinct l.*, r.flag from
  (select * replace (nullif(event_type, 'error') as event_type) from events) l left join
  (select event_id, case when event_id % 3 = 0 then user_id + 1 else user_id end as user_id,
     nullif(event_type, 'error') as event_type, ts, value, props, length(event_type) as flag from events) r
on l.event_id = r.event_id and l.user_id = r.user_id and l.event_type = r.event_type
and l.ts = r.ts and l.value = r.value and l.props = r.props""")
def j_left_sixkey(t):
    e = t.events.withColumn("event_type", F.nullif("event_type", F.lit("error")))
    other = e.withColumn("flag", F.length("event_type")).withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return C.enrich_left(e, other, ["event_id", "user_id", "event_type", "ts", "value", "props"], ["flag"])


@query("j_left", T1_BASE + """select n.note_id, n.pat_deid, t1.class_1, t1.class_2, t1.class_3,
  t1.class_4 from notes n left join t1 on n.pat_deid = t1.pat_deid""")
def j_left(t):
    return t.notes.select("note_id", "pat_deid").join(t1(t).drop("classes", "total"),
                                                      "pat_deid", "left")


@query("j_inner", """select n.note_id, n.pat_deid, p.sex, p.race from notes n
  join patients p on n.pat_deid = p.pat_deid""")
def j_inner(t):
    return t.notes.select("note_id", "pat_deid").join(
        t.patients.select("pat_deid", "sex", "race"), "pat_deid")


@query("j_right", T1_BASE + """select t1.pat_deid, n.n_notes from
  (select pat_deid, count(*) as n_notes from notes where note_desc = 'H&P' group by pat_deid) n
  right join t1 on n.pat_deid = t1.pat_deid""")
def j_right(t):
    n = (t.notes.where(F.col("note_desc") == "H&P").groupBy("pat_deid")
         .agg(F.count(F.lit(1)).alias("n_notes")))
    return n.join(t1(t).select("pat_deid"), "pat_deid", "right").select("pat_deid", "n_notes")


@query("j_semi", "select * from patients where pat_deid in (select pat_deid from notes "
       "where note_desc = 'H&P')")
def j_semi(t):
    return t.patients.join(t.notes.where(F.col("note_desc") == "H&P").select("pat_deid"),
                           "pat_deid", "left_semi")


@query("j_anti", "select * from patients where pat_deid not in (select pat_deid from notes "
       "where note_desc = 'H&P')")
def j_anti(t):
    return t.patients.join(t.notes.where(F.col("note_desc") == "H&P").select("pat_deid"),
                           "pat_deid", "left_anti")


# ------------------------------------------------------------------ 2.5 aggregations
@query("a_nunique", "select (select count(distinct pat_deid) from notes) as notes_patients, "
       "(select count(distinct pat_deid) from encounters) as encounter_patients")
def a_nunique(t):
    a = t.notes.select(F.count_distinct("pat_deid")).scalar()
    b = t.encounters.select(F.count_distinct("pat_deid")).scalar()
    return t.spark.range(1).select(a.alias("notes_patients"), b.alias("encounter_patients"))


@query("a_value_counts", "select pt_class, count(*) as n from encounters "
       "where pt_class is not null group by pt_class")
def a_value_counts(t):
    return R.value_counts(t.encounters, "pt_class")


@query("a_value_counts_norm", """select note_desc, count(*) as n,
  count(*) / sum(count(*)) over () as share from notes where note_desc is not null
  group by note_desc""")
def a_value_counts_norm(t):
    return R.value_counts_norm(t.notes, "note_desc")


@query("a_value_counts_multi", "select pt_class, dx_name, count(*) as n from encounters "
       "where pt_class is not null and dx_name is not null group by pt_class, dx_name")
def a_value_counts_multi(t):
    return R.value_counts(t.encounters, "pt_class", "dx_name")


@query("a_group_sum", "select user_id, round(sum(value), 6) as total_value, "
       "count(*) as n_events from events group by user_id")
def a_group_sum(t):
    return t.events.groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total_value"),
                                           F.count(F.lit(1)).alias("n_events"))


@query("a_group_count", "select pat_deid, note_desc, count(*) as n from notes "
       "group by pat_deid, note_desc")
def a_group_count(t):
    return t.notes.groupBy("pat_deid", "note_desc").agg(F.count(F.lit(1)).alias("n"))


WC_SQL = "len(string_split(note, ' '))"


@query("a_basic_stats", f"""select note_desc, count(wc) as count, cast(min(wc) as double) as min,
  cast(max(wc) as double) as max, round(avg(wc), 6) as mean, median(wc) as median,
  round(stddev_samp(wc), 6) as std
from (select note_desc, {WC_SQL} as wc from notes) z group by note_desc""")
def a_basic_stats(t):
    s = R.basic_stats(t.notes.select("note_desc", TX.word_count("note").alias("wc")), "wc",
                      ["note_desc"])
    return s.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("a_describe", f"""select count(wc) as count, round(avg(wc), 6) as mean,
  round(stddev_samp(wc), 6) as std, cast(min(wc) as double) as min,
  quantile_cont(wc, 0.25) as p25, quantile_cont(wc, 0.5) as p50, quantile_cont(wc, 0.75) as p75,
  cast(max(wc) as double) as max from (select {WC_SQL} as wc from notes) z""")
def a_describe(t):
    d = R.describe(t.notes.select(TX.word_count("note").alias("wc")), "wc")
    return d.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("a_histogram", f"""with x as (select {WC_SQL} as wc from notes),
b as (select min(wc) as lo, max(wc) as hi from x)
select cast(least(floor((wc - lo) / ((hi - lo) / 30.0)), 29) as int) as bin,
  round(lo + cast(least(floor((wc - lo) / ((hi - lo) / 30.0)), 29) as int) * (hi - lo) / 30.0, 6)
    as "left", count(*) as n
from x, b group by 1, 2""")
def a_histogram(t):
    h = R.histogram(t.notes.select(TX.word_count("note").alias("wc")), "wc", 30)
    return h.withColumn("left", F.round("left", 6))


@query("a_max_filter", f"""select note_id, note_desc, wc from
  (select note_id, note_desc, {WC_SQL} as wc from notes) z
  where wc = (select max({WC_SQL}) from notes n2 where n2.note_desc = z.note_desc)""")
def a_max_filter(t):
    d = t.notes.select("note_id", "note_desc", TX.word_count("note").alias("wc"))
    return R.max_filter(d, "wc", ["note_desc"])


@query("a_collect_classes", chain(*SYMS, SYMU, CLS) + """select pat_deid,
  array_to_string(list_sort(list(distinct lower(ae_class))), '|') as classes
from cls group by pat_deid""")
def a_collect_classes(t):
    from ..operators import outcome as O
    return (O.ae_class(symu(t)).groupBy("pat_deid")
            .agg(F.array_join(F.array_sort(F.collect_set(F.lower("ae_class"))), "|")
                 .alias("classes")))


# ------------------------------------------------------------------ 2.6 windows
@query("w_distinct", "select distinct pat_deid, note from notes")
def w_distinct(t):
    return t.notes.select("pat_deid", "note").distinct()


@query("w_dedupe_first", "select * from notes qualify row_number() over (partition by pat_deid, "
       "note order by effective_time, note_id) = 1")
def w_dedupe_first(t):
    return R.dedupe_first(t.notes, ["pat_deid", "note"], ["effective_time", "note_id"])


@query("w_dup_mask", "select doc_id, row_number() over (partition by text order by doc_id) > 1 "
       "as is_dup from documents")
def w_dup_mask(t):
    return R.dup_mask(t.documents.select("doc_id", "text"), ["text"], ["doc_id"]).drop("text")


@query("w_sort_multi", "select o_orderkey, o_orderpriority, o_totalprice from orders "
       "order by o_orderpriority desc, o_totalprice desc, o_orderkey")
def w_sort_multi(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(
        F.desc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey")


@query("w_topk", """select dx_name, count(*) as n from encounters where dx_name is not null
  group by dx_name order by n desc, dx_name limit 10""")
def w_topk(t):
    return R.topk(R.value_counts(t.encounters, "dx_name"), [F.desc("n"), "dx_name"], 10)


@query("w_limit", "select note_id, pat_deid from notes where note_desc = 'H&P' "
       "order by note_id limit 3")
def w_limit(t):
    return R.topk(t.notes.where(F.col("note_desc") == "H&P").select("note_id", "pat_deid"),
                  ["note_id"], 3)


@query("w_array_dedupe", "select note_id, array_to_string(list_distinct_ordered, '[SEP]') as "
       "sentences from (select note_id, list_reduce(list_transform(l, lambda x: [x]), "
       "lambda acc, x: case when list_contains(acc, x[1]) then acc else list_concat(acc, x) end) "
       "as list_distinct_ordered from (select note_id, " + SPLIT_SQL.replace("{x}", "note")
       + " as l from notes) z where len(l) > 0) y")
def w_array_dedupe(t):
    s = t.notes.select("note_id", TX.sentence_split("note").alias("l")).where(F.size("l") > 0)
    return s.select("note_id", TX.join_sep(F.array_distinct("l")).alias("sentences"))


# Two layers from the target nodes of the 'in' relation, each relation with its own k.
FANOUT = {"in": 5, "co-occur": 2}
FANOUT_SQL = """(select * from graph_edges where dst in ({nodes}) qualify row_number() over (
  partition by dst, etype order by md5(cast(src as varchar) || '42'), src) <= case etype when 'in' then 5 else 2 end)"""


@query("w_fanout_sample", "with one as " + FANOUT_SQL.format(nodes="select dst from graph_edges where etype = 'in'")
       + ", two as " + FANOUT_SQL.format(nodes="select src from one")
       + " select 1 as layer, src, dst, etype, weight from one union all select 2, src, dst, etype, weight from two")
def w_fanout_sample(t):
    from ..operators.graph import layered_sample
    return layered_sample(t.graph_edges, t.graph_edges.where("etype = 'in'"), FANOUT, layers=2, seed=42)


# ------------------------------------------------------------------ 2.7 set operations
@query("s_union_all", "select note_id, pat_deid from notes where note_desc = 'H&P' union all "
       "select note_id, pat_deid from notes where note_desc = 'ED Provider Notes'")
def s_union_all(t):
    n = t.notes.select("note_id", "pat_deid", "note_desc")
    return (n.where(F.col("note_desc") == "H&P").drop("note_desc")
            .unionByName(n.where(F.col("note_desc") == "ED Provider Notes").drop("note_desc")))


ED_IDS = "select pat_deid from encounters where pt_class = 'Emergency Services'"
IN_IDS = "select pat_deid from encounters where pt_class = 'Inpatient'"


@query("s_except", f"{IN_IDS} except {ED_IDS}")
def s_except(t):
    e = t.encounters
    return (e.where(F.col("pt_class") == C.INPATIENT).select("pat_deid")
            .subtract(e.where(F.col("pt_class") == C.ED).select("pat_deid")))


@query("s_intersect", f"{IN_IDS} intersect {ED_IDS}")
def s_intersect(t):
    e = t.encounters
    return (e.where(F.col("pt_class") == C.INPATIENT).select("pat_deid")
            .intersect(e.where(F.col("pt_class") == C.ED).select("pat_deid")))


@query("s_symdiff", """select pat_deid, note_desc from (
  select distinct pat_deid, 'H&P' as note_desc from notes where note_desc = 'H&P'
  union all select distinct pat_deid, 'H&P' from encounters where pt_class = 'Inpatient') u
  group by pat_deid, note_desc having count(*) = 1""")
def s_symdiff(t):
    n = t.notes
    a = n.where(F.col("note_desc") == "H&P").select("pat_deid", "note_desc").distinct()
    b = (t.encounters.where(F.col("pt_class") == C.INPATIENT)
         .select("pat_deid", F.lit("H&P").alias("note_desc")).distinct())
    return R.symdiff(a, b)

