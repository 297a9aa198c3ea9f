"""Scored-table operators (m_*): confusion, report, Hamming, subset accuracy,
multilabel accuracy, ROC, AUC, BCE, chunking and pooling.

Input: a long scored table (id, class, y, score). Everything is a grouped
aggregate by class (a handful of rows after the partial aggregate) or by id.
ROC/AUC need running sums over scores; they are computed on the distinct
(class, score) counts with bucket offsets (see ``_cum_by_score``) so a class
holding a third of all rows is never sorted in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import bce_with_logits, predict

SCORE_RANGES = 256  # ranges of distinct scores of a class in m_roc / m_auc


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """m_confusion: TN/FP/FN/TP per class with a strict '>' threshold."""
    p = predict("score", threshold)
    y = F.col("y")
    return scored.groupBy("class").agg(
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"))


def _prf(tp, fp, fn):
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return prec, rec, f1


def report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """m_report: precision/recall/F1/support per class, plus micro, macro,
    weighted and samples averages (zero division -> 0)."""
    c = confusion(scored, threshold)
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    prec, rec, f1 = _prf(tp, fp, fn)
    per = c.select(F.col("class").alias("label"), prec.alias("precision"), rec.alias("recall"),
                   f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))
    tot = c.agg(*[F.sum(x).cast("double").alias(x) for x in ("tp", "fp", "fn")])
    mp, mr, mf = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    micro = tot.select(F.lit("micro avg").alias("label"), mp.alias("precision"),
                       mr.alias("recall"), mf.alias("f1"),
                       (F.col("tp") + F.col("fn")).cast("long").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                    F.sum("support").alias("support"))
    sw = F.sum("support")
    weighted = per.agg(F.lit("weighted avg").alias("label"),
                       (F.sum(F.col("precision") * F.col("support")) / sw).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / sw).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / sw).alias("f1"),
                       sw.alias("support"))
    p = predict("score", threshold)
    s = scored.groupBy("id").agg(F.sum((F.col("y") * p).cast("double")).alias("inter"),
                                 F.sum(p.cast("double")).alias("npred"),
                                 F.sum(F.col("y").cast("double")).alias("ntrue"))
    samples = s.agg(
        F.lit("samples avg").alias("label"),
        F.avg(F.when(F.col("npred") > 0, F.col("inter") / F.col("npred")).otherwise(0.0)).alias("precision"),
        F.avg(F.when(F.col("ntrue") > 0, F.col("inter") / F.col("ntrue")).otherwise(0.0)).alias("recall"),
        F.avg(F.when(F.col("ntrue") + F.col("npred") > 0,
                     2 * F.col("inter") / (F.col("ntrue") + F.col("npred"))).otherwise(0.0)).alias("f1"),
        F.sum("ntrue").cast("long").alias("support"))
    return per.unionByName(micro).unionByName(macro).unionByName(weighted).unionByName(samples)


def hamming(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """m_hamming: share of (id, class) labels predicted wrong."""
    return scored.agg(F.avg((predict("score", threshold) != F.col("y")).cast("double"))
                      .alias("hamming_loss"))


def subset_accuracy(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """m_subset_acc: share of ids whose whole label vector is right."""
    per = scored.groupBy("id").agg(
        F.min((predict("score", threshold) == F.col("y")).cast("double")).alias("ok"))
    return per.agg(F.avg("ok").alias("subset_accuracy"))


def accuracy_avg(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """m_accuracy_avg: micro / macro / weighted (by support) multilabel accuracy."""
    c = confusion(scored, threshold)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    per = c.select("class", ((F.col("tp") + F.col("tn")) / n).alias("acc"),
                   (F.col("tp") + F.col("fn")).alias("support"), n.alias("n"),
                   (F.col("tp") + F.col("tn")).alias("ok"))
    return per.agg((F.sum("ok") / F.sum("n")).alias("micro"), F.avg("acc").alias("macro"),
                   (F.sum(F.col("acc") * F.col("support")) / F.sum("support")).alias("weighted"))


def _cum_by_score(scored: DataFrame) -> DataFrame:
    """Per (class, distinct score): pos/neg counts and the positives/negatives with a
    strictly higher score. Distinct scores are dealt into ranges by splitters taken from
    the class's own scores, whatever their scale; a range's offset is the running total
    of the ranges above it, and the exact running sum is only taken inside one range.
    A score that many rows share is one row by then."""
    d = scored.groupBy("class", "score").agg(F.sum(F.col("y")).cast("long").alias("pos"),
                                             F.sum(1 - F.col("y")).cast("long").alias("neg"))
    cuts = d.groupBy("class").agg(F.percentile_approx(
        "score", [i / SCORE_RANGES for i in range(1, SCORE_RANGES)]).alias("_cuts"))
    d = d.join(cuts, "class").withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    bt = d.groupBy("class", "_b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    wb = Window.partitionBy("class").orderBy(F.desc("_b"))
    bt = (bt.withColumn("op", F.sum("bp").over(wb) - F.col("bp"))
          .withColumn("on", F.sum("bn").over(wb) - F.col("bn")).select("class", "_b", "op", "on"))
    wi = Window.partitionBy("class", "_b").orderBy(F.desc("score"))
    return (d.join(bt, ["class", "_b"])
            .withColumn("pos_above", F.col("op") + F.sum("pos").over(wi) - F.col("pos"))
            .withColumn("neg_above", F.col("on") + F.sum("neg").over(wi) - F.col("neg"))
            .drop("_b", "op", "on"))


def roc(scored: DataFrame) -> DataFrame:
    """m_roc: FPR/TPR at each distinct score threshold (score >= t predicted 1), and the
    start (0, 0) of each class, where nothing is predicted (null threshold)."""
    c = _cum_by_score(scored)
    tot = scored.groupBy("class").agg(F.sum("y").alias("P"), F.sum(1 - F.col("y")).alias("N"))
    start = tot.select("class", F.lit(None).cast("double").alias("threshold"),
                       F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(
            c.join(tot, "class")
            .select("class", F.col("score").alias("threshold"),
                    ((F.col("neg_above") + F.col("neg")) / F.nullif(F.col("N"), F.lit(0))).alias("fpr"),
                    ((F.col("pos_above") + F.col("pos")) / F.nullif(F.col("P"), F.lit(0))).alias("tpr")))


def auc(scored: DataFrame) -> DataFrame:
    """m_auc: ROC-AUC per class (Mann-Whitney, ties count one half); null when
    a class has only one label value."""
    c = _cum_by_score(scored)
    # negatives strictly below a score = N - neg_above - neg
    tot = scored.groupBy("class").agg(F.sum("y").cast("double").alias("P"),
                                      F.sum(1 - F.col("y")).cast("double").alias("N"))
    s = (c.join(tot, "class")
         .withColumn("term", F.col("pos") * (F.col("N") - F.col("neg_above") - F.col("neg")
                                             + 0.5 * F.col("neg")))
         .groupBy("class").agg(F.sum("term").alias("u"), F.first("P").alias("P"),
                               F.first("N").alias("N")))
    return s.select("class", F.when((F.col("P") > 0) & (F.col("N") > 0),
                                    F.col("u") / (F.col("P") * F.col("N"))).alias("auc"))


def bce(scored: DataFrame, logit_col: str = "logit", class_weight: dict | None = None,
        pos_weight: float = 1.0) -> DataFrame:
    """m_bce: mean binary cross-entropy with logits (optionally class-weighted)."""
    l = bce_with_logits(logit_col, "y", pos_weight)
    if class_weight:
        w = F.lit(1.0)
        for k, v in class_weight.items():
            w = F.when(F.col("class") == k, F.lit(float(v))).otherwise(w)
        l = l * w
    return scored.agg(F.avg(l).alias("bce"))


def words(text_col: str = "note"):
    from ..functions.text import WS
    return F.filter(F.split(F.col(text_col), WS), lambda w: F.length(w) > 0)


def chunk(notes: DataFrame, size: int = 512, text_col: str = "note",
          id_col: str = "note_id") -> DataFrame:
    """m_chunk: fixed-size word chunks (no overlap); other columns repeated."""
    w = words(text_col)
    n = F.size(w)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0)))
    keep = [c for c in notes.columns if c != text_col]
    return (notes.select(*keep, w.alias("_w"), F.posexplode(starts).alias("chunk", "_c"))
            .select(*keep, "chunk", F.slice("_w", F.col("_c") * size + 1, size).alias("words")))


def truncate(notes: DataFrame, n: int = 512, text_col: str = "note") -> DataFrame:
    """m_truncate: first n words only."""
    return notes.withColumn(text_col, F.array_join(F.slice(words(text_col), 1, n), " "))


def chunk_mean(chunks: DataFrame, id_col: str = "note_id", vec_col: str = "embedding") -> DataFrame:
    """m_chunk_mean: note vector = element-wise mean of its chunk vectors."""
    return (chunks.select(id_col, F.posexplode(vec_col).alias("dim", "x"))
            .groupBy(id_col, "dim").agg(F.avg(F.col("x").cast("double")).alias("value")))


def masked_mean(chunks: DataFrame, mask_col: str, id_col: str = "note_id",
                vec_col: str = "embedding") -> DataFrame:
    """m_masked_mean: sum(x * m) / max(sum(m), 1e-9) per note and dimension."""
    e = chunks.select(id_col, F.col(mask_col).cast("double").alias("m"),
                      F.posexplode(vec_col).alias("dim", "x"))
    return (e.groupBy(id_col, "dim")
            .agg((F.sum(F.col("x").cast("double") * F.col("m"))
                  / F.greatest(F.sum("m"), F.lit(1e-9))).alias("value")))


def label_max(chunks: DataFrame, labels_col: str, id_col: str = "note_id") -> DataFrame:
    """m_label_max: a note's label vector is the element-wise max over chunks."""
    return (chunks.select(id_col, F.posexplode(labels_col).alias("k", "v"))
            .groupBy(id_col, "k").agg(F.max("v").alias("value")))
