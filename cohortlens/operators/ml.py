"""ML-data operators: parameter grid, text baseline and its cross-validation.

The neural classifier is out of scope; the baseline is a Spark ML pipeline
(tokenize -> hashed term frequencies -> IDF -> logistic regression), one binary
model per class, fitted and scored as distributed jobs.
"""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .split import stratified_kfold


def param_grid(folds: DataFrame, grid: dict[str, list]) -> DataFrame:
    """m_param_grid: every setting combination for every fold of the data
    (generated per fold row with explode, not a cross join)."""
    out = folds.select("fold").distinct()
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def _counted(data: DataFrame, text_col: str, features: int = 1 << 16) -> DataFrame:
    """The text's hashed term frequencies ``_tf`` in its place. They depend on the row
    alone, so they are made once, not in every fit."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern="\\W+", minTokenLength=2)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features)
    return tf.transform(tok.transform(data)).drop(text_col, "_tok")


def _pipeline(label_col: str, reg: float = 0.01):
    idf = IDF(inputCol="_tf", outputCol="_x")
    lr = LogisticRegression(featuresCol="_x", labelCol=label_col, regParam=reg, maxIter=50)
    return Pipeline(stages=[idf, lr]), lr


def _folds(data: DataFrame, id_col: str, label: str, k: int) -> DataFrame:
    """The data with a ``fold``, stratified on the label, written once."""
    folds = stratified_kfold(data.select(id_col, F.col(label).cast("string").alias("_key")).dropDuplicates([id_col]),
                             id_col, ["_key"], k)
    return cut_lineage(data.join(folds.select(id_col, "fold"), id_col))


def baseline(docs: DataFrame, labels: DataFrame, classes: list[str], k: int = 3,
             text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """m_baseline: one binary text classifier per class and fold; returns the scored long
    table (id, class, y, score, fold) that the m_* metrics consume. A row is scored by the
    model (features included) fitted on the other folds, which never saw it."""
    data = cut_lineage(_counted(docs.select(id_col, text_col).join(labels, id_col), text_col))
    out = None
    for c in classes:
        d = _folds(data.withColumn("_y", F.col(c).cast("double")), id_col, c, k)
        for fold in range(k):
            pipe, _ = _pipeline("_y")
            model = pipe.fit(d.where(F.col("fold") != fold))
            s = model.transform(d.where(F.col("fold") == fold)).select(
                F.col(id_col).alias("id"), F.lit(c).alias("class"), F.col(c).alias("y"),
                vector_to_array("probability")[1].alias("score"), "fold")
            out = s if out is None else out.unionByName(s)
    return out


def cv_baseline(docs: DataFrame, labels: DataFrame, label: str, k: int = 3,
                text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """m_cv_baseline: choose the regularisation by cross-validation on the stratified
    folds, report the metric per setting."""
    counted = cut_lineage(_counted(docs.select(id_col, text_col).join(labels, id_col), text_col))
    data = _folds(counted.withColumn("_y", F.col(label).cast("double")), id_col, label, k)
    pipe, lr = _pipeline("_y")
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1]).build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, foldCol="fold",
                        evaluator=BinaryClassificationEvaluator(labelCol="_y"), numFolds=k)
    model = cv.fit(data)
    spark = docs.sparkSession
    rows = [(float(pm[lr.regParam]), float(m)) for pm, m in zip(grid, model.avgMetrics)]
    return spark.createDataFrame(rows, "reg_param double, avg_auc double")
