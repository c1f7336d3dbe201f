"""MLlib training jobs: price-index regressor and risk-band classifier.

Training data are built with DataFrame operators (positional window vectors,
risk components), assembled with ``VectorAssembler`` and fitted with MLlib's
distributed random forests.  The training frame is checkpointed into the
shared checkpoint folder before fitting, because the forest reads it once
per tree level and its lineage (windows, joins) should not be recomputed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidal.operators.bands import classification_report
from tidal.operators.evaluate import SPLIT_NAMES, mae, rmse
from tidal.session import checkpoint_dir, cut_lineage

# Fixed values of the models: forest size, seed and regularisation.
N_TREES = 100
SEED = 42
REG_MAX_DEPTH = 10
CLS_MAX_DEPTH = 6
CLS_MIN_LEAF = 4


def train_price_regressor(data: DataFrame, feature_cols: list[str], label: str = "target",
                          split: str = "split", max_depth: int = REG_MAX_DEPTH):
    """Random forest regressor fitted on the 'train' rows; returns (model, predictions)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    va = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    assembled = cut_lineage(va.transform(data))
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=N_TREES, seed=SEED,
                               maxDepth=max_depth, featureSubsetStrategy="all")
    model = rf.fit(assembled.filter(F.col(split) == "train"))
    return model, model.transform(assembled)


def regression_report(pred: DataFrame, label: str = "target", split: str = "split") -> DataFrame:
    err = F.col(label) - F.col("prediction")
    return pred.groupBy(split).agg(mae(err).alias("mae"), rmse(err).alias("rmse"), F.count(F.lit(1)).alias("n"))


def fit_risk_classifier(data: DataFrame, feature_cols: list[str], label: str = "band", split: str = "split"):
    """Random forest classifier (depth 6, min leaf 4, 100 trees) fitted on the 'train' rows; returns (pipeline, filled rows)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
    from pyspark.ml.classification import RandomForestClassifier
    filled = data.na.fill(0.0, subset=feature_cols)
    idx = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(filled)
    pipe = Pipeline(stages=[
        idx,
        VectorAssembler(inputCols=feature_cols, outputCol="features"),
        RandomForestClassifier(featuresCol="features", labelCol="_y", numTrees=N_TREES, seed=SEED,
                               maxDepth=CLS_MAX_DEPTH, minInstancesPerNode=CLS_MIN_LEAF),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=idx.labels),
    ])
    train = cut_lineage(filled)
    return pipe.fit(train.filter(F.col(split) == "train")), train


def train_risk_classifier(data: DataFrame, feature_cols: list[str], label: str = "band",
                          split: str = "split"):
    """``fit_risk_classifier``, then predicts every row; returns (model, predictions).

    The model is saved to the shared checkpoint folder and loaded again, which leaves its training summary
    behind: that of two classes holds the session, and no task that carries the model can be serialized once
    any write of the session has been observed (``DataFrame.observe``).
    """
    from pyspark.ml import PipelineModel
    fitted, train = fit_risk_classifier(data, feature_cols, label, split)
    path = f"{checkpoint_dir(data.sparkSession).rstrip('/')}/models/fitted-{uuid.uuid4().hex}"
    fitted.write().save(path)
    model = PipelineModel.load(path)
    return model, model.transform(train)


def accuracy_report(pred: DataFrame, label: str = "band", split: str = "split") -> DataFrame:
    ok = (F.col(label) == F.col("predicted")).cast("long")
    return pred.groupBy(split).agg(F.avg(ok.cast("double")).alias("accuracy"),
                                   (F.count(F.lit(1)) - F.sum(ok)).alias("errors"),
                                   F.count(F.lit(1)).alias("n"))


def key_errors(pred: DataFrame, label: str = "target", key: str = "key", split: str = "split", on: str = "test") -> DataFrame:
    """MAE and RMSE of the predictions per key over one split's rows."""
    err = F.col(label) - F.col("prediction")
    return pred.filter(F.col(split) == on).groupBy(key).agg(mae(err).alias("mae"), rmse(err).alias("rmse"))


def fit_checks(pred: DataFrame, label: str = "band", split: str = "split") -> DataFrame:
    """One row: accuracy and errors of every split and the train-val gap (large: overfitting); a split without rows is NULL."""
    ok = (F.col(label) == F.col("predicted")).cast("double")
    aggs = []
    for s in SPLIT_NAMES:
        here = F.when(F.col(split) == s, ok)
        aggs += [F.avg(here).alias(f"{s}_accuracy"), F.sum(1 - here).cast("long").alias(f"{s}_errors")]
    return pred.agg(*aggs).withColumn("overfitting_gap", F.col("train_accuracy") - F.col("val_accuracy"))


def score_saved(spark: SparkSession, path: str, data: DataFrame) -> DataFrame:
    """Predictions of the pipeline saved at ``path/model``, written to ``path/predictions`` and read from there."""
    from pyspark.ml import PipelineModel
    PipelineModel.load(f"{path}/model").transform(data).drop("features", "rawPrediction", "probability", "_y") \
        .write.mode("overwrite").parquet(f"{path}/predictions")
    return spark.read.parquet(f"{path}/predictions")


def price_regressor_job(data: DataFrame, feature_cols: list[str], path: str) -> DataFrame:
    """Fit on 'train', save the pipeline, score every row with the saved one, save the reports; returns the predictions.

    ``path`` (shared storage) gets ``model``, ``predictions``, ``report`` (per split) and ``key_errors`` (test rows per key).
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    spark, path = data.sparkSession, path.rstrip("/")
    data.write.mode("overwrite").parquet(f"{path}/data")
    data = spark.read.parquet(f"{path}/data")
    model, _ = train_price_regressor(data, feature_cols)
    assemble = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    PipelineModel(stages=[assemble, model]).write().overwrite().save(f"{path}/model")
    pred = score_saved(spark, path, data)
    regression_report(pred).write.mode("overwrite").json(f"{path}/report")
    key_errors(pred).write.mode("overwrite").json(f"{path}/key_errors")
    return pred


def risk_classifier_job(data: DataFrame, feature_cols: list[str], path: str, label: str = "band") -> DataFrame:
    """Fit on 'train', save the pipeline, score every row with the saved one, save the reports; returns the predictions.

    ``path`` (shared storage) gets ``model``, ``predictions``, ``report`` (per class, test rows) and ``checks`` (``fit_checks``).
    A missing feature counts 0; labels are indexed over all rows.
    """
    spark, path = data.sparkSession, path.rstrip("/")
    data.na.fill(0.0, subset=feature_cols).write.mode("overwrite").parquet(f"{path}/data")
    data = spark.read.parquet(f"{path}/data")
    model, _ = fit_risk_classifier(data, feature_cols, label)
    model.write().overwrite().save(f"{path}/model")
    pred = score_saved(spark, path, data)
    classification_report(pred.filter(F.col("split") == "test"), label, "predicted").write.mode("overwrite").json(f"{path}/report")
    fit_checks(pred, label).write.mode("overwrite").json(f"{path}/checks")
    return pred


def save_model_and_report(model, report: DataFrame, path: str) -> None:
    """Persist a fitted model and its metrics report (JSON lines) under ``path``.

    ``path`` should be on shared storage (for example under the session's
    ``spark.checkpoint.dir``); both writes are distributed Spark writes.
    """
    model.write().overwrite().save(f"{path.rstrip('/')}/model")
    report.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/report")
