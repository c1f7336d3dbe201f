"""Model training queries (rows-only: forests are not expressible in SQL)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidal.functions import scalar
from tidal.operators import bands, ml, series
from tidal.plans.q_forecast import q_risk_from_horizons
from tidal.plans.q_series import median_filled
from tidal.plans.registry import register
from tidal.plans.views import TEST, TRAIN, VAL, predictions
from tidal.session import checkpoint_dir

# Three positional windows of 10 periods, each labelled by the price index at its end.
WINDOWS = (("train", TRAIN[1] - 9), ("val", VAL[1] - 9), ("test", TEST[1] - 9))


def window_features(spark, sf_dir):
    """Per key and split: 10 median-filled values (f0..f9) and the price index at the window end."""
    filled = median_filled(spark, sf_dir)
    price = series.enrich_predictions(predictions(spark, sf_dir)).select("key", "period", "price_index")
    parts = None
    for name, start in WINDOWS:
        w = filled.filter(F.col("period").between(start, start + 9)).withColumn("offset", F.col("period") - start)
        wide = w.groupBy("key").pivot("offset", list(range(10))).agg(F.first("actual_filled"))
        wide = wide.select("key", *[F.col(str(i)).alias(f"f{i}") for i in range(10)])
        tgt = price.filter(F.col("period") == start + 9).select("key", F.col("price_index").alias("target"))
        d = wide.join(tgt, "key").withColumn("split", F.lit(name))
        parts = d if parts is None else parts.unionByName(d)
    return parts


@register("price_model_eval")
def q_price_model_eval(spark, sf_dir):
    """Random-forest price-index regressor on 10-period windows: MAE / RMSE per split."""
    data = window_features(spark, sf_dir)
    _, pred = ml.train_price_regressor(data, [f"f{i}" for i in range(10)])
    return ml.regression_report(pred)


RISK_FEATURES = [f"{c}_5" for c in ("slope_ofr_change", "slope_inflation_pct", "sum_ofr_change", "sum_inflation_pct")]


def risk_features(spark, sf_dir):
    """Per key: the raw 5-period components, its band and a stratified split."""
    risk = q_risk_from_horizons(spark, sf_dir)
    data = risk.select("key", *RISK_FEATURES, scalar.risk_band(F.col("risk_score_5"), "raw").alias("band"))
    return bands.stratified_split(data, "key", "band")


@register("risk_classifier")
def q_risk_classifier(spark, sf_dir):
    """Random-forest band classifier on the raw 5-period components; accuracy per split."""
    _, pred = ml.train_risk_classifier(risk_features(spark, sf_dir), RISK_FEATURES)
    return ml.accuracy_report(pred)


def _job_folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/models/{name}-{uuid.uuid4().hex}"


@register("price_key_errors")
def q_price_key_errors(spark, sf_dir):
    """Test error per key of the price regressor, saved, loaded again and applied in a second job."""
    pred = ml.price_regressor_job(window_features(spark, sf_dir), [f"f{i}" for i in range(10)], _job_folder(spark, "price"))
    return ml.key_errors(pred)


@register("risk_model_report")
def q_risk_model_report(spark, sf_dir):
    """Class report over the test predictions of the saved risk classifier."""
    pred = ml.risk_classifier_job(risk_features(spark, sf_dir), RISK_FEATURES, _job_folder(spark, "risk"))
    return bands.classification_report(pred.filter("split = 'test'"), "band", "predicted")


@register("risk_model_checks")
def q_risk_model_checks(spark, sf_dir):
    """Accuracy and errors per split of the saved risk classifier, and its train-val gap."""
    return ml.fit_checks(ml.risk_classifier_job(risk_features(spark, sf_dir), RISK_FEATURES, _job_folder(spark, "risk")))
