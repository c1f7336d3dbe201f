"""Forecast evaluation: error metrics, fit flags and anomalies.

Per-key metrics are conditional aggregates in one ``groupBy(key)``; pooled
metrics and thresholds (90th percentile, global std) are one-row scalar
subqueries, never an un-partitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidal.operators.order_stats import exact_quantile

SPLIT_NAMES = ("train", "val", "test")


def _err(actual: str, forecast: str) -> Column:
    a, f = F.col(actual), F.col(forecast)
    return F.when(a.isNotNull() & f.isNotNull(), a - f)


def mae(err: Column) -> Column:
    return F.avg(F.abs(err))


def rmse(err: Column) -> Column:
    return F.sqrt(F.avg(err * err))


def eval_by_split(df: DataFrame, split: str = "split", key: str = "key", actual: str = "actual",
                  forecast: str = "forecast", splits=SPLIT_NAMES) -> DataFrame:
    """Per key: MAE and RMSE of every split over rows with an actual; NULL if none."""
    err = _err(actual, forecast)
    aggs = []
    for s in splits:
        e = F.when(F.col(split) == s, err)
        aggs += [mae(e).alias(f"{s}_mae"), rmse(e).alias(f"{s}_rmse")]
    return df.groupBy(key).agg(*aggs)


def eval_overall(df: DataFrame, split: str = "split", actual: str = "actual",
                 forecast: str = "forecast") -> DataFrame:
    """Metrics pooled over all keys, per split."""
    err = _err(actual, forecast)
    return (df.filter(F.col(split).isNotNull()).groupBy(split)
            .agg(mae(err).alias("mae"), rmse(err).alias("rmse"),
                 F.count(err).alias("n")))


def overfit_flags(metrics: DataFrame, train: str = "train_mae", val: str = "val_mae") -> DataFrame:
    """Keys whose validation error is more than twice their train error."""
    return metrics.filter(F.col(train).isNotNull() & F.col(val).isNotNull()
                          & (F.col(train) * 2 < F.col(val)))


def underfit_flags(metrics: DataFrame, train: str = "train_mae", val: str = "val_mae",
                   q: float = 0.9) -> DataFrame:
    """Keys whose train error exceeds the q-quantile (exact, interpolated) of val errors."""
    thr = exact_quantile(metrics, val, q).scalar()
    return metrics.filter(F.col(train).isNotNull() & (F.col(train) > thr))


def forecast_anomalies(pred: DataFrame, eval_from: int, key: str = "key", period: str = "period",
                       actual: str = "actual", forecast: str = "forecast",
                       k: float = 2.0) -> DataFrame:
    """Rows at ``period >= eval_from`` whose forecast is more than ``k`` std from the last actual.

    last actual = the actual of period - 1 if that row exists, else the row's
    own actual; if NULL, the key's last known actual; rows still without one
    are skipped.  std = population std of the key's actuals; a key with one
    row or zero std uses the global std, and a zero global std uses 1.
    """
    w = Window.partitionBy(key).orderBy(period)
    prev_is_adjacent = F.lag(period).over(w) == F.col(period) - 1
    by_key = Window.partitionBy(key)
    gsd = F.col("_gsd")
    g = F.when(gsd == 0, F.lit(1.0)).otherwise(gsd)
    sd = F.when((F.col("_n") <= 1) | (F.col("_sd") == 0), g).otherwise(F.col("_sd"))
    rows = (pred.select(
        "*", F.when(prev_is_adjacent, F.lag(actual).over(w)).alias("_prev"),
        F.coalesce(prev_is_adjacent, F.lit(False)).alias("_has_prev"),
        F.stddev_pop(actual).over(by_key).alias("_sd"), F.count(F.lit(1)).over(by_key).alias("_n"),
        F.max_by(F.col(actual), F.when(F.col(actual).isNotNull(), F.col(period))).over(by_key).alias("_known"))
            .filter(F.col(period) >= eval_from))
    last = F.coalesce(F.when(F.col("_has_prev"), F.col("_prev")).otherwise(F.col(actual)),
                      F.col("_known"))
    out = (rows.withColumn("_gsd", pred.agg(F.stddev_pop(actual)).scalar())
           .withColumn("last_actual", last)
           .withColumn("_thr", sd * k))
    return (out.filter(F.col("last_actual").isNotNull()
                       & (F.abs(F.col(forecast) - F.col("last_actual")) > F.col("_thr")))
            .select(key, period, forecast, "last_actual",
                    (F.col(forecast) - F.col("last_actual")).alias("deviation")))


def eval_rollup(df: DataFrame, split: str = "split", key: str = "key", actual: str = "actual",
                forecast: str = "forecast") -> DataFrame:
    """Per (split, key) and pooled per split metrics in one aggregation (GROUPING SETS).

    ``level`` is 'key' for per-key rows and 'pooled' for the per-split rows
    (whose ``key`` is NULL).  Partial aggregates are combined map-side, so
    the pooled rows cost no second pass over the data.
    """
    err = _err(actual, forecast)
    out = (df.filter(F.col(split).isNotNull()).rollup(split, key)
           .agg(mae(err).alias("mae"), rmse(err).alias("rmse"), F.count(err).alias("n"),
                F.grouping(key).alias("_gk"), F.grouping(split).alias("_gs")))
    out = out.filter(F.col("_gs") == 0)
    return out.select(split, key, F.when(F.col("_gk") == 1, "pooled").otherwise("key").alias("level"),
                      "mae", "rmse", "n")
