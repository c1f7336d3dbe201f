"""Evaluation queries over the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidal.operators import evaluate, series
from tidal.plans import sql
from tidal.plans.registry import register, rounded
from tidal.session import materialize
from tidal.plans.views import FUTURE, TEST, TRAIN, VAL, predictions, shared_predictions

# Evaluation splits: the test split runs through the future periods (rows
# without an actual simply do not count), as in the reference evaluation.
EVAL_BOUNDS = (("train", TRAIN[0], TRAIN[1]), ("val", VAL[0], VAL[1]), ("test", TEST[0], FUTURE[1]))


def eval_split(period):
    c = None
    for name, lo, hi in EVAL_BOUNDS:
        c = (F.when(period.between(lo, hi), name) if c is None
             else c.when(period.between(lo, hi), name))
    return c


def tagged(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("split", eval_split(F.col("period")))


SQL_TAGGED = f"""WITH {sql.PREDICTIONS},
tagged AS (SELECT *, CASE WHEN period BETWEEN {TRAIN[0]} AND {TRAIN[1]} THEN 'train'
                          WHEN period BETWEEN {VAL[0]} AND {VAL[1]} THEN 'val'
                          WHEN period BETWEEN {TEST[0]} AND {FUTURE[1]} THEN 'test' END AS split,
                  CASE WHEN actual IS NOT NULL AND forecast IS NOT NULL THEN actual - forecast END AS err
           FROM predictions)"""


def _sql_metric_cols() -> str:
    cols = []
    for s in ("train", "val", "test"):
        cols.append(f"round(avg(abs(CASE WHEN split = '{s}' THEN err END)), 6) + 0.0 AS {s}_mae")
        cols.append(f"round(sqrt(avg(CASE WHEN split = '{s}' THEN err * err END)), 6) + 0.0 AS {s}_rmse")
    return ", ".join(cols)


SQL_METRICS = SQL_TAGGED + f""",
metrics AS (SELECT key, {_sql_metric_cols()} FROM tagged GROUP BY key)"""


def metrics(spark, sf_dir):
    return rounded(evaluate.eval_by_split(tagged(spark, sf_dir)))


@register("eval_by_key", SQL_METRICS + " SELECT * FROM metrics")
def q_eval_by_key(spark, sf_dir):
    """Train / val / test MAE and RMSE per key in one aggregation."""
    return metrics(spark, sf_dir)


@register("eval_overall", SQL_TAGGED + """
SELECT split, round(avg(abs(err)), 6) + 0.0 AS mae, round(sqrt(avg(err * err)), 6) + 0.0 AS rmse,
       count(err) AS n
FROM tagged WHERE split IS NOT NULL GROUP BY split""")
def q_eval_overall(spark, sf_dir):
    """Metrics pooled over keys per split."""
    return rounded(evaluate.eval_overall(tagged(spark, sf_dir)))


@register("eval_rollup", SQL_TAGGED + """
SELECT split, key, CASE WHEN grouping(key) = 1 THEN 'pooled' ELSE 'key' END AS level,
       round(avg(abs(err)), 6) + 0.0 AS mae, round(sqrt(avg(err * err)), 6) + 0.0 AS rmse, count(err) AS n
FROM tagged WHERE split IS NOT NULL GROUP BY GROUPING SETS ((split, key), (split))""")
def q_eval_rollup(spark, sf_dir):
    """Per-key and pooled metrics per split in one aggregation pass."""
    return rounded(evaluate.eval_rollup(tagged(spark, sf_dir)))


@register("overfit_keys", SQL_METRICS + """
SELECT key, train_mae, val_mae FROM metrics
WHERE train_mae IS NOT NULL AND val_mae IS NOT NULL AND train_mae * 2 < val_mae""")
def q_overfit_keys(spark, sf_dir):
    return evaluate.overfit_flags(metrics(spark, sf_dir)).select("key", "train_mae", "val_mae")


@register("underfit_keys", SQL_METRICS + """
SELECT key, train_mae, val_mae FROM metrics
WHERE train_mae IS NOT NULL AND train_mae > (SELECT quantile_cont(val_mae, 0.9) FROM metrics)""")
def q_underfit_keys(spark, sf_dir):
    """Train MAE above the 90th percentile of val MAE (the per-key table is written once)."""
    m = materialize(metrics(spark, sf_dir), "eval_metrics")
    return evaluate.underfit_flags(m).select("key", "train_mae", "val_mae")


@register("forecast_anomalies", f"""WITH {sql.PREDICTIONS},
stats AS (SELECT key, stddev_pop(actual) AS sd, count(*) AS n,
                 arg_max(actual, period) FILTER (WHERE actual IS NOT NULL) AS known
          FROM predictions GROUP BY key),
gstats AS (SELECT CASE WHEN stddev_pop(actual) = 0 THEN 1.0 ELSE stddev_pop(actual) END AS gsd FROM predictions),
rows_ AS (
  SELECT p.key, p.period, p.forecast,
         coalesce(CASE WHEN q.key IS NOT NULL THEN q.actual ELSE p.actual END, s.known) AS last_actual,
         2 * CASE WHEN s.n <= 1 OR s.sd = 0 THEN g.gsd ELSE s.sd END AS thr
  FROM predictions p
  LEFT JOIN predictions q ON q.key = p.key AND q.period = p.period - 1
  JOIN stats s ON s.key = p.key CROSS JOIN gstats g
  WHERE p.period >= {TEST[0]})
SELECT key, period, forecast, round(last_actual, 6) + 0.0 AS last_actual,
       round(forecast - last_actual, 6) + 0.0 AS deviation
FROM rows_ WHERE last_actual IS NOT NULL AND abs(forecast - last_actual) > thr""")
def q_forecast_anomalies(spark, sf_dir):
    """|forecast - last actual| > 2 std over the test and future periods."""
    return rounded(evaluate.forecast_anomalies(shared_predictions(spark, sf_dir), TEST[0]))


@register("last_known", f"""WITH {sql.PREDICTIONS}
SELECT key, arg_max(actual, period) AS last_known FROM predictions WHERE actual IS NOT NULL GROUP BY key""")
def q_last_known(spark, sf_dir):
    """Last non-NULL actual per key (order = period)."""
    return series.last_known(predictions(spark, sf_dir))


@register("per_key_error", f"""WITH {sql.PREDICTIONS}
SELECT key, round(abs(actual - forecast), 6) + 0.0 AS abs_error FROM predictions
WHERE period = {TEST[1]} AND actual IS NOT NULL AND forecast IS NOT NULL""")
def q_per_key_error(spark, sf_dir):
    """|y - yhat| per key at the last test period (one row: MAE = RMSE)."""
    p = predictions(spark, sf_dir).filter((F.col("period") == TEST[1]) & F.col("actual").isNotNull()
                                          & F.col("forecast").isNotNull())
    return rounded(p.select("key", F.abs(F.col("actual") - F.col("forecast")).alias("abs_error")))
