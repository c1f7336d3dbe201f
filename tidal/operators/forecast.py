"""Forecasting and model selection on keyed series.

Closed-form forecasters (naive, drift, linear extrapolation) are column
expressions plus ``explode(sequence(...))`` for the horizon.  Order-selected
ARIMA has no closed form: ``fit_candidates`` gathers each key's series into one
row (bounded by the length of the period axis, not by the data volume, even when
a key owns a third of the raw rows) and fits the keys of an Arrow batch side by side.
Selection among candidates (window, order) is plain DataFrame aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidal.functions.scalar import finite_or_null
from tidal.operators import arima
from tidal.operators.order_stats import exact_quantile
from tidal.session import ship_package

# Fixed values of the model search: the candidate orders (p, d, q) in order of
# simplicity, the capped training window and the tie tolerance on val MAE.
ORDERS = ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 2), (2, 1, 1))
TRAIN_CAP = 18
TIE_TOL = 0.12


def _nan_true(cond: Column) -> Column:
    """Python comparison semantics for NaN/NULL operands (``nan != 0`` is True)."""
    return F.coalesce(cond, F.lit(True))


def linear_forecast(features: DataFrame, horizon_from: int, horizon_to: int, last_period: int,
                    span: int, beta: float = 0.5, key: str = "key") -> DataFrame:
    """Linear extrapolation of the relative index and price index.

    ``features``: key, ofr, price (finite or NULL; NULL filled by the median
    over keys), c_first, c_last (first / last observation of the series).
    slope = (c_last - c_first) / span with c_first NULL -> 0 and c_last NULL
    -> ofr; OFR slope = ofr * slope / c_last unless either is 0;
    ofr_t = max(0, ofr + slope_ofr * h); price_t = max(0, P (1 + beta (ofr_t - ofr) / ofr)).
    """
    med = exact_quantile(features.select(finite_or_null(F.col("price")).alias("price")), "price", 0.5).scalar()
    f = features
    price = F.coalesce(finite_or_null(F.col("price")), med)
    ofr = F.col("ofr")
    c1 = F.coalesce(F.col("c_first"), F.lit(0.0))
    c2 = F.coalesce(F.col("c_last"), ofr)
    slope = (c2 - c1) / span
    ofr_slope = F.when(_nan_true(c2 != 0) & _nan_true(ofr != 0),
                       ofr * F.try_divide(slope, c2)).otherwise(slope)
    f = f.select(key, ofr.alias("ofr"), price.alias("price0"), ofr_slope.alias("ofr_slope"),
                 F.explode(F.sequence(F.lit(horizon_from), F.lit(horizon_to))).alias("period"))
    ofr_fc = F.greatest(F.lit(0.0), F.col("ofr") + F.col("ofr_slope") * (F.col("period") - last_period))
    f = f.withColumn("ofr_forecast", ofr_fc)
    px = F.when(_nan_true(F.col("ofr") != 0),
                F.col("price0") * (1 + beta * F.try_divide(F.col("ofr_forecast") - F.col("ofr"), F.col("ofr"))))
    px = px.otherwise(F.col("price0"))
    return f.select(key, "period", "ofr_forecast",
                    F.greatest(F.lit(0.0), px).alias("price_forecast"), "ofr", "price0")


def extend_linear(features: DataFrame, horizon_from: int, horizon_to: int, last_period: int,
                  span: int, beta: float = 0.5, key: str = "key") -> DataFrame:
    """Extrapolated value per future period plus the key's replaced feature row.

    value_t = max(0, c_last + slope * (t - last)) with both ends NULL -> 0;
    ofr / price become the final-horizon forecasts; ofr_change is the
    *fraction* vs the old ofr (0 when that is NULL or 0).
    """
    fc = linear_forecast(features, horizon_from, horizon_to, last_period, span, beta, key)
    final = fc.filter(F.col("period") == horizon_to).select(
        key, F.col("ofr_forecast").alias("ofr_new"), F.col("price_forecast").alias("price_new"))
    c1 = F.coalesce(F.col("c_first"), F.lit(0.0))
    c2 = F.coalesce(F.col("c_last"), F.lit(0.0))
    slope = (c2 - c1) / span
    ext = features.select(key, "ofr", "price", c2.alias("_c2"), slope.alias("_slope"),
                          F.explode(F.sequence(F.lit(horizon_from), F.lit(horizon_to))).alias("period"))
    ext = ext.withColumn("value_ext", F.greatest(F.lit(0.0), F.col("_c2") + F.col("_slope")
                                                  * (F.col("period") - last_period)))
    out = ext.join(final, key, "left")
    ofr_new = F.coalesce(F.col("ofr_new"), F.col("ofr"))
    chg = F.when(F.col("ofr").isNull() | (F.col("ofr") == 0), F.lit(0.0)).otherwise(
        F.try_divide(ofr_new - F.col("ofr"), F.col("ofr")))
    return out.select(key, "period", "value_ext", ofr_new.alias("ofr_ext"),
                      F.coalesce(F.col("price_new"), F.col("price")).alias("price_ext"),
                      chg.alias("ofr_change_frac"))


def extend_drift(history: DataFrame, window: int, steps: int, key: str = "key",
                 period: str = "period", value: str = "value") -> DataFrame:
    """History plus a random-walk-with-drift forecast of ``steps`` periods per key.

    The drift is fitted on each key's last ``window`` periods:
    y_{T+h} = y_T + h * (y_T - y_{T-window+1}) / (window - 1).  The future
    rows are generated from each key's last row with ``explode`` inside its
    own partition, so history and forecast stay partitioned by key (no
    union, no extra exchange before the per-key windows that follow).
    """
    by_key = Window.partitionBy(key)
    t_last = F.max(period).over(by_key)
    in_win = F.col(period) >= t_last - (window - 1)
    h = history.select(
        "*", (F.col(period) == t_last).alias("_is_last"),
        F.max_by(F.col(value), F.col(period)).over(by_key).alias("_y_last"),
        F.min_by(F.col(value), F.when(in_win, F.col(period))).over(by_key).alias("_y_first"))
    steps_col = F.when(F.col("_is_last"), F.sequence(F.lit(0), F.lit(steps))).otherwise(F.array(F.lit(0)))
    h = h.select("*", F.explode(steps_col).alias("_h"))
    drift = F.col("_y_last") + F.col("_h") * (F.col("_y_last") - F.col("_y_first")) / (window - 1)
    cols = [c for c in history.columns if c not in (period, value)]
    return h.select(*cols, (F.col(period) + F.col("_h")).alias(period),
                    F.when(F.col("_h") == 0, F.col(value)).otherwise(drift).alias(value))


# ---------------------------------------------------------------- selection

def choose_window(cands: DataFrame, key: str = "key", tol: float = TIE_TOL) -> DataFrame:
    """Per key: 'capped' if its best val MAE <= best 'full' MAE * (1 + tol), else 'full'."""
    best = cands.groupBy(key).agg(
        F.min(F.when(F.col("train_window") == "full", F.col("val_mae"))).alias("_full"),
        F.min(F.when(F.col("train_window") == "capped", F.col("val_mae"))).alias("_capped"))
    full = F.coalesce(F.col("_full"), F.lit(float("inf")))
    capped = F.coalesce(F.col("_capped"), F.lit(float("inf")))
    pick = F.when(capped <= full * (1 + tol), "capped").otherwise("full")
    return best.select(key, pick.alias("train_window"))


def choose_order(cands: DataFrame, rule: str = "simple", key: str = "key",
                 tol: float = TIE_TOL) -> DataFrame:
    """One candidate per key (and window, if present) by validation MAE.

    ``simple``: among candidates within ``tol`` of the best MAE, the lowest
    (p + q, MAE, list position).  ``best``: strict minimum MAE, first in the
    list on ties.
    """
    part = [key] + (["train_window"] if "train_window" in cands.columns else [])
    w = Window.partitionBy(*part)
    c = cands.filter(F.col("val_mae").isNotNull())
    if rule == "simple":
        c = c.withColumn("_best", F.min("val_mae").over(w))
        c = c.filter(F.col("val_mae") <= F.col("_best") * (1 + tol))
        order = [F.col("complexity"), F.col("val_mae"), F.col("order_idx")]
    elif rule == "best":
        order = [F.col("val_mae"), F.col("order_idx")]
    else:
        raise ValueError(f"unknown rule {rule!r}")
    rn = F.row_number().over(w.orderBy(*order))
    return c.withColumn("_rn", rn).filter(F.col("_rn") == 1).drop("_rn", "_best")


# ---------------------------------------------------------------- ARIMA (maximum likelihood)

def arima_fit_forecast(y: np.ndarray, p: int, d: int, q: int, steps: int):
    """(fitted, forecast) of one series by exact maximum likelihood, or None; see ``arima.fit``."""
    return arima.fit([np.asarray(y, dtype=float)], p, d, q, steps)[0]


#: Series that are fitted side by side: the last steps of the search, in which few series are left, cost one batch little.
SIDE_BY_SIDE = 2048


def _whole_series(rows: DataFrame, key: str, period: str, value: str, *more: str) -> DataFrame:
    """One row per key: its periods and values in order (a key has one row per period, so this is bounded)."""
    each = F.sort_array(F.collect_list(F.struct(period, value)))
    return (rows.groupBy(key, *more).agg(each.alias("_s"))
            .select(key, *more, F.col(f"_s.{period}").alias("periods"), F.col(f"_s.{value}").alias("values")))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as float arrays; null items become NaN."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else []


def naive_fallback(grid: DataFrame, fitted_keys: DataFrame, train_to: int, key: str = "key", period: str = "period",
                   value: str = "value") -> DataFrame:
    """Rows ``key, period, kind, forecast`` for the keys without any fitted candidate.

    Train rows forecast themselves (there is no in-sample fit); later ones get
    the last known train value, 0 where there is none.
    """
    rest = grid.join(fitted_keys.select(key).distinct(), key, "left_anti")
    in_train = F.col(period) <= train_to
    last = F.max_by(F.col(value), F.when(in_train & F.col(value).isNotNull(), F.col(period))).over(Window.partitionBy(key))
    return rest.select(key, period, F.when(in_train, "fit").otherwise("fc").alias("kind"),
                       F.when(in_train, F.col(value)).otherwise(F.coalesce(last, F.lit(0.0))).alias("forecast"))


def forecast_chosen(history: DataFrame, chosen: DataFrame, steps: int, cap: int = TRAIN_CAP, key: str = "key",
                    period: str = "period", value: str = "value") -> DataFrame:
    """``key, period, forecast``: ``steps`` periods after each key's last one, by its chosen order.

    ``chosen``: key, p, d, q.  The order is fitted again on the last ``cap``
    periods of the whole history; a key without a chosen order takes (0, 1, 0),
    one whose fit fails repeats its last value (0 where it has none).
    """
    kind = dict(history.dtypes)[key]
    schema = f"{key} {kind}, {period} int, forecast double"
    order = F.coalesce(F.when(F.col("p").isNotNull(), F.array("p", "d", "q")), F.array(*map(F.lit, (0, 1, 0))))
    rows = (_whole_series(history.select(key, period, value), key, period, value)
            .join(chosen.select(key, "p", "d", "q"), key, "left")
            .select(key, "periods", "values", order.cast("array<int>").alias("order")))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SIDE_BY_SIDE):
                part = whole.slice(at, SIDE_BY_SIDE)
                series = [y[-cap:] for y in _arrays(part.column(2))]
                orders = [tuple(o) for o in part.column(3).to_pylist()]
                ahead = np.zeros((len(series), steps))
                for o in set(orders):
                    own = [i for i, x in enumerate(orders) if x == o]
                    for i, got in zip(own, arima.fit([series[i] for i in own], *o, steps)):
                        known = series[i][np.isfinite(series[i])]
                        ahead[i] = got[1] if got else (known[-1] if len(known) else 0.0)
                last = np.array([p[-1] for p in _arrays(part.column(1))])
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(series)), steps)))
                ends = (last[:, None] + 1 + np.arange(steps)).astype(np.int32).ravel()
                yield pa.RecordBatch.from_arrays([keys, pa.array(ends), pa.array(ahead.ravel())],
                                                 names=[key, period, "forecast"])

    ship_package(history.sparkSession)
    return rows.mapInArrow(run, schema)


CANDIDATE_SCHEMA = ("key string, train_window string, order_idx int, p int, q int, "
                    "period int, kind string, forecast double")


def fit_candidates(train: DataFrame, first_future: int, steps: int, cap: int = TRAIN_CAP,
                   orders=ORDERS, key: str = "key", period: str = "period",
                   value: str = "value") -> DataFrame:
    """Every (window, order) candidate per key: in-sample fits and ``steps`` forecasts.

    ``train`` holds each key's (imputed, gap-free) training series.  Output
    rows: kind 'fit' for in-sample fitted values, 'fc' for forecasts at
    periods first_future .. first_future + steps - 1.  Failed fits (too few
    points, non-finite output) yield no rows; ``naive_fallback`` serves such keys.
    """
    orders = tuple(orders)
    names = ["key", "train_window", "order_idx", "p", "q", "period", "kind", "forecast"]

    def candidates(keys, periods, found, last, window, idx, p, q) -> pa.RecordBatch:
        """The rows of one candidate of some keys: fitted values, then forecasts."""
        own = [keys[i] for i, _ in found]
        n_fit = [len(fitted) for _, (fitted, _) in found]
        rows = sum(n_fit) + steps * len(found)
        future = first_future + np.arange(steps)
        at = np.concatenate([x for i, _ in found for x in (periods[i][-last:], future)]).astype(np.int32)
        forecast = np.concatenate([x for _, got in found for x in got])
        kind = [k for n in n_fit for k in ["fit"] * n + ["fc"] * steps]
        same = [pa.array([x] * rows, t) for x, t in ((window, pa.string()), *((x, pa.int32()) for x in (idx, p, q)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(own, pa.string()).take(pa.array(np.repeat(np.arange(len(own)), np.array(n_fit) + steps))), *same,
             pa.array(at), pa.array(kind), pa.array(forecast, from_pandas=True)], names=names)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SIDE_BY_SIDE):
                part = whole.slice(at, SIDE_BY_SIDE)
                keys = part.column(0).cast(pa.string()).to_pylist()
                periods, values = _arrays(part.column(1)), _arrays(part.column(2))
                long = [i for i, y in enumerate(values) if len(y) > cap]
                for name, rows, last in (("full", range(len(keys)), 0), ("capped", long, cap)):
                    series = [values[i][-last:] for i in rows]
                    for idx, (p, d, q) in enumerate(orders):
                        found = [(i, got) for i, got in zip(rows, arima.fit(series, p, d, q, steps)) if got]
                        if found:
                            yield candidates(keys, periods, found, last, name, idx, p, q)

    ship_package(train.sparkSession)
    return _whole_series(train.select(key, period, value), key, period, value).mapInArrow(run, CANDIDATE_SCHEMA)
