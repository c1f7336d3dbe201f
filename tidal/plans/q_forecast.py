"""Forecasting queries: closed-form forecasters, horizons, risk path, model selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidal.functions.scalar import finite_or_null
from tidal.operators import evaluate, forecast, reshape, risk, series
from tidal.operators.order_stats import exact_quantile
from tidal.plans import sql
from tidal.plans.registry import register, rounded
from tidal.plans.views import FUTURE, TEST, TRAIN, VAL, predictions, shared_predictions, shared_sums
from tidal.session import materialize

SPAN = f"(SELECT {TEST[1]} - min(period) FROM supplier_month)"
CAP_FROM = TRAIN[1] - forecast.TRAIN_CAP + 1
#: Series whose ARIMA candidates one task fits.
SERIES_PER_TASK = 1000
HORIZONS = {"5": (TEST[1] + 1, TEST[1] + 5), "10": (TEST[1] + 1, TEST[1] + 10)}


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def history(spark, sf_dir, p=None):
    """Observed part of the prediction table (periods up to the last test period)."""
    p = predictions(spark, sf_dir) if p is None else p
    return (p.filter(F.col("period") <= TEST[1])
            .select("key", "period", F.col("actual").alias("value")))


def feature_rows(spark, sf_dir, p=None):
    """Per key: last OFR and price index (feature rules) plus first / last observation."""
    chain = series.feature_chain(history(spark, sf_dir, p))
    last = F.max_by(F.struct("ofr", "price_index", "value"), "period")
    return (chain.groupBy("key").agg(last.alias("s"), F.min_by("value", "period").alias("c_first"))
            .select("key", "s.ofr", F.col("s.price_index").alias("price"),
                    "c_first", F.col("s.value").alias("c_last")))


SQL_FEATURES = f"""WITH {sql.PREDICTIONS},
hist AS (SELECT key, period, actual AS value FROM predictions WHERE period <= {TEST[1]}),
{sql.feature_chain('hist')},
feat AS (SELECT key, arg_max_null(ofr, period) AS ofr, arg_max_null(price_index, period) AS price,
                arg_min_null(value, period) AS c_first, arg_max_null(value, period) AS c_last
         FROM fc GROUP BY key),
featm AS (SELECT *, coalesce(CASE WHEN isfinite(price) THEN price END,
                             (SELECT median(CASE WHEN isfinite(price) THEN price END) FROM feat)) AS price0,
                 coalesce(c_last, ofr) AS c2, coalesce(c_first, 0.0) AS c1 FROM feat),
slopes AS (SELECT *, (c2 - c1) / {SPAN} AS slope FROM featm),
oslope AS (SELECT *, CASE WHEN coalesce(c2 <> 0, true) AND coalesce(ofr <> 0, true)
                          THEN ofr * (slope / c2) ELSE slope END AS ofr_slope FROM slopes),
lin AS (SELECT o.key, CAST(g.t AS INTEGER) AS period, o.ofr, o.price0,
               greatest(0.0, o.ofr + o.ofr_slope * (g.t - {TEST[1]})) AS ofr_forecast
        FROM oslope o CROSS JOIN range({FUTURE[0]}, {FUTURE[1] + 1}) g(t)),
lin2 AS (SELECT *, greatest(0.0, CASE WHEN coalesce(ofr <> 0, true)
                                      THEN price0 * (1 + 0.5 * (ofr_forecast - ofr) / ofr)
                                      ELSE price0 END) AS price_forecast FROM lin)"""


def shared_features(spark, sf_dir):
    """Per-key feature rows written once (the forecast reads them for the median and the rows), and the span.

    The span is the number of periods from the first observation in the data to the last; it and the rows come
    from sums that are written once, so ``lineitem`` is scanned once.
    """
    sums, bounds = shared_sums(spark, sf_dir)
    feats = feature_rows(spark, sf_dir, predictions(spark, sf_dir, bounds, sums))
    return materialize(feats, "feature_rows"), max(1, bounds[1] - bounds[0])


def linear(spark, sf_dir):
    feats, span = shared_features(spark, sf_dir)
    return forecast.linear_forecast(feats, FUTURE[0], FUTURE[1], TEST[1], span)


@register("forecast_linear", SQL_FEATURES + f"""
SELECT key, period, {r6('ofr_forecast', 'ofr_forecast')}, {r6('price_forecast', 'price_forecast')} FROM lin2""")
def q_forecast_linear(spark, sf_dir):
    """Linear extrapolation of the relative index and price index for the future periods."""
    return rounded(linear(spark, sf_dir).select("key", "period", "ofr_forecast", "price_forecast"))


@register("extend_linear", SQL_FEATURES + f""",
fin AS (SELECT key, ofr_forecast AS ofr_new, price_forecast AS price_new FROM lin2 WHERE period = {FUTURE[1]}),
ext AS (SELECT f.key, CAST(g.t AS INTEGER) AS period, f.ofr, f.price,
               greatest(0.0, coalesce(f.c_last, 0.0) + (coalesce(f.c_last, 0.0) - coalesce(f.c_first, 0.0)) / {SPAN}
                             * (g.t - {TEST[1]})) AS value_ext
        FROM feat f CROSS JOIN range({FUTURE[0]}, {FUTURE[1] + 1}) g(t))
SELECT e.key, e.period, {r6('e.value_ext', 'value_ext')}, {r6('coalesce(n.ofr_new, e.ofr)', 'ofr_ext')},
       {r6('coalesce(n.price_new, e.price)', 'price_ext')},
       {r6('CASE WHEN e.ofr IS NULL OR e.ofr = 0 THEN 0.0 ELSE (coalesce(n.ofr_new, e.ofr) - e.ofr) / e.ofr END', 'ofr_change_frac')}
FROM ext e LEFT JOIN fin n ON e.key = n.key""")
def q_extend_linear(spark, sf_dir):
    """Extrapolated values plus the feature row replaced by the final-horizon forecast."""
    feats, span = shared_features(spark, sf_dir)
    return rounded(forecast.extend_linear(feats, FUTURE[0], FUTURE[1], TEST[1], span))


@register("rebased_price", SQL_FEATURES + f""",
base AS (SELECT key, price0 AS p0,
                nullif(coalesce(CASE WHEN isfinite(ofr) THEN ofr END,
                                (SELECT median(CASE WHEN isfinite(ofr) THEN ofr END) FROM feat)), 0) AS ofr0
         FROM featm),
med AS (SELECT period, median(ofr_forecast) AS m FROM lin2 GROUP BY period)
SELECT l.key, l.period,
       {r6('b.p0 * (1 + 0.5 * coalesce((coalesce(l.ofr_forecast, m.m) - b.ofr0) / b.ofr0, 0.0))', 'price_rebased')}
FROM lin2 l JOIN base b ON l.key = b.key JOIN med m ON l.period = m.period""")
def q_rebased_price(spark, sf_dir):
    """P0 * (1 + beta * (OFR_t - OFR0) / OFR0) with median-filled bases; NULL ratio -> 0."""
    feats, span = shared_features(spark, sf_dir)
    lin = forecast.linear_forecast(feats, FUTURE[0], FUTURE[1], TEST[1], span)
    med_ofr = exact_quantile(feats.select(finite_or_null(F.col("ofr")).alias("ofr")), "ofr", 0.5).scalar()
    base = feats.select("key", F.nullif(F.coalesce(finite_or_null(F.col("ofr")), med_ofr), F.lit(0.0))
                        .alias("ofr0"))
    per_med = exact_quantile(lin, "ofr_forecast", 0.5, ("period",), "_m")
    df = (lin.join(base, "key").join(per_med, "period")
          .withColumn("price_rebased", series.rebased_price(
              F.col("price0"), F.col("ofr0"), F.coalesce(F.col("ofr_forecast"), F.col("_m")))))
    return rounded(df.select("key", "period", "price_rebased"))


@register("forecast_naive", f"""WITH {sql.PREDICTIONS}
SELECT key, period, forecast FROM predictions WHERE period >= {VAL[0]}""")
def q_forecast_naive(spark, sf_dir):
    """Last (mean-imputed) train value repeated over val, test and future periods."""
    train = (predictions(spark, sf_dir).filter(F.col("period") <= TRAIN[1])
             .select("key", "period", F.col("actual").alias("value")))
    train = series.impute_series_mean(train)
    last = train.groupBy("key").agg(F.max_by("value", "period").alias("forecast"))
    return last.select("key", F.explode(F.sequence(F.lit(VAL[0]), F.lit(FUTURE[1]))).alias("period"),
                       "forecast")


# ------------------------------------------------------------- horizons / risk

def horizon_chain(spark, sf_dir, p=None):
    """History (mean-imputed) + 10-step drift forecast, then the floored index chain."""
    hist = series.impute_series_mean(history(spark, sf_dir, p))
    return series.index_chain(forecast.extend_drift(hist, forecast.TRAIN_CAP, 10))


SQL_HORIZON = f"""WITH {sql.PREDICTIONS},
hist AS (SELECT key, period, coalesce(actual, avg(actual) OVER (PARTITION BY key)) AS value
         FROM predictions WHERE period <= {TEST[1]}),
ends AS (SELECT key, arg_max(value, period) AS y_last, arg_min(value, period) AS y_first
         FROM hist WHERE period >= {TEST[1] - forecast.TRAIN_CAP + 1} GROUP BY key),
fut AS (SELECT e.key, CAST(g.h + {TEST[1]} AS INTEGER) AS period,
               e.y_last + g.h * (e.y_last - e.y_first) / {forecast.TRAIN_CAP - 1} AS value
        FROM ends e CROSS JOIN range(1, 11) g(h)),
full_ AS (SELECT key, period, value FROM hist UNION ALL SELECT key, period, value FROM fut),
{sql.index_chain('full_')}"""


@register("forecast_horizons", SQL_HORIZON + f"""
SELECT key, period, {r6('ofr_change', 'ofr_change')}, {r6('inflation_pct', 'inflation_pct')}, '5' AS horizon
FROM ix WHERE period BETWEEN {HORIZONS['5'][0]} AND {HORIZONS['5'][1]}
UNION ALL
SELECT key, period, {r6('ofr_change', 'ofr_change')}, {r6('inflation_pct', 'inflation_pct')}, '10' AS horizon
FROM ix WHERE period BETWEEN {HORIZONS['10'][0]} AND {HORIZONS['10'][1]}""")
def q_forecast_horizons(spark, sf_dir):
    """Change and inflation over the next 5 and 10 periods (the 5-step set is inside the 10)."""
    return horizons_from(horizon_rows(spark, sf_dir))


def horizon_rows(spark, sf_dir, p=None):
    """The index chain's rows inside the forecast horizons, written once to the shared folder.

    Both the horizon table and the risk components read only these rows
    (keys x 10 periods); writing them once means the history windows, which
    start from the raw tables, run once per query even when several
    consumers (descriptions, upserts, risk) use them.
    """
    lo = min(a for a, _ in HORIZONS.values())
    hi = max(b for _, b in HORIZONS.values())
    chain = horizon_chain(spark, sf_dir, p).filter(F.col("period").between(lo, hi))
    return materialize(chain.select("key", "period", "ofr_change", "inflation_pct"), "horizon_rows")


def horizons_from(rows):
    return rounded(reshape.tag_ranges(rows, HORIZONS, "horizon"))


def risk_from(rows):
    comps = risk.horizon_risk(rows, HORIZONS)
    scored = risk.risk_score(comps, horizons=tuple(HORIZONS), persist=False)
    return rounded(scored.select("key", *[f"risk_score_{h}" for h in HORIZONS], *_HCOMP))


def risk_and_horizons(spark, sf_dir):
    """(risk table, horizon table) from one written set of horizon rows."""
    rows = horizon_rows(spark, sf_dir)
    return risk_from(rows), horizons_from(rows)


_HCOMP = [f"{c}_{h}" for h in HORIZONS for c in risk.COMPONENTS]


def _sql_horizon_components() -> str:
    aggs = []
    for h, (lo, hi) in HORIZONS.items():
        for c in ("ofr_change", "inflation_pct"):
            y = f"CASE WHEN period BETWEEN {lo} AND {hi} THEN {c} END"
            x = f"CASE WHEN period BETWEEN {lo} AND {hi} THEN period END"
            aggs.append(f"{sql.slope(y, x)} AS slope_{c}_{h}")
        for c in ("ofr_change", "inflation_pct"):
            aggs.append(f"{sql.fsum(f'CASE WHEN period BETWEEN {lo} AND {hi} THEN {c} END')} AS sum_{c}_{h}")
    return f"comp AS (SELECT key, {', '.join(aggs)} FROM ix GROUP BY key)"


def _sql_norm(c: str) -> str:
    return (f"CASE WHEN max({c}) OVER () = min({c}) OVER () OR max({c}) OVER () IS NULL THEN 0.5 "
            f"ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END")


RISK_CTE = SQL_HORIZON + ",\n" + _sql_horizon_components() + f""",
risk AS (SELECT key, {', '.join(
    f"round(round_even(({' + '.join(_sql_norm(f'{c}_{h}') for c in risk.COMPONENTS)}) / 4, 6), 6) + 0.0 AS risk_score_{h}"
    for h in HORIZONS)},
       {', '.join(r6(c, c) for c in _HCOMP)}
FROM comp)"""


@register("risk_from_horizons", RISK_CTE + " SELECT * FROM risk")
def q_risk_from_horizons(spark, sf_dir):
    """History -> drift forecast -> index chain -> per-horizon components -> min-max -> score.

    This is the reference's risk path end to end, one row per supplier.
    """
    return risk_from(horizon_rows(spark, sf_dir))


# ------------------------------------------------------------- model selection

MODELS = (("naive", 0), ("mean", 0), ("drift", 1))


def simple_candidates(spark, sf_dir):
    """Closed-form candidates (naive, mean, drift) on the full and capped train windows.

    val MAE is kept at 1e-9 resolution so that equal models tie exactly and
    the list position decides, whatever order partial sums were added in.
    """
    p = shared_predictions(spark, sf_dir)
    train = series.impute_series_mean(
        p.filter(F.col("period") <= TRAIN[1]).select("key", "period", F.col("actual").alias("value")))
    val = p.filter(F.col("period").between(*VAL) & F.col("actual").isNotNull()).select("key", "period", "actual")

    def stats(df, window):
        return df.groupBy("key").agg(
            F.max_by("value", "period").alias("_last"), F.min_by("value", "period").alias("_first"),
            F.avg("value").alias("_mean"), F.count(F.lit(1)).alias("_n"),
            F.max("period").alias("_t")).withColumn("train_window", F.lit(window))

    st = stats(train, "full").unionByName(stats(train.filter(F.col("period") >= CAP_FROM), "capped"))
    models = F.array(*[F.struct(F.lit(i).alias("order_idx"), F.lit(c).alias("complexity"))
                       for i, (_, c) in enumerate(MODELS)])
    st = st.select("*", F.explode(models).alias("m")).select("*", "m.order_idx", "m.complexity").drop("m")
    j = st.join(val, "key")
    h = F.col("period") - F.col("_t")
    fc = (F.when(F.col("order_idx") == 0, F.col("_last"))
          .when(F.col("order_idx") == 1, F.col("_mean"))
          .otherwise(F.col("_last") + h * (F.col("_last") - F.col("_first")) / (F.col("_n") - 1)))
    return (j.groupBy("key", "train_window", "order_idx", "complexity")
            .agg(F.round(F.avg(F.abs(F.col("actual") - fc)), 9).alias("val_mae")))


SQL_CANDS = f"""WITH {sql.PREDICTIONS},
train AS (SELECT key, period, coalesce(actual, avg(actual) OVER (PARTITION BY key)) AS value
          FROM predictions WHERE period <= {TRAIN[1]}),
st AS (SELECT key, 'full' AS train_window, arg_max(value, period) AS l, arg_min(value, period) AS f,
              avg(value) AS mu, count(*) AS n, max(period) AS t FROM train GROUP BY key
       UNION ALL
       SELECT key, 'capped', arg_max(value, period), arg_min(value, period), avg(value), count(*), max(period)
       FROM train WHERE period >= {CAP_FROM} GROUP BY key),
models AS (SELECT * FROM (VALUES {', '.join(f'({i}, {c})' for i, (_, c) in enumerate(MODELS))}) v(order_idx, complexity)),
val AS (SELECT key, period, actual FROM predictions WHERE period BETWEEN {VAL[0]} AND {VAL[1]} AND actual IS NOT NULL),
cands AS (
  SELECT s.key, s.train_window, m.order_idx, m.complexity,
         round(avg(abs(v.actual - CASE m.order_idx WHEN 0 THEN s.l WHEN 1 THEN s.mu
                                   ELSE s.l + (v.period - s.t) * (s.l - s.f) / (s.n - 1) END)), 9) AS val_mae
  FROM st s CROSS JOIN models m JOIN val v ON v.key = s.key
  GROUP BY 1, 2, 3, 4),
best AS (SELECT key, min(CASE WHEN train_window = 'full' THEN val_mae END) AS bf,
                min(CASE WHEN train_window = 'capped' THEN val_mae END) AS bc FROM cands GROUP BY key),
chosen AS (SELECT key, CASE WHEN coalesce(bc, 'inf'::DOUBLE) <= coalesce(bf, 'inf'::DOUBLE) * 1.12
                            THEN 'capped' ELSE 'full' END AS train_window FROM best)"""


@register("choose_window", SQL_CANDS + " SELECT key, train_window FROM chosen")
def q_choose_window(spark, sf_dir):
    """Capped training window if its best val MAE is within 12 % of the full window's."""
    return forecast.choose_window(simple_candidates(spark, sf_dir))


@register("choose_order", SQL_CANDS + """,
within AS (SELECT c.* FROM cands c JOIN chosen w ON c.key = w.key AND c.train_window = w.train_window),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY complexity, val_mae, order_idx) AS rn
           FROM within w2
           WHERE val_mae <= (SELECT min(val_mae) FROM within x WHERE x.key = w2.key) * 1.12)
SELECT key, train_window, order_idx, round(val_mae, 6) + 0.0 AS val_mae FROM ranked WHERE rn = 1""")
def q_choose_order(spark, sf_dir):
    """Within the chosen window: simplest candidate within 12 % of the best val MAE."""
    cands = simple_candidates(spark, sf_dir)
    chosen = cands.join(forecast.choose_window(cands), ["key", "train_window"])
    pick = forecast.choose_order(chosen, "simple")
    return rounded(pick.select("key", "train_window", "order_idx", "val_mae"))


@register("choose_order_best", SQL_CANDS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY key, train_window ORDER BY val_mae, order_idx) AS rn FROM cands)
SELECT key, train_window, order_idx, round(val_mae, 6) + 0.0 AS val_mae FROM ranked WHERE rn = 1""")
def q_choose_order_best(spark, sf_dir):
    """Strict-minimum rule per (key, window); earlier candidates win ties."""
    pick = forecast.choose_order(simple_candidates(spark, sf_dir), "best")
    return rounded(pick.select("key", "train_window", "order_idx", "val_mae"))


# ------------------------------------------------------------- ARIMA (rows-only)

def arima_candidate_table(spark, sf_dir, p=None):
    """ARIMA fits and forecasts of every candidate, written once to the shared checkpoint folder.

    The Python fits are the expensive step and both the selection and the
    final metrics read them, so they are computed once and kept on shared
    storage (safe against executor loss) rather than recomputed per branch.
    """
    p = shared_predictions(spark, sf_dir) if p is None else p
    # Key partitioning with an explicit count: AQE does not merge it (the
    # input is small in bytes but the fits are CPU-heavy), and both the
    # imputation window and the grouped map reuse it without another exchange.
    # A task gets many series, because the array steps of a search cost few of them nearly as much.
    keys = p.select("key").distinct().count()
    n = max(-(-keys // SERIES_PER_TASK), spark.sparkContext.defaultParallelism)
    raw = (p.filter(F.col("period") <= TRAIN[1])
           .select("key", "period", F.col("actual").alias("value")).repartition(n, "key"))
    train = series.impute_series_mean(raw)
    steps = TEST[1] - VAL[0] + 1
    return materialize(forecast.fit_candidates(train, VAL[0], steps), "arima_candidates")


def candidate_maes(cands, p):
    fc = cands.filter(F.col("kind") == "fc")
    val = p.filter(F.col("period").between(*VAL) & F.col("actual").isNotNull())
    j = fc.join(val.select("key", "period", "actual"), ["key", "period"])
    return (j.groupBy("key", "train_window", "order_idx", "p", "q")
            .agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("val_mae"))
            .withColumn("complexity", F.col("p") + F.col("q")))


@register("arima_candidates")
def q_arima_candidates(spark, sf_dir):
    """Validation MAE of every (window, order) ARIMA candidate per key."""
    p = shared_predictions(spark, sf_dir)
    return candidate_maes(arima_candidate_table(spark, sf_dir, p), p)


@register("arima_naive_candidates", f"""WITH {sql.PREDICTIONS},
n AS (SELECT key, count(*) AS n FROM predictions WHERE period <= {TRAIN[1]} GROUP BY key HAVING count(actual) > 0)
SELECT n.key, w.train_window, round(avg(abs(p.actual - p.forecast)), 6) + 0.0 AS val_mae
FROM n JOIN predictions p ON p.key = n.key JOIN (VALUES ('full', 5), ('capped', {forecast.TRAIN_CAP + 1})) w(train_window, least_n)
  ON n.n >= w.least_n
WHERE p.period BETWEEN {VAL[0]} AND {VAL[1]} AND p.actual IS NOT NULL GROUP BY 1, 2""")
def q_arima_naive_candidates(spark, sf_dir):
    """The (0, 1, 0) candidates, whose fit is exact: the last train value, in both windows."""
    p = shared_predictions(spark, sf_dir)
    maes = candidate_maes(arima_candidate_table(spark, sf_dir, p), p)
    return rounded(maes.filter("order_idx = 0").select("key", "train_window", "val_mae"))


def backtest_rows(spark, sf_dir):
    """key, period, split, actual, forecast: the chosen candidate's rows, naive ones for keys without a fit."""
    p = shared_predictions(spark, sf_dir)
    cands = arima_candidate_table(spark, sf_dir, p)
    maes = candidate_maes(cands, p)
    chosen = forecast.choose_order(maes.join(forecast.choose_window(maes), ["key", "train_window"]), "simple")
    chosen = materialize(chosen.select("key", "train_window", "order_idx"), "chosen_orders")
    fitted = cands.join(chosen, ["key", "train_window", "order_idx"]).select("key", "period", "kind", "forecast")
    grid = p.filter(F.col("period") <= TEST[1]).select("key", "period", F.col("actual").alias("value"))
    train_mean = F.avg(F.when(F.col("period") <= TRAIN[1], F.col("value"))).over(Window.partitionBy("key"))
    grid = grid.withColumn("value", F.coalesce("value", F.when(F.col("period") <= TRAIN[1], train_mean)))
    rows = fitted.unionByName(forecast.naive_fallback(grid, chosen, TRAIN[1]))
    split = F.when(F.col("kind") == "fit", "train").when(F.col("period") <= VAL[1], "val").otherwise("test")
    return rows.join(p.select("key", "period", "actual"), ["key", "period"]).select(
        "key", "period", split.alias("split"), "actual", "forecast")


@register("backtest")
def q_backtest(spark, sf_dir):
    """Window choice -> order choice -> val / test metrics (rounded to 4) of every key."""
    m = evaluate.eval_by_split(backtest_rows(spark, sf_dir))
    return m.select("key", *[F.round(c, 4).alias(c) for c in m.columns if c != "key"])


@register("backtest_predictions")
def q_backtest_predictions(spark, sf_dir):
    """Train, val and test rows with actual and forecast, the input of enrichment and evaluation."""
    return rounded(backtest_rows(spark, sf_dir))


def arima_future(spark, sf_dir, p, hist):
    """The next 10 periods of every key by the order of least val MAE, fitted again on the last 18 of ``hist``."""
    maes = candidate_maes(arima_candidate_table(spark, sf_dir, p), p)
    best = forecast.choose_order(maes.join(forecast.choose_window(maes), ["key", "train_window"]), "best")
    order = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(o, "pdq")]) for o in forecast.ORDERS])
    chosen = best.select("key", F.element_at(order, F.col("order_idx") + 1).alias("o")).select("key", "o.*")
    return forecast.forecast_chosen(hist, chosen, max(b for _, b in HORIZONS.values()) - TEST[1])


@register("arima_horizons")
def q_arima_horizons(spark, sf_dir):
    """The next 10 periods by the order of least val MAE, fitted again on the last 18 of all history."""
    p = shared_predictions(spark, sf_dir)
    return rounded(arima_future(spark, sf_dir, p, series.impute_series_mean(history(spark, sf_dir, p))))


@register("risk_from_arima")
def q_risk_from_arima(spark, sf_dir):
    """The risk path on the chosen models: history ++ ARIMA forecasts -> index chain -> components -> score."""
    p = shared_predictions(spark, sf_dir)
    hist = series.impute_series_mean(history(spark, sf_dir, p))
    future = arima_future(spark, sf_dir, p, hist).withColumnRenamed("forecast", "value")
    lo, hi = min(a for a, _ in HORIZONS.values()), max(b for _, b in HORIZONS.values())
    chain = series.index_chain(hist.select("key", "period", "value").unionByName(future))
    rows = chain.filter(F.col("period").between(lo, hi)).select("key", "period", "ofr_change", "inflation_pct")
    return risk_from(materialize(rows, "arima_horizon_rows"))
