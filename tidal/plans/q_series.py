"""Series, reshape and aggregation queries on the supplier and nation series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidal.operators import reshape, series
from tidal.operators.order_stats import exact_quantile
from tidal.plans import sql
from tidal.plans.registry import register, rounded
from tidal.plans.views import (FUTURE, TEST, TRAIN, VAL, first_period, predictions, supplier_bounds, shared_predictions, split_of,
                               supplier_month, supplier_month_zero)
from tidal.sources.tables import read_table

W_KP = "OVER (PARTITION BY key ORDER BY period)"
W_RUN = "OVER (PARTITION BY key ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


@register("aggregate_series", f"WITH {sql.SUPPLIER_MONTH} SELECT key, period, value FROM supplier_month")
def q_aggregate_series(spark, sf_dir):
    """Sum per (key, period); ordering happens only at output."""
    return supplier_month(spark, sf_dir).orderBy("key", "period")


@register("densify_series",
          f"WITH {sql.SUPPLIER_MONTH_ZERO} SELECT key, period, value FROM supplier_month_zero")
def q_densify(spark, sf_dir):
    return supplier_month_zero(spark, sf_dir).select("key", "period", "value")


_BASES = f"""
bases AS (SELECT key,
                 arg_min(value, period) FILTER (WHERE value <> 0) AS base_nz,
                 arg_min(value, period) FILTER (WHERE value > 0) AS base_pos
          FROM supplier_month_zero GROUP BY key),
idx AS (SELECT s.key, s.period, s.value,
               CASE WHEN b.base_nz IS NOT NULL THEN s.value / b.base_nz * 100 END AS ofr_keep,
               CASE WHEN b.base_pos IS NOT NULL AND s.value <> 0 THEN s.value / b.base_pos * 100 END AS ofr_null
        FROM supplier_month_zero s JOIN bases b ON s.key = b.key),
chg AS (SELECT *,
          CASE WHEN lag(ofr_keep) {W_KP} = 0
               THEN CASE WHEN ofr_keep > 0 THEN 'inf'::DOUBLE WHEN ofr_keep < 0 THEN '-inf'::DOUBLE END
               ELSE (ofr_keep / lag(ofr_keep) {W_KP} - 1) * 100 END AS chg_keep,
          CASE WHEN lag(ofr_null) {W_KP} <> 0
               THEN (ofr_null - lag(ofr_null) {W_KP}) / lag(ofr_null) {W_KP} * 100 END AS chg_null
        FROM idx),
fac AS (SELECT *, coalesce(1 + 0.5 * (chg_keep / 100), 1.0) AS f_keep,
                  coalesce(1 + 0.5 * (chg_null / 100), 1.0) AS f_null,
                  row_number() OVER (PARTITION BY key ORDER BY period) AS rn FROM chg),
{sql.seq_product('fac', 'f_keep', 'price_keep', False, 'rec_keep')},
{sql.seq_product('fac', 'f_null', 'price_floor', True, 'rec_floor')},
px AS (SELECT f.*, a.price_keep, b.price_floor FROM fac f
       JOIN rec_keep a ON f.key = a.key AND f.rn = a.rn
       JOIN rec_floor b ON f.key = b.key AND f.rn = b.rn)"""

_ZERO_CHAIN = f"WITH {sql.SUPPLIER_MONTH_ZERO}, {_BASES}"


def _zero_chains(spark, sf_dir):
    df = supplier_month_zero(spark, sf_dir)
    df = series.relative_index(df, "value", "ofr_keep", zero="keep")
    df = series.relative_index(df, "value", "ofr_null", zero="null")
    df = series.pct_change(df, "ofr_keep", "chg_keep", zero="keep")
    df = series.pct_change(df, "ofr_null", "chg_null", zero="null")
    df = series.compounded_index(df, "chg_keep", "price_keep", floor=False)
    return series.compounded_index(df, "chg_null", "price_floor", floor=True)


@register("ofr_index", _ZERO_CHAIN + f"""
SELECT key, period, value, {r6('ofr_keep', 'ofr_keep')}, {r6('ofr_null', 'ofr_null')} FROM idx""")
def q_ofr_index(spark, sf_dir):
    """Relative index vs the first non-zero / first positive value (zero kept / nulled)."""
    return rounded(_zero_chains(spark, sf_dir).select("key", "period", "value", "ofr_keep", "ofr_null"))


@register("ofr_change", _ZERO_CHAIN + f"""
SELECT key, period, {r6('chg_keep', 'chg_keep')}, {r6('chg_null', 'chg_null')} FROM chg""")
def q_ofr_change(spark, sf_dir):
    """Adjacent-row % change: x/0 = +inf (keep) or NULL (null rule)."""
    return rounded(_zero_chains(spark, sf_dir).select("key", "period", "chg_keep", "chg_null"))


@register("price_index", _ZERO_CHAIN + f"""
SELECT key, period, {r6('price_keep', 'price_keep')}, {r6('price_floor', 'price_floor')} FROM px""")
def q_price_index(spark, sf_dir):
    """Compounded index, unfloored (feature rules) and floored at 0 (enrich rules)."""
    return rounded(_zero_chains(spark, sf_dir).select("key", "period", "price_keep", "price_floor"))


@register("inflation", f"""WITH {sql.SUPPLIER_MONTH_ZERO}, {sql.index_chain('supplier_month_zero')}
SELECT key, period, {r6('price_index', 'price_index')}, {r6('inflation_pct', 'inflation_pct')} FROM ix""")
def q_inflation(spark, sf_dir):
    chain = series.index_chain(supplier_month_zero(spark, sf_dir))
    return rounded(chain.select("key", "period", "price_index", "inflation_pct"))


ENRICH_SQL = f"""WITH {sql.PREDICTIONS},
pc AS (SELECT key, period, actual, forecast, coalesce(actual, forecast) AS value FROM predictions),
{sql.index_chain('pc')}"""


@register("enrich_predictions", ENRICH_SQL + f"""
SELECT key, period, actual, forecast, {r6('ofr', 'ofr')}, {r6('ofr_change', 'ofr_change')},
       {r6('price_index', 'price_index')}, {r6('inflation_pct', 'inflation_pct')} FROM ix""")
def q_enrich_predictions(spark, sf_dir):
    """catch = actual else forecast -> relative index -> change -> floored price -> inflation."""
    out = series.enrich_predictions(predictions(spark, sf_dir))
    return rounded(out.select("key", "period", "actual", "forecast", "ofr", "ofr_change",
                              "price_index", "inflation_pct"))


@register("country_features", _ZERO_CHAIN + f"""
SELECT key, max(period) AS last_period,
       round(arg_max(ofr_keep, period), 6) + 0.0 AS ofr, round(arg_max(chg_keep, period), 6) + 0.0 AS ofr_change,
       round(arg_max(price_keep, period), 6) + 0.0 AS price_index
FROM px GROUP BY key""")
def q_country_features(spark, sf_dir):
    """Per key: last period's OFR, OFR change and price index (feature rules, +inf kept)."""
    return rounded(series.latest_features(supplier_month_zero(spark, sf_dir)))


@register("abs_change", f"""WITH {sql.SUPPLIER_MONTH}
SELECT key, period, value, value - lag(value) {W_KP} AS abs_change FROM supplier_month""")
def q_abs_change(spark, sf_dir):
    return series.abs_change(supplier_month(spark, sf_dir))


@register("tail_window", f"""WITH {sql.SUPPLIER_MONTH}
SELECT key, period, value FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY period DESC) AS rn FROM supplier_month)
WHERE rn <= 18""")
def q_tail_window(spark, sf_dir):
    """Last 18 periods per key (train cap); row_number <= n becomes a per-partition group limit."""
    return series.tail_window(supplier_month(spark, sf_dir), 18)


@register("impute_series_mean", f"""WITH {sql.PREDICTIONS}
SELECT key, period, round(coalesce(actual, avg(actual) OVER (PARTITION BY key)), 6) + 0.0 AS actual_filled
FROM predictions""")
def q_impute_series_mean(spark, sf_dir):
    df = series.impute_series_mean(predictions(spark, sf_dir), "actual", "actual_filled")
    return rounded(df.select("key", "period", "actual_filled"))


_FUT = list(range(FUTURE[0], FUTURE[1] + 1))


@register("pivot_series", f"""WITH {sql.PREDICTIONS}
SELECT key, {', '.join(f'max(CASE WHEN period = {p} THEN forecast END) AS p{p}' for p in _FUT)}
FROM predictions WHERE period BETWEEN {FUTURE[0]} AND {FUTURE[1]} GROUP BY key""")
def q_pivot_series(spark, sf_dir):
    """Future forecasts long -> one column per period (explicit pivot values)."""
    fut = predictions(spark, sf_dir).filter(F.col("period").between(*FUTURE))
    return reshape.pivot_series(fut, _FUT, value="forecast")


@register("unpivot_series", f"""WITH {sql.SUPPLIER_MONTH},
keys AS (SELECT DISTINCT key FROM supplier_month)
SELECT k.key, CAST(g.period AS INTEGER) AS period, m.value
FROM keys k CROSS JOIN (SELECT unnest(range(lo, 69)) AS period FROM (SELECT min(period) AS lo FROM supplier_month)) g
LEFT JOIN supplier_month m ON m.key = k.key AND m.period = g.period""")
def q_unpivot_series(spark, sf_dir):
    """Wide (one column per period, found at plan time) -> long, NULL cells kept."""
    bounds = supplier_bounds(spark, sf_dir)
    periods = list(range(first_period(bounds), TEST[1] + 1))
    return reshape.unpivot_series(reshape.pivot_series(supplier_month(spark, sf_dir, bounds), periods))


@register("history_plus_forecast", f"""WITH {sql.PREDICTIONS}
SELECT key, period, actual AS value, 'history' AS kind FROM predictions WHERE period <= {TEST[1]}
UNION ALL
SELECT key, period, forecast AS value, 'forecast' AS kind FROM predictions WHERE period >= {FUTURE[0]}""")
def q_history_plus_forecast(spark, sf_dir):
    past = F.col("period") <= TEST[1]
    return predictions(spark, sf_dir).select(
        "key", "period", F.when(past, F.col("actual")).otherwise(F.col("forecast")).alias("value"),
        F.when(past, "history").otherwise("forecast").alias("kind"))


@register("merge_forecast", f"""WITH {sql.PREDICTIONS}
SELECT key, period, value, 'main' AS src FROM supplier_month
UNION ALL
SELECT p.key, p.period, p.forecast AS value, 'forecast' AS src FROM predictions p
WHERE NOT EXISTS (SELECT 1 FROM supplier_month m WHERE m.key = p.key AND m.period = p.period)""")
def q_merge_forecast(spark, sf_dir):
    """Left merge where the main table wins on collisions (anti-join of the other side)."""
    p = shared_predictions(spark, sf_dir)
    main = p.filter("actual IS NOT NULL").select("key", "period", F.col("actual").alias("value"),
                                                 F.lit("main").alias("src"))
    fc = p.select("key", "period", F.col("forecast").alias("value"),
                                          F.lit("forecast").alias("src"))
    return reshape.merge_main_wins(main, fc, ["key", "period"])


@register("union_horizons", f"""{ENRICH_SQL}
SELECT key, period, {r6('ofr_change', 'ofr_change')}, {r6('inflation_pct', 'inflation_pct')}, 'h3' AS horizon
FROM ix WHERE period BETWEEN {FUTURE[0]} AND {FUTURE[0] + 2}
UNION ALL
SELECT key, period, {r6('ofr_change', 'ofr_change')}, {r6('inflation_pct', 'inflation_pct')}, 'h7' AS horizon
FROM ix WHERE period BETWEEN {FUTURE[0]} AND {FUTURE[1]}""")
def q_union_horizons(spark, sf_dir):
    """Short and long forecast horizons stacked with a horizon tag."""
    e = series.enrich_predictions(predictions(spark, sf_dir)).select(
        "key", "period", "ofr_change", "inflation_pct")
    return rounded(reshape.tag_ranges(e, {"h3": (FUTURE[0], FUTURE[0] + 2), "h7": FUTURE}, "horizon"))


@register("split_by_period", f"""WITH {sql.PREDICTIONS}
SELECT key, period, actual,
       CASE WHEN period BETWEEN {TRAIN[0]} AND {TRAIN[1]} THEN 'train'
            WHEN period BETWEEN {VAL[0]} AND {VAL[1]} THEN 'val' ELSE 'test' END AS split
FROM predictions WHERE period BETWEEN {TRAIN[0]} AND {TEST[1]}""")
def q_split_by_period(spark, sf_dir):
    """Chronological train / val / test tag by inclusive period ranges."""
    p = predictions(spark, sf_dir).select("key", "period", "actual")
    return p.withColumn("split", split_of(F.col("period"))).filter(F.col("split").isin("train", "val", "test"))


@register("country_totals", f"""WITH {sql.PREDICTIONS}
SELECT n.n_name AS nation, p.period, sum(p.actual) AS total
FROM predictions p JOIN supplier s ON CAST(s.s_suppkey AS VARCHAR) = p.key
JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY 1, 2""")
def q_country_totals(spark, sf_dir):
    """Sum over duplicate keys (suppliers of one nation); NULL when every input is NULL."""
    p = predictions(spark, sf_dir)
    sup = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("key"), "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return (p.join(sup, "key").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy("nation", "period").agg(F.sum("actual").alias("total")))


MEDIAN_SQL = f"""WITH {sql.PREDICTIONS},
med AS (SELECT period, median(actual) AS med FROM predictions GROUP BY period),
filled AS (SELECT p.key, p.period, coalesce(p.actual, m.med) AS actual_filled
           FROM predictions p JOIN med m ON p.period = m.period)"""


def median_filled(spark, sf_dir):
    """Per-period exact median over keys replaces NULL."""
    p = shared_predictions(spark, sf_dir)
    med = exact_quantile(p, "actual", 0.5, ("period",), "med")
    return (p.join(med, "period")
            .select("key", "period", F.coalesce("actual", "med").alias("actual_filled")))


@register("median_fill", MEDIAN_SQL + " SELECT key, period, round(actual_filled, 6) + 0.0 AS actual_filled FROM filled")
def q_median_fill(spark, sf_dir):
    return rounded(median_filled(spark, sf_dir))


_VEC = list(range(TRAIN[1] - 9, TRAIN[1] + 1))


@register("window_vector", MEDIAN_SQL + f"""
SELECT key, {', '.join(f'round(max(CASE WHEN period = {p} THEN actual_filled END), 6) + 0.0 AS f{i}' for i, p in enumerate(_VEC))}
FROM filled WHERE period BETWEEN {_VEC[0]} AND {_VEC[-1]} GROUP BY key""")
def q_window_vector(spark, sf_dir):
    """Fixed-length positional vector of the last 10 train periods (median-filled)."""
    f = median_filled(spark, sf_dir).filter(F.col("period").between(_VEC[0], _VEC[-1]))
    f = f.withColumn("offset", F.col("period") - _VEC[0])
    wide = f.groupBy("key").pivot("offset", list(range(10))).agg(F.first("actual_filled"))
    return rounded(wide.select("key", *[F.col(str(i)).alias(f"f{i}") for i in range(10)]))


@register("quality_report", f"""WITH {sql.PREDICTIONS},
t AS (SELECT *, CASE WHEN period BETWEEN {TRAIN[0]} AND {TRAIN[1]} THEN 'train'
                     WHEN period BETWEEN {VAL[0]} AND {VAL[1]} THEN 'val' ELSE 'test' END AS split
      FROM predictions WHERE period BETWEEN {TRAIN[0]} AND {TEST[1]})
SELECT split, count(DISTINCT key) AS n_keys, count(DISTINCT period) AS n_periods,
       count(*) - count(actual) AS missing_before_fill
FROM t GROUP BY split""")
def q_quality_report(spark, sf_dir):
    """Per split: keys, periods and missing cells before any fill, in one pass."""
    p = predictions(spark, sf_dir).withColumn("split", split_of(F.col("period")))
    p = p.filter(F.col("split").isin("train", "val", "test"))
    return p.groupBy("split").agg(
        F.countDistinct("key").alias("n_keys"), F.countDistinct("period").alias("n_periods"),
        (F.count(F.lit(1)) - F.count("actual")).alias("missing_before_fill"))


@register("distinct_keys", f"""WITH {sql.SUPPLIER_MONTH}
SELECT key, period AS first_period, value AS first_value FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY period) AS rn FROM supplier_month) WHERE rn = 1""")
def q_distinct_keys(spark, sf_dir):
    """One row per key: its first observation (deterministic order, not dropDuplicates)."""
    sm = supplier_month(spark, sf_dir)
    first = F.min_by(F.struct("period", "value"), "period")
    return sm.groupBy("key").agg(first.alias("s")).select(
        "key", F.col("s.period").alias("first_period"), F.col("s.value").alias("first_value"))


@register("sample_keys", f"""WITH {sql.SUPPLIER_MONTH}
SELECT m.key, m.period, m.value FROM supplier_month m
WHERE m.key IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                WHERE n.n_name = 'NATION_1')""")
def q_sample_keys(spark, sf_dir):
    """Series of a chosen key subset (the suppliers of one nation) via a semi join."""
    sup = read_table(spark, sf_dir, "supplier")
    nation = read_table(spark, sf_dir, "nation").filter(F.col("n_name") == "NATION_1")
    keys = sup.join(F.broadcast(nation), sup.s_nationkey == nation.n_nationkey, "left_semi") \
        .select(F.col("s_suppkey").cast("string").alias("key"))
    return supplier_month(spark, sf_dir).join(keys, "key", "left_semi")


@register("limit_rows", f"""WITH {sql.SUPPLIER_MONTH}
SELECT key, period, value FROM supplier_month ORDER BY key, period LIMIT 5""")
def q_limit_rows(spark, sf_dir):
    """Head of the ordered series (a LIMIT always comes with an ORDER BY)."""
    return supplier_month(spark, sf_dir).orderBy("key", "period").limit(5)
