"""Per-key series operators on the long form ``(key, period, value)``.

All windows are ``partitionBy(key).orderBy(period)``; Spark evaluates every
window expression with that spec in one Window operator over one sort, so a
chain such as relative index -> % change -> price index -> inflation costs a
single exchange by key.  Series are short (one row per key and period), so a
partition never holds more than one key's periods even when one key owns a
third of the raw rows: the raw rows are aggregated to ``(key, period)`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidal.functions.scalar import finite_or_null

INF = float("inf")


def _w(key: str, period: str):
    return Window.partitionBy(key).orderBy(period)


def _w_all(key: str, period: str):
    return _w(key, period).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _w_running(key: str, period: str):
    return _w(key, period).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def first_valid(value: str, rule: str = "nonzero", key: str = "key", period: str = "period") -> Column:
    """Baseline: first non-NULL value that is ``!= 0`` (rule "nonzero") or ``> 0`` ("positive")."""
    v = F.col(value)
    cond = v != 0 if rule == "nonzero" else v > 0
    return F.first(F.when(cond, v), ignorenulls=True).over(_w_all(key, period))


def relative_index(df: DataFrame, value: str = "value", out: str = "ofr", zero: str = "keep",
                   rule: str | None = None, key: str = "key", period: str = "period") -> DataFrame:
    """value / baseline * 100.

    ``zero="keep"``: a zero value gives 0 (baseline rule "nonzero");
    ``zero="null"``: a zero value gives NULL (baseline rule "positive").
    """
    rule = rule or ("nonzero" if zero == "keep" else "positive")
    base = first_valid(value, rule, key, period)
    v = F.col(value)
    idx = v / base * 100
    if zero == "null":
        idx = F.when(v != 0, idx)
    return df.withColumn(out, F.when(base.isNotNull(), idx))


def pct_change(df: DataFrame, col: str, out: str, zero: str = "keep",
               key: str = "key", period: str = "period") -> DataFrame:
    """Adjacent-row % change (gaps in periods are bridged, no fill).

    ``zero="keep"``: ``(cur / prev - 1) * 100``; x/0 gives +-inf, 0/0 NULL.
    ``zero="null"``: ``(cur - prev) / prev * 100``; NULL when prev is NULL or 0.
    """
    cur = F.col(col)
    prev = F.lag(cur).over(_w(key, period))
    if zero == "keep":
        by_zero = (F.when(cur > 0, F.lit(INF)).when(cur < 0, F.lit(-INF)))
        chg = F.when(prev == 0, by_zero).otherwise((F.try_divide(cur, prev) - 1) * 100)
    else:
        chg = F.when(prev != 0, F.try_divide(cur - prev, prev) * 100)
    return df.withColumn(out, chg)


def compounded_index(df: DataFrame, change: str, out: str = "price_index", beta: float = 0.5,
                     start: float = 100.0, floor: bool = False,
                     key: str = "key", period: str = "period") -> DataFrame:
    """P0 = start; Pt = Pt-1 * (1 + beta * change / 100); NULL change carries forward.

    Expressed as a running product of factors.  The start value is folded
    into the first factor, so the running frame (which Spark updates one row
    at a time) multiplies in exactly the order of the step-by-step loop.
    With ``floor`` the loop clamps at 0 every step; 0 is absorbing, so the
    price is 0 from the first factor <= 0 onwards, which a running ``min`` of
    the factors detects.
    """
    factor = F.coalesce(1 + beta * (F.col(change) / 100), F.lit(1.0))
    first = F.row_number().over(_w(key, period)) == 1
    w = _w_running(key, period)
    price = F.product(F.when(first, F.lit(start) * factor).otherwise(factor)).over(w)
    if floor:
        price = F.when(F.min(factor).over(w) <= 0, F.lit(0.0)).otherwise(price)
    return df.withColumn(out, price)


def change_vs_prev(df: DataFrame, col: str, out: str, key: str = "key",
                   period: str = "period") -> DataFrame:
    """(cur - prev) / prev * 100 over adjacent rows; NULL when prev is NULL or 0."""
    return pct_change(df, col, out, zero="null", key=key, period=period)


def inflation_pct(df: DataFrame, price: str = "price_index", out: str = "inflation_pct",
                  key: str = "key", period: str = "period") -> DataFrame:
    return change_vs_prev(df, price, out, key, period)


def index_chain(df: DataFrame, value: str = "value", key: str = "key", period: str = "period",
                beta: float = 0.5) -> DataFrame:
    """Relative index, % change, floored price index and inflation (zero -> NULL rules)."""
    df = relative_index(df, value, "ofr", zero="null", key=key, period=period)
    df = pct_change(df, "ofr", "ofr_change", zero="null", key=key, period=period)
    df = compounded_index(df, "ofr_change", "price_index", beta=beta, floor=True, key=key, period=period)
    return inflation_pct(df, "price_index", "inflation_pct", key=key, period=period)


def enrich_predictions(pred: DataFrame, key: str = "key", period: str = "period",
                       beta: float = 0.5) -> DataFrame:
    """catch = coalesce(actual, forecast), then the floored index chain."""
    df = pred.withColumn("catch", F.coalesce(F.col("actual"), F.col("forecast")))
    return index_chain(df, "catch", key, period, beta)


def feature_chain(df: DataFrame, value: str = "value", key: str = "key", period: str = "period",
                  beta: float = 0.5) -> DataFrame:
    """Feature rules: zeros kept (x/0 = +-inf), no price floor."""
    df = relative_index(df, value, "ofr", zero="keep", key=key, period=period)
    df = pct_change(df, "ofr", "ofr_change", zero="keep", key=key, period=period)
    return compounded_index(df, "ofr_change", "price_index", beta=beta, floor=False,
                            key=key, period=period)


def latest_features(df: DataFrame, value: str = "value", key: str = "key",
                    period: str = "period", beta: float = 0.5) -> DataFrame:
    """Per key: the last period's OFR, OFR change and price index of the feature chain."""
    chained = feature_chain(df, value, key, period, beta)
    last = F.max_by(F.struct("ofr", "ofr_change", "price_index"), F.col(period))
    return (chained.groupBy(key).agg(last.alias("s"), F.max(period).alias("last_period"))
            .select(key, "last_period", "s.ofr", "s.ofr_change", "s.price_index"))


def abs_change(df: DataFrame, col: str = "value", out: str = "abs_change",
               key: str = "key", period: str = "period") -> DataFrame:
    """Absolute change vs the previous row."""
    return df.withColumn(out, F.col(col) - F.lag(col).over(_w(key, period)))


def rebased_price(p0: Column, ofr0: Column, ofr_t: Column, beta: float = 0.5) -> Column:
    """P0 * (1 + beta * (OFR_t - OFR0) / OFR0); a NULL ratio (incl. OFR0 = 0) counts as 0."""
    ratio = F.when(ofr0 != 0, F.try_divide(ofr_t - ofr0, ofr0))
    return p0 * (1 + beta * F.coalesce(ratio, F.lit(0.0)))


def impute_series_mean(df: DataFrame, col: str = "value", out: str | None = None,
                       key: str = "key") -> DataFrame:
    """NULLs replaced by the series' own mean."""
    out = out or col
    return df.withColumn(out, F.coalesce(F.col(col), F.avg(col).over(Window.partitionBy(key))))


def tail_window(df: DataFrame, n: int, key: str = "key", period: str = "period",
                out: str | None = None) -> DataFrame:
    """Last ``n`` periods per key (or, with ``out``, the rank from the end as a column)."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.col(period).desc()))
    if out:
        return df.withColumn(out, rn)
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def last_known(df: DataFrame, col: str = "actual", out: str = "last_known",
               key: str = "key", period: str = "period") -> DataFrame:
    """Per key: value of ``col`` at the latest period where it is not NULL."""
    return (df.filter(F.col(col).isNotNull()).groupBy(key)
            .agg(F.max_by(col, period).alias(out)))


def finite(col: str) -> Column:
    return finite_or_null(F.col(col))
