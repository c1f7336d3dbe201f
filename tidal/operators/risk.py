"""Risk components, min-max normalisation and the combined risk score.

Everything is one ``groupBy(key)`` (partial aggregation before the shuffle)
plus global scalars computed as one-row scalar subqueries; no
un-partitioned window is ever used, so no single task sees all keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidal.functions.scalar import finite_or_null, risk_band

COMPONENTS = ("slope_ofr_change", "slope_inflation_pct", "sum_ofr_change", "sum_inflation_pct")


def safe_slope(y: Column, x: Column) -> Column:
    """OLS slope over finite points; 0 when fewer than two remain."""
    yf = finite_or_null(y)
    return F.coalesce(F.when(F.regr_count(yf, x) >= 2, F.regr_slope(yf, x)), F.lit(0.0))


def safe_sum(y: Column) -> Column:
    """Sum with NULL, NaN and +-inf counted as 0."""
    return F.coalesce(F.sum(F.coalesce(finite_or_null(y), F.lit(0.0))), F.lit(0.0))


def risk_components(df: DataFrame, key: str = "key", period: str = "period",
                    cols=("ofr_change", "inflation_pct"), suffix: str = "",
                    where: Column | None = None) -> list[Column]:
    """Aggregate expressions: slope and sum of each column per key.

    ``where`` restricts the rows seen by these aggregates, so several
    horizons can be computed in a single ``groupBy`` pass.
    """
    aggs = []
    for c in cols:
        y = F.col(c) if where is None else F.when(where, F.col(c))
        x = F.col(period) if where is None else F.when(where, F.col(period))
        aggs.append(safe_slope(y, x).alias(f"slope_{c}{suffix}"))
    for c in cols:
        y = F.col(c) if where is None else F.when(where, F.col(c))
        aggs.append(safe_sum(y).alias(f"sum_{c}{suffix}"))
    return aggs


def min_max_norm(df: DataFrame, cols: list[str], prefix: str = "norm_") -> DataFrame:
    """(x - min) / (max - min) over all rows; a constant or all-NULL column gives 0.5.

    The extremes are one global aggregate evaluated as a scalar subquery (a
    single row computed once and passed to every task as a value), so the
    normalisation itself is a plain projection at any scale.
    """
    stats = df.agg(F.struct(*[F.min(c).alias(f"mn_{c}") for c in cols],
                            *[F.max(c).alias(f"mx_{c}") for c in cols]).alias("s")).scalar()
    # evaluate the subquery once into a column; fields are read from that column
    out = df.withColumn("_stats", stats)
    for c in cols:
        mn, mx = F.col(f"_stats.mn_{c}"), F.col(f"_stats.mx_{c}")
        out = out.withColumn(
            f"{prefix}{c}",
            F.when(mn.isNull() | mx.isNull() | (mx == mn), F.lit(0.5))
            .otherwise((F.col(c) - mn) / (mx - mn)))
    return out.drop("_stats")


def risk_score(components: DataFrame, horizons=("5", "10"), digits: int = 6,
               persist: bool = True) -> DataFrame:
    """Mean of the four normalised components per horizon, rounded half-even.

    The per-key component table feeds both the global extremes and the
    final projection; it is written once to the shared checkpoint folder
    (one row per key) so the upstream plan, which scans the raw tables,
    runs once instead of once per branch.
    """
    cols = [f"{c}_{h}" for h in horizons for c in COMPONENTS]
    if persist:
        from tidal.session import materialize
        components = materialize(components, "risk_components")
    normed = min_max_norm(components, cols)
    for h in horizons:
        parts = [F.col(f"norm_{c}_{h}") for c in COMPONENTS]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        normed = normed.withColumn(f"risk_score_{h}", F.bround(total / len(parts), digits))
    return normed.drop(*[f"norm_{c}" for c in cols])


def tail_risk(series: DataFrame, key: str = "key", period: str = "period",
              horizons=(5, 10)) -> DataFrame:
    """Risk components over each key's last ``h`` periods, all horizons in one aggregate.

    ``series`` carries ``ofr_change`` and ``inflation_pct`` (see
    ``series.index_chain``).  Ranking from the end and the aggregate share the
    key partitioning, so this is one exchange by key.
    """
    from tidal.operators.series import tail_window
    ranked = (tail_window(series, max(horizons), key, period, out="_from_end")
              .filter(F.col("_from_end") <= max(horizons)))
    aggs = []
    for h in horizons:
        aggs += risk_components(ranked, key, period, suffix=f"_{h}",
                                where=F.col("_from_end") <= h)
    return ranked.groupBy(key).agg(*aggs)


def banded(df: DataFrame, score: str, out: str, policy: str = "raw") -> DataFrame:
    return df.withColumn(out, risk_band(F.col(score), policy))


def horizon_risk(series: DataFrame, horizons: dict[str, tuple[int, int]], key: str = "key",
                 period: str = "period") -> DataFrame:
    """Risk components of every forecast horizon (period range) in one ``groupBy(key)``.

    This replaces computing each horizon separately and joining them side by
    side: one pass, one exchange, and keys line up by construction.
    """
    aggs = []
    for name, (lo, hi) in horizons.items():
        aggs += risk_components(series, key, period, suffix=f"_{name}",
                                where=F.col(period).between(lo, hi))
    return series.groupBy(key).agg(*aggs)


def join_horizons(parts: dict[str, DataFrame], key: str = "key") -> DataFrame:
    """Per-horizon component tables side by side, joined on the key (full outer)."""
    out = None
    for name, df in parts.items():
        d = df.select(key, *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != key])
        out = d if out is None else out.join(d, key, "full")
    return out
