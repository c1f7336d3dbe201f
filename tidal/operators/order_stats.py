"""Exact quantiles without a buffer of all values.

Of groups, in two passes.  The first brackets the wanted position between two values of a
mergeable sketch of fixed size.  The second counts, by (group, value), the
values inside the bracket and all those below it as one row; only the bracket's
distinct values, a small share of the group, are ordered to find the position.

Of a whole table, in rounds: each counts the values below and up to a few cut points and keeps
the two nearest to the position, until the rest has a stated number of distinct values at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidal.session import materialize

#: The sketch is off by at most 1 / ACCURACY of a group's rows; the bracket reaches SLACK to either side.
ACCURACY, SLACK = 10_000, 0.001
#: Groups of fewer rows are their own bracket (SLACK of them is less than a few positions).
WHOLE = 4096
#: Cut points of a round, and the distinct values that the last one may hand to the driver.
CUTS, MOST = 32, 10_000


def _cuts(values: DataFrame) -> list[float]:
    """Values at even shares of the rows, the least and the greatest among them."""
    inner = F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], ACCURACY)
    low, high, between = values.agg(F.min("_v"), F.max("_v"), inner).first()
    return sorted({low, high, *between})


def quantile_by_rounds(df: DataFrame, value: str, q: float, most: int = MOST) -> float | None:
    """The interpolated ``q``-quantile of the non-null values of a whole table; None without any, NaN is the largest.

    A round reads the written values once for the cut points and once for the counts, and leaves about a 16th of the
    rows.  Where a few values with most of the rows hold both ends, the cuts are taken from the distinct values
    instead.  The last round counts at most ``most`` distinct values and places them on the driver.
    """
    values = materialize(df.select(F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL"), "quantile_values")
    n, sound, low, high = values.agg(F.count("_v"), F.count_if(~F.isnan("_v")), F.min("_v"),
                                     F.max(F.when(~F.isnan("_v"), F.col("_v")))).first()
    if not n:
        return None
    at = (n - 1) * q
    first, second = math.floor(at), math.ceil(at)
    if second >= sound:
        return math.nan
    ends, below, rows, few = (low, high), 0, sound, False

    def inside() -> DataFrame:
        return values.filter(F.col("_v").between(*map(F.lit, ends)))

    most = max(most, 2)  # two neighbours cannot be cut
    while ends[0] != ends[1] and rows > most and not few:
        tried = ends
        for source in (inside(), inside().distinct()):
            cuts = _cuts(source)
            counts = values.agg(*[c for v in cuts for c in (F.count_if(F.col("_v") < v), F.count_if(F.col("_v") <= v))]).first()
            placed = [(v, counts[2 * i], counts[2 * i + 1]) for i, v in enumerate(cuts)]
            left = max(p for p in placed if p[1] <= first)
            right = min(p for p in placed if p[2] > second)
            ends, below, rows = (left[0], right[0]), left[1], right[2] - left[1]
            if ends != tried:
                break
            if inside().distinct().limit(most + 1).count() <= most:
                few = True
                break
    found, upto = {}, below
    for v, c in sorted(tuple(r) for r in inside().groupBy("_v").count().collect()):
        for position in (first, second):
            if upto <= position < upto + c:
                found[position] = v
        upto += c
    share = at - first
    return found[first] if not share else found[first] + (found[second] - found[first]) * share


def exact_quantile(df: DataFrame, value: str, q: float, by: tuple[str, ...] = (), out: str = "quantile") -> DataFrame:
    """``by``, ``out``: the interpolated ``q``-quantile of the non-null values per group (no ``by``: one row).

    NULL where a group has no value; NaN counts as the largest value; rows with
    a NULL in ``by`` take no part.  The rows of a hot group are counted in every
    task before they are sent on by (group, value).  Without ``by`` the value is
    found at once, by ``quantile_by_rounds``.
    """
    by = list(by)
    if not by:
        found = quantile_by_rounds(df, value, q)
        return df.sparkSession.range(1).select(F.lit(found).cast("double").alias(out))
    src = df.select(*by, F.col(value).cast("double").alias("_v"))
    ends = F.percentile_approx("_v", [max(0.0, q - SLACK), min(1.0, q + SLACK)], ACCURACY)
    small = F.count("_v") < WHOLE
    bracket = src.groupBy(*by).agg(F.struct(
        F.count("_v").alias("n"),
        F.when(small, F.min("_v")).otherwise(F.element_at(ends, 1)).alias("lo"),
        F.when(small, F.max("_v")).otherwise(F.element_at(ends, 2)).alias("hi")).alias("_b"))
    with_b = src.join(bracket, by)
    # NULL stands for all values below the bracket and sorts first
    counted = with_b.filter(F.col("_v") <= F.col("_b.hi")).groupBy(
        *by, F.col("_b.n").alias("_n"), F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())
    placed = counted.select(*by, "_v", "_c", ((F.col("_n") - 1) * F.lit(q)).alias("_at"),
                            F.sum("_c").over(w).alias("_upto"))

    def held(position):
        return F.max(F.when((F.col("_upto") - F.col("_c") <= position) & (position < F.col("_upto")), F.col("_v")))

    found = placed.groupBy(*by).agg(held(F.floor("_at")).alias("_low"), held(F.ceil("_at")).alias("_high"),
                                    F.max(F.col("_at") - F.floor("_at")).alias("_share"))
    between = F.when(F.col("_share") == 0, F.col("_low")).otherwise(
        F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share"))
    return bracket.select(*by).join(found.select(*by, between.alias(out)), by, "left")
