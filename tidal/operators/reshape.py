"""Reshaping: densify, pivot / unpivot, unions and merges of keyed series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def densify(df: DataFrame, lo: int | None = None, hi: int | None = None, fill=None,
            per_key_range: bool = False, key: str = "key", period: str = "period",
            value: str = "value") -> DataFrame:
    """Every period of a range exists for every key; missing cells get ``fill``.

    Each row fills the gap up to its key's next row (the first one also the gap
    before it) with ``explode(sequence(...))`` inside one key window: no join,
    no buffer per key, and the output stays hash-partitioned by key, so the
    per-key windows that usually follow need no further exchange.
    ``per_key_range`` uses each key's own first..last period; otherwise rows
    outside ``lo``..``hi`` are left out.  Duplicate (key, period) cells are an error.
    """
    others = [c for c in df.columns if c not in (key, period)]
    w = Window.partitionBy(key).orderBy(period)
    near = df.select("*", F.lead(period).over(w).alias("_next"), F.lag(period).over(w).alias("_prev"))
    start, end = F.col(period), F.col("_next") - 1
    if per_key_range:
        end = F.coalesce(end, F.col(period))
    else:
        start = F.greatest(F.when(F.col("_prev").isNull(), F.lit(lo)).otherwise(start), F.lit(lo))
        end = F.least(F.coalesce(end, F.lit(hi)), F.lit(hi))
    twice = F.raise_error(F.concat(F.lit("duplicate cell at period "), F.col(period).cast("string")))
    cells = F.when(F.col("_next") == F.col(period), twice.cast("array<int>")).when(
        start <= end, F.sequence(start.cast("int"), end.cast("int")))
    out = near.select("*", F.explode(cells).alias("_cell"))
    own = F.col("_cell") == F.col(period)
    kept = {c: F.when(own, F.col(c)) for c in others}
    if fill is not None:
        kept[value] = F.coalesce(kept[value], F.lit(fill))
    return out.select(key, F.col("_cell").alias(period), *[kept[c].alias(c) for c in others])


def pivot_series(df: DataFrame, periods: list[int], key: str = "key", period: str = "period",
                 value: str = "value", prefix: str = "p", check: bool = False) -> DataFrame:
    """Long -> one column per period (explicit value list: no extra job to find them).

    Duplicate ``(key, period)`` cells are an error, as in a strict pivot: each cell's rows are counted in the
    aggregate that takes its value.  With ``check`` a (small, limit-1) job verifies that before the pivot.
    """
    if check:
        assert_unique_cells(df, key, period)
    twice = F.raise_error(F.lit("duplicate (key, period) cells cannot be pivoted"))
    cell = F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.first(value))
    cells = df.groupBy(key, period).agg(cell.alias("_cell"))
    pivoted = cells.groupBy(key).pivot(period, periods).agg(F.first("_cell"))
    return pivoted.select(key, *[F.col(str(p)).alias(f"{prefix}{p}") for p in periods])


def assert_unique_cells(df: DataFrame, key: str = "key", period: str = "period") -> None:
    if df.groupBy(key, period).count().filter("count > 1").limit(1).count():
        raise ValueError("duplicate (key, period) cells cannot be pivoted")


def unpivot_series(wide: DataFrame, key: str = "key", prefix: str = "p",
                   period: str = "period", value: str = "value") -> DataFrame:
    """Wide digit-named columns -> long; column list resolved at plan time."""
    cols = sorted((c for c in wide.columns if c.startswith(prefix) and c[len(prefix):].lstrip("-").isdigit()),
                  key=lambda c: int(c[len(prefix):]))
    long = wide.unpivot(key, cols, "_col", value)
    return long.select(key, F.substring("_col", len(prefix) + 1, 10).cast("int").alias(period), value)


def merge_main_wins(main: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Union of ``main`` and the rows of ``other`` whose keys are absent from ``main``."""
    return main.unionByName(other.join(main.select(*keys), keys, "left_anti"))


def tag_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Append frames with a tag column naming their origin."""
    out = None
    for name, df in parts.items():
        d = df.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def tag_ranges(df: DataFrame, ranges: dict[str, tuple[int, int]], tag: str, period: str = "period") -> DataFrame:
    """Each row once per named period range that holds it, tagged with the name, in one pass."""
    names = F.array(*[F.when(F.col(period).between(lo, hi), F.lit(name)) for name, (lo, hi) in ranges.items()])
    return df.select("*", F.explode(F.array_compact(names)).alias(tag))
