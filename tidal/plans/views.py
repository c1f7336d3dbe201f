"""Keyed monthly series derived from the driver's star schema.

Every operator works on a long table ``(key, period, value)``.  These views
build such tables from ``lineitem``/``orders``/``customer``/``nation`` so the
work of every registered query grows with the base tables.

Scale notes: ``lineitem`` is pre-aggregated per order before it meets
``orders`` (one row per order instead of ~4), and every aggregate is partial
(map-side combine) before its shuffle, so a nation or supplier that holds a
third of all rows only ever ships one partial sum per map task.  ``nation`` is
a fixed 25-row dimension and is broadcast; ``customer`` joins by key and is
left to AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidal.sources.tables import read_table

# Fixed values of the period axis.  The supplier series count months so that the
# last month in the data is always period TEST[1]: test is the last 8 observed
# periods, val the 10 before, train all history before that (no lower bound,
# periods may be negative), future the 7 periods after the data.
EPOCH_YEAR = 1995
TRAIN = (-100_000, 50)
VAL = (51, 60)
TEST = (61, 68)
FUTURE = (69, 75)
SPLITS = (("train",) + TRAIN, ("val",) + VAL, ("test",) + TEST)


def month_index(ts: Column) -> Column:
    return (F.year(ts) - EPOCH_YEAR) * 12 + F.month(ts) - 1


REVENUE_SCALE = 10000


def revenue_units() -> Column:
    """Revenue of a line in 1/10000 currency units as an exact BIGINT.

    price (cents) x (1 - discount) (percent) is exact in integers, so sums do
    not depend on the order partitions are combined in; ~3e17 headroom per
    cell even at sf100000.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    pct = F.round((1 - F.col("l_discount")) * 100).cast("bigint")
    return cents * pct


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key = nation name, period = order month, value = revenue (exact integer sum)."""
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.sum(revenue_units()).alias("rev")))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", month_index(F.col("o_orderdate")).alias("period"))
    per_cust = (li.join(orders, li.l_orderkey == orders.o_orderkey)
                .groupBy("o_custkey", "period").agg(F.sum("rev").alias("rev")))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("key"), "period")
            .agg((F.sum("rev").cast("double") / REVENUE_SCALE).alias("value")))


def supplier_bounds(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last ship month in the data (month index): one aggregate of one column."""
    m = month_index(F.col("l_shipdate"))
    first, last = read_table(spark, sf_dir, "lineitem").agg(F.min(m), F.max(m)).first()
    return (first, last) if last is not None else (0, 0)


def first_period(bounds: tuple[int, int]) -> int:
    """Period of the first ship month, counted back from the last one."""
    return TEST[1] - (bounds[1] - bounds[0])


def supplier_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key = supplier key (as text), month = ship month (month index), value = quantity shipped."""
    li = read_table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").cast("string").alias("key"), month_index(F.col("l_shipdate")).alias("month"))
            .agg(F.sum("l_quantity").alias("value")))


def shared_sums(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int]]:
    """``supplier_sums`` written once, and the first and last month in it: the only scan of ``lineitem``."""
    from tidal.session import materialize
    sums = materialize(supplier_sums(spark, sf_dir), "supplier_sums")
    first, last = sums.agg(F.min("month"), F.max("month")).first()
    return sums, ((first, last) if last is not None else (0, 0))


def supplier_month(spark: SparkSession, sf_dir: str, bounds: tuple[int, int] | None = None,
                   sums: DataFrame | None = None) -> DataFrame:
    """key = supplier key (as text), period = ship month (the last one is TEST[1]), value = quantity shipped."""
    last = (bounds or supplier_bounds(spark, sf_dir))[1]
    sums = supplier_sums(spark, sf_dir) if sums is None else sums
    return sums.select("key", (F.col("month") - F.lit(last) + F.lit(TEST[1])).alias("period"), "value")


def supplier_month_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier_month`` densified over each key's own period range, gaps = 0."""
    from tidal.operators.reshape import densify
    return densify(supplier_month(spark, sf_dir), fill=0.0, per_key_range=True)


def split_of(period: Column) -> Column:
    """train / val / test / future tag of a period (NULL outside the bounds)."""
    return (F.when(period.between(*TRAIN), "train").when(period.between(*VAL), "val")
            .when(period.between(*TEST), "test").when(period.between(*FUTURE), "future"))


def predictions(spark: SparkSession, sf_dir: str, bounds: tuple[int, int] | None = None,
                sums: DataFrame | None = None) -> DataFrame:
    """Prediction table ``(key, period, actual, forecast)`` on the supplier series.

    Dense grid per supplier from the first period of the data to the last
    future one; actual = quantity shipped (NULL where none); forecast = naive model fitted on the
    mean-imputed train series: the previous period in-sample, the last train
    value for val / test / future.
    """
    from tidal.operators.reshape import densify
    from pyspark.sql import Window
    bounds = bounds or supplier_bounds(spark, sf_dir)
    dense = densify(supplier_month(spark, sf_dir, bounds, sums), lo=first_period(bounds), hi=FUTURE[1])
    by_key = Window.partitionBy("key")
    ordered = by_key.orderBy("period")
    is_train = F.col("period") <= TRAIN[1]
    train_mean = F.avg(F.when(is_train, F.col("value"))).over(by_key)
    imputed = F.when(is_train, F.coalesce(F.col("value"), train_mean))
    last_train = F.last(imputed, ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (dense.withColumn("_imp", imputed)
            .select("key", "period",
                    F.col("value").alias("actual"),
                    F.when(is_train, F.lag("_imp").over(ordered)).otherwise(last_train)
                    .alias("forecast")))


def shared_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions`` written once to the shared checkpoint folder.

    For queries that read the prediction grid more than once (statistics and
    rows, train and validation, candidates and actuals): one scan of the raw
    tables and one small written table (keys x periods) instead of a
    rescan of ``lineitem`` per branch.
    """
    from tidal.session import materialize
    return materialize(predictions(spark, sf_dir), "predictions")
