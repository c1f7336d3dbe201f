"""Exact quantiles by bracket and count, and positions over range buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidal.operators import text
from tidal.operators.order_stats import exact_quantile, quantile_by_rounds


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.999, 1.0])
@pytest.mark.parametrize("n", [1, 2, 12, 5001, 30000])
def test_matches_numpy(spark, n, q):
    df = spark.range(n).select((F.xxhash64("id") % 100003 / 7.0).alias("v"))
    values = np.array([r.v for r in df.collect()])
    assert exact_quantile(df, "v", q).collect()[0][0] == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_hot_values_groups_and_nulls(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        F.when(F.col("id") % 2 == 0, 5.0).when(F.col("id") % 7 > 0, F.xxhash64("id") % 1000 / 1.0).alias("v"))
    df = df.unionByName(spark.createDataFrame([("none", None)], "g string, v double"))
    got = {r.g: r.m for r in exact_quantile(df, "v", 0.25, ("g",), "m").collect()}
    pdf = df.toPandas()
    want = pdf.groupby("g").v.quantile(0.25)
    assert got.pop("none") is None
    assert got == {g: pytest.approx(want[g], abs=1e-9) for g in got} and len(got) == 6


@pytest.mark.parametrize("q", [0.0, 0.31, 0.5, 0.9995, 1.0])
@pytest.mark.parametrize("shape", ["spread", "ends", "one"])
def test_rounds_on_ties_and_skew(spark, shape, q):
    """``ends``: two values hold nearly all rows on both sides of the others; ``one``: a value holds a third."""
    i, h = F.col("id"), F.xxhash64("id") % 4999 / 7.0
    v = {"spread": h, "ends": F.when(i % 20 == 0, h).when(i % 2 == 0, -1e9).otherwise(1e9),
         "one": F.when(i % 3 == 0, 5.0).otherwise(h)}[shape]
    df = spark.range(40000).select(F.when(i % 11 > 0, v).alias("v"))
    values = df.toPandas().v.dropna().to_numpy()
    assert quantile_by_rounds(df, "v", q, most=50) == pytest.approx(np.quantile(values, q), abs=1e-6)


def test_rounds_with_nan_and_infinities(spark):
    df = spark.createDataFrame([(float(x),) for x in ("-inf", 1, 2, "inf", "nan")] + [(None,)], "v double")
    got = [quantile_by_rounds(df, "v", q, most=1) for q in (0.0, 0.25, 0.375, 0.5, 0.75, 1.0)]
    assert got[:5] == [-np.inf, 1.0, 1.5, 2.0, np.inf] and np.isnan(got[5])


def test_no_window_without_a_key(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    plan = exact_quantile(df, "v", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_empty_table_gives_null(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_quantile(df, "v", 0.5).collect()[0][0] is None
    assert exact_quantile(df, "v", 0.5, ("g",)).collect() == []


def test_range_bucket_positions(spark):
    # most ids lie close together, some far away
    df = spark.range(6000).select(F.when(F.col("id") % 50 == 0, F.col("id") * 10 ** 9).otherwise(F.col("id")).alias("k"))
    buckets = text.range_bucket(df, "k", buckets=64)
    sizes = [r["count"] for r in buckets.groupBy("_range").count().collect()]
    assert len(sizes) <= 64 and max(sizes) < 6000 / 16
    got = sorted((r.idx, r.k) for r in text.global_index(buckets, ["k"], F.col("_range")).collect())
    assert got == list(enumerate(sorted(r.k for r in df.collect())))
