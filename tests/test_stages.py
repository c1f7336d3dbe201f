"""The saved feature pipeline: odd wide files, one call, the same rows as the single operators."""

import statistics

import pytest
from pyspark.ml import PipelineModel

from tidal.operators import series, stages

BOUNDS = {"train": (1990, 1991), "val": (1992, 1992), "test": (1993, 1994)}
FILE = """Note,1992,Country,1990,1991,1993,x1,1994
a,3, france ,1,2,4,9,5
b,1,FRANCE,1,,1,9,NA
c,4,USA,0,8,2,9,1
d,,Spain,,,,9,
e,7,,7,7,7,9,7
f,inf,Chad,abc,5,0,9,10
"""


def write(tmp_path, text):
    p = tmp_path / "wide.csv"
    p.write_text(text)
    return str(p)


def loop(values):
    """The last index, change and price of a series, step by step."""
    base = next((v for v in values if v), None)
    ofr = [None if base is None or v is None else v / base * 100 for v in values]
    price, change = 100.0, None
    for before, now in zip([None] + ofr, ofr):
        change = None
        if before is not None and now is not None:
            change = (now / before - 1) * 100 if before else (float("inf") if now > 0 else None)
        price = price if change is None else price * (1 + 0.5 * change / 100)
    return ofr[-1], change, price


def test_one_call_on_an_odd_file(spark, tmp_path):
    out = str(tmp_path / "job")
    rows = stages.feature_job(spark, write(tmp_path, FILE), out, BOUNDS).collect()
    want = {"France": [2.0, 2.0, 4.0, 5.0, 5.0], "United States": [0.0, 8.0, 4.0, 2.0, 1.0],
            "Spain": [None] * 5, "Chad": [None, 5.0, None, 0.0, 10.0]}
    assert {(r.key, r.period): r.value for r in rows} == {
        (k, 1990 + i): v for k, vs in want.items() for i, v in enumerate(vs)}
    assert all(BOUNDS[r.split][0] <= r.period <= BOUNDS[r.split][1] for r in rows)
    feats = {k: loop(v) for k, v in want.items()}
    assert feats["Chad"][1] == float("inf") and feats["Spain"][0] is None
    for i, name in enumerate(stages.FEATURES):
        sound = [f[i] for f in feats.values() if f[i] is not None and f[i] != float("inf")]
        for r in rows:
            own = feats[r.key][i]
            expected = own if own in sound else statistics.median(sound)
            assert r[name] == pytest.approx(expected, abs=1e-9)
    # the saved pipeline, loaded again, keeps the medians it was fitted with
    model = PipelineModel.load(f"{out}/model")
    again = model.transform(spark.createDataFrame([("Peru", None, None)], "Country string, `1993` string, `1994` string"))
    medians = model.stages[2].value("medians")
    assert [(r.period, r.value, r.ofr, r.split) for r in again.orderBy("period").collect()] == [
        (1993, None, medians["ofr"], "test"), (1994, None, medians["ofr"], "test")]


def test_equals_the_single_operators(spark, tmp_path):
    raw = spark.read.option("header", True).csv(write(tmp_path, FILE))
    long = stages.YearsToLong(keyCol="Country", lo=1991, hi=1993).transform(raw)
    assert sorted({r.period for r in long.collect()}) == [1991, 1992, 1993]
    got = {r.key: r[3:] for r in stages.SeriesFeatures().transform(long).collect()}
    sums = long.groupBy("key", "period").sum("value").withColumnRenamed("sum(value)", "value")
    assert got == {r.key: r[2:] for r in series.latest_features(sums).collect()}


def test_years_out_of_range_and_missing(spark, tmp_path):
    raw = spark.read.option("header", True).csv(write(tmp_path, FILE))
    assert stages.YearsToLong(lo=2050, hi=2060).transform(raw).select("period").distinct().count() == 5
    with pytest.raises(ValueError, match="year columns"):
        stages.YearsToLong().transform(raw.select("Country", "x1"))


def test_empty_file(spark, tmp_path):
    rows = stages.feature_pipeline(BOUNDS).fit(
        spark.createDataFrame([], "Country string, `1990` string")).transform(
        spark.createDataFrame([("a", "1")], "Country string, `1990` string")).collect()
    assert [(r.key, r.value, r.ofr, r.ofr_change, r.price_index) for r in rows] == [("A", 1.0, 100.0, None, 100.0)]
