"""Edge series (hand-computed) and a step-by-step loop as brute force for the window forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import series_df
from tidal.operators import series


def loop_chain(values, beta=0.5, floor=True):
    """Brute force of the enrich rules: positive baseline, zero -> NULL, floored price."""
    base = next((v for v in values if v is not None and v > 0), None)
    ofr = [None if base is None or v is None or v == 0 else v / base * 100 for v in values]
    chg = [None]
    for i in range(1, len(values)):
        p, c = ofr[i - 1], ofr[i]
        chg.append((c - p) / p * 100 if p not in (None, 0) and c is not None else None)
    price, out = 100.0, []
    for i, ch in enumerate(chg):
        if i > 0 and ch is not None:
            price = price * (1 + beta * (ch / 100))
        if floor:
            price = max(0.0, price)
        out.append(price)
    infl = [None]
    for i in range(1, len(out)):
        p = out[i - 1]
        infl.append((out[i] - p) / p * 100 if p != 0 else None)
    return ofr, chg, out, infl


def run_chain(spark, values):
    rows = [("k", i, v) for i, v in enumerate(values)]
    df = series.index_chain(series_df(spark, rows)).orderBy("period").collect()
    return ([r.ofr for r in df], [r.ofr_change for r in df], [r.price_index for r in df],
            [r.inflation_pct for r in df])


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("values", [
    [0.0, 0.0, 5.0, 10.0],          # leading zeros
    [10.0, 0.0, 5.0],               # internal zero
    [10.0, None, 20.0],             # internal NULL
    [None, None, None],             # all NULL
    [0.0, 0.0],                     # all zero
    [7.0],                          # single point
    [5.0, 5.0],                     # two equal
    [10.0, -30.0, 20.0],            # negative -> factor <= 0 -> floor, stays 0
])
def test_index_chain_edges(spark, values):
    got = run_chain(spark, values)
    want = loop_chain(values)
    for g, w in zip(got, want):
        assert all(close(a, b) for a, b in zip(g, w)), (values, got, want)


def test_index_chain_random_matches_loop(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for k in range(40):
        vals = [None if rng.random() < 0.1 else (0.0 if rng.random() < 0.1 else rng.uniform(-20, 200))
                for _ in range(rng.randint(1, 25))]
        expected[str(k)] = loop_chain(vals)
        rows += [(str(k), i, v) for i, v in enumerate(vals)]
    out = series.index_chain(series_df(spark, rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r.key, []).append(r)
    for k, rs in by.items():
        rs.sort(key=lambda r: r.period)
        want_price = expected[k][2]
        # start value folded into the first factor: exactly the loop's multiplication order
        assert [r.price_index for r in rs] == want_price


def test_feature_rules_keep_zero_gives_inf(spark):
    df = series.latest_features(series_df(spark, [("k", 0, 0.0), ("k", 1, 0.0), ("k", 2, 5.0), ("k", 3, 10.0)]))
    r = df.collect()[0]
    assert r.ofr == 200.0 and r.ofr_change == 100.0 and math.isinf(r.price_index)


def test_pct_change_bridges_gaps_previous_actual_does_not(spark):
    from tidal.operators.evaluate import forecast_anomalies
    df = series_df(spark, [("k", 1, 10.0), ("k", 2, 20.0), ("k", 4, 40.0)])
    chg = {r.period: r.c for r in series.pct_change(df, "value", "c", zero="null").collect()}
    assert chg[4] == 100.0  # 20 -> 40 across the missing period 3
    pred = spark.createDataFrame([("k", 1, 10.0, 10.0), ("k", 2, 20.0, 10.0), ("k", 4, 40.0, 500.0)],
                                 "key string, period int, actual double, forecast double")
    an = forecast_anomalies(pred, 4).collect()
    assert an[0].last_actual == 40.0  # no row at period 3 -> the row's own actual


def test_golden_naive_metrics(spark):
    from tidal.operators.evaluate import eval_by_split
    val = [1250, 1350, 1350, 1450, 1450, 1450, 2050, 2050, 2650, 3250]
    test = [4000, 4780, 5560, 6360, 7200, 8050, 9000, 10000]
    rows = [("a", 2001 + i, float(v), 1300.0, "val") for i, v in enumerate(val)]
    rows += [("a", 2011 + i, float(v), 1300.0, "test") for i, v in enumerate(test)]
    df = spark.createDataFrame(rows, "key string, period int, actual double, forecast double, split string")
    m = eval_by_split(df).collect()[0]
    assert round(m.val_mae, 4) == 540.0 and round(m.val_rmse, 4) == 826.1356
    assert round(m.test_mae, 4) == 5568.75 and round(m.test_rmse, 4) == 5900.2553


def test_golden_change_and_rebased_price(spark):
    df = series_df(spark, [("a", 2017, 9000.0), ("a", 2018, 10000.0)])
    r = series.pct_change(df, "value", "c", zero="null").orderBy("period").collect()[-1]
    assert abs(r.c - 11.11111111) < 1e-6
    ofr0, p0, step = 10000.0, 1184.9148825849013, 145.5882352941171
    got = spark.range(1).select(series.rebased_price(F.lit(p0), F.lit(ofr0), F.lit(ofr0 + 7 * step)).alias("p"))
    assert abs(got.collect()[0].p - 1245.2932659401467) < 1e-9


def test_impute_and_tail(spark):
    df = series_df(spark, [("k", i, None if i == 2 else float(i)) for i in range(6)])
    filled = {r.period: r.value for r in series.impute_series_mean(df).collect()}
    assert filled[2] == (0 + 1 + 3 + 4 + 5) / 5
    assert sorted(r.period for r in series.tail_window(df, 2).collect()) == [4, 5]


def test_golden_anomaly_row(spark):
    from tidal.operators.evaluate import forecast_anomalies
    actual = {2011: 4000.0, 2012: 4780.0, 2013: 5560.0, 2014: 6360.0, 2015: 7200.0}
    rows = [("a", y, v, 1300.0) for y, v in actual.items()]
    pred = spark.createDataFrame(rows, "key string, period int, actual double, forecast double")
    out = {r.period: r for r in forecast_anomalies(pred, 2011).collect()}
    assert out[2015].last_actual == 6360.0 and out[2015].deviation == -5060.0


def test_join_horizons_matches_single_pass(spark):
    from tidal.operators import risk
    rows = [("k", p, float(p % 3) - 1.0, float(p % 2)) for p in range(10)]
    rows += [("j", p, float(p), None) for p in range(10)]
    df = spark.createDataFrame(rows, "key string, period int, ofr_change double, inflation_pct double")
    one = risk.horizon_risk(df, {"5": (0, 4), "10": (0, 9)})
    parts = {h: df.filter(F.col("period").between(lo, hi)).groupBy("key").agg(*risk.risk_components(df))
             for h, (lo, hi) in {"5": (0, 4), "10": (0, 9)}.items()}
    two = risk.join_horizons(parts)
    a = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in one.select(sorted(one.columns)).collect())
    b = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in two.select(sorted(two.columns)).collect())
    assert a == b


def test_eval_rollup_pooled_equals_overall(spark):
    from tidal.operators.evaluate import eval_overall, eval_rollup
    rows = [(k, p, float(p * (i + 1)), float(p), "train" if p < 5 else "val")
            for i, k in enumerate("abc") for p in range(10)]
    df = spark.createDataFrame(rows, "key string, period int, actual double, forecast double, split string")
    pooled = {r.split: (r.mae, r.rmse) for r in eval_rollup(df).filter("level = 'pooled'").collect()}
    overall = {r.split: (r.mae, r.rmse) for r in eval_overall(df).collect()}
    assert pooled.keys() == overall.keys()
    for s in pooled:
        assert all(abs(x - y) < 1e-9 for x, y in zip(pooled[s], overall[s]))
