"""Maximum-likelihood ARIMA: the likelihood, the search, batches, and the jobs that use them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidal.operators import arima, forecast


def dense_likelihood(z, phi, theta):
    """Gaussian log likelihood from the whole covariance matrix, variance concentrated out."""
    n, m = len(z), 4000
    psi = np.zeros(m)
    for j in range(m):
        psi[j] = (1.0 if j == 0 else theta[j - 1] if j <= len(theta) else 0.0) + sum(
            phi[i] * psi[j - i - 1] for i in range(len(phi)) if j - i - 1 >= 0)
    gamma = np.array([psi[:m - k] @ psi[k:] for k in range(n)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    scale = z @ np.linalg.solve(cov, z) / n
    return -0.5 * (n * (np.log(2 * np.pi * scale) + 1) + np.linalg.slogdet(cov)[1])


def simulate(rng, n, phi, theta):
    e = rng.normal(size=n + 200)
    z = np.zeros(n + 200)
    for t in range(2, n + 200):
        z[t] = e[t] + sum(a * z[t - i - 1] for i, a in enumerate(phi)) + sum(b * e[t - j - 1] for j, b in enumerate(theta))
    return z[200:]


@pytest.mark.parametrize("p,q", [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)])
def test_likelihood_equals_the_dense_one(p, q):
    rng = np.random.default_rng(p * 3 + q)
    phi = arima.coefficients(rng.uniform(-0.9, 0.9, (5, p)))
    theta = -arima.coefficients(rng.uniform(-0.9, 0.9, (5, q)))
    start = np.array([0, 3, 0, 11, 20])
    z = rng.normal(size=(5, 30))
    got = arima.kalman(z, start, phi, theta)
    want = [dense_likelihood(z[i, start[i]:], phi[i], theta[i]) for i in range(5)]
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("phi,theta", [((), (0.6,)), ((), (-0.5,)), ((0.7,), (0.4,)), ((-0.6,), (0.3,)), ((0.5, -0.3), (0.4,))])
def test_parameters_of_simulated_series_are_recovered(phi, theta):
    rng = np.random.default_rng(7)
    z = np.stack([simulate(rng, 500, phi, theta) for _ in range(30)])
    a, b, _ = arima.estimate(z, np.zeros(30, int), len(phi), len(theta))
    for got, want in ((a, phi), (b, theta)):
        for j, c in enumerate(want):
            assert abs(np.median(got[:, j]) - c) < 0.05 and np.mean(np.abs(got[:, j] - c)) < 0.12


def two_regressions(z, p, q):
    """The estimate of a long autoregression and a regression on its residuals, inside the allowed region."""
    n, m = len(z), min(max(p, q) + 3, len(z) // 3)
    lagged = np.column_stack([z[m - i - 1:n - i - 1] for i in range(m)])
    e = np.zeros(n)
    e[m:] = z[m:] - lagged @ np.linalg.lstsq(lagged, z[m:], rcond=None)[0]
    s = m + max(p, q)
    cols = [z[s - i - 1:n - i - 1] for i in range(p)] + [e[s - j - 1:n - j - 1] for j in range(q)]
    c = np.linalg.lstsq(np.column_stack(cols), z[s:], rcond=None)[0]
    out = []
    for x in (c[:p], c[p:]):
        total = np.abs(x).sum()
        out.append(x * (0.98 / total) if total >= 0.98 else x)
    return out


def test_likelihood_is_at_least_that_of_two_regressions_on_every_supplier(spark):
    from tidal.plans.views import supplier_month
    rows = supplier_month(spark, "/root/testdata/sf0.01").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("period", "value"))).alias("s")).collect()
    series = [np.diff([x["value"] for x in r["s"]]) for r in rows]
    series = [z / np.std(z) for z in series if len(z) > 25]
    assert len(series) >= 90
    for p, q in ((0, 1), (1, 1), (1, 2), (2, 1)):
        longest = max(map(len, series))
        wide = np.stack([np.concatenate([np.zeros(longest - len(z)), z]) for z in series])
        start = np.array([longest - len(z) for z in series])
        found = arima.estimate(wide, start, p, q)[2]
        old = [two_regressions(z, p, q) for z in series]
        phi, theta = (np.stack([o[k] for o in old]).reshape(len(series), -1) for k in (0, 1))
        assert (found >= arima.kalman(wide, start, phi, theta) - arima.GAIN).all(), (p, q)


def test_series_side_by_side_equal_single_ones():
    rng = np.random.default_rng(3)
    series = [np.cumsum(rng.normal(size=n)) * 10.0 ** k + 5 for k, n in enumerate((5, 6, 9, 18, 40, 83))]
    series += [np.full(12, 3.0), np.arange(9.0), np.array([1.0, np.nan, 2, 3, 4, 5]), np.ones(4), np.zeros(0)]
    for order in forecast.ORDERS:
        for got, y in zip(arima.fit(series, *order, 4), series):
            one = arima.fit([y], *order, 4)[0]
            assert (got is None) == (one is None)
            if got:
                assert np.allclose(got[0], one[0], equal_nan=True) and np.allclose(got[1], one[1])
                assert len(got[0]) == len(y) and np.isnan(got[0][0]) and len(got[1]) == 4
    assert [g is None for g in arima.fit(series, 0, 1, 0, 2)][-3:] == [True, True, True]
    assert arima.fit([np.full(12, 3.0)], 1, 1, 1, 2)[0][1].tolist() == [3.0, 3.0]


def test_chosen_orders_of_keys_with_and_without(spark):
    rows = [(k, t, float((t * 7 + k) % 11)) for k in range(4) for t in range(30)] + [(9, 0, 4.0), (9, 1, None), (8, 0, None)]
    h = spark.createDataFrame(rows, "key long, period int, value double")
    chosen = spark.createDataFrame([(0, 0, 1, 1), (1, 1, 1, 1), (2, 0, 1, 0), (9, 1, 1, 2)], "key long, p int, d int, q int")
    got = {}
    for r in forecast.forecast_chosen(h, chosen, 3).orderBy("period").collect():
        got.setdefault(r["key"], []).append((r["period"], r["forecast"]))
    assert sorted(got) == [0, 1, 2, 3, 8, 9] and all(len(v) == 3 for v in got.values())
    y = np.array([float((t * 7) % 11) for t in range(30)])[-forecast.TRAIN_CAP:]
    assert [v for _, v in got[0]] == pytest.approx(arima.fit([y], 0, 1, 1, 3)[0][1].tolist())
    assert got[2] == [(30, float((29 * 7 + 2) % 11)), (31, float((29 * 7 + 2) % 11)), (32, float((29 * 7 + 2) % 11))]
    assert got[9] == [(2, 4.0), (3, 4.0), (4, 4.0)] and got[8] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_backtest_report_of_its_written_rows(spark):
    """The metrics of ``backtest`` are those of the rows of ``backtest_predictions``."""
    from __spark_entry__ import queries
    q = queries()
    rows = [r for r in q["backtest_predictions"](spark, SF_SMALL).collect() if r["actual"] is not None]
    for r in q["backtest"](spark, SF_SMALL).collect():
        for split, col in (("val", "val_mae"), ("test", "test_mae")):
            off = [abs(x["actual"] - x["forecast"]) for x in rows if x["key"] == r["key"] and x["split"] == split]
            name = next(c for c in r.asDict() if c.lower() == col)
            assert (r[name] is None) == (not off) and (not off or r[name] == pytest.approx(np.mean(off), abs=1e-3))


def textbook_filter(z, phi, theta, ahead):
    """Predictions and forecasts of one series by the Kalman filter in matrices."""
    r = max(len(phi), len(theta) + 1)
    move = np.eye(r, k=1)
    move[:len(phi), 0] = phi
    load = np.concatenate([[1.0], theta, np.zeros(r - 1 - len(theta))])
    noise = np.outer(load, load)
    cov = np.linalg.solve(np.eye(r * r) - np.kron(move, move), noise.ravel()).reshape(r, r)
    state, fitted, future = np.zeros(r), [], []
    for x in z:
        fitted.append(state[0])
        state = move @ (state + cov[:, 0] / cov[0, 0] * (x - state[0]))
        cov = move @ (cov - np.outer(cov[:, 0], cov[0]) / cov[0, 0]) @ move.T + noise
    for _ in range(ahead):
        future.append(state[0])
        state = move @ state
    return np.array(fitted), np.array(future)


@pytest.mark.parametrize("p,q", [(0, 0), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 3), (3, 0), (3, 1), (4, 4)])
def test_filter_equals_the_textbook_one(p, q):
    rng = np.random.default_rng(10 * p + q)
    phi = arima.coefficients(rng.uniform(-0.9, 0.9, (6, p)))
    theta = -arima.coefficients(rng.uniform(-0.9, 0.9, (6, q)))
    z, start = rng.normal(size=(6, 40)), np.array([0, 0, 5, 17, 30, 34])
    value, fitted, future = arima.kalman(z, start, phi, theta, 5)
    assert value == pytest.approx(arima.kalman(z, start, phi, theta))
    for i in range(6):
        one, ahead = textbook_filter(z[i, start[i]:], phi[i], theta[i], 5)
        assert np.isnan(fitted[i, :start[i]]).all()
        assert np.allclose(fitted[i, start[i]:], one) and np.allclose(future[i], ahead)


def test_the_grid_computes_its_covariances_once_for_all_series(monkeypatch):
    """No covariance of a grid point per series: they do not depend on the data."""
    sizes, stationary = [], arima._stationary
    monkeypatch.setattr(arima, "_stationary", lambda phi, load: sizes.append(load[0].size) or stationary(phi, load))
    arima.estimate(np.random.default_rng(1).normal(size=(50, 30)), np.zeros(50, int), 1, 2)
    assert sizes[0] == len(arima.GRID) ** 3


def test_tasks_of_few_series_are_not_made(spark):
    """One task of many series and not one for each shuffle partition: at most the session's own cores."""
    from tidal.plans import q_forecast
    p = spark.range(3 * q_forecast.SERIES_PER_TASK // 100).selectExpr("CAST(id AS string) AS key").crossJoin(
        spark.range(40, 69).selectExpr("CAST(id AS int) AS period")).withColumn("actual", (F.hash("key", "period") % 100).cast("double"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        table = q_forecast.arima_candidate_table(spark, SF_SMALL, p)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert table.select("key").distinct().count() == 30
    assert len(table.inputFiles()) <= max(1, spark.sparkContext.defaultParallelism)
