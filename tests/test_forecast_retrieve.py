"""ARIMA estimator, model selection, k-NN paths and LSH recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidal.operators import forecast, retrieve
from tidal.operators.ann import knn_lsh
from tidal.sources.tables import read_table


def test_arima_010_is_naive():
    y = np.array([3.0, 5.0, 4.0, 8.0, 9.0, 7.0])
    fitted, fc = forecast.arima_fit_forecast(y, 0, 1, 0, 3)
    assert list(fc) == [7.0, 7.0, 7.0]
    assert np.isnan(fitted[0]) and list(fitted[1:]) == list(y[:-1])


def test_arima_too_short_is_dropped():
    assert forecast.arima_fit_forecast(np.array([1.0, 2.0, 3.0, 4.0]), 1, 1, 1, 2) is None


def test_arima_recovers_ar1_of_differences():
    rng = np.random.default_rng(0)
    phi, n = 0.6, 400
    z = np.zeros(n)
    for t in range(1, n):
        z[t] = phi * z[t - 1] + rng.normal()
    y = np.cumsum(z) + 100
    fitted, fc = forecast.arima_fit_forecast(y, 1, 1, 0, 1)
    expected = y[-1] + phi * (y[-1] - y[-2])
    assert abs(fc[0] - expected) < 0.25


def test_choose_order_rules(spark):
    c = spark.createDataFrame(
        [("k", "full", 0, 0, 100.0), ("k", "full", 1, 1, 95.0), ("k", "full", 2, 2, 80.0),
         ("k", "capped", 0, 0, 90.0), ("k", "capped", 1, 1, 90.0)],
        "key string, train_window string, order_idx int, complexity int, val_mae double")
    w = forecast.choose_window(c).collect()[0]
    assert w.train_window == "full"  # 90 > 80 * 1.12
    simple = {r.train_window: r.order_idx for r in forecast.choose_order(c, "simple").collect()}
    best = {r.train_window: r.order_idx for r in forecast.choose_order(c, "best").collect()}
    assert simple == {"full": 2, "capped": 0} and best == {"full": 2, "capped": 0}


def test_fit_candidates_rows(spark):
    rows = [("a", t, float(t % 5 + t)) for t in range(30)]
    df = spark.createDataFrame(rows, "key string, period int, value double")
    out = forecast.fit_candidates(df, 30, 4, cap=18)
    fc = out.filter("kind = 'fc'").groupBy("train_window", "order_idx").count().collect()
    assert all(r["count"] == 4 for r in fc) and {r.train_window for r in fc} == {"full", "capped"}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_blocks_agree_and_match_brute_force(spark, metric):
    emb = read_table(spark, SF_SMALL, "embeddings")
    q = emb.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")).filter("vec_id < 12")
    one = sorted(tuple(r) for r in retrieve.knn(emb, q, 3, metric).collect())
    blocked = sorted(tuple(r) for r in retrieve.knn(emb, q, 3, metric, block_bytes=5 * 64 * 8).collect())
    assert [r[:3] for r in one] == [r[:3] for r in blocked]
    assert [r[3] for r in one] == pytest.approx([r[3] for r in blocked], abs=1e-12)
    rows = {r.vec_id: np.array(r.embedding, float) for r in emb.collect()}

    def key(a, b):
        return ((a - b) ** 2).sum() if metric == "l2" else -(a @ b) / np.sqrt((a @ a) * (b @ b))
    for qid in range(12):
        want = sorted(rows, key=lambda i: (round(key(rows[i], rows[qid]), 9), i))[:3]
        assert [i for q_, _, i, _ in one if q_ == qid] == want


def test_knn_leaves_out_unsound_vectors(spark):
    nan = float("nan")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]),
                                 (6, [1.0, 0.0]), (7, []), (8, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None)], "qid string, qvec array<double>")
    assert [(r.qid, r["rank"], r.vec_id) for r in retrieve.knn(emb, q, 5).collect()] == [("a", 1, 1), ("a", 2, 6)]
    assert [r.vec_id for r in retrieve.knn(emb, q, 5, "l2").collect()] == [1, 6, 5]
    assert retrieve.knn(emb, q.filter("qid = 'b'"), 5).collect() == []
    assert retrieve.knn(emb.limit(0), q, 5).collect() == []


def test_knn_plan_prelimits_per_partition(spark):
    emb = read_table(spark, SF_SMALL, "embeddings")
    plan = retrieve.knn(emb, retrieve.label_queries(emb), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_lsh_recall_vs_exact(spark):
    emb = read_table(spark, "/root/testdata/sf0.01", "embeddings")
    q = retrieve.label_queries(emb)
    exact = {(r.qid, r.vec_id) for r in retrieve.knn(emb, q, 5, "cosine").collect()}
    approx = {(r.qid, r.vec_id) for r in knn_lsh(emb, q, 5).collect()}
    assert len(exact & approx) / len(exact) >= 0.8


def test_pluggable_embedder_batches(spark):
    from tidal.operators import embed
    calls = []

    def toy(texts):
        calls.append(len(texts))
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    df = spark.range(0, 300).select(F.col("id"), F.concat(F.lit("a" * 3), F.col("id").cast("string")).alias("content"))
    out = embed.embed_with(df.coalesce(1), toy, batch=96).orderBy("id").collect()
    assert len(out) == 300 and list(out[0].embedding) == [4.0, 3.0]


def test_regressor_save_and_report(spark, tmp_path):
    from tidal.operators import ml
    rows = [(float(i), float(i % 7), float(2 * i + 1), "train" if i < 80 else "test") for i in range(100)]
    df = spark.createDataFrame(rows, "f0 double, f1 double, target double, split string")
    model, pred = ml.train_price_regressor(df, ["f0", "f1"], max_depth=4)
    rep = ml.regression_report(pred)
    ml.save_model_and_report(model, rep, str(tmp_path / "m"))
    from pyspark.ml.regression import RandomForestRegressionModel
    assert RandomForestRegressionModel.load(str(tmp_path / "m" / "model")).getNumTrees == ml.N_TREES
    assert spark.read.json(str(tmp_path / "m" / "report")).count() == 2
