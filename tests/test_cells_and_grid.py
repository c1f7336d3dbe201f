"""Inverted file of k-means cells, the k-NN grid, and the risk path on ARIMA forecasts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_BENCH, SF_SMALL
from tidal.operators import ann, retrieve
from tidal.sources.tables import read_table


def test_recall_and_rows_read_at_the_registered_parameters(spark, tmp_path):
    emb = read_table(spark, SF_BENCH, "embeddings")
    index = ann.build_cells(emb, str(tmp_path / "cells"))
    assert index.sizes.sum() == emb.count() and len(index.sizes) == round(emb.count() ** 0.5)
    q = emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = {(r.qid, r.vec_id) for r in retrieve.knn(emb, q, 5, "cosine").collect()}
    got = ann.knn_cells(index, q, 5).collect()
    found = {(r.qid, r.vec_id) for r in got}
    assert len(found) == 5 * q.count()
    assert len(exact & found) / len(exact) >= 0.9
    read = np.array([sum(index.sizes[r["cell"]] for r in rows) for rows in (
        g["cells"] for g in ann.probes(index, q, 5).groupBy("qid").agg(F.collect_list(F.struct("cell")).alias("cells")).collect())])
    assert read.mean() / index.sizes.sum() < ann.PROBED + 0.05
    scores = {(r.qid, r["rank"]): r.score for r in got}
    assert all(scores[i, k] >= scores[i, k + 1] - 1e-9 for i, k in scores if (i, k + 1) in scores)


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 16))
    rows = [(i, (centre[i % 20] + 0.1 * rng.normal(size=16)).tolist()) for i in range(2000)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_cells(emb, str(tmp_path / "cells"))
    q = emb.filter("vec_id < 60").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = {(r.qid, r.vec_id) for r in retrieve.knn(emb, q, 10).collect()}
    found = {(r.qid, r.vec_id) for r in ann.knn_cells(index, q, 10, probed=0.06).collect()}
    assert len(exact & found) / len(exact) >= 0.95
    one = ann.knn_cells(index, q.filter("qid = 0"), 10, probed=0.06)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_odd_vectors_and_short_tables(spark, tmp_path):
    nan = float("nan")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]),
                                 (6, [0.0, 2.0]), (7, [1.0, 0.1])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [0.0, 0.0])], "qid string, qvec array<double>")
    index = ann.build_cells(emb, str(tmp_path / "few"))
    assert [(r.qid, r["rank"], r.vec_id) for r in ann.knn_cells(index, q, 5).orderBy("rank").collect()] == [
        ("a", 1, 1), ("a", 2, 7), ("a", 3, 6)]
    none = ann.build_cells(emb.limit(0), str(tmp_path / "none"))
    assert none.sizes.sum() == 0


def test_lsh_drops_no_candidate_by_distance(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-0.6, 0.8])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qvec array<double>")
    got = ann.knn_lsh(emb, q, 5, bucket_length=100.0, num_tables=32).collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_grid_of_string_ids_and_many_groups(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    emb = spark.createDataFrame([(f"id{i:03d}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>")
    q = emb.limit(50).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    for block in (None, 6 * 8 * 7):
        got = {}
        for r in retrieve.knn(emb.repartition(5), q, 4, metric, block_bytes=block).collect():
            got.setdefault(r.qid, []).append((r["rank"], r.vec_id))
        for i in range(50):
            d = ((x - x[i]) ** 2).sum(1) if metric == "l2" else -(x @ x[i]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])
            assert [v for _, v in sorted(got[f"id{i:03d}"])] == [f"id{j:03d}" for j in np.lexsort((np.arange(300), d))[:4]]
    assert "toLocalIterator" not in open(retrieve.__file__).read()


def test_risk_of_arima_forecasts_equals_its_steps(spark):
    """Scores from ``risk_from_arima`` against numpy on the forecasts of ``arima_horizons``."""
    from __spark_entry__ import queries
    q = queries()
    risk = q["risk_from_arima"](spark, SF_SMALL).collect()
    future = q["arima_horizons"](spark, SF_SMALL)
    assert len(risk) == future.select("key").distinct().count()
    assert all(0 <= r["risk_score_5"] <= 1 and 0 <= r["risk_score_10"] <= 1 for r in risk)
    from tidal.plans import q_forecast as qf
    from tidal.operators import series
    hist = series.impute_series_mean(qf.history(spark, SF_SMALL)).select("key", "period", "value")
    rows = {}
    for r in hist.unionByName(future.withColumnRenamed("forecast", "value")).collect():
        rows.setdefault(r["key"], []).append((r["period"], r["value"]))
    (lo, hi), sums = qf.HORIZONS["10"], {}
    for key, s in rows.items():
        s.sort()
        base = next((v for _, v in s if v is not None and v > 0), None)
        ofr = [(t, None if v in (None, 0) or base is None else v / base * 100) for t, v in s]
        change = [(t, None if a in (None, 0) or b is None else (b - a) / a * 100) for (_, a), (t, b) in zip(ofr, ofr[1:])]
        sums[key] = sum(c for t, c in change if lo <= t <= hi and c is not None)
    got = {r["key"]: r["sum_ofr_change_10"] for r in risk}
    assert all(got[k] == pytest.approx(sums[k], rel=1e-4, abs=1e-3) for k in got)
