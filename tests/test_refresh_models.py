"""Embedding tables brought up to date, and reports of saved models."""

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidal.operators import bands, embed, ml
from tidal.plans import q_ml, q_sink
from tidal.sources import io

ROWS = [("a", "one text"), ("b", "another text"), ("c", "one text"), ("d", None), ("e", "")]


def _embed(texts):
    return texts.withColumn("embedding", F.array(F.length("content").cast("float")))


def _refresh(spark, base, rows, version="v1"):
    return embed.refresh_embeddings(base, spark.createDataFrame(rows, "k string, content string"), ["k"], _embed, version)


def test_only_new_and_changed_texts_are_embedded(spark, tmp_path):
    base = str(tmp_path / "t")
    assert _refresh(spark, base, ROWS) == 3  # two texts and the empty one
    stamp = {r.k: r.embedded_at for r in io.read_upsert_table(spark, base).collect()}
    assert _refresh(spark, base, ROWS) == 0
    changed = [("a", "a longer text")] + ROWS[1:]
    assert _refresh(spark, base, changed) == 1
    rows = {r.k: r for r in io.read_upsert_table(spark, base).collect()}
    assert {k: (r.content, r.embedding) for k, r in rows.items()} == {k: (t or "", [float(len(t or ""))]) for k, t in changed}
    assert rows["b"].embedded_at == stamp["b"] and rows["a"].embedded_at > stamp["a"]
    assert _refresh(spark, base, changed, "v2") == 4  # another embedder starts anew


def test_no_rows(spark, tmp_path):
    assert _refresh(spark, str(tmp_path / "t"), []) == 0


def test_refreshed_table_equals_a_fresh_one(spark):
    base, counts = q_sink.embedding_loads(spark, SF_SMALL)
    rows = q_sink.describe_rows(spark, SF_SMALL)
    fresh = {(r.source_type, r.source_id): (r.content, r.embedding) for r in embed.embed_hashing(rows).collect()}
    got = {(r.source_type, r.source_id): (r.content, r.embedding) for r in io.read_upsert_table(spark, base).collect()}
    assert got == fresh and counts[1] > 3 and counts[2] == 0


def test_saved_price_model(spark, tmp_path):
    path = str(tmp_path)
    data = q_ml.window_features(spark, SF_SMALL)
    pred = ml.price_regressor_job(data, [f"f{i}" for i in range(10)], path)
    assert pred.count() == data.count()
    sql = "SELECT key, avg(abs(target - prediction)), sqrt(avg((target - prediction) ** 2)) FROM read_parquet('{}/predictions/*.parquet') WHERE split = 'test' GROUP BY key"
    want = {r[0]: r[1:] for r in duckdb.sql(sql.format(path)).fetchall()}
    got = {r["key"]: (r["mae"], r["rmse"]) for r in spark.read.json(f"{path}/key_errors").collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], nan_ok=True) for k in got)
    assert {r["split"] for r in spark.read.json(f"{path}/report").collect()} == {"train", "val", "test"}


def test_saved_risk_model(spark, tmp_path):
    path = str(tmp_path)
    pred = ml.risk_classifier_job(q_ml.risk_features(spark, SF_SMALL), q_ml.RISK_FEATURES, path)
    rows = [(r["split"], r["band"], r["predicted"]) for r in pred.collect()]
    checks = spark.read.json(f"{path}/checks").first()
    for s in ("train", "val", "test"):
        mine = [b == p for t, b, p in rows if t == s]
        assert checks[f"{s}_errors"] == mine.count(False)
        assert checks[f"{s}_accuracy"] == pytest.approx(sum(mine) / len(mine))
    assert checks["overfitting_gap"] == pytest.approx(checks["train_accuracy"] - checks["val_accuracy"])
    report = {r["label"]: r for r in spark.read.json(f"{path}/report").collect()}
    for band in bands.LABELS:
        test = [(b, p) for t, b, p in rows if t == "test"]
        hit = sum(b == p == band for b, p in test)
        assert report[band]["support"] == sum(b == band for b, _ in test)
        assert report[band]["precision"] == pytest.approx(hit / max(1, sum(p == band for _, p in test)))


def test_two_class_model_after_an_observed_write(spark, tmp_path):
    """A session that has observed a write still predicts: the model's tasks do not carry the session."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(str(tmp_path / "seen"))
    assert seen.get == {"n": 3}
    rows = [(str(i), float(i % 10), "high" if i % 10 > 4 else "low", ("train", "val", "test")[i % 3]) for i in range(120)]
    model, pred = ml.train_risk_classifier(spark.createDataFrame(rows, "key string, x double, band string, split string"), ["x"])
    assert {r["split"]: (r["accuracy"], r["errors"], r["n"]) for r in ml.accuracy_report(pred).collect()} == {
        s: (1.0, 0, 40) for s in ("train", "val", "test")}
