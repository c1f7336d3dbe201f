import zlib

import numpy as np

from tests.conftest import SF_BENCH
from tests.llm.conftest import rows
from tidal.llm import toxicity


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF_BENCH}/documents.parquet")
    labels = spark.read.parquet(f"{SF_BENCH}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    assert {r["doc_id"] for r in out if r["held_out"]} == {
        r["doc_id"] for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and truth.get(r["doc_id"]) in (0, 1)]
    caught = [p for p, t in held if t]
    clean = [p for p, t in held if not t]
    assert sum(caught) >= 0.6 * len(caught) and sum(clean) <= 0.01 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)


def test_held_out_labels_teach_nothing(spark, docs):
    from tests.conftest import SF_SMALL
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    from pyspark.sql import functions as F
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(docs, labels).collect()) == sorted(toxicity.toxicity(docs, flipped).collect())


def test_calibration():
    x = np.array([[0.0], [4.0], [8.0], [30.0]])
    b = toxicity.calibrate(np.r_[x, x], np.r_[np.zeros(4), np.ones(4)], np.array([90, 5, 2, 0.0, 1, 1, 3, 40]))
    p = 1 / (1 + np.exp(-(b[0] + b[1] * x[:, 0])))
    assert list(p) == sorted(p) and p[0] < 0.1 and p[-1] > 0.95


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(2, 0, 7), (4, 0, 7), (7, 1, 7), (7, 0, 7), (9, None, 7), (None, 1, 7), (5, 3, 7)],
                                   "doc_id long, toxic int, text int")
    got = rows(toxicity.toxicity(odd, labels))
    assert len(got) == odd.count() and all(0 <= r[2] <= 1 for r in got)
    assert rows(toxicity.toxicity(empty, labels)) == []
    assert {r[2] for r in rows(toxicity.toxicity(odd, labels.limit(0)))} == {0.5}
    long_word = spark.createDataFrame([(1, "q" * 200_000)], "doc_id long, text string")
    assert len(rows(toxicity.toxicity(long_word, labels))) == 1
