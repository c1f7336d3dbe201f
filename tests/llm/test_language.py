import zlib

from tests.conftest import SF_CHECK
from tests.llm.conftest import rows
from tidal.llm import language


def test_codewords_are_distinct_and_far_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = language.codewords(n)
        near = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert near >= code.shape[1] / 4 and near >= 1
        assert all(0 < b.sum() < n for b in code.T)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = language.identify(docs).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_predictions_do_not_read_labels(spark, docs):
    from pyspark.sql import functions as F
    a = language.identify(docs)
    held = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    b = language.identify(held.withColumn("lang", F.when(~F.col("h"), F.col("lang"))))
    assert sorted(a.collect()) == sorted(b.collect())


def test_odd_rows(odd, empty):
    got = rows(language.identify(odd), "doc_id", "lang_pred", "score")
    by = {r[0]: r[1:] for r in got}
    assert len(got) == odd.count()
    assert all(by[i] == ("und", 0.0) for i in (1, 2, 3, 8))
    assert by[4][0] == "en" and by[7][0] != "und"
    assert rows(language.identify(empty)) == []
    assert {r[1] for r in rows(language.identify(odd.withColumn("lang", odd["lang"].substr(9, 1)).filter("lang is null")),
                               "doc_id", "lang_pred")} <= {"und"}
