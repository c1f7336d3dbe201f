import importlib

import public_tokenizers
import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.conftest import ROWS, SCHEMA
from tests.llm.test_counts_packing import check_packed
from tests.llm.test_simhash import finger, groups
from tests.llm.test_suffix_dedup import brute
from tidal.llm import mixing, toxicity


def test_stages_equal_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    cols = docs.columns
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    data = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] not in bad}
    one = corpus_pipeline.drop_toxic(spark, docs, SF_SMALL)
    assert one.columns == cols and {r["doc_id"]: r for r in one.collect()} == data

    ids = sorted(data)
    comp = groups(ids, [finger(data[i]["text"]) for i in ids])
    data = {i: data[i] for n, i in enumerate(ids) if comp[n] == i}
    two = corpus_pipeline.drop_near_duplicates(spark, one, SF_SMALL)
    assert two.columns == cols and {r["doc_id"]: r for r in two.collect()} == data

    ids = sorted(data)
    text = {i: kept.decode("utf-8", "ignore") for i, (_, _, kept) in zip(ids, brute([data[i]["text"] for i in ids], corpus_pipeline.PASSAGE))}
    three = corpus_pipeline.drop_repeated_passages(spark, two, SF_SMALL)
    assert three.columns == cols
    got = {r["doc_id"]: r for r in three.collect()}
    assert {i: r["text"] for i, r in got.items()} == text
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == data[i]["lang"] for i, r in got.items())

    times = {r["doc_id"]: r["repeats"] for r in mixing.mix(three).collect()}
    four = corpus_pipeline.mix_sources(spark, three, SF_SMALL)
    assert four.columns == cols
    count = {}
    for r in four.collect():
        assert r == got[r["doc_id"]]
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {i: n for i, n in times.items() if n}

    path = public_tokenizers.path("word_bpe_49k.json")
    n, total = check_packed(corpus_pipeline.pack_sequences(spark, four, SF_SMALL), four, path, 4096, 1)
    assert n <= -(-total // 4096) + 1


def test_repeated_passages_of_over_fifty_words_go(spark):
    import random
    rng = random.Random(9)

    def prose(n):
        return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n))
    passages = [prose(51) for _ in range(12)]
    texts = [f"{prose(80)} {passages[n % 12]} {prose(80)}" for n in range(36)]
    clean = [prose(200) for _ in range(30)]
    df = spark.createDataFrame([(n, t, "en", "a", len(t)) for n, t in enumerate(texts + clean)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, df, SF_SMALL).collect()}
    assert all(len(passages[n % 12].encode()) >= corpus_pipeline.PASSAGE for n in range(36))
    assert all(len(t) - len(got[n]) >= len(passages[n % 12]) for n, t in enumerate(texts))
    assert all(got[36 + n] == t for n, t in enumerate(clean))


def test_odd_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(2, 0), (4, 1)], "doc_id long, toxic int")
    for name, rows in (("odd", ROWS), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.count() >= (1 if rows else 0) and "sequence_id" in out.columns
        assert rows or not out.count()


def test_rows_that_share_an_id_are_judged_each(spark, monkeypatch):
    nouns = "river stone cloud engine paper garden winter copper signal harbour".split()
    texts = [" ".join(f"{w}{n * k}" for k, w in enumerate(nouns * 3)) for n in range(1, 7)]
    data = [(None, texts[0], "en", "a", 1), (None, texts[1], "en", "b", 1), (None, texts[2], "en", "b", 1),
            (None, texts[2], "en", "b", 1), (7, texts[3], "en", "a", 1), (7, texts[4], "en", "c", 1),
            (7, texts[4], "en", "c", 1), (8, texts[4], "en", "c", 1), (None, texts[5], "en", "c", 1),
            (9, texts[5], "en", "c", 1), (None, None, None, None, None)]
    odd = spark.createDataFrame(data, SCHEMA)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, odd, SF_SMALL).collect()]
    want = [data[i] for i in (0, 1, 2, 4, 5, 9, 10)]
    assert sorted(got, key=str) == sorted(want, key=str)

    from pyspark.sql import functions as F
    bad = [texts[1], texts[3]]
    monkeypatch.setattr(toxicity, "toxicity", lambda d, labels, key="doc_id": d.select(
        "doc_id", F.coalesce(F.col("text").isin(bad).cast("int"), F.lit(0)).alias("predicted"), *{key} - {"doc_id"}))
    got = [tuple(r) for r in corpus_pipeline.drop_toxic(spark, odd, SF_SMALL).collect()]
    assert sorted(got, key=str) == sorted([r for r in data if r[1] not in bad], key=str)

    times = sorted(r["repeats"] for r in mixing.mix(odd).collect())
    assert len(set(times)) > 1 and corpus_pipeline.mix_sources(spark, odd, SF_SMALL).count() == sum(times)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_names(name):
    assert name
