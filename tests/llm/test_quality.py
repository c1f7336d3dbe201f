import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from tests.conftest import SF_BENCH
from tests.llm.conftest import rows
from tidal.llm import quality

MARKS = ".,;:!?'\"-()"


def brute(text):
    """The statistics of one text, one character, word and line at a time."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shown = "".join(w)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    pairs = list(zip(w, w[1:]))
    upper, lower = (sum(a <= c <= b for c in shown) for a, b in ("AZ", "az"))

    def share(part, whole):
        return part / whole if whole else 0.0

    def symbol(c):
        return c < "\x80" and not (c.isalnum() or c in MARKS)

    return {
        "words": len(w), "word_length": share(len(shown), len(w)), "longest_word": max(map(len, w), default=0),
        "short_words": share(sum(len(x) <= 3 for x in w), len(w)), "upper": share(upper, upper + lower),
        "digits": share(sum("0" <= c <= "9" for c in shown), len(shown)),
        "marks": share(sum(c in MARKS for c in shown), len(shown)),
        "symbols": share(sum(map(symbol, shown)), len(shown)),
        "non_ascii": share(sum(c >= "\x80" for c in shown), len(shown)),
        "capitalised": share(sum("A" <= x[0] <= "Z" for x in w), len(w)),
        "ended": share(sum(x[-1] in MARKS or symbol(x[-1]) for x in w), len(w)),
        "exclaimed": share(text.count("!"), len(w)), "distinct_words": share(len(set(w)), len(w)),
        "top_word": share(max((w.count(x) for x in set(w)), default=0), len(w)),
        "repeated_next": share(sum(a == b for a, b in pairs), len(w)),
        "distinct_pairs": share(len(set(pairs)), len(pairs)), "lines": len(lines),
        "distinct_lines": share(len(set(lines)), len(lines)), "line_words": share(len(w), len(lines))}


def test_statistics_equal_brute_force():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "A!", "être ÉTÉ 你好 🙂", "x" * 2000, "one one one\none one one\n\n two"]
    texts += ["".join(rng.choices("ab cA\n!1é.$ ", k=rng.randint(0, 60))) for _ in range(300)]
    got = quality.statistics(pa.array(texts, pa.string()))
    for values, text in zip(got, texts):
        want = brute(text)
        assert list(want) == list(quality.STATS)
        assert values.tolist() == pytest.approx(list(want.values())), text


def met(rule, stats):
    return all(low < stats[name] <= high for name, low, high in rule.terms)


def test_rules_are_the_paths_of_a_tree():
    tree = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 5.5)
   If (feature 0 <= 2.5)
    Predict: 0.0
   Else (feature 0 > 2.5)
    Predict: 1.0
  Else (feature 0 > 5.5)
   If (feature 7 <= 1.0E-4)
    Predict: 0.0
   Else (feature 7 > 1.0E-4)
    Predict: 1.0
"""
    inf = math.inf
    assert [r.terms for r in quality.paths(tree)] == [
        (("words", -inf, 5.5),), (("words", -inf, 2.5),), (("words", 2.5, 5.5),), (("words", 5.5, inf),),
        (("symbols", -inf, 1e-4), ("words", 5.5, inf)), (("symbols", 1e-4, inf), ("words", 5.5, inf))]


def test_held_out_labels_and_scores_of_the_rules(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_BENCH}/documents.parquet")
    labels = spark.read.parquet(f"{SF_BENCH}/labels.parquet")
    fitted, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    out = quality.quality(docs, labels).collect()
    ensemble = fitted[0]
    assert 0 < len(ensemble.rules) < 200
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(out) == len(text)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out
            if r["held_out"] and truth.get(r["doc_id"]) in (0, 1)]
    bad, good = [p for p, t in held if not t], [p for p, t in held if t]
    assert sum(bad) <= 0.03 * len(bad) and sum(good) >= 0.99 * len(good)
    for r in out[:400]:
        stats = brute(text[r["doc_id"]])
        total = ensemble.base + sum(w for rule, w in ensemble.rules if met(rule, stats))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == (r["score"] >= 0.5)


def test_held_out_labels_teach_nothing(spark, docs):
    from pyspark.sql import functions as F

    from tests.conftest import SF_SMALL
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1,
                                                  1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.quality(docs, labels).collect()) == sorted(quality.quality(docs, flipped).collect())


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(2, 0, 7), (4, 0, 7), (7, 1, 7), (7, 0, 7), (9, None, 7), (None, 1, 7), (5, 3, 7)],
                                   "doc_id long, quality int, text int")
    got = rows(quality.quality(odd, labels))
    assert len(got) == odd.count() and all(0 <= r[2] <= 1 for r in got)
    assert rows(quality.quality(empty, labels)) == []
    assert {r[2] for r in rows(quality.quality(odd, labels.limit(0)))} == {0.5}
    assert {r[3] for r in rows(quality.quality(odd, labels.filter("quality = 0")))} == {0}
    long_word = spark.createDataFrame([(1, "q" * 3_000_000)], "doc_id long, text string")
    assert len(rows(quality.quality(long_word, labels))) == 1
