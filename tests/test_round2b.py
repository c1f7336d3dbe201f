"""References of all kinds, gap filling, naive fallback, chosen orders, requested bands, context headers."""

import html

import pytest
from pyspark.sql import functions as F

from tidal.operators import forecast, reshape, retrieve, text


@pytest.mark.parametrize("raw", [
    "plain", "a &amp;lt; b", "&eacute;&hellip;&nbsp;x", "&#8212;&#x1F600;&#X41;", "&unknown; & &;", "&#0;&#xD800;&#1114112;",
    "&#150;&#128;", "tail &copy", "&NotEqualTilde;!", "&&amp;&", ""])
def test_references_match_python(spark, raw):
    got = spark.createDataFrame([(raw,)], "t string").select(text.decode_references(F.col("t"))).first()[0]
    want = html.unescape(raw) if not raw.endswith("&copy") else raw  # only references with a semicolon
    assert got == want


def test_null_text_stays_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(text.decode_references(F.col("t"))).first()[0] is None


def test_densify_gaps_and_ranges(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 6, None), ("b", 1, 2.0), ("c", 20, 9.0), ("d", -5, 1.0), ("d", 2, 4.0)],
                               "key string, period int, value double")
    got = {(r.key, r.period): r.value for r in reshape.densify(df, lo=1, hi=7).collect()}
    assert len(got) == 28 and {k for k, _ in got} == set("abcd")
    assert {k: v for k, v in got.items() if v is not None} == {("a", 3): 1.0, ("b", 1): 2.0, ("d", 2): 4.0}
    own = sorted((r.key, r.period, r.value) for r in reshape.densify(df, fill=0.0, per_key_range=True).collect()
                 if r.key in "ab")
    assert own == [("a", 3, 1.0), ("a", 4, 0.0), ("a", 5, 0.0), ("a", 6, 0.0), ("b", 1, 2.0)]
    assert reshape.densify(df.limit(0), lo=1, hi=7).collect() == []


def test_densify_rejects_duplicates(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 3, 2.0)], "key string, period int, value double")
    with pytest.raises(Exception, match="duplicate cell"):
        reshape.densify(df, lo=1, hi=4).collect()


def test_keys_without_a_fit_fall_back(spark):
    grid = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 5.0), ("b", 2, 7.0), ("b", 3, None), ("c", 1, None), ("c", 3, 2.0)],
                                 "key string, period int, value double")
    fitted = spark.createDataFrame([("a",)], "key string")
    got = sorted((r.key, r.period, r.kind, r.forecast) for r in forecast.naive_fallback(grid, fitted, 2).collect())
    assert got == [("b", 1, "fit", 5.0), ("b", 2, "fit", 7.0), ("b", 3, "fc", 7.0), ("c", 1, "fit", None), ("c", 3, "fc", 0.0)]


def test_chosen_order_forecasts(spark):
    rows = [("a", i, float(i * i)) for i in range(30)] + [("b", 7, 3.0), ("n", 1, None)]
    hist = spark.createDataFrame(rows, "key string, period int, value double")
    chosen = spark.createDataFrame([("a", 0, 1, 0)], "key string, p int, d int, q int")
    got = {(r.key, r.period): r.forecast for r in forecast.forecast_chosen(hist, chosen, 2).collect()}
    assert got == {("a", 30): 841.0, ("a", 31): 841.0, ("b", 8): 3.0, ("b", 9): 3.0, ("n", 2): 0.0, ("n", 3): 0.0}


def test_unsupported_order_is_an_error():
    with pytest.raises(ValueError):
        forecast.arima_fit_forecast([1.0] * 9, 0, 2, 0, 2)


def test_unknown_requests_are_medium(spark):
    asked = spark.createDataFrame([("a", "5"), ("a", "20"), ("x", "5")], "key string, horizon string")
    known = spark.createDataFrame([("a", "5", "high")], "key string, horizon string, band string")
    got = {(r.key, r.horizon): r.band for r in retrieve.requested_bands(asked, known).collect()}
    assert got == {("a", "5"): "high", ("a", "20"): "medium", ("x", "5"): "medium"}


def test_context_keeps_whole_texts_and_missing_parts(spark):
    long = "word " * 5000
    df = spark.createDataFrame([(1, 2, None, None, None), (1, 1, "s", "u", long)],
                               "qid int, rank int, source string, url string, t string")
    got = retrieve.context_with_sources(df, "qid", "t").first()["context"]
    assert got == f"[1] (Source: s, URL: u)\n{long}\n\n---\n\n[2] (Source: , URL: )\n"
