"""Errors where a value would otherwise be chosen or a row lost without a word."""

import pytest

from tidal.operators import bands, reshape


def test_a_cell_given_twice_is_an_error(spark):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 9, 3.0)]
    schema = "key string, period int, value double"
    wide = reshape.pivot_series(spark.createDataFrame(rows, schema), [1, 2])
    assert sorted(map(tuple, wide.collect())) == [("a", 1.0, 2.0), ("b", None, None)]
    with pytest.raises(Exception, match="cannot be pivoted"):
        reshape.pivot_series(spark.createDataFrame(rows + [("a", 1, 5.0)], schema), [1, 2]).collect()


def test_an_unknown_band_is_an_error(spark):
    dim = bands.band_dimension(spark)
    good = spark.createDataFrame([("High", 1), ("low", 2)], "band string, n int")
    got = {r.band: r.explanation for r in bands.explain_band(good, "band", dim).collect()}
    assert got == {"High": bands.EXPLANATIONS["high"], "low": bands.EXPLANATIONS["low"]}
    for odd in ("severe", None):
        bad = good.unionAll(spark.createDataFrame([(odd, 3)], "band string, n int"))
        with pytest.raises(Exception, match="band must be"):
            bands.explain_band(bad, "band", dim).collect()
        assert bands.explain_band(bad, "band", dim, unknown="drop").count() == 2
