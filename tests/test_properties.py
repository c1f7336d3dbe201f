"""Property tests: bounds, constants, partitioning invariance."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidal.operators import risk, series

finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[finite] * 8), min_size=1, max_size=12))
def test_risk_score_in_unit_interval(spark, rows):
    cols = [f"{c}_{h}" for h in ("5", "10") for c in risk.COMPONENTS]
    df = spark.createDataFrame([(str(i),) + r for i, r in enumerate(rows)], ["key"] + cols)
    out = risk.risk_score(df, persist=False).collect()
    for r in out:
        assert 0.0 <= r.risk_score_5 <= 1.0 and 0.0 <= r.risk_score_10 <= 1.0


def test_min_max_constant_column_is_half(spark):
    df = spark.createDataFrame([(str(i), 3.0, float(i)) for i in range(5)], "key string, a double, b double")
    out = risk.min_max_norm(df, ["a", "b"]).orderBy("key").collect()
    assert [r.norm_a for r in out] == [0.5] * 5
    assert [r.norm_b for r in out] == [0.0, 0.25, 0.5, 0.75, 1.0]


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=9))
def test_index_chain_repartition_invariant(spark, n):
    rows = [(str(k), p, float((k * 7 + p * 3) % 11)) for k in range(6) for p in range(12)]
    df = spark.createDataFrame(rows, "key string, period int, value double")
    base = sorted(tuple(r) for r in series.index_chain(df).collect())
    shuffled = sorted(tuple(r) for r in series.index_chain(df.repartition(n)).collect())
    assert base == shuffled
