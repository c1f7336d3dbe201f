import math

import numpy as np
import pytest

from tests.conftest import SF_CHECK
from tests.llm.conftest import rows
from tidal.llm import negatives

COLS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, every=100, positives=5, k=5, share=80):
    """All pairs, in Python integers; ``data``: (vec_id, vector, label)."""
    sound = [(i, [math.floor(256 * float(c)) for c in v], lab) for i, v, lab in data
             if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]

    def order(pair):
        return -pair[0], pair[1] is None, pair[1] or 0

    out = []
    for n, (a, x, lab) in enumerate(sound):
        if a is None or a % every:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), i, other) for m, (i, y, other) in enumerate(sound)
                  if m != n and len(y) == len(x)]
        for ps, p in sorted(((s, i) for s, i, other in scored if other == lab), key=order)[:positives]:
            inside = [(s, i) for s, i, other in scored if other != lab and share * ps <= 100 * s <= 100 * ps]
            out += [(a, p, r + 1, i, ps, s) for r, (s, i) in enumerate(sorted(inside, key=order)[:k])]
    return sorted(out, key=str)


def relabel(data):
    return [(i, v, (lab + 1) % 10 if lab is not None and i is not None and i % 7 == 0 else lab) for i, v, lab in data]


def test_query_equals_brute_force(spark):
    from tidal.llm.queries import QUERIES
    data = [tuple(r) for r in spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()]
    got = rows(QUERIES["op11_hard_negatives"](spark, SF_CHECK), *COLS)
    assert sorted(got, key=str) == brute(relabel(data)) and len(got) > 20


def test_query_equals_its_sql(spark):
    import duckdb

    from tests.conftest import SF_BENCH
    from tidal.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_BENCH}/embeddings.parquet')")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({ORACLE['op11_hard_negatives']})").fetchall()
    assert sorted(want) == sorted(rows(QUERIES["op11_hard_negatives"](spark, SF_BENCH), *COLS))


@pytest.mark.parametrize("width", [3, 64, 100])
def test_bounds_hold(width):
    rng = np.random.default_rng(width)
    x = np.floor(rng.standard_normal((500, width)) * 256).astype(np.int64)
    x[0] = 0
    x[1] = x[2]
    turn = negatives.rotation(width)
    assert np.allclose(turn.T @ turn, np.eye(width))
    codes = negatives.Codes(x, turn)
    for anchor in (x[2], x[3], x[0], -x[4], x[5] * 1000):
        low, high = codes.bounds(anchor, turn)
        exact = x @ anchor
        assert (low <= exact).all() and (exact <= high).all()
        if anchor.any():
            # the interval is far narrower than what lengths alone allow
            assert np.mean(high - low) < 0.8 * 2 * np.mean(codes.norm) * np.linalg.norm(anchor)


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((4, width))
    return [(i, (centre[i % 4] + 0.4 * rng.standard_normal(width)).astype(np.float32).tolist(), int(rng.integers(3)))
            for i in range(n)]


def test_clusters_ties_and_blocks(spark):
    data = clustered(900, 8, 3)
    data += [(2000 + i, data[5][1], i % 3) for i in range(60)]  # copies under several labels: ties by id
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(data, every=20)
    for size in (dict(), dict(block_rows=64, block_anchors=4)):
        assert sorted(rows(negatives.mine(df, every=20, **size), *COLS), key=str) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = clustered(40, 4, 1)
    data += [(100, None, 1), (200, [1.0, None, 1.0, 1.0], 1), (300, [1.0, nan, 1.0, 1.0], 1), (400, [inf, 1.0, 1.0, 1.0], 1),
             (500, [1.0, 1.0, 1.0, 1.0], None), (None, data[3][1], 0), (None, data[4][1], 1), (600, [0.0] * 4, 1),
             (700, [], 0), (800, [2.0, 1.0], 0), (801, [2.0, 1.0], 0), (802, [1.9, 1.0], 1), (10, data[9][1], 1),
             data[20], data[20], (-20, data[8][1], 2)]
    df = spark.createDataFrame(data, SCHEMA).selectExpr(
        "*", "'x' AS key", "1 AS block", "2 AS width", "'r' AS rows", "3 AS score", "4 AS vector")
    got = rows(negatives.mine(df.repartition(3), every=10), *COLS)
    assert sorted(got, key=str) == brute(data, every=10)
    assert rows(negatives.mine(df.limit(0))) == []
    assert rows(negatives.mine(df.filter("vec_id % 100 <> 0"))) == []
    with pytest.raises(Exception, match="too large"):
        negatives.mine(spark.createDataFrame([(0, [1e30], 1)], SCHEMA)).collect()
