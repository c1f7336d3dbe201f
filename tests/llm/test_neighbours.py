import numpy as np

from tests.conftest import SF_CHECK
from tests.llm.conftest import rows
from tidal.llm import neighbours


def brute(ids, x, k, every):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_scores_and_ranks(spark):
    emb = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    data = emb.collect()
    ids = np.array([r["vec_id"] for r in data])
    x = np.array([r["embedding"] for r in data], np.float64)
    want = brute(ids, x, 20, 20)
    place = {i: n for n, i in enumerate(ids)}
    got = {}
    for r in neighbours.nearest(emb, leaf_rows=8, share=2.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    found = 0
    for q, near in got.items():
        near.sort()
        assert [r[0] for r in near] == list(range(1, 21))
        assert all(abs(s - float((x[place[q]] * x[place[v]]).sum())) < 1e-12 for _, v, s in near)
        assert [(-s, v) for _, v, s in near] == sorted((-s, v) for _, v, s in near)
        found += len({v for _, v, _ in near} & {v for v, _ in want[q]})
    assert found / sum(map(len, want.values())) >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vec = [(i, [1.0, 2.0]) for i in range(1, 60)] + [(i, [3.0, -1.0 * i]) for i in range(100, 130)]
    bad = [(200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (260, [nan, 1.0]), (280, [inf, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "q") for i, v in vec + bad + vec[:3]], "vec_id long, embedding array<float>, leaf string")
    want = brute(np.array([i for i, _ in vec]), np.array([v for _, v in vec]), 20, 20)
    got = {}
    for r in neighbours.nearest(df, share=50.0, block_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want
    assert rows(neighbours.nearest(df.limit(0))) == []
    few = df.filter("vec_id in (20, 21)").distinct()
    assert rows(neighbours.nearest(few)) == [(20, 1, 21, 5.0)]
