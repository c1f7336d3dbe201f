import random
import re
from fractions import Fraction

import pytest

from tests.llm.conftest import rows
from tidal.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(size, weight, total, most):
    capped, target = set(), {}
    while True:
        left = Fraction(total) - sum(most * size[i] for i in capped)
        todo = [i for i in range(len(size)) if i not in capped]
        target = {i: left * weight[i] / sum(weight[j] for j in todo) for i in todo}
        new = {i for i in todo if target[i] > most * size[i]}
        if not new:
            return [float(target.get(i, most * size[i])) for i in range(len(size))]
        capped |= new


def test_targets():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 12)
        size = [rng.choice([0, rng.randint(1, 50), rng.randint(1, 5000)]) for _ in range(n)]
        weight = [i % 3 + 1 for i in range(n)]
        assert mixing.share_targets(size, weight, sum(size), 3) == brute_targets(size, weight, sum(size), 3)


def brute_flow(patterns, quotas, most):
    """Least cost of the largest flow, one word at a time along cheapest paths (Bellman-Ford)."""
    n, m = len(patterns), len(quotas)
    s, t = n + m, n + m + 1
    edges = []

    def add(u, v, c, w):
        edges.append([u, v, c, w])
        edges.append([v, u, 0, -w])
    for p, (src, words) in enumerate(patterns):
        for level in range(most):
            add(s, p, words, level)
        for q in src:
            add(p, n + q, 10**9, 0)
    for q, c in enumerate(quotas):
        add(n + q, t, c, 0)
    flow = cost = 0
    while True:
        dist, back = {s: 0}, {}
        for _ in range(n + m + 2):
            for i, (u, v, c, w) in enumerate(edges):
                if c and u in dist and dist[u] + w < dist.get(v, 10**9):
                    dist[v], back[v] = dist[u] + w, i
        if t not in dist:
            return flow, cost
        v = t
        while v != s:
            edges[back[v]][2] -= 1
            edges[back[v] ^ 1][2] += 1
            v = edges[back[v]][0]
        flow, cost = flow + 1, cost + dist[t]


def test_flow_is_largest_and_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        m = rng.randint(1, 4)
        patterns = [(tuple(rng.sample(range(m), rng.randint(1, m))), rng.randint(0, 6)) for _ in range(rng.randint(1, 5))]
        quotas = [rng.randint(0, 12) for _ in range(m)]
        out = mixing.route(patterns, quotas, 3)
        taken = [sum(f.values()) for f in out]
        for q in range(m):
            assert sum(f.get(q, 0) for f in out) <= quotas[q]
        cost = 0
        for (_, words), x in zip(patterns, taken):
            assert x <= 3 * words
            cost += sum(min(words, max(0, x - level * words)) * level for level in range(3))
        assert (sum(taken), cost) == brute_flow(patterns, quotas, 3)


def test_mix(docs):
    out = mixing.mix(docs).collect()
    text = {r["doc_id"]: r for r in docs.collect()}
    sizes = {i: len(WORD.findall(r["text"])) for i, r in text.items()}
    names = sorted({r["source"] for r in text.values()})
    size = [sum(sizes[i] for i, r in text.items() if r["source"] == s) for s in names]
    target = brute_targets(size, [i % 3 + 1 for i in range(len(names))], sum(size), 3)
    taken = dict.fromkeys(names, 0)
    assert len(out) == len(text)
    for r in out:
        i = names.index(text[r["doc_id"]]["source"])
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], size[i])
        assert r["target"] == pytest.approx(target[i])
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[names[i]] += r["taken"]
    for s, t in zip(names, target):
        longest = max(sizes[i] for i, r in text.items() if r["source"] == s)
        assert abs(taken[s] - t) <= longest / 2 + 1
    assert sorted(out) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_mix_of_odd_rows_and_overlapping_sources(spark, odd, empty):
    got = rows(mixing.mix(odd), "doc_id", "size", "taken")
    assert len(got) == odd.count() and {r[2] for r in got if not r[1]} == {0}
    assert rows(mixing.mix(empty)) == []
    df = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else [["a"], None, []][i % 3]) for i in range(60)],
                               "doc_id long, text string, source array<string>")
    out = mixing.mix(df).collect()
    assert len(out) == 60 and all(r["taken"] % 10 == 0 and r["taken"] <= 30 for r in out)


def test_null_and_repeated_ids_meet_their_targets(spark):
    def table(ident):
        return spark.createDataFrame([(ident(n), f"{n} " + "w " * 9, "abc"[n % 3]) for n in range(3000)],
                                     "doc_id long, text string, source string")

    for ident in (lambda n: n, lambda n: None, lambda n: 7, lambda n: n % 3):
        df = table(ident)
        got = sorted(rows(mixing.mix(df)), key=str)
        taken = {}
        for r in got:
            taken[r[1][0]] = taken.get(r[1][0], 0) + r[5]
        assert taken == {"a": 5000, "b": 10000, "c": 15000}
        assert got == sorted(rows(mixing.mix(df.repartition(5))), key=str)
    # rows equal in everything
    df = spark.createDataFrame([(None, "w " * 10, "abc"[n % 3]) for n in range(600)],
                               "doc_id long, text string, source string")
    taken = {}
    for r in mixing.mix(df).collect():
        taken[r["sources"][0]] = taken.get(r["sources"][0], 0) + r["taken"]
    assert taken == {"a": 1000, "b": 2000, "c": 3000}


def test_small_sources_come_within_a_hundredth(spark):
    from tests.conftest import SF_CHECK
    taken, target = {}, {}
    for r in mixing.mix(spark.read.parquet(f"{SF_CHECK}/documents.parquet")).collect():
        s = r["sources"][0]
        taken[s], target[s] = taken.get(s, 0) + r["taken"], r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())
