import random
import re

import numpy as np
import xxhash

from tests.llm.conftest import ROWS, rows
from tidal.llm import simhash
from tidal.llm.links import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def finger(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, most=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(i)
    return {i: min((ids[m] for m in ms if ids[m] is not None), default=None) for ms in out.values() for i in ms}


def check(df, data):
    got = rows(simhash.near_duplicates(df))
    fps = [finger(t) for _, t in data]
    comp = groups([i for i, _ in data], fps)
    want = [(i, f - (1 << 64) if f >> 63 else f, comp[n]) for n, ((i, _), f) in enumerate(zip(data, fps))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_documents(docs):
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(odd, empty):
    check(odd, [(r[0], r[1]) for r in ROWS])
    assert rows(simhash.near_duplicates(empty)) == []


def test_links_have_the_components_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "OWN_ROWS", 40)
    monkeypatch.setattr(simhash, "GUEST_ROWS", 90)
    rng = random.Random(8)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):  # chains of near fingerprints
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.close_links(df, 4, sample_rows=100, leaf_rows=16)
    for r in links.collect():
        assert 0 < ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4
    name = {r["node"] % (1 << 64): r["root"] for r in components(links).collect()}
    got, want = {}, groups(fps, fps)
    for i, f in enumerate(fps):
        got.setdefault(name.get(f, f"alone {f}"), set()).add(f)
    back = {}
    for i, f in enumerate(fps):
        back.setdefault(want[i], set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, back.values()))
    assert links.count() < 4 * len(fps)


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (7, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(200, 260)]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
