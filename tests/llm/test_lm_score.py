import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ROWS, rows
from tidal.llm import lm_score

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall((text or "").encode().lower())


def slow_ppm(train, order):
    """Counts by context, and a scorer that escapes and excludes one context at a time."""
    counts = {}
    for seq in train:
        for at in range(order, len(seq)):
            for j in range(order + 1):
                counts.setdefault(seq[at - j:at], Counter())[seq[at]] += 1

    def score(seq):
        total = 0.0
        for at in range(order, len(seq)):
            out: set = set()
            for j in range(order, -1, -1):
                c = counts.get(seq[at - j:at])
                if c is None:
                    continue
                left = {s: n for s, n in c.items() if s not in out}
                whole = sum(left.values()) + len(left)
                if seq[at] in left:
                    total += math.log10(left[seq[at]] / whole)
                    break
                if left:
                    total += math.log10(len(left) / whole)
                out |= set(c)
            else:
                total -= math.log10(256 - len(out))
        return total

    return score


def brute(data, order):
    seqs = [(i, tokens(t)) for i, t in data]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in seqs]
    train = [t for (_, t), h in zip(seqs, held) if not h]
    count = Counter(w for t in train for w in [*t, None])
    n, v = sum(count.values()), len(count)
    pad = lambda t: b"\0" * order + b" ".join(t) + b"\0"
    ppm = slow_ppm([pad(t) for t in train], order)
    out = []
    for (i, t), h in zip(seqs, held):
        every = [*t, None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in every)
        out.append((i, h, len(every), sum(count[w] > 0 for w in every), n, base, ppm(pad(t))))
    return out


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_documents(docs):
    data = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()]
    df = docs.sparkSession.createDataFrame(data, "doc_id long, text string").repartition(3)
    same(rows(lm_score.score(df, order=3, head=500)), brute(data, 3))


def test_odd_rows(odd, empty):
    same(rows(lm_score.score(odd, order=2, head=3)), brute([(r[0], r[1]) for r in ROWS], 2))
    assert rows(lm_score.score(empty)) == []


def test_what_the_broadcast_leaves_out_is_scored_in_full(docs, odd):
    data = [(r["doc_id"], r["text"]) for r in docs.limit(40).collect()]
    df = docs.sparkSession.createDataFrame(data, "doc_id long, text string").repartition(3)
    same(rows(lm_score.score(df, max_pairs=100, head=50)), brute(data, 5))
    same(rows(lm_score.score(odd, order=4, max_pairs=0, head=0)), brute([(r[0], r[1]) for r in ROWS], 4))


def test_a_bound_holds_for_large_counts(spark):
    counts = spark.range(40).selectExpr("(id + 1) * 30000 AS n")
    for most in (0, 1, 7, 39, 40):
        assert counts.filter(f"n > {lm_score._floor(counts, most, 'n')}").count() <= most


def test_a_pruned_trie_is_still_a_probability():
    rng = random.Random(1)
    order, text = 2, bytes(rng.choices(b"abcd ", [5, 3, 2, 1, 4], k=400))
    seq = b"\0\0" + text + b"\0"
    pairs = []
    for j in range(order + 1):
        c = Counter(int.from_bytes(seq[at - j:at + 1], "big") for at in range(order, len(seq)))
        c = {k: n for k, n in c.items() if n >= 3}
        key = np.array(sorted(c), np.uint64)
        pairs.append((key, np.array([c[int(k)] for k in key])))
    trie = lm_score.Trie(order, pairs)
    for ctx in (b"ab", b"zz", b"d ", b"\0\0"):
        code = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** trie.score(code)).sum() == pytest.approx(1.0)


def test_better_than_chance_on_held_out(docs):
    got = [r for r in lm_score.score(docs).collect() if r["held_out"]]
    size = {r["doc_id"]: len(b" ".join(tokens(r["text"]))) + 1 for r in docs.collect()}
    bits = -sum(r["score"] for r in got) / sum(size[r["doc_id"]] for r in got) * math.log2(10)
    assert bits < 3.2
