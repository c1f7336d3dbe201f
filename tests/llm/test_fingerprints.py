import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import ROWS, rows
from tidal.llm import fingerprints as fp
from tidal.llm.common import WindowHash


def slow(text):
    """One text's signatures, chunk by chunk."""
    raw = np.frombuffer(text.encode(), np.uint8)
    h = WindowHash(raw)
    rolled = [int(v) >> 32 for v in h.each(fp.WINDOW)]
    k = 0
    while fp.BLOCK * fp.LONG << k < len(raw):
        k += 1

    def sign(k):
        ends = [i + fp.WINDOW for i, r in enumerate(rolled)
                if r % 3 == 0 and (r // 3 == 0 or (r // 3) % (1 << k) == 0)]
        n = len(ends)
        ends = [e for e in ends[:fp.LONG - 1] if e < len(raw)]
        out, at = "", 0
        for e in [*ends, *([len(raw)] if len(raw) else [])]:
            out += fp.LETTERS[int(h.of(np.array([at]), np.array([e]))[0]) >> 58]
            at = e
        return out, n

    while k and sign(k)[1] < fp.LONG // 2 - 1:
        k -= 1
    return f"{fp.BLOCK << k}:{sign(k)[0]}:{sign(k + 1)[0]}"


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (0 if x == y else 2)))
        prev = now
    return prev[-1]


def slow_likeness(x, y):
    (bx, *sx), (by, *sy) = x.split(":"), y.split(":")
    if not sx[0] and not sy[0]:
        return 1.0
    best = 0.0
    for i, j in ((0, 0), (1, 1), (1, 0), (0, 1)):
        if int(bx) << i == int(by) << j and sx[i] and sy[j]:
            a, b = sx[i], sy[j]
            run = fp.RUN
            short = max(len(a), len(b)) < run
            if a == b if short else any(a[k:k + run] in b for k in range(len(a) - run + 1)):
                best = max(best, 1 - edit(a, b) / (len(a) + len(b)))
    return best


def want(data):
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for n, (i, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][1]
        cut = len(t) // 4
        new = t[:len(t) - cut] + nxt[:cut]
        a, b, c = slow(t), slow(new), slow(nxt)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, slow_likeness(a, b), slow_likeness(a, c)))
    return out


def same(got, expected):
    got, expected = sorted(got, key=str), sorted(expected, key=str)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [g[5:] for g in got] == [pytest.approx(e[5:]) for e in expected]


def test_fingerprints_equal_brute_force(docs):
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for parts in (1, 5):
        same(rows(fp.fingerprint(docs.repartition(3), parts=parts)), want(data))


def test_odd_rows(spark, odd, empty):
    same(rows(fp.fingerprint(odd, parts=3)), want([(r[0], r[1] or "") for r in ROWS]))
    assert rows(fp.fingerprint(empty, parts=3)) == []
    one = odd.filter("doc_id = 9")
    same(rows(fp.fingerprint(one, parts=4)), want([(9, ROWS[9][1])]))


def test_parse_and_likeness_of_random_signatures():
    rng = random.Random(4)
    text = []
    for _ in range(200):
        a = "".join(rng.choices(fp.LETTERS[:3], k=rng.randint(0, 64)))
        text.append(f"{3 << rng.randint(0, 2)}:{a}:{a[:rng.randint(0, 64)]}")
    x, y = fp.parse(text[::2]), fp.parse(text[1::2])
    assert x.text() == text[::2]
    assert fp.likeness(x, y).tolist() == pytest.approx([slow_likeness(a, b) for a, b in zip(text[::2], text[1::2])])
