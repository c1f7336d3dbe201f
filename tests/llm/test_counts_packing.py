import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, models

from tests.llm.conftest import rows
from tidal.llm import packing, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def greedy(word, start, rest):
    n, at, first = 0, 0, True
    while at < len(word):
        pieces = start if first else rest
        for to in range(len(word), at, -1):
            if word[at:to] in pieces:
                break
        else:
            return -1
        n, at, first = n + 1, to, False
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(3)
    for _ in range(60):
        vocab = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 25))}
        start, rest = set(rng.sample(sorted(vocab), (len(vocab) + 1) // 2)), set(rng.sample(sorted(vocab), len(vocab) // 2))
        auto = token_counts.Automaton(sorted(start), sorted(rest))
        words = [bytes(rng.choices(b"abcd", k=rng.randint(0, 14))) for _ in range(80)]
        got = auto.counts(pa.array([w.decode() for w in words]))
        assert got.tolist() == [greedy(w, start, rest) for w in words]


def test_token_counts_equal_a_word_piece_model(spark, docs):
    start, rest = token_counts.byte_level_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    vocab = {"[UNK]": 0}
    for p in start:
        vocab.setdefault(p.decode("latin-1"), len(vocab))
    for p in rest:
        vocab.setdefault("##" + p.decode("latin-1"), len(vocab))
    model = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6))
    out = token_counts.count_tokens(docs, token_counts.Automaton(start, rest, prefix=b" "))
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in out.collect()}
    for r in docs.collect():
        words = WORD.findall(r["text"])
        n = sum(len(model.encode(" " + w.encode().decode("latin-1")).ids) for w in words)
        assert got[r["doc_id"]] == (len(words), n, 0)


def test_token_counts_of_odd_rows(odd, empty):
    auto = token_counts.Automaton([b"one", b"t"], [b"x", b"w", b"o"])
    got = sorted(rows(token_counts.count_tokens(odd, auto)), key=str)
    assert len(got) == odd.count()
    by = {r[0]: r[1:] for r in got}
    assert by[1] == by[2] == by[3] == (0, 0, 0)
    assert by[4] == (1, 1, 0) and by[6] == (1, 1, 1)
    assert rows(token_counts.count_tokens(empty, auto)) == []


def check_packed(out, docs, path, capacity, end):
    tok = Tokenizer.from_file(path)
    want = []
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [end]
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = np.array(ids[at:at + capacity], "<u4")
            want.append((r["doc_id"], k, at, len(piece), zlib.crc32(piece.tobytes())))
    got = out.collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seq), sum(r["length"] for r in got)


def test_packing(spark, docs, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    n, total = check_packed(packing.pack(docs, path), docs, path, 4096, 1)
    assert n == -(-total // 4096)
    check_packed(packing.pack(odd, path, capacity=64, salts=3), odd, path, 64, 1)
    assert rows(packing.pack(empty, path)) == []


def exact(sizes, capacity):
    """Fewest bins, by trying everything."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= sizes[i]}:
            k = bins.index(room)
            go(i + 1, bins[:k] + [room - sizes[i]] + bins[k + 1:])
        go(i + 1, bins + [capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.randint(6, 30)
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        stock = packing._Stock(counts)
        fixed = packing.reduce_stock(stock, capacity)
        left = [s for s in stock.sizes for _ in range(stock.count[s])]
        assert all(sum(b) <= capacity for b, _ in fixed)
        assert sorted(left + [s for b, n in fixed for s in b * n]) == sorted(sizes)
        assert sum(n for _, n in fixed) + exact(sorted(left, reverse=True), capacity) == exact(sizes, capacity)


def test_plan_covers_every_item():
    rng = random.Random(6)
    for _ in range(100):
        capacity = rng.randint(5, 60)
        counts = {s: rng.randint(1, 5000) for s in rng.sample(range(1, capacity + 1), rng.randint(1, 5))}
        bins = packing.plan_bins(counts, capacity)
        got = {}
        for b, n in bins:
            assert sum(b) <= capacity
            for s in b:
                got[s] = got.get(s, 0) + n
        assert got == counts
        assert len(bins) < 60 * len(counts)


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words: equal under any polynomial modulo 2^64, not under the word keys."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other), (3, f"{word} {other}")], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packed(packing.pack(df, path), df, path, 4096, 1)
