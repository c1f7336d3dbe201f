import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import rows
from tidal.llm import alignment
from tidal.llm.common import text_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")

TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "a   b \n c", "\n\n a\n\nb\n", "one two  three\ttabs \t end",
    "être là été çà", "你好 世界 。 你 好", "🙂🙂 🙂x x🙂 👩‍👩‍👧", "﻿mark z", "nb sp ace",
    "thin hair　wide x", "x\x1cy \x1f z \x85 w", "a\x00b \x00", "▁ mark", "x▁y z", "<|endoftext|> <s> </s><unk> <0x41>",
    "don't we'll 'S it's 123 4567 12a a12 !!! ... $$$ a!b", "ǅ ß ﬁ ａｂ é", "𓀀x 𓀀 𓀀𓀀", "a b c d e" * 50,
    "Ġ Ċ ĠĠ", "x" * 900, "ab" * 400 + " end", "‍ ​ ‎", "same words here", "same words here",
    "é ́ e ́", "\r\n\r\n x\r\ny", "߿ߺ ߿ ࠀ ⿿ 　x",
]


def one(text, a, b, vocab_a):
    """Tokens and byte ends from whole-text encodings and decoded bytes alone."""
    if not text:
        return None
    data = (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [vocab_a[i] for i in ids_a]
    bytes_b = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", p)) else p.replace("▁", " ").encode()
               for p in map(b.id_to_piece, ids_b)]
    if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
        return None
    return ids_a, np.cumsum([len(x) for x in bytes_a]).tolist(), ids_b, np.cumsum([len(x) for x in bytes_b]).tolist()


def brute(data):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    # the decoder's own view of each id
    back = {c: n for c, n in alignment.byte_level_alphabet().items()}
    vocab = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
             for t, i in a.get_vocab(with_added_tokens=True).items()}
    found, holds = [], {}
    for _, text in data:
        got = one(text, a, b, vocab)
        links, groups = [], []
        if got:
            ia, ea, ib, eb = got
            sa, sb = [0, *ea], [0, *eb]
            links = [(x, y) for i, x in enumerate(ia) for j, y in enumerate(ib)
                     if sa[i] < eb[j] and sb[j] < ea[i]]
            cuts = sorted(set(ea) & set(eb))
            groups = ";".join(
                ",".join(str(x) for i, x in enumerate(ia) if lo < ea[i] <= hi) + "|" +
                ",".join(str(y) for j, y in enumerate(ib) if lo < eb[j] <= hi) for lo, hi in zip([0, *cuts], cuts))
        found.append((got, links, groups))
        for p in set(links):
            holds[p] = holds.get(p, 0) + 1
    best = {}
    for (x, _), n in holds.items():
        best[x] = max(best.get(x, 0), n)
    return [(i, len(g[0]), len(g[2]), t.count("|"), len(ls), sum(holds[p] == best[p[0]] for p in ls),
             sum(holds[p] for p in ls), t) if g else (i, 0, 0, 0, 0, 0, 0, "") for (i, _), (g, ls, t) in zip(data, found)]


@pytest.mark.parametrize("head", [alignment.HEAD, 30, 0])
def test_odd_texts_equal_brute_force(spark, head):
    data = list(enumerate(TEXTS))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted(rows(alignment.align(df, A, B, head=head), *COLS))
    assert got == brute(data)
    assert sum(r[1] > 0 for r in got) > 25


def test_documents_equal_brute_force(spark, docs):
    data = sorted((r["doc_id"], r["text"]) for r in docs.filter("length(text) < 1500").collect())[:60]
    ids = [i for i, _ in data]
    got = sorted(rows(alignment.align(docs.filter(docs.doc_id.isin(ids)), A, B), *COLS))
    assert got == brute(data)


def test_units_join_to_the_whole_texts_tokens(docs):
    """Texts encoded unit by unit have the ids of the whole text, on all documents."""
    tokens = alignment.Tokens(A, B)
    for r in docs.collect():
        buf, off = text_bytes(pa.array([" " + r["text"]]))
        start = [*alignment.cut_units(buf, off).tolist(), len(buf)]
        units = [bytes(buf[x:y]).decode() for x, y in zip(start, start[1:])]
        a = [i for e in tokens.a.encode_batch(units, add_special_tokens=False) for i in e.ids]
        b = [i for ids in tokens.b.encode([u[1:] for u in units]) for i in ids]
        assert a == tokens.a.encode(" " + r["text"], add_special_tokens=False).ids
        assert b == tokens.b.encode(r["text"])


def test_chunks_of_any_size_agree(spark, docs):
    want = sorted(rows(alignment.align(docs, A, B), *COLS))
    small = alignment.align(docs.repartition(5), A, B, head=500, chunk=20_000)
    assert sorted(rows(small, *COLS)) == want


def test_odd_and_empty_tables(spark, odd, empty):
    got = rows(alignment.align(odd, A, B), *COLS)
    assert len(got) == odd.count() and [r for r in got if r[0] == 1] == [(1, 0, 0, 0, 0, 0, 0, "")]
    assert rows(alignment.align(empty, A, B)) == []


def test_query(spark):
    from tests.conftest import SF_SMALL
    from tidal.llm.queries import QUERIES
    out = QUERIES["op12_cross_tokenizer"](spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r["doc_id"]: r["groups"] for r in alignment.align(docs, A, B).collect()}
    for r in out.collect():
        g = want[r["doc_id"]]
        assert r["groups_sha256"] == (hashlib.sha256(g.encode()).hexdigest() if g else "")
