"""Token counts: greedy longest-match word pieces counted by one linear pass of an automaton.

The vocabulary becomes two tries, one of pieces that start a word and one of
pieces that continue it.  Every node has a failure link into the continuing
trie and the number of pieces that are complete once that link is followed, so
counting reads each byte of a word once and never builds a piece.  The counts
equal those of repeated longest-prefix matching.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidal.llm.common import batch, map_arrow, per_row, steps, words

#: The roots: node 0 for the start of a word, node 1 for the rest of one.
START, REST = 0, 1
#: Words still running below which a step by step walk beats whole-array steps.
FEW = 24


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word pieces of a byte-level vocabulary file: those with a leading space start a word.

    A word is matched with one space before it, as such vocabularies spell
    words inside a text.  All single bytes are pieces, so every word has a count.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    pieces = [bytes(back[c] for c in piece) for piece in vocab if all(c in back for c in piece)]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


class Automaton:
    """Trie edges, failure links and popped-piece counts as arrays (size bound by the vocabulary)."""

    def __init__(self, starting: list[bytes], continuing: list[bytes], prefix: bytes = b""):
        kids: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((START, starting), (REST, continuing)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in kids[at]:
                        kids[at][c] = len(kids)
                        kids.append({})
                        ends.append(False)
                    at = kids[at][c]
                if at > REST:
                    ends[at] = True
        fail, pops = [-1] * len(kids), [0] * len(kids)
        queue = deque([START, REST])
        while queue:
            u = queue.popleft()
            for c, v in kids[u].items():
                queue.append(v)
                if ends[v]:
                    fail[v], pops[v] = REST, 1
                    continue
                z, p = fail[u], pops[u]
                while z >= 0 and c not in kids[z]:
                    p += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = kids[z][c], p
        self.prefix = prefix
        self.edges = np.array([(u, c, v) for u, to in enumerate(kids) for c, v in to.items()], np.int32).reshape(-1, 3)
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        self._next = None

    def __getstate__(self):
        return {**self.__dict__, "_next": None, "_row": None, "_begin": None}

    def _open(self) -> None:
        """The transition table: a dense row for each node with children, made where it is used."""
        inner = np.unique(self.edges[:, 0])
        self._row = np.full(len(self.fail), len(inner), np.int32)
        self._row[inner] = np.arange(len(inner))
        self._next = np.full((len(inner) + 1, 256), -1, np.int32)
        self._next[self._row[self.edges[:, 0]], self.edges[:, 1]] = self.edges[:, 2]
        self._begin = self._walk(START, 0, self.prefix)

    def _walk(self, node: int, count: int, tail: bytes) -> tuple[int, int]:
        """State and count after ``tail``; state -1 when no piece fits."""
        nxt, row, fail, pops = self._next, self._row, self.fail, self.pops
        for c in tail:
            to = nxt[row[node], c]
            while to < 0:
                count += int(pops[node])
                node = int(fail[node])
                if node < 0:
                    return -1, count
                to = nxt[row[node], c]
            node = int(to)
        return node, count

    def counts(self, distinct: pa.Array) -> np.ndarray:
        """Pieces of each word; -1 where the vocabulary cannot spell it; 0 for an empty word."""
        if self._next is None:
            self._open()
        n = len(distinct)
        lens = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(lens)[:-1]]) if n else np.zeros(0, np.int64)
        buf = np.frombuffer(b"".join(w.as_buffer() for w in distinct.cast(pa.binary())), np.uint8) \
            if n and lens.sum() else np.zeros(0, np.uint8)
        order = np.argsort(-lens, kind="stable")
        size, at = lens[order], begin[order]
        node = np.full(n, self._begin[0], np.int32)
        count = np.full(n, self._begin[1], np.int32)
        j, live = 0, int(np.searchsorted(-size, 0, side="left"))
        empty = size == 0
        while live > FEW:
            self._step(node, count, np.arange(live), buf[at[:live] + j])
            j += 1
            live = int(np.searchsorted(-size, -j, side="left"))
        for i in range(live):
            if node[i] >= 0:
                node[i], count[i] = self._walk(int(node[i]), int(count[i]), buf[at[i] + j:at[i] + size[i]].tobytes())
        todo = np.flatnonzero((node >= 0) & (node != REST) & ~empty)
        while len(todo):
            count[todo] += self.pops[node[todo]]
            node[todo] = self.fail[node[todo]]
            todo = todo[(node[todo] >= 0) & (node[todo] != REST)]
        count[node < 0] = -1
        count[empty] = 0
        out = np.empty(n, np.int32)
        out[order] = count
        return out

    def _step(self, node: np.ndarray, count: np.ndarray, live: np.ndarray, byte: np.ndarray) -> None:
        """All live words read one byte; only those without an edge follow failure links."""
        ok = node[live] >= 0
        live, byte = live[ok], byte[ok]
        to = self._next[self._row[node[live]], byte]
        while True:
            fits = to >= 0
            node[live[fits]] = to[fits]
            live, byte = live[~fits], byte[~fits]
            if not len(live):
                return
            count[live] += self.pops[node[live]]
            node[live] = self.fail[node[live]]
            ok = node[live] >= 0
            live, byte = live[ok], byte[ok]
            to = self._next[self._row[node[live]], byte]


def count_tokens(docs: DataFrame, automaton: Automaton, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens, n_unknown.

    Words are runs of anything but ASCII white space.  A word that the
    vocabulary cannot spell counts as one token and as one unknown.  Null and
    empty texts have zeros, a null doc_id stays null, repeated rows are counted
    each, an empty table gives no rows; only the two named columns are read.
    Narrow: no shuffle; the automaton, bound by the vocabulary, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()),
                        ("n_unknown", pa.int64())])

    def run(batches):
        auto = shared.value
        for part in steps(batches, 1, 8 << 20):
            n = part.num_rows
            each, row = words(part.column(1))
            coded = each.dictionary_encode()
            count = auto.counts(coded.dictionary)
            count = count[coded.indices.to_numpy(zero_copy_only=False)] if len(each) else np.zeros(0, np.int32)
            yield batch(schema, part.column(0), np.bincount(row, minlength=n).astype(np.int64),
                        per_row(np.abs(count), row, n).astype(np.int64),
                        per_row(count < 0, row, n).astype(np.int64))

    cols = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return map_arrow(cols, run, "doc_id long, n_words long, n_tokens long, n_unknown long")
