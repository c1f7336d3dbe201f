"""Cross-tokenizer alignment: the tokens of a byte-level BPE (A) against those of a sentencepiece model (B).

Both tokenizers give character spans of their tokens.  A span whose bytes are
those of its token is a coarse cut; where several tokens share a character
(parts of a multibyte character, byte-fallback tokens) the cuts inside are
refined with the tokens' decoded bytes.  Two cut lists over the same bytes then
give the groups (bytes between cuts that both have) and the links (token pairs
whose byte ranges overlap: one per piece between neighbouring cuts of either).

Neither tokenizer joins bytes across a space that follows a character other
than white space, so each text falls into units there.  A task aligns each distinct
unit once and a document is the sequence of its units.

The installed sentencepiece no longer has its immutable proto; the offset
mapping that replaced it returns the same spans.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidal.llm.common import filled, map_arrow, steps, text_bytes, trim
from tidal.session import materialize

#: Bytes of text that make one chunk, whose distinct links are counted and looked up together.
CHUNK = 4 << 20
#: Pairs whose counts are broadcast at most (about 17 bytes each); the others are joined.
HEAD = 1 << 18
#: Units a worker remembers at most.
MOST = 300_000

_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_MARK = "▁"


def byte_level_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes, in
    order, for the characters from 256 on.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class _Bytes:
    """The bytes of each id, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The joined bytes of a sequence of ids."""
        size = self.size[ids]
        stop = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)]


class Tokens:
    """Both tokenizers and the alignments of the units that this worker has met."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.paths = path_a, path_b
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_level_alphabet()
        named = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = _Bytes([bytes(alphabet[c] for c in t) if alphabet.keys() >= set(t) else t.encode() for t in named])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece joins words: texts can't be cut at spaces")
        self.bytes_b = _Bytes([bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_MARK, " ").encode()
                               for p in pieces])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        #: of each unit: whether it is sound, and where its links start
        self.sound, self.first = np.zeros(0, bool), np.zeros(1, np.int64)
        #: links in order: number of the pair, and whether the A (1) and the B token (2) ends with it
        self.pair, self.ends = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        #: pairs by number (A's id in the upper half), and their numbers in the order of the pairs
        self.code, self.order, self.ranked = (np.zeros(0, np.int64) for _ in range(3))

    def units(self, distinct: list[str]) -> np.ndarray:
        """Numbers of the units, aligned where they are new."""
        if len(self.known) > MOST:
            self.clear()
        known = self.known
        new = [u for u in distinct if u not in known]
        for at in range(0, len(new), 20_000):
            self.learn(new[at:at + 20_000])
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))

    def learn(self, units: list[str], alone: bool = False) -> None:
        """Align new units, each with a space first.

        Many are encoded as one text; where that text's tokens are not its
        bytes, its units are encoded alone.
        """
        buf, off = text_bytes(pa.array(units, pa.string()))
        join = np.zeros(len(units), bool) if alone else _ends_safely(buf, off[1:-1])
        first = np.flatnonzero(np.concatenate([[True], ~join[:len(units) - 1]]) | (np.arange(len(units)) % 256 == 0))
        texts = units if alone else ["".join(units[x:y]) for x, y in itertools.pairwise([*first.tolist(), len(units)])]
        text_off = np.append(off[first], off[-1])
        char = np.flatnonzero((buf & 0xC0) != 0x80)  # bytes that start a character
        base = np.searchsorted(char, text_off)  # characters before each text
        char = np.append(char, len(buf))
        a = self.a.encode_batch(texts, add_special_tokens=False)
        ids_a, end_a, in_a, ok_a = _cuts(buf, text_off, base, char, self.bytes_a, [e.ids for e in a],
                                         [e.offsets for e in a], 0)
        b = self.b.encode([t[1:] for t in texts], return_type="offset_mapping", num_threads=1)
        ids_b, end_b, in_b, ok_b = _cuts(buf, text_off, base, char, self.bytes_b, [e["ids"] for e in b],
                                         [e["offsets"] for e in b], 1)
        sound = ok_a & ok_b
        if not sound.all():
            ids_a, end_a = ids_a[sound[in_a]], end_a[sound[in_a]]
            ids_b, end_b = ids_b[sound[in_b]], end_b[sound[in_b]]
        cut = _distinct(np.concatenate([end_a, end_b]))
        i, j = np.searchsorted(end_a, cut), np.searchsorted(end_b, cut)
        ends = np.zeros(len(cut), np.uint8)
        if len(cut):
            ends = (end_a[i] == cut).astype(np.uint8) + (end_b[j] == cut).astype(np.uint8) * 2
        pair = self.numbered((ids_a[i] << 32) + ids_b[j])
        count = np.bincount(np.searchsorted(off, cut, side="left") - 1, minlength=len(units))
        sound = np.repeat(sound, np.diff(np.append(first, len(units))))
        now = np.ones(len(units), bool) if alone else sound
        mine = [u for u, k in zip(units, now.tolist()) if k]
        self.known.update(zip(mine, range(len(self.sound), len(self.sound) + len(mine))))
        self.sound = np.concatenate([self.sound, sound[now]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count[now])])
        self.pair, self.ends = np.concatenate([self.pair, pair]), np.concatenate([self.ends, ends])
        if len(mine) < len(units):
            self.learn([u for u, k in zip(units, now.tolist()) if not k], alone=True)

    def numbered(self, pairs: np.ndarray) -> np.ndarray:
        """Numbers of the pairs, new ones added."""
        at = self._find(pairs)
        new = self.ranked[at] != pairs if len(self.code) else np.ones(len(pairs), bool)
        if new.any():
            self.code = np.concatenate([self.code, _distinct(pairs[new])])
            self.order = np.argsort(self.code)
            self.ranked = self.code[self.order]
            at = self._find(pairs)
        return self.order[at].astype(np.int32)

    def _find(self, pairs: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.ranked, pairs), max(0, len(self.ranked) - 1))


def _distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _ends_safely(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is surely no white space (nor the mark that stands for a space).

    Of characters of two or three bytes only those of leads that no white space has are taken.
    """
    plain = np.ones(256, bool)  # ASCII besides white space and separators
    plain[[*range(9, 14), *range(28, 33)]] = False
    plain[0x80:] = False
    one, two, three, four = (buf[np.maximum(at - k, 0)] for k in (1, 2, 3, 4))
    more = (one >= 0x80) & (one < 0xC0)
    return plain[one] | more & ((two >= 0xC3) | (two < 0xC0) & ((three >= 0xE4) | (three < 0xC0) & (four >= 0xF0)))


def _cuts(buf: np.ndarray, off: np.ndarray, base: np.ndarray, char: np.ndarray, table: _Bytes,
          ids: list[list[int]], spans: list[list[tuple[int, int]]], skip: int):
    """All ids, the byte at which each token ends, its unit, and whether each unit's tokens are its bytes.

    ``spans`` are in characters, ``skip`` of which the tokenizer did not see.
    """
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    n = int(count.sum())
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, n)
    span = np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable(spans)), np.int64, 2 * n)
    unit = np.repeat(np.arange(len(ids)), count)
    size = table.size[flat]
    stop = np.cumsum(size)
    before = np.concatenate([[0], stop])[np.cumsum(count) - count]  # decoded bytes before each unit
    total = np.bincount(unit, weights=size, minlength=len(ids)).astype(np.int64)
    sound = total == np.diff(off)
    # decoded ends, exact in a sound unit
    decoded = off[unit] + stop - before[unit]
    # coarse cuts: a span of as many bytes as its token; a unit's first token starts with it
    last = len(char) - 1
    begin = char[np.minimum(base[unit] + span[::2] + skip, last)]
    first = np.cumsum(count) - count
    begin[first[count > 0]] = off[:-1][count > 0]
    end = char[np.minimum(base[unit] + span[1::2] + skip, last)]
    coarse = end - begin == size
    # other cuts follow the nearest coarse one before them by the decoded bytes between
    at = np.maximum.accumulate(np.where(coarse, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    shift = np.where(at >= first[unit], (end - decoded)[at], 0)
    cut = decoded + shift
    sound &= np.bincount(unit, weights=cut != decoded, minlength=len(ids)) == 0
    # the joined bytes must be the unit's
    mine = sound[unit]
    of = np.repeat(np.arange(len(ids)), np.where(sound, np.diff(off), 0))
    wrong = table.of(flat[mine]) != buf[np.repeat(sound, np.diff(off))]
    sound &= np.bincount(of, weights=wrong, minlength=len(ids)) == 0
    return flat, cut, unit, sound


_TOKENS: list[Tokens] = []


def _tokens(path_a: str, path_b: str) -> Tokens:
    if not _TOKENS or _TOKENS[0].paths != (path_a, path_b):
        _TOKENS[:] = [Tokens(path_a, path_b)]
    return _TOKENS[0]


def cut_units(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where units start: at each text, and at a space after a character that is surely no white space.

    A space that ends its text stays with the word before it: B has no tokens for nothing.
    """
    if not len(buf):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(buf == 0x20)
    at = at[(at > 0) & ~np.isin(at + 1, off)]
    return _distinct(np.concatenate([at[_ends_safely(buf, at)], off[:-1][np.diff(off) > 0]]))


def _chunk_rows(part: pa.RecordBatch, chunk: int, known: Tokens) -> pa.RecordBatch:
    """One row for some documents: their distinct pairs, in how many documents each is, and the documents as units."""
    texts = filled(part.column(1))
    n = len(texts)
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    buf, off = text_bytes(texts)
    start = cut_units(buf, off)
    at = pa.py_buffer(np.append(start, len(buf)).astype(np.int32))
    coded = pa.StringArray.from_buffers(len(start), at, pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(start) else np.zeros(0, np.int64)
    number = known.units(coded.dictionary.to_pylist())
    doc = np.searchsorted(off, start, side="right") - 1
    sound = np.bincount(doc, weights=~known.sound[number][code], minlength=n) == 0
    keep = sound[doc]
    code, doc = code[keep], doc[keep]
    used = np.zeros(len(number), bool)
    used[code] = True
    code, number = (np.cumsum(used) - 1)[code], number[used]
    # links of the units that are left, as places in the sorted distinct pairs
    count = known.first[number + 1] - known.first[number]
    links, _ = _spread(known.first[number], count)
    used = np.flatnonzero(np.bincount(known.pair[links], minlength=len(known.code)))
    used = used[np.argsort(known.code[used])]
    pairs, rank = known.code[used], np.zeros(len(known.code), np.int32)
    rank[used] = np.arange(len(used))
    place = rank[known.pair[links]]
    # documents that hold each pair
    each, of = _spread((np.cumsum(count) - count)[code], count[code])
    held = doc[of] * len(pairs) + place[each]
    if n * len(pairs) <= 1 << 27:
        flags = np.zeros(n * len(pairs), bool)
        flags[held] = True
        docs = flags.reshape(n, -1).sum(axis=0)
    else:
        docs = np.bincount(_distinct(held) % max(1, len(pairs)), minlength=len(pairs))
    body = {"docs": part.column(0), "units": np.bincount(doc, minlength=n).astype(np.int32), "unit": code.astype(np.int32),
            "links": count.astype(np.int32), "link": place.astype(np.int64) * 4 + known.ends[links]}
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([pairs], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int64())),
         pa.array([_packed(body)], pa.binary())], names=["chunk", "pairs", "docs", "body"])


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges of ``size`` from ``start``, and the range of each."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + np.repeat(start - np.cumsum(size) + size, size), of


def _packed(body: dict) -> bytes:
    """Arrays of different lengths as one compressed Arrow message."""
    sink = pa.BufferOutputStream()
    cols = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v))
            for k, v in body.items()}
    row = pa.RecordBatch.from_pydict(cols)
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(pa.py_buffer(body)).read_next_batch()
    return {k: row.column(k).flatten() for k in row.schema.names}


def _group_texts(unit_links: np.ndarray, pair: np.ndarray, ends: np.ndarray, digits: list[str]) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each unit from its links."""
    group = np.concatenate([[0], np.cumsum(ends == 3)[:-1]]) if len(ends) else np.zeros(0, np.int64)
    of_a, of_b = np.flatnonzero(ends & 1), np.flatnonzero(ends & 2)
    side = np.concatenate([np.zeros(len(of_a), np.int64), np.ones(len(of_b), np.int64)])
    link = np.concatenate([of_a, of_b])
    order = np.lexsort((link, side, group[link]))
    ids = np.concatenate([pair[of_a] >> 32, pair[of_b] & 0xFFFFFFFF])[order]
    side, link = side[order], link[order]
    # after a token: ',' inside its side of the group, '|' after the A side, ';' after the group
    mark = np.where(side == 0, "|", ";")
    same = (side[1:] == side[:-1]) & (group[link[1:]] == group[link[:-1]])
    mark[:-1][same] = ","
    texts = [digits[i] + m for i, m in zip(ids.tolist(), mark.tolist())]
    unit = np.repeat(np.arange(len(unit_links)), unit_links)[link]
    at = np.searchsorted(unit, np.arange(len(unit_links) + 1)).tolist()
    return ["".join(texts[a:b])[:-1] for a, b in itertools.pairwise(at)]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])


def _documents(body: dict[str, pa.Array], pairs: np.ndarray, count: np.ndarray, best: np.ndarray,
               digits: list[str]) -> pa.RecordBatch:
    """The documents of a chunk, with the counts of its distinct pairs."""
    units, unit, links, link = (body[k].to_numpy(zero_copy_only=False) for k in ("units", "unit", "links", "link"))
    place, ends = link >> 2, (link & 3).astype(np.uint8)
    start = np.cumsum(links) - links

    def per_unit(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
        return total[start + links] - total[start]

    def per_doc(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[unit])])
        stop = np.cumsum(units)
        return total[stop] - total[stop - units]

    texts: list[str] = []
    for at in range(0, len(links), 20_000):  # some units at a time: their tokens are many small strings
        own = slice(int(start[at]), int(start[at:at + 20_000][-1] + links[at:at + 20_000][-1]))
        texts += _group_texts(links[at:at + 20_000], pairs[place[own]], ends[own], digits)
    at = np.concatenate([[0], np.cumsum(units)]).tolist()
    each = unit.tolist()
    groups = [";".join([texts[u] for u in each[a:b]]) for a, b in itertools.pairwise(at)]
    return pa.RecordBatch.from_arrays([
        body["docs"], *(pa.array(per_doc(per_unit(v)), pa.int64()) for v in (
            ends & 1, ends >> 1, ends == 3, np.ones(len(ends), np.int64), best[place], count[place])),
        pa.array(groups, pa.string())], schema=_OUT)


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
          head: int = HEAD, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: one row per row of ``docs``.

    A encodes a space and the text, B (which adds the space) the text, both
    without special tokens.  ``groups`` lists the ids between common cuts:
    ``a1,a2|b1;a3|b2,b3``.  A pair's count is the number of rows that hold it
    linked; ``n_best`` counts the links whose count is the highest of their A
    id, ``count_sum`` adds up the counts of all links.

    Null or empty texts, and texts whose tokens do not decode to their bytes,
    have zeros and an empty ``groups``.  Repeated rows and rows without an id
    count each; an empty table gives no rows; only the two named columns are read.

    Distinct pairs are counted per chunk before they are shuffled.  Counts of
    the ``head`` most frequent pairs at most are broadcast, a cache of fixed
    size; the others are joined per chunk, and as each of those is in fewer
    chunks than the head's least count, none of them is a hot key.
    """
    cols = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def chunks(batches):
        known = _tokens(path_a, path_b)
        number = itertools.count(TaskContext.get().partitionId() << 32)
        held, size = [], 0
        for part in steps(batches, 1, chunk):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if size >= chunk:
                yield _chunk_rows(_joined(held), next(number), known)
                held, size = [], 0
        if held:
            yield _chunk_rows(_joined(held), next(number), known)

    chunked = materialize(map_arrow(cols, chunks, "chunk long, pairs array<long>, docs array<long>, body binary"),
                          "align-chunks")
    counts = (chunked.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n")))
    counts = materialize(counts, "align-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))  # at most A's vocabulary
    counts = (counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a"))
              .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))

    power = (F.length(F.bin("n")) - 1).alias("power")
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(power).agg(F.count("*").alias("pairs")).collect()}
    least = max(sizes, default=0) + 1
    while least > 0 and sum(n for p, n in sizes.items() if p >= least - 1) <= head:
        least -= 1
    frequent = counts.filter(F.col("n") >= 1 << least)
    cache = frequent.toArrow().sort_by("pair")
    cached = docs.sparkSession.sparkContext.broadcast(
        tuple(cache.column(c).to_numpy() for c in ("pair", "n", "best")))
    if least:  # pairs beyond the cache: their counts go to the chunks that hold them
        rest = (chunked.select("chunk", F.explode("pairs").alias("pair"))
                .join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
                .join(counts.filter(F.col("n") < 1 << least), "pair")
                .groupBy("chunk").agg(F.collect_list(F.struct("pair", "n", "best")).alias("found")))
        done = chunked.join(rest, "chunk", "left").select("pairs", "body", "found")
    else:
        done = chunked.select("pairs", "body", F.expr(
            "CAST(NULL AS array<struct<pair: bigint, n: bigint, best: boolean>>)").alias("found"))

    def finish(batches):
        if _TOKENS:  # the worker's units are done with
            _TOKENS.clear()
            trim()
        known, n_known, best_known = cached.value
        digits = list(map(str, range(1 << 17)))
        for part in batches:
            for row in range(part.num_rows):
                pairs = part.column(0).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
                count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
                if len(known):
                    i = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    hit = known[i] == pairs
                    count[hit], best[hit] = n_known[i[hit]], best_known[i[hit]]
                found = part.column(2).slice(row, 1).flatten()
                if len(found):
                    at = np.searchsorted(pairs, found.field(0).to_numpy())
                    count[at], best[at] = found.field(1).to_numpy(), found.field(2).to_numpy(zero_copy_only=False)
                out = _documents(_unpacked(part.column(1)[row].as_py()), pairs, count, best, digits)
                yield from steps([out], 7, 4 << 20)

    return map_arrow(done, finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                   "count_sum long, groups string")


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
