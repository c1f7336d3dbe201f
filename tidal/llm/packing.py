"""Best-fit packing: Martello-Toth dominance reduction, then best fit for what is left.

Documents become pieces of at most ``capacity`` tokens; the pieces are packed
by length.  Only the number of pieces of each length, at most ``capacity``
counts at any input size, reaches the driver; it plans bins for whole groups of
equal pieces, and the plan is dealt to the pieces on the executors.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidal.llm.common import batch, map_arrow, steps, word_keys, words
from tidal.session import materialize


class _Stock:
    """Lengths still to be packed, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {size: n for size, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest items besides one of length ``without``."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.count[size] - (size == without))
            if len(out) == n:
                break
        return out


def reduce_stock(stock: _Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins that dominate every other bin with the same largest item, fixed and taken off the stock.

    For the largest item ``j`` of each length, with room ``r`` beside it:
    nothing else fits: ``{j}``; an item fills ``r``, or no two items fit
    together: ``{j, p}`` with the largest ``p`` that fits; no three fit and the
    best pair is no larger than ``p``: ``{j, p}``; no three fit and no pair has
    a smaller member above ``b``, the largest that fits beside ``p``:
    ``{j, p, b}``.  Each stands for all other sets, item by item, so some best
    packing holds it.  Bins of equal lengths are fixed together.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        for j in list(reversed(stock.sizes)):
            while j in stock.count:
                found = _dominating(stock, j, capacity)
                if not found:
                    break
                bin_, n = found
                for size in bin_:
                    stock.take(size, n)
                fixed.append((bin_, n))
                again = True
    return fixed


def _dominating(stock: _Stock, j: int, capacity: int) -> tuple[tuple[int, ...], int] | None:
    """A dominating bin with ``j`` and how many of it; the conditions hold until one of its lengths runs out."""
    def many(*bin_: int) -> tuple[tuple[int, ...], int]:
        return bin_, min(stock.count[s] // bin_.count(s) for s in set(bin_))

    def beside(room: int, *used: int) -> int:
        """Largest length of at most ``room`` that has an item besides the used ones."""
        i = bisect.bisect_right(stock.sizes, room) - 1
        while i >= 0 and stock.count[stock.sizes[i]] <= used.count(stock.sizes[i]):
            i -= 1
        return stock.sizes[i] if i >= 0 else 0

    room = capacity - j
    p = beside(room, j)
    if not p:
        return many(j)
    low = stock.smallest(3, j)
    if p == room or len(low) < 2 or low[0] + low[1] > room:
        return many(j, p)
    if len(low) == 3 and sum(low) <= room:
        return None
    best = tall = 0  # best sum of a pair, and the largest smaller member of a pair that fits
    for y in stock.sizes:
        if 2 * y > room:
            break
        if stock.count[y] > (y == j) and (x := beside(room - y, j, y)) >= y:
            best, tall = max(best, x + y), y
    if best <= p:
        return many(j, p)
    b = beside(room - p, j, p)
    return many(j, p, b) if b and tall <= b else None


def best_fit(stock: _Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over groups of bins with equal contents."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(bin_: tuple[int, ...], n: int, room: int) -> None:
        if not n:
            return
        if not room:
            done.append((bin_, n))
            return
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((bin_, n))

    for size in reversed(stock.sizes):
        left = stock.count[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                full, rest = divmod(left, each)
                put((size,) * each, full, capacity - each * size)
                if rest:
                    put((size,) * rest, 1, capacity - rest * size)
                break
            room = rooms[i]
            bin_, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            each = room // size
            full = min(n, left // each)
            if full:
                put(bin_ + (size,) * each, full, room - each * size)
                left -= full * each
                put(bin_, n - full, room)
            else:
                put(bin_ + (size,) * left, 1, room - left * size)
                put(bin_, n - 1, room)
                left = 0
    for room in rooms:
        done += open_[room]
    return done


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, number of such bins) covering every item once."""
    stock = _Stock(counts)
    fixed = reduce_stock(stock, capacity)
    return fixed + best_fit(stock, capacity)


def _slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of equal places: first rank of the run, items per bin, first bin, offset."""
    ranks: dict[int, int] = {}
    rows, base = [], 0
    for bin_, n in bins:
        at = 0
        for size in sorted(set(bin_), reverse=True):
            k = bin_.count(size)
            rows.append((size, ranks.get(size, 0), k, base, at))
            ranks[size] = ranks.get(size, 0) + n * k
            at += k * size
        base += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("size", "rank", "each", "bin", "offset"), cols))


#: A word of letters or digits with a run of marks after it, which the tokenizer splits off.
_ENDED = re.compile(r"(.*[^\W_])([.,!?;:]+)", re.DOTALL)


class _Ids:
    """Ids of the words a worker has met, by the words' hashes; about 30 bytes each, at most about ``MOST`` words."""

    MOST = 1_000_000

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = tokenizer_path
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.flat, self.used = np.zeros(1 << 16, kind), 0

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each key, and whether it is there."""
        i = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return i, (self.key[i] == key) if len(self.key) else np.zeros(len(key), bool)

    def add(self, key: np.ndarray, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), self.flat.dtype, total)
        at = self.used + np.cumsum(size) - size
        self.used += total
        order = np.argsort(key)
        where = np.searchsorted(self.key, key[order])
        self.key = np.insert(self.key, where, key[order])
        self.at, self.size = np.insert(self.at, where, at[order]), np.insert(self.size, where, size[order])

    def encoded(self, some: list[str]) -> list[list[int]]:
        """Ids of distinct strings without white space, each encoded once."""
        key = word_keys(pa.array(some, pa.string()))
        i, known = self.find(key)
        new = np.flatnonzero(~known)
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            got = self.tokenizer.encode_batch_fast([some[n] for n in part], add_special_tokens=False)
            self.add(key[part], [e.ids for e in got])
        i, _ = self.find(key)
        return [self.flat[a:a + n].tolist() for a, n in zip(self.at[i].tolist(), self.size[i].tolist())]

    def look(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of each word start, and how many there are."""
        if len(self.key) > self.MOST:
            self.clear()
        key = word_keys(distinct)
        _, known = self.find(key)
        new = np.flatnonzero(~known)
        if len(new):
            words_ = distinct.take(pa.array(new)).to_pylist()
            split = [m.groups() if (m := _ENDED.fullmatch(w)) else (w,) for w in words_]
            units = list(dict.fromkeys(u for s in split for u in s))
            ids = dict(zip(units, self.encoded(units)))
            ended = [n for n, s in enumerate(split) if len(s) == 2]
            self.add(key[new[ended]], [ids[split[n][0]] + ids[split[n][1]] for n in ended])
        i, _ = self.find(key)
        return self.at[i], self.size[i].astype(np.int64)


#: The tokenizer and its words, which a worker loads once.
_IDS: list[_Ids] = []


def _ids(tokenizer_path: str) -> _Ids:
    if not _IDS or _IDS[0].path != tokenizer_path:
        _IDS[:] = [_Ids(tokenizer_path)]
    return _IDS[0]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of each document: ids of its words, then ``end_id``, cut every ``capacity`` ids.

    The tokenizer drops white space, never joins across it and splits marks off
    a word, so distinct words without their last marks are encoded once.  Null
    text is an empty one (one piece that holds ``end_id`` alone).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def pieces_of(part: pa.RecordBatch, known: _Ids) -> pa.RecordBatch:
        rows = part.num_rows
        each, row = words(part.column(1))
        coded = each.dictionary_encode()
        begin, size = known.look(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False) if len(each) else np.zeros(0, np.int64)
        begin, size = begin[code], size[code]
        # all ids of the step, one place left after each document for its end
        total = np.bincount(row, weights=size, minlength=rows).astype(np.int64) + 1
        off = np.concatenate([[0], np.cumsum(total)])
        stop = np.cumsum(size)
        flat = np.empty(off[-1], "<u4")
        own = np.repeat(begin - stop + size, size)
        own += np.arange(len(own))
        end = np.zeros(len(flat), bool)
        end[off[1:] - 1] = True
        flat[~end] = known.flat[own]
        flat[end] = end_id
        pieces = -(-total // capacity)
        of = np.repeat(np.arange(rows), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = nth * capacity
        length = np.minimum(capacity, total[of] - start)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip((off[of] + start).tolist(), (off[of] + start + length).tolist())]
        return batch(schema, part.column(0).take(pa.array(of)), nth.astype(np.int32), start, length, crc)

    def run(batches):
        known = _ids(tokenizer_path)
        for part in steps(batches, 1, 4 << 20):
            yield pieces_of(part, known)

    cols = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return map_arrow(cols, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
         doc_id: str = "doc_id", text: str = "text", salts: int = 256) -> DataFrame:
    """Pieces with the sequence and offset that hold each: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold at most ``capacity`` ids, without gaps.  Repeated rows are
    packed each; a null doc_id stays null; an empty table gives no rows; only
    the two named columns are read.  Pieces are written once to the shared
    folder.  Ranks within a length are counted per salt first, so pieces of one
    length spread over ``salts`` tasks.  The plan sent to the executors has at
    most a few runs per length and never grows with the corpus.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, capacity, end_id, doc_id, text), "pack-pieces")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    by_salt = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counted = materialize(by_salt, "pack-counts")  # at most capacity x salts rows
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(_slots(plan_bins(counts, capacity)))
    before = counted.select(
        "length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = (pieces
              .withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
              .join(before, ["length", "salt"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("rank")))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        slots = plan.value
        key = (slots["size"] << 44) + slots["rank"]  # ranks stay far below 2^44
        for part in batches:
            size, rank = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 5))
            i = np.searchsorted(key, (size << 44) + rank, side="right") - 1
            nth, within = np.divmod(rank - slots["rank"][i], slots["each"][i])
            yield batch(schema, *(part.column(c) for c in range(5)), slots["bin"][i] + nth,
                        slots["offset"][i] + within * size)

    return map_arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), place,
                     "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


