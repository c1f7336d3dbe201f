"""LM scoring: prediction by partial matching over byte contexts.

A trie of byte contexts is pretrained on the training texts.  A symbol is coded
by the longest known context; where that has not seen it, an escape (estimated
by the number of distinct symbols, method C) leads to the next shorter context,
from whose counts the symbols already ruled out are excluded.  Pretrained counts
are fixed, so the exclusions of each context are worked out once and all bytes of
a batch are coded side by side.  A word count model is scored beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidal.llm.common import batch, filled, held_out, map_arrow, mixed, steps, text_bytes, word_keys, words
from tidal.session import materialize

#: Bytes of context, at most 6 (a context and its symbol are packed into 56 bits).
ORDER = 5
#: Contexts of so many bytes and more are scored by the task that has all contexts with the same last bytes.
SPLIT = 3
#: Contexts with their symbols that one step of such a task takes, about.
CHUNK = 1 << 19
#: Most frequent (context, symbol) pairs whose log probabilities are broadcast; all others are looked up by a join.
MAX_PAIRS = 1 << 20
#: Most frequent words whose counts are broadcast; all others are looked up by a join.
HEAD = 1 << 18
#: Counts gathered in a task before they are sent on.
HELD = 2 << 20


class Lookup:
    """Position of a key among distinct keys: open addressing over arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(max(1, 3 * len(keys))))))
        self.slot = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys))
        pos = self._place(keys)
        while len(todo):
            free = todo[self.slot[pos[todo]] < 0]
            self.slot[pos[free]] = free
            todo = todo[self.slot[pos[todo]] != todo]
            pos[todo] = (pos[todo] + 1) & (len(self.slot) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        live, pos = np.arange(len(keys)), self._place(keys)
        while len(live):
            s = self.slot[pos]
            hit = (s >= 0) & (self.keys[s] == keys[live])
            out[live[hit]] = s[hit]
            on = (s >= 0) & ~hit
            live, pos = live[on], (pos[on] + 1) & (len(self.slot) - 1)
        return out


class Trie:
    """Contexts of 0 to ``order`` bytes with the log10 probabilities of what follows them."""

    def __init__(self, order: int, pairs: list[tuple[np.ndarray, np.ndarray]]):
        """``pairs[j]``: sorted packed (context of j bytes, symbol) and their counts."""
        self.order = order
        self.pair, self.context, self.count = [], [], []
        self.first, self.escape, self.total, self.left = [], [], [], []
        above = None  # keys, counts and totals of the next shorter contexts
        for j in range(order + 1):
            key, n = pairs[j]
            n = n.astype(np.float64)
            ctx, inverse, distinct = np.unique(key >> np.uint64(8), return_inverse=True, return_counts=True)
            total = np.bincount(inverse, weights=n, minlength=len(ctx))
            here = Lookup(key)
            self.pair.append(here)
            self.context.append(Lookup(ctx))
            self.count.append(np.log10(n))
            whole = total + distinct
            # coded in this context, when it is the first one tried
            self.first.append(np.log10(n) - np.log10(whole[inverse]) if len(key) else n)
            self.escape.append(np.log10(distinct / whole))
            if j:
                # escaped from here: what the shorter context has besides the symbols seen here
                low = np.uint64(256 ** j - 1)  # the pair without its oldest byte
                i = above["pair"].find(key & low)
                up = above["context"].find(ctx & np.uint64(256 ** (j - 1) - 1))
                gone = np.bincount(inverse, weights=above["n"][i], minlength=len(ctx))
                rest = above["distinct"][up] - distinct
                self.total.append(np.log10(np.maximum(above["total"][up] - gone + rest, 1)))
                self.left.append(rest)
            else:
                self.total.append(np.zeros(len(ctx)))
                self.left.append(np.zeros(len(ctx), np.int64))
            above = {"pair": here, "context": self.context[-1], "n": n, "total": total, "distinct": distinct}
        self.unseen = 256 - (len(pairs[0][0]))

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol; ``code`` packs its ``order`` context bytes and itself."""
        k = self.order
        i = self.pair[k].find(code & np.uint64(256 ** (k + 1) - 1))
        out = np.zeros(len(code))
        hit = i >= 0
        out[hit] = self.first[k][i[hit]]
        live = np.flatnonzero(~hit)
        prev = np.full(len(live), -1, np.int64)  # the longer context that was escaped from
        for j in range(k, -1, -1):
            if not len(live):
                return out
            key = code[live] & np.uint64(256 ** (j + 1) - 1)
            fresh = prev < 0
            if j < k:
                i = self.pair[j].find(key)
                hit = i >= 0
                a = hit & fresh
                out[live[a]] += self.first[j][i[a]]
                b = hit & ~fresh
                out[live[b]] += self.count[j][i[b]] - self.total[j + 1][prev[b]]
                live, key, prev, fresh = live[~hit], key[~hit], prev[~hit], fresh[~hit]
            ctx = self.context[j].find(key >> np.uint64(8))
            known = ctx >= 0
            a = known & fresh
            out[live[a]] += self.escape[j][ctx[a]]
            b = known & ~fresh
            if b.any():
                rest = self.left[j + 1][prev[b]]
                # nothing but excluded symbols: the escape is certain
                out[live[b]] += np.where(rest > 0, np.log10(np.maximum(rest, 1)) - self.total[j + 1][prev[b]], 0.0)
            prev = np.where(known, ctx, prev)
        # symbols that were never seen share what is left evenly
        out[live] -= np.log10(max(1, self.unseen))
        return out


def _codes(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed contexts and symbols of lowered words joined by one space, with a zero byte at the end, and their rows."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(filled(column)))
    buf, off = text_bytes(pc.ascii_trim(pc.binary_join(lists, " "), " "))
    n = len(column)
    row = np.repeat(np.arange(n), np.diff(off))
    flat = np.zeros(len(buf) + n * (order + 1), np.uint8)
    flat[np.arange(len(buf)) + (row + 1) * order + row] = buf
    code = np.zeros(len(flat), np.uint64)
    for j in range(order + 1):  # the oldest byte first
        code[order:] |= flat[j:len(flat) - order + j].astype(np.uint64) << np.uint64(8 * (order - j))
    size = np.diff(off) + 1
    start = off[:-1] + np.arange(n) * (order + 1) + order
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    return code[at], np.repeat(np.arange(n), size)


def _gather(texts: DataFrame, order: int) -> DataFrame:
    """kind, key, n, used: counts of words (0) and of contexts with their symbols (1).

    ``texts`` holds a text and whether it is held out.  ``n`` counts the training
    texts; ``used`` all texts, so every context that will be scored has a row.
    """
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64()), ("used", pa.int64())])

    def run(batches):
        held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]

        def merged(kind):
            keys, n, used = (np.concatenate(c) for c in zip(*held[kind]))
            order_ = np.argsort(keys, kind="stable")
            keys, n, used = keys[order_], n[order_], used[order_]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            held[kind] = [(keys[first], *(np.add.reduceat(c, first) if len(keys) else c for c in (n, used)))]

        def flush(kind):
            if held[kind]:
                merged(kind)
                (keys, n, used), = held[kind]
                held[kind] = []
                for at in range(0, len(keys), 1 << 18):
                    k = keys[at:at + (1 << 18)]
                    yield batch(schema, np.full(len(k), kind, np.int8), k.view(np.int64), n[at:at + (1 << 18)],
                                used[at:at + (1 << 18)])

        def size(kind):
            return sum(len(k) for k, *_ in held[kind])

        for part in steps(batches, 0, 2 << 20):
            for rest in (False, True):
                some = part.column(0).filter(pc.equal(part.column(1), rest))
                if not len(some):
                    continue
                if not rest:
                    each, _ = words(pc.ascii_lower(filled(some)))
                    coded = each.dictionary_encode()
                    n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                    held[0].append((word_keys(coded.dictionary), n, n))
                keys, used = np.unique(_codes(some, order)[0], return_counts=True)
                held[1].append((keys, np.zeros_like(used) if rest else used, used))
            for kind in (0, 1):
                if size(kind) > HELD:
                    merged(kind)
                    if size(kind) > HELD // 2:
                        yield from flush(kind)
        for kind in (0, 1):
            yield from flush(kind)

    return (map_arrow(texts, run, "kind byte, key long, n long, used long").groupBy("kind", "key")
            .agg(F.sum("n").alias("n"), F.sum("used").alias("used")))


def _floor(counts: DataFrame, most: int, by: str) -> int:
    """A least count that at most ``most`` rows exceed; counts above 2^16 are told apart by powers of two."""
    top = 1 << 16
    n = F.col(by)
    level = F.when(n <= top, n).otherwise(F.expr(f"shiftleft(1L, length(bin({by})))"))  # no row of a level exceeds it
    rows = counts.groupBy(level.alias("n")).agg(F.count("*").alias("rows")).collect()  # at most top and 47 more
    got = 0
    for r in sorted(rows, reverse=True):
        got += r["rows"]
        if got > most:
            return r["n"]
    return 0


def _summed(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order and their counts."""
    key, inverse = np.unique(pair, return_inverse=True)
    return key, np.bincount(inverse, weights=n, minlength=len(key)).astype(np.int64)


def _logs(counts: DataFrame, order: int) -> DataFrame:
    """key, used, log: the log10 probability of every context and symbol of all texts, from all training counts.

    Contexts that end alike meet in one task, so it has all that follows them at
    SPLIT bytes and more; shorter contexts, whose number the alphabet bounds, are broadcast.
    """
    split = min(SPLIT, order)
    counts = counts.filter("kind = 1")
    low = []
    if split:
        short = (counts.filter("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(256 ** split - 1)).alias("pair"))
                 .agg(F.sum("n").alias("n")).toArrow())  # at most 256 ** SPLIT rows
        pair, n = short.column("pair").to_numpy().astype(np.uint64), short.column("n").to_numpy()
        low = [_summed(pair & np.uint64(256 ** (j + 1) - 1), n) for j in range(split)]
    shared = counts.sparkSession.sparkContext.broadcast(low)
    schema = pa.schema([("key", pa.int64()), ("used", pa.int64()), ("log", pa.float64())])

    def run(batches):
        got = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
        if not got:
            return
        key, n, used = (np.concatenate(c) for c in zip(*got))
        key = key.astype(np.uint64)
        end = (key >> np.uint64(8)) & np.uint64(256 ** split - 1)
        by = np.argsort(end, kind="stable")
        key, n, used, end = key[by], n[by], used[by], end[by]
        edges = np.r_[np.flatnonzero(np.r_[True, end[1:] != end[:-1]]), len(end)]
        at = 0
        while at < len(key):  # whole ends, about CHUNK rows
            to = int(edges[max(np.searchsorted(edges, at + CHUNK, side="right") - 1, np.searchsorted(edges, at) + 1)])
            some, m = key[at:to], n[at:to]
            pairs = [_summed(some[m > 0] & np.uint64(256 ** (j + 1) - 1), m[m > 0]) for j in range(split, order + 1)]
            logs = Trie(order, [*shared.value, *pairs]).score(some)
            for a in range(0, len(some), 1 << 18):
                yield batch(schema, some[a:a + (1 << 18)].view(np.int64), used[at + a:min(to, at + a + (1 << 18))],
                            logs[a:a + (1 << 18)])
            at = to

    ends = F.shiftright("key", 8).bitwiseAND(F.lit(256 ** split - 1))
    return map_arrow(counts.select("key", "n", "used").repartition(ends), run, "key long, used long, log double")


def score(docs: DataFrame, order: int = ORDER, max_pairs: int = MAX_PAIRS, head: int = HEAD,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Both models learn from all texts whose crc32(doc_id) mod 7 is not 2 and see
    a text as its words, A-Z lowered, between single spaces, and one end.
    ``base_score`` is the add-one word model; ``score`` the log10 probability of
    the same sequence, byte by byte.  Null and empty texts are the end alone.
    Repeated rows are scored each (and teach each); an empty table gives no
    rows; only the two named columns are read.

    Counts cover all training texts, and every pair is scored with all of them.
    Broadcast are the counts of the ``head`` most frequent words and the log
    probabilities of the ``max_pairs`` most frequent context pairs, as a cache of
    a stated size; the others meet theirs in a join, whose keys are rare, so none
    is hot.
    """
    spark = docs.sparkSession
    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    teach = cols.filter(~held_out("doc_id", 7, 2))
    counts = materialize(_gather(cols.select("text", held_out("doc_id", 7, 2)), order), "lm-counts")
    ends = teach.select("doc_id").count()
    sums = counts.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens = sums["n"] + ends
    distinct = sums["v"] + (1 if ends else 0)
    logs = materialize(_logs(counts, order), "lm-logs")
    seldom = _floor(logs, max_pairs, "used")
    often = logs.filter(F.col("used") > seldom).select("key", "log").toArrow()  # at most max_pairs rows
    rare = _floor(counts.filter("kind = 0"), head, "n")
    top = counts.filter(F.expr("kind = 0") & (F.col("n") > rare)).select("key", "n").toArrow()  # at most head rows
    shared = spark.sparkContext.broadcast((
        Lookup(often.column("key").to_numpy().astype(np.uint64)), often.column("log").to_numpy(),
        Lookup(top.column("key").to_numpy().view(np.uint64)), np.log10(top.column("n").to_numpy() + 1.0)))
    end_log = float(np.log10(ends + 1))

    schema = pa.schema([("row", pa.int64()), ("kind", pa.int8()), ("key", pa.int64()), ("m", pa.int32()),
                        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("part", pa.float64()), ("score", pa.float64())])

    def run(batches):
        pairs, pair_logs, known, logs = shared.value
        base = TaskContext.get().partitionId() << 40  # rows of one scan task, in its order

        def look_up(kind, names, r, keys, times):
            m = len(r)
            return batch(schema, names[r], np.full(m, kind, np.int8), keys.view(np.int64), times.astype(np.int32),
                         *(pa.nulls(m, f.type) for f in list(schema)[4:]))

        for some in steps(batches, 1):
            n = some.num_rows
            names = base + np.arange(n)
            base += n
            code, row = _codes(some.column(1), order)
            at = pairs.find(code)
            common = at >= 0
            lm = np.bincount(row[common], weights=pair_logs[at[common]], minlength=n)
            keys, code = np.unique(code[~common], return_inverse=True)
            rest, times = np.unique(row[~common] * (len(keys) + 1) + code, return_counts=True)
            r, c = np.divmod(rest, len(keys) + 1)
            yield look_up(1, names, r, keys[c], times)
            each, row = words(pc.ascii_lower(filled(some.column(1))))
            coded = each.dictionary_encode()
            keys = word_keys(coded.dictionary)
            place = known.find(keys)
            code = coded.indices.to_numpy(zero_copy_only=False) if len(each) else np.zeros(0, np.int64)
            at = place[code]
            common = at >= 0
            part = np.bincount(row[common], weights=logs[at[common]], minlength=n) + end_log
            have = np.bincount(row[common], minlength=n) + (1 if ends else 0)
            # the row itself, of a kind of its own that nothing is found for
            yield batch(schema, names, np.full(n, 2, np.int8), mixed(names.view(np.uint64)).view(np.int64),
                        np.zeros(n, np.int32), some.column(0), np.bincount(row, minlength=n) + 1, have, part, lm)
            rest, times = np.unique(row[~common] * (len(keys) + 1) + code[~common], return_counts=True)
            r, c = np.divmod(rest, len(keys) + 1)
            yield look_up(0, names, r, keys[c], times)

    coded = map_arrow(cols, run, "row long, kind byte, key long, m int, doc_id long, n_tokens long, n_known long, "
                                 "part double, score double")
    table = (counts.filter(F.expr("kind = 0") & (F.col("n") <= rare))
             .select("kind", "key", F.log10(F.col("n") + F.lit(1.0)).alias("log"))
             .union(logs.filter(F.col("used") <= seldom).select(F.lit(1).cast("byte"), "key", "log")))
    looked = coded.join(table, ["kind", "key"], "left")

    def found(kind, value):
        return F.coalesce(F.sum(F.when((F.col("kind") == kind) & F.col("log").isNotNull(), value)), F.lit(0))

    rows = looked.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"),
        F.max("part").alias("part"), (F.max("score") + found(1, F.col("m") * F.col("log"))).alias("score"),
        found(0, F.col("m")).alias("rare_known"), found(0, F.col("m") * F.col("log")).alias("rare_part"))
    return rows.select(
        "doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("part") + F.col("rare_part") - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1))))
        .alias("base_score"), "score")
