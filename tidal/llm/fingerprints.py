"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over seven bytes sets chunk boundaries where it hits the block
size; each chunk gives one character of the signature.  The block size follows
the text's length, and the next larger one is signed too, so texts of similar
length can be compared.  Signatures are compared by edit distance.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidal.llm.common import WindowHash, batch, map_arrow, mixed

#: Characters of a signature, in order.
LETTERS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
#: The smallest block; block sizes are ``BLOCK * 2**k``.
BLOCK = 3
#: Characters of a signature at most; the last takes all that follows.
LONG = 64
#: A shared run of so many characters is needed for any likeness, as in spamsum.
RUN = 7
WINDOW = 7
_LETTERS = np.frombuffer(LETTERS.encode(), np.uint8)


class Signatures:
    """Block exponents and the two signatures (codes 0 to 63 in rows, with their lengths) of many texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        size = np.diff(off)
        hashes = WindowHash(buf)
        level, place = self._triggers(buf, off, hashes)
        doc = np.searchsorted(off, place, side="left") - 1  # the text that ends a chunk at ``place``
        # boundaries at each level, then at that level or above
        count = np.bincount(doc * 33 + level, minlength=n * 33).reshape(n, 33)[:, ::-1].cumsum(1)[:, ::-1]
        k = np.zeros(n, np.int64)
        big = size > BLOCK * LONG
        k[big] = np.ceil(np.log2(size[big] / (BLOCK * LONG))).astype(np.int64)
        row = np.arange(n)
        while True:  # too few chunks: halve the block
            few = (k > 0) & (count[row, np.minimum(k, 32)] < LONG // 2 - 1)
            if not few.any():
                break
            k[few] -= 1
        self.k = k
        self.sig, self.len = [], []
        for more in (0, 1):
            sig, length = self._sign(hashes, off, doc, place, level >= k[doc] + more, n)
            self.sig.append(sig)
            self.len.append(length)

    @staticmethod
    def _triggers(buf: np.ndarray, off: np.ndarray, hashes: WindowHash) -> tuple[np.ndarray, np.ndarray]:
        """Ends of windows whose hash hits block ``BLOCK * 2**level``, the highest such level."""
        h = hashes.each(WINDOW) >> np.uint64(32)
        at = np.flatnonzero(h % np.uint64(BLOCK) == 0)
        end = at + WINDOW
        inside = off[np.searchsorted(off, end, side="left") - 1] <= at
        at, end = at[inside], end[inside]
        t = h[at] // np.uint64(BLOCK)
        low = t & (~t + np.uint64(1))
        level = np.where(t == 0, 32, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64)
        return np.minimum(level, 32), end

    @staticmethod
    def _sign(hashes: WindowHash, off, doc, place, use, n) -> tuple[np.ndarray, np.ndarray]:
        doc, place = doc[use], place[use]
        nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
        cut = (nth < LONG - 1) & (place < off[doc + 1])
        doc, place, nth = doc[cut], place[cut], nth[cut]
        # chunks: up to each boundary, then what is left of every text that is not empty
        got = np.bincount(doc, minlength=n)
        rest = np.flatnonzero(np.diff(off) > 0)
        all_doc = np.concatenate([doc, rest])
        all_nth = np.concatenate([nth, got[rest]])
        all_end = np.concatenate([place, off[rest + 1]])
        order = np.lexsort((all_nth, all_doc))
        all_doc, all_nth, all_end = all_doc[order], all_nth[order], all_end[order]
        begin = np.where(all_nth == 0, off[all_doc], np.concatenate([[0], all_end[:-1]])) if len(all_doc) else all_end
        sig = np.full((n, LONG), 255, np.uint8)
        sig[all_doc, all_nth] = (hashes.of(begin, all_end) >> np.uint64(58)).astype(np.uint8)
        return sig, np.bincount(all_doc, minlength=n)

    def text(self) -> list[str]:
        a, b = (np.where(s < 64, _LETTERS[s & 63], 32).view(f"S{LONG}").ravel().astype(str).tolist() for s in self.sig)
        return [f"{BLOCK << int(k)}:{x.strip()}:{y.strip()}" for k, x, y in zip(self.k, a, b)]

    def take(self, rows) -> "Signatures":
        out = object.__new__(Signatures)
        out.k, out.sig, out.len = self.k[rows], [s[rows] for s in self.sig], [n[rows] for n in self.len]
        return out


def parse(fingerprints: list[str]) -> Signatures:
    """Signatures back from their text."""
    code = np.full(256, 255, np.uint8)
    code[_LETTERS] = np.arange(64)
    out = object.__new__(Signatures)
    parts = [f.split(":") for f in fingerprints]
    out.k = np.array([(int(p[0]) // BLOCK).bit_length() - 1 for p in parts], np.int64)
    out.sig, out.len = [], []
    for i in (1, 2):
        out.len.append(np.array([len(p[i]) for p in parts], np.int64))
        joined = "".join(p[i].ljust(LONG) for p in parts).encode()
        out.sig.append(code[np.frombuffer(joined, np.uint8)].reshape(-1, LONG))
    return out


def common_subsequence(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair, 64 cells of the table at a time."""
    n = len(a)
    row = np.arange(n)
    mask = np.zeros((n, 256), np.uint64)
    for i in range(LONG):
        mask[row, a[:, i]] |= np.uint64(1 << i)
    mask[:, 255] = 0
    v = np.full(n, ~np.uint64(0))
    for j in range(int(nb.max(initial=0))):
        u = v & mask[row, b[:, j]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def shares_run(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether a pair shares a run of RUN characters (of all of them, where both are shorter)."""
    short = np.maximum(na, nb) < RUN
    out = short & (na == nb) & (na > 0) & (np.where(a == b, 1, 0).sum(1) == LONG)
    pad = np.where(a == 255, 254, a)
    for shift in range(RUN - LONG, LONG - RUN + 1):
        x, y = (pad[:, shift:], b[:, :LONG - shift]) if shift >= 0 else (pad[:, :shift], b[:, -shift:])
        eq = x == y
        run = eq[:, :-1] & eq[:, 1:]      # 2
        run4 = run[:, :-2] & run[:, 2:]   # 4
        out |= (run4[:, :-3] & run4[:, 3:]).any(1)  # 4 + 4 with one shared: 7
    return out


def _alike(a, na, b, nb) -> np.ndarray:
    out = np.zeros(len(a))
    i = np.flatnonzero(shares_run(a, na, b, nb))
    if len(i):
        lcs = common_subsequence(a[i], na[i], b[i], nb[i])
        # edit distance where a replacement counts as a removal and an insertion: na + nb - 2 lcs
        out[i] = 2.0 * lcs / (na[i] + nb[i])
    return out


def likeness(x: Signatures, y: Signatures) -> np.ndarray:
    """1 - edit distance / total length at the best common block size; 0 without one; two empty texts are alike."""
    out = np.zeros(len(x.k))
    for i, j, d in ((0, 0, 0), (1, 1, 0), (1, 0, 1), (0, 1, -1)):
        r = np.flatnonzero(y.k - x.k == d)
        for at in range(0, len(r), 4096):
            s = r[at:at + 4096]
            out[s] = np.maximum(out[s], _alike(x.sig[i][s], x.len[i][s], y.sig[j][s], y.len[j][s]))
    out[(x.len[0] == 0) & (y.len[0] == 0)] = 1.0
    return out


def signatures(texts: list[str]) -> Signatures:
    """Signatures of some texts, held end to end in one buffer."""
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return Signatures(np.frombuffer(b"".join(raw), np.uint8), off)


def _following(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by ranges of doc_id, in order, each range followed by the first row of the next.

    The ranges come from quantiles of doc_id; the first id of each is looked up
    in the ids alone, so the texts move once.
    """
    ids = docs.select("doc_id")
    ends = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100_000)).first()[0] \
        if parts > 1 else None
    ends = sorted(set(ends or []))

    def part() -> Column:
        # null ids come last
        at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("doc_id"))) if ends else F.lit(0)
        return F.when(F.col("doc_id").isNull(), len(ends) + 1).otherwise(at).cast("int")

    first = {r["part"]: r["first"] for r in
             ids.select("doc_id", part().alias("part")).groupBy("part").agg(F.min("doc_id").alias("first")).collect()}
    full = sorted(first)
    back, opening = {}, {}
    for i, p in enumerate(full):
        before = full[i - 1]  # of the first part: the last, around the end
        back[p], opening[p] = before, first[p]
    n = len(ends) + 2
    back_ = F.array(*[F.lit(back.get(p, 0)) for p in range(n)])
    opening_ = F.array(*[F.lit(opening.get(p)).cast("long") for p in range(n)])
    opens = F.col("doc_id").eqNullSafe(F.element_at(opening_, F.col("part") + 1))
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))
    there = F.struct(F.element_at(back_, F.col("part") + 1).alias("part"), F.lit(1).alias("tail"))
    return (docs.withColumn("part", part())
            .withColumn("at", F.explode(F.when(opens, F.array(here, there)).otherwise(F.array(here))))
            .select("at.part", "at.tail", "doc_id", "text")
            .repartitionById(n, F.col("part"))
            .sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text"))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint each text, and its edited text, and compare them and the next document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The edited text has its last ``floor(n_chars / 4)``
    code points replaced by the first as many (or all) of the next document, by
    ascending doc_id, nulls last, repeated ids by the hash of their texts; after
    the last comes the first, which for a single row is itself.  Null text is
    empty; an empty text's signatures are empty, and two of them are alike (1).
    An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def make(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows for all texts but the last, which only follows."""
        edited = []
        for own, nxt in zip(texts, texts[1:]):
            cut = len(own) // 4
            edited.append(own[:len(own) - cut] + nxt[:cut])
        own, new = signatures(texts), signatures(edited)
        here, there = np.arange(len(texts) - 1), np.arange(1, len(texts))
        return batch(schema, ids[:-1], [len(t) for t in texts[:-1]],
                     [hashlib.sha256(t.encode()).hexdigest() for t in edited], own.text()[:-1], new.text(),
                     likeness(own.take(here), new), likeness(own.take(here), own.take(there)))

    def run(batches):
        ids: list = []
        texts: list[str] = []
        held, closed = 0, False
        for part in batches:
            for tail, i, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                if closed:
                    continue  # more rows of the id that opens the next range
                closed = tail == 1
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held > 400_000 and len(ids) > 1:
                    yield make(ids, texts)
                    ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield make(ids, texts)

    return map_arrow(_following(cols, parts), run,
                     "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                     "edited_fingerprint string, near_edited double, near_next double")
