"""Toxicity: compression distance with two zstandard dictionaries.

One dictionary is trained on ordinary text, the other on toxic text.  Each
window of a text, a word between spaces, is compressed with both; a window that
the toxic dictionary makes shorter speaks for toxicity.  The differences of a
text are turned into a score that is calibrated on the labelled rows.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidal.llm.common import batch, filled, held_out, map_arrow, steps, trim, words
from tidal.session import materialize

#: A window is a word; longer words are cut into windows that overlap by a quarter.
WINDOW = 64
#: A window is written so often before it is compressed, so that block headers cost both sides the same.
TIMES = 4
#: Lengths of the segments that a dictionary is made of.
SEGMENTS = (5, 6, 7, 8)
#: Windows with at least these differences are counted besides the largest difference.
CLEAR = (3, 4, 5)
_PARAMS = {"window_log": 14, "hash_log": 14, "chain_log": 14, "search_log": 6, "min_match": 5, "target_length": 64,
           "strategy": zstandard.STRATEGY_LAZY2}


#: Texts whose segments are counted together.
GROUP = 64


def _segments(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every distinct (segment of ``n`` bytes packed into an integer, text that holds it), in order."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    m = max(0, len(buf) - n + 1)
    key = np.zeros(m, np.uint64)
    for j in range(n):
        key = (key << np.uint64(8)) | buf[j:j + m]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))[:m]
    inside = np.arange(m) + n <= off[doc + 1]
    key, doc = key[inside], doc[inside]
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def _groups(texts: list[bytes], n: int):
    """Segments of a few texts at a time, so that arrays stay small at any number of texts; texts keep their numbers."""
    for at in range(0, len(texts), GROUP):
        key, doc = _segments(texts[at:at + GROUP], n)
        yield key, doc + np.int32(at)


def _held(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct segments, in order, and how many texts hold each."""
    key, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for more, _ in _groups(texts, n):
        more, times = np.unique(more, return_counts=True)
        i = np.minimum(np.searchsorted(key, more), max(0, len(key) - 1))
        old = key[i] == more if len(key) else np.zeros(len(more), bool)
        count[i[old]] += times[old]
        where = np.searchsorted(key, more[~old])
        key, count = np.insert(key, where, more[~old]), np.insert(count, where, times[~old])
    return key, count


def train(toxic: list[bytes], ordinary: list[bytes], size: int = 4096, common: int = 1000) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary, from sampled texts.

    The library's own trainer only follows frequency and would fill both
    dictionaries with what the classes share.  So the toxic one covers the toxic
    texts greedily with segments that stand out against ordinary text (a text's
    worth halves with each segment that it holds, so all texts get some), and
    both hold the most common ordinary words.
    """
    words_ = Counter(w for t in ordinary for w in set(t.split()))
    shared = b"".join(b" " + w + b" " for w, _ in sorted(words_.items(), key=lambda x: (-x[1], x[0]))[:common])
    held: dict[bytes, tuple[np.ndarray, float]] = {}
    nt, no = len(toxic), len(ordinary)
    for n in SEGMENTS if nt and no else ():
        key, count = _held(toxic, n)
        key, count = key[count >= min(4, nt)], count[count >= min(4, nt)]
        against = np.zeros(len(key), np.int64)
        for other, _ in _groups(ordinary, n):
            at = np.searchsorted(key, other)
            at = at[(at < len(key)) & (key[np.minimum(at, max(0, len(key) - 1))] == other)] if len(key) else at[:0]
            against += np.bincount(at, minlength=len(key))
        odds = np.log((count + 0.5) / (nt + 1)) - np.log((against + 0.5) / (no + 1))
        key, odds = key[odds >= 2.5], odds[odds >= 2.5]
        holders: list[list[np.ndarray]] = [[] for _ in key]
        for more, doc in _groups(toxic, n):
            low, high = np.searchsorted(more, key, side="left"), np.searchsorted(more, key, side="right")
            for k in np.flatnonzero(high > low):
                holders[k].append(doc[low[k]:high[k]])
        for k, docs in enumerate(holders):
            held[int(key[k]).to_bytes(8, "big")[8 - n:]] = (np.concatenate(docs), float(odds[k]))
    worth = np.ones(nt)

    def gain(s: bytes) -> float:
        docs, odds = held[s]
        return -float(worth[docs].sum()) * odds * len(s)

    queue = [(gain(s), s) for s in held]
    heapq.heapify(queue)
    chosen: list[bytes] = []
    room = size
    while queue and room > 0:
        _, s = heapq.heappop(queue)
        now = gain(s)
        if queue and now > queue[0][0]:
            heapq.heappush(queue, (now, s))
            continue
        if worth[held[s][0]].sum() < min(2.5, nt):
            break
        chosen.append(s)
        room -= len(s) + 1
        worth[held[s][0]] /= 2
    mark = b" ".join(reversed(chosen))
    # as much ordinary text in place of the toxic segments, so both dictionaries have one size
    fill = b" ".join(ordinary)[:len(mark)].ljust(len(mark))
    return shared + mark, shared + fill


class Compressors:
    """Both compressors; made where they are used."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.contents = toxic, ordinary
        self._made = None
        self._known: dict[bytes, int] = {}

    def __getstate__(self):
        return {"contents": self.contents, "_made": None, "_known": {}}

    def _open(self):
        made = []
        params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False,
                                                     write_dict_id=False, **_PARAMS)
        for content in self.contents:
            d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=zstandard.ZstdCompressionParameters(**_PARAMS))
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        self._made = made

    def forget(self) -> None:
        self._known.clear()

    def differences(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each word, the most over a long word's windows."""
        if self._made is None:
            self._open()
        toxic, ordinary = self._made
        known = self._known
        if len(known) > 200_000:  # a cache of lengths; nothing depends on it
            known.clear()
        out = np.empty(len(windows), np.int32)
        for i, w in enumerate(windows):
            d = known.get(w)
            if d is None:
                if len(w) <= WINDOW:
                    x = (b" " + w + b" ") * TIMES
                    d = known[w] = len(ordinary(x)) - len(toxic(x))
                else:
                    d = -WINDOW
                    for at in range(0, len(w) - WINDOW // 4, WINDOW - WINDOW // 4):
                        x = (b" " + w[at:at + WINDOW] + b" ") * TIMES
                        d = max(d, len(ordinary(x)) - len(toxic(x)))
            out[i] = d
        return out


def evidence(docs: DataFrame, compressors: Compressors, doc_id: str = "doc_id", text: str = "text",
             key: str | None = None) -> DataFrame:
    """doc_id, n, most, c3, c4, c5: a text's windows, their largest difference, and how many reach each of CLEAR.

    A long column named by ``key`` is carried along under its name.
    """
    carried = [key] if key else []
    shared = docs.sparkSession.sparkContext.broadcast(compressors)  # a few thousand bytes
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("most", pa.int32()),
                        *((f"c{c}", pa.int64()) for c in CLEAR), *((c, pa.int64()) for c in carried)])

    def run(batches):
        try:
            for part in steps(batches, 1, 4 << 20):
                n = part.num_rows
                each, row = words(pc.ascii_lower(filled(part.column(1))))
                coded = each.dictionary_encode()
                diff = shared.value.differences(coded.dictionary.cast(pa.binary()).to_pylist())
                diff = diff[coded.indices.to_numpy(zero_copy_only=False)] if len(each) else np.zeros(0, np.int32)
                most = np.zeros(n, np.int32)
                np.maximum.at(most, row, diff)
                yield batch(schema, part.column(0), np.bincount(row, minlength=n), most,
                            *(np.bincount(row, weights=diff >= c, minlength=n).astype(np.int64) for c in CLEAR),
                            *part.columns[2:])
        finally:
            shared.value.forget()

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carried)
    return map_arrow(cols, run, "doc_id long, n long, most int, " +
                     ", ".join([*(f"c{c} long" for c in CLEAR), *(f"`{c}` long" for c in carried)]))


def features() -> list[Column]:
    """Largest difference, and the clear windows by number and by share, on scales with an end."""
    n = F.greatest("n", F.lit(1))
    return [F.least("most", F.lit(10)).cast("double"),
            *(F.least(F.log1p(F.col(f"c{c}").cast("double")), F.lit(4.0)) for c in CLEAR),
            *(F.log1p(200.0 * F.col(f"c{c}") / n) for c in CLEAR)]


def calibrate(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights, the constant first, by Newton steps with a slight pull to zero."""
    x = np.c_[np.ones(len(x)), x]
    pull = np.eye(x.shape[1]) * 0.1
    pull[0, 0] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + pull
        step = np.linalg.solve(bend, x.T @ (weight * (toxic - p)) - pull @ b)
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return b


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = 1000,
             fit_bytes: int = 32768, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
             key: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (and the long column ``key``, if named) for every row of ``docs``.

    Labels are learned from rows with crc32(doc_id) mod 3 other than 1.  The
    dictionaries are trained on the ``fit_rows`` labelled texts of each class of
    least hash among those of at most ``fit_bytes`` bytes (the stated bound of
    the sample); the calibration covers all labelled rows, and every window of
    every text is scored.  Null and empty texts have no windows and get the
    score of a text without evidence.  Labels other than 0 and 1 and null ids teach
    nothing; an id with labels of both kinds counts as toxic; without both
    classes the score is the share of toxic labels seen (0.5 without any).
    Repeated rows are scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = (labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("toxic"))
             .filter("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
             .filter(~held_out("id", 3, 1)))
    # the sample's ids first, from ids and sizes alone; then only their texts
    sizes = docs.select(F.col(doc_id).cast("long").alias("id"), F.octet_length(F.col(text).cast("string")).alias("size"))
    fit = sizes.filter(F.col("size") <= fit_bytes).join(known, "id").select("id", "toxic").distinct()
    ids = [r for t in (0, 1) for r in
           fit.filter(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()]
    chosen = spark.createDataFrame([(r["id"], r["toxic"]) for r in ids], "id long, toxic int")  # 2 x fit_rows ids
    rows = (docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
            .filter(F.octet_length("text") <= fit_bytes).join(F.broadcast(chosen), "id")
            .groupBy("id", "toxic").agg(F.min("text").alias("text")).orderBy("id").collect() if ids else [])
    texts: list[list[bytes]] = [[], []]
    for r in rows:
        texts[r["toxic"]].append(r["text"].encode().lower())
    made = Compressors(*train(texts[1], texts[0]))
    del rows, texts
    trim()  # the driver's share goes back before the scoring starts
    marks = materialize(evidence(docs, made, doc_id, text, key), "toxicity-marks")
    # labelled rows in cells of a grid: a bounded number at any number of rows
    grid = [F.round(f * 8).cast("int").alias(f"f{i}") for i, f in enumerate(features())]
    cells = marks.join(known, marks["doc_id"] == known["id"]).groupBy("toxic", *grid).count().collect()
    seen = [sum(r["count"] for r in cells if r["toxic"] == t) for t in (0, 1)]
    if all(seen):
        x = np.array([[r[f"f{i}"] / 8 for i in range(len(grid))] for r in cells])
        b = calibrate(x, np.array([r["toxic"] for r in cells]), np.array([r["count"] for r in cells], float))
        line = F.lit(float(b[0]))
        for f, w in zip(features(), b[1:]):
            line = line + f * float(w)
        score = 1 / (1 + F.exp(-line))
    else:
        score = F.lit(seen[1] / sum(seen) if sum(seen) else 0.5)
    return (marks.withColumn("score", score)
            .select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"),
                    *([key] if key else [])))
