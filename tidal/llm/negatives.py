"""Hard-negative mining with rotated one-bit codes.

Every vector, of integer components, is rotated into a wider space; the signs of its
rotated components are its code.  Stored beside the code are the length of the
code's direction within the space of the vectors, the vector's part along it
(the alignment) and the length of the rest (the residual).  An anchor's
rotated components are rounded to a grid of 8 bits, so its product with a code is a sum of
popcounts over bit planes.  With the anchor's part along the code, Cauchy-Schwarz
bounds what residual and rounding can add: each inner product lies in a known
interval.  Rows whose interval cannot reach the result are passed over, the
others get their integer inner product.

Rows and anchors meet block by block.  Two rounds over the blocks: the first finds each
anchor's positives, the second the negatives in the window below each positive.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidal.llm.common import map_arrow
from tidal.session import materialize

#: Bits of a code for each component of a vector, and bits of an anchor's rounded components.
BITS, PLANES = 4, 8
#: Rows and anchors of a block at most.
ROWS, ANCHORS = 1 << 15, 1 << 10
#: Stands for a missing id: behind all others in ties.
_NO_ID = (1 << 63) - 1


def rotation(width: int) -> np.ndarray:
    """Orthonormal columns that take ``width`` components to the bits of a code (a multiple of 64)."""
    bits = max(64, -(-BITS * width // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng([20240511, width]).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :width])


class Codes:
    """One-bit codes of the rows of an integer matrix, with what bounds their inner products."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        x = vectors.astype(float)
        sign = x @ turn.T >= 0
        self.bits = np.packbits(sign, axis=1).view(np.uint64)  # rows x words
        # the code's direction, seen from the space of the vectors
        inside = (np.where(sign, 1.0, -1.0) / math.sqrt(len(turn))) @ turn
        self.length = np.maximum(np.sqrt((inside * inside).sum(axis=1)), 1e-300)  # 0 for vectors without components
        self.along = (x * inside).sum(axis=1) / self.length
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.rest = np.sqrt(np.maximum(self.norm ** 2 - self.along ** 2, 0.0))

    def bounds(self, anchor: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest value of each row's inner product with ``anchor``."""
        turned = turn @ anchor.astype(float)
        bits = len(turned)
        top = float(np.abs(turned).max())
        step = 2 * top / ((1 << PLANES) - 1) or 1.0
        level = np.rint((turned + top) / step).astype(np.int64)
        planes = np.packbits((level >> np.arange(PLANES)[:, None] & 1).astype(bool), axis=1).view(np.uint64)
        ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        weighed = np.zeros(len(self.bits), np.int64)
        for k in range(PLANES):
            weighed += np.bitwise_count(self.bits & planes[k]).sum(axis=1, dtype=np.int64) << k
        # sum of sign * rounded component: signs are 2 * bit - 1, rounded components level * step - top
        estimate = ((2 * weighed - level.sum()) * step - (2 * ones - bits) * top) / math.sqrt(bits)
        error = float(np.linalg.norm(turned - (level * step - top)))  # a code has length 1
        part = estimate / self.length  # the anchor along the code's direction, within error / length
        off = error / self.length
        size = float(np.sqrt((anchor.astype(float) ** 2).sum()))
        least_part = np.maximum(np.abs(part) - off, 0.0)
        beside = self.rest * np.sqrt(np.maximum(size * size - least_part ** 2, 0.0))
        slack = beside + np.abs(self.along) * off + 1e-9 * self.norm * size + 1e-6
        middle = self.along * part
        return middle - slack, middle + slack


def _top(score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` places by score, highest first, ties by id."""
    return np.lexsort((ident, -score))[:k]


class Block:
    """Rows of one block: keys, ids, labels, vectors and their codes."""

    def __init__(self, key: np.ndarray, ident: np.ndarray, label: np.ndarray, data: bytes, turn: np.ndarray):
        self.key, self.ident, self.label = key, ident, label
        self.vectors = np.frombuffer(data, "<i8").reshape(len(key), -1)
        self.turn, self.codes = turn, Codes(self.vectors, turn)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.vectors[rows] @ anchor

    def positives(self, key: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` rows of the label other than the anchor's own: places and scores."""
        low, high = self.codes.bounds(anchor, self.turn)
        mine = np.flatnonzero((self.label == label) & (self.key != key))
        if len(mine) > k:
            floor = np.partition(low[mine], len(mine) - k)[len(mine) - k]
            mine = mine[high[mine] >= floor]
        # the best estimates first: their integer scores raise the floor for the rest
        if len(mine) > 4 * k:
            best = mine[np.argpartition(-(low + high)[mine], 2 * k)[:2 * k]]
            mine = mine[high[mine] >= np.sort(self.scores(best, anchor))[-k]]
        score = self.scores(mine, anchor)
        first = _top(score, self.ident[mine], k)
        return mine[first], score[first]

    def negatives(self, label: int, anchor: np.ndarray, windows: list[int], k: int, share: int):
        """For each positive score the first ``k`` rows of other labels in its window: places and scores."""
        low, high = self.codes.bounds(anchor, self.turn)
        other = np.flatnonzero(self.label != label)
        low, high = low[other], high[other]
        need = np.zeros(len(other), bool)
        for top in windows:
            least = share * top / 100
            sure = (high <= top) & (low >= least)
            if sure.sum() >= k:  # k rows surely inside: rows below their k-th lower bound cannot follow
                least = max(least, float(np.partition(low[sure], -k)[-k]))
            need |= (high >= least) & (low <= top)
        rows = other[need]
        score = self.scores(rows, anchor)
        out = []
        for top in windows:
            inside = np.flatnonzero((100 * score >= share * top) & (score <= top))
            inside = inside[_top(score[inside], self.ident[rows[inside]], k)]
            out.append((rows[inside], score[inside]))
        return out


def _prepared(df: DataFrame, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """key, vec_id, label, width, data (integer components) of the rows that take part."""
    out = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("width", pa.int32()),
                     ("data", pa.binary())])

    def run(batches):
        for part in batches:
            column = part.column(3)
            size = np.asarray(column.value_lengths())
            x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(scale))
            longest = int(size.max(initial=0))
            if longest and float(np.abs(x).max(initial=0.0)) ** 2 * max(longest, 100) >= 2.0 ** 62:
                raise ValueError("components too large for inner products of 64 bits")
            x = x.astype("<i8")
            at = np.concatenate([[0], np.cumsum(size)]).tolist()
            data = [x[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array(size, pa.int32()),
                                              pa.array(data, pa.binary())], schema=out)

    whole = (F.col("label").isNotNull() & F.col("vector").isNotNull()
             & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = (df.select(F.monotonically_increasing_id().alias("key"),
                      F.coalesce(df[vec_id].cast("long"), F.lit(_NO_ID)).alias("vec_id"),
                      df[label].cast("long").alias("label"), df[vector].cast("array<double>").alias("vector"))
            .filter(whole))
    return map_arrow(rows, run, "key long, vec_id long, label long, width int, data binary")


def _packs(rows: DataFrame, block: str, *more: str) -> DataFrame:
    """One row for each width and block, with its rows as arrays in the order of their keys."""
    each = F.sort_array(F.collect_list(F.struct("key", "vec_id", "label", "data", *more)))
    return rows.groupBy("width", block).agg(each.alias("rows")).select(
        "width", block, *(F.col(f"rows.{c}").alias(f"{block}_{c}") for c in ("key", "vec_id", "label", *more)),
        F.col("rows.data").alias(f"{block}_data"))


def mine(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256,
         vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", block_rows: int = ROWS,
         block_anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x); anchors are the rows whose id is
    divisible by ``every``.  An anchor's positives are the ``positives`` other
    rows of its label with the highest inner products; for each of them the
    first ``negatives`` rows of other labels whose product is at least ``share`` per cent
    of the positive's and at most as high are returned.  Ties go to the smaller id.

    Rows with a null label, a null vector or a component that is null or not
    finite take no part.  A row without an id is no anchor; it may be a positive or a
    negative (with a null id) and comes last in ties.  Every row counts on its own, also where ids or whole rows
    repeat; vectors meet those of their own width only.  An empty table, or one without anchors, gives no rows.
    Components whose products could pass 64 bits are an error.

    Every anchor meets every row, in blocks: at most ``block_rows`` x ``block_anchors`` at a time.  Blocks
    go by a hash of the row, so no label or copy makes a large one.
    """
    spark = df.sparkSession
    all_rows = materialize(_prepared(df, vec_id, label, vector, scale), "negatives-rows")
    n = all_rows.count()
    slots = spark.sparkContext.defaultParallelism * 4
    blocks = max(1, -(-n // block_rows), min(slots, n // 512))
    groups = max(1, -(-n // every // block_anchors))
    rows = all_rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    packed = materialize(_packs(rows, "block"), "negatives-blocks")
    anchors = (all_rows.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != _NO_ID))
               .withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")))

    def met(groups_: DataFrame) -> DataFrame:
        """Every block of rows beside every group of anchors of its width, dealt by both."""
        spread = groups_.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return packed.join(spread, ["width", "block"])

    def block_of(part: pa.RecordBatch, i: int, cache: dict) -> Block:
        name = (part.column("width")[i].as_py(), part.column("block")[i].as_py())
        if cache.get("name") != name:
            key, ident, lab = (part.column(f"block_{c}").slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                               for c in ("key", "vec_id", "label"))
            data = b"".join(part.column("block_data").slice(i, 1).flatten().to_pylist())
            cache.update(name=name, block=Block(key, ident, lab, data, rotation(name[0])))
        return cache["block"]

    def anchors_of(part: pa.RecordBatch, i: int, *more: str):
        cols = [part.column(f"group_{c}").slice(i, 1).flatten().to_pylist() for c in ("key", "vec_id", "label", "data", *more)]
        for key, ident, lab, data, *rest in zip(*cols):
            yield key, ident, lab, np.frombuffer(data, "<i8"), *rest

    first = pa.schema([("key", pa.int64()), ("positive_key", pa.int64()), ("positive_id", pa.int64()),
                       ("positive_score", pa.int64())])

    def find_positives(batches):
        cache: dict = {}
        for part in batches:
            for i in range(part.num_rows):
                block = block_of(part, i, cache)
                found = [[], [], [], []]
                for key, _, lab, x in anchors_of(part, i):
                    place, score = block.positives(key, lab, x, positives)
                    for out, more in zip(found, ([key] * len(place), block.key[place].tolist(),
                                                 block.ident[place].tolist(), score.tolist())):
                        out += more
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=first)

    def find_negatives(batches):
        cache: dict = {}
        for part in batches:
            for i in range(part.num_rows):
                block = block_of(part, i, cache)
                found = [[], [], [], []]
                for key, _, lab, x, tops in anchors_of(part, i, "tops"):
                    distinct = sorted(set(tops))
                    for top, (place, score) in zip(distinct, block.negatives(lab, x, distinct, negatives, share)):
                        for out, more in zip(found, ([key] * len(place), [top] * len(place),
                                                     block.ident[place].tolist(), score.tolist())):
                            out += more
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=second)

    second = pa.schema([("key", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()),
                        ("negative_score", pa.int64())])

    def ranked(found: DataFrame, by: list[str], score: str, ident: str, k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(score), ident)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found = map_arrow(met(_packs(anchors, "group")), find_positives,
                      "key long, positive_key long, positive_id long, positive_score long")
    best = materialize(ranked(found, ["key"], "positive_score", "positive_id", positives).drop("rank"),
                       "negatives-positives")
    tops = best.groupBy("key").agg(F.collect_list("positive_score").alias("tops"))  # at most ``positives`` each
    found = map_arrow(met(_packs(anchors.join(tops, "key"), "group", "tops")), find_negatives,
                      "key long, positive_score long, negative_id long, negative_score long")
    below = ranked(found, ["key", "positive_score"], "negative_score", "negative_id", negatives)
    ids = anchors.select("key", F.col("vec_id").alias("anchor_id"))

    def known(c: str):
        return F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)

    return (best.join(below, ["key", "positive_score"]).join(ids, "key")
            .select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score"))
