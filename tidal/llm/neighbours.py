"""Approximate nearest neighbours: a forest of random-projection trees, a shared queue, exact reranking.

Trees are fitted on a bounded sample of distinct vectors; every distinct vector
is filed in one leaf of each tree.  A query walks all trees at once through one
priority queue ordered by the smallest margin on the way, until the leaves it
has taken hold a given share of the rows.  Rows and queries of a leaf meet in
blocks of bounded size, which score exactly and keep the best of each query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidal.llm.common import batch, map_arrow, small_batches
from tidal.session import materialize


class Forest:
    """Hyperplanes of all trees; children below zero are leaves (``-1 - leaf``)."""

    def __init__(self, sample: np.ndarray, trees: int, leaf_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes, self.cuts, self.kids, self.roots = [], [], [], []
        self.leaves = 0
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf_rows, rng))
        self.planes = np.array(self.planes).reshape(-1, sample.shape[1])
        self.cuts = np.array(self.cuts)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf_rows:
            for _ in range(4):  # a direction through two rows; others when it does not split
                a, b = x[rng.choice(rows, 2, replace=False)]
                plane = a - b
                norm = np.linalg.norm(plane)
                if not norm:
                    continue
                side = x[rows] @ (plane / norm)
                cut = float(np.median(side))
                right = side > cut
                if 0 < right.sum() < len(rows):
                    node = len(self.planes)
                    self.planes.append(plane / norm)
                    self.cuts.append(cut)
                    self.kids.append(None)
                    self.kids[node] = (self._grow(x, rows[~right], leaf_rows, rng),
                                       self._grow(x, rows[right], leaf_rows, rng))
                    return node
        self.leaves += 1
        return -self.leaves

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if not len(rows):
                    continue
                if node < 0:
                    out[rows, t] = -1 - node
                    continue
                right = x[rows] @ self.planes[node] > self.cuts[node]
                todo += [(self.kids[node][0], rows[~right]), (self.kids[node][1], rows[right])]
        return out

    def search(self, q: np.ndarray, held: np.ndarray, budget: int) -> list[int]:
        """Leaves in order of margin, from all trees, until they hold ``budget`` rows."""
        margin = self.planes @ q - self.cuts if len(self.planes) else self.cuts
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        out, got = [], 0
        while queue and got < budget:
            least, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                got += int(held[-1 - node])
                continue
            left, right = self.kids[node]
            m = float(margin[node])
            heapq.heappush(queue, (max(least, -m), right))
            heapq.heappush(queue, (max(least, m), left))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate makes all norms equal, so the largest inner product is the nearest direction."""
    return np.hstack([x, np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))[:, None]])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 12, leaf_rows: int = 48,
            sample_rows: int = 16384, share: float = 1.6, block_rows: int = 4096, seed: int = 7,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id ``every`` divides.

    Nearness is the inner product in double precision, ties go to the smaller
    id.  ``share``: rows in the leaves that a query takes over all trees, as a
    part of all distinct rows (each row stands in every tree, so 1.6 over 12
    trees are well below all rows).  The forest is fitted on the ``sample_rows``
    distinct vectors of least hash and files every row.

    Vectors that are null, zero, or hold null or non-finite components, and
    rows with a null id, take no part, nor do vectors of another length than
    the most common one.  Equal vectors are filed once with their ``k + 1``
    smallest ids, which are all that can be among the ``k`` nearest.  Repeated
    (id, vector) rows count once.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    good = (vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
            .filter("id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND "
                    "abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)"))
    dims = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], out)
    good = good.filter(F.size("vec") == dims["d"]).withColumn("key", F.xxhash64("vec"))
    # window group limits keep k + 1 ids of a vector per task before anything moves
    by_vec = Window.partitionBy("key", "vec").orderBy("id")
    kept = good.dropDuplicates(["id", "key", "vec"]).withColumn("n", F.row_number().over(by_vec)).filter(F.col("n") <= k + 1)
    filed = materialize(kept.groupBy("key", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                        .withColumn("cls", F.element_at("ids", 1)), "ann-classes")
    asked = materialize(good.filter(F.col("id") % every == 0).select("id", "key", "vec").distinct()
                        .join(filed.select("key", "vec", "cls"), ["key", "vec"]).select("id", "cls"), "ann-asked")
    n = filed.count()
    top = float(filed.select(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()[0])
    rows = filed.orderBy(F.xxhash64("key"), "cls").limit(sample_rows).select("vec").collect()  # bounded
    forest = Forest(_lifted(np.array([r["vec"] for r in rows]), top), trees, leaf_rows, seed)
    shared = spark.sparkContext.broadcast(forest)

    filed_schema = pa.schema([("leaf", pa.int32()), ("cls", pa.int64()), ("ids", pa.list_(pa.int64())),
                              ("vec", pa.list_(pa.float64()))])

    def file_rows(batches):
        for part in batches:
            if part.num_rows:
                leaf = shared.value.file(_lifted(_matrix(part.column("vec")), top))
                for t in range(leaf.shape[1]):
                    yield batch(filed_schema, leaf[:, t], part.column("cls"), part.column("ids"), part.column("vec"))

    in_leaf = map_arrow(filed.select("cls", "ids", "vec"), file_rows,
                        "leaf int, cls long, ids array<long>, vec array<double>")
    held = np.zeros(forest.leaves, np.int64)
    for r in in_leaf.groupBy("leaf").count().collect():  # one row per leaf of the bounded forest
        held[r["leaf"]] = r["count"]
    budget = int(share * n) + k
    asked_schema = pa.schema([("leaf", pa.int32()), ("q", pa.int64()), ("qvec", pa.list_(pa.float64()))])

    def search(batches):
        for part in batches:
            if part.num_rows:
                x = _matrix(part.column("vec"))
                lifted = np.hstack([x, np.zeros((len(x), 1))])
                found = [shared.value.search(q, held, budget) for q in lifted]
                row = np.repeat(np.arange(len(x)), [len(f) for f in found])
                for at in range(0, len(row), 4096):
                    r = pa.array(row[at:at + 4096])
                    yield batch(asked_schema, np.concatenate(found).astype(np.int32)[at:at + 4096],
                                part.column("cls").take(r), part.column("vec").take(r))

    query = filed.join(asked.select("cls").distinct(), "cls", "left_semi").select("cls", "vec")
    visits = materialize(map_arrow(query.repartition("cls"), search, "leaf int, q long, qvec array<double>"), "ann-visits")
    come = np.zeros(forest.leaves, np.int64)
    for r in visits.groupBy("leaf").count().collect():
        come[r["leaf"]] = r["count"]
    # blocks of a leaf: rows x queries, each side of bounded size; both counts are one number per leaf
    nr = F.element_at(F.array(*[F.lit(int(v)) for v in np.maximum(1, -(-held // block_rows))]), F.col("leaf") + 1) \
        if (held > block_rows).any() else F.lit(1)
    nq = F.element_at(F.array(*[F.lit(int(v)) for v in np.maximum(1, -(-come // block_rows))]), F.col("leaf") + 1) \
        if (come > block_rows).any() else F.lit(1)
    left = (visits.withColumn("qb", F.pmod(F.xxhash64("q"), nq).cast("int"))
            .withColumn("rb", F.explode(F.sequence(F.lit(0), nr.cast("int") - 1))))
    right = (in_leaf.withColumn("rb", F.pmod(F.xxhash64("cls"), nr).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), nq.cast("int") - 1))))

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        cols: list[list] = [[], [], [], []]
        if len(q) and len(r):
            x, ids, cls = np.stack(r["vec"]), r["ids"].to_numpy(), r["cls"].to_numpy()
            for at in range(0, len(q), 512):
                some = q.iloc[at:at + 512]
                y = np.stack(some["qvec"])
                near = y @ x.T
                m = min(k + 1, len(x))
                # everything that ties with the last of the best, to the last bits, is reranked exactly
                edge = np.partition(near, len(x) - m, axis=1)[:, len(x) - m] - 1e-9 * top * top
                i, j = np.nonzero(near >= edge[:, None])
                score = (y[i] * x[j]).sum(1)
                order = np.lexsort((cls[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < m
                cols[0].append(some["q"].to_numpy()[i[keep]])
                cols[1].append(cls[j[keep]])
                cols[2].append(score[keep])
                cols[3].extend(ids[j[keep]])
        flat = [np.concatenate(c) if c else [] for c in cols[:3]]
        return pd.DataFrame({"q": np.array(flat[0], np.int64), "cls": np.array(flat[1], np.int64),
                             "score": np.array(flat[2], np.float64), "ids": pd.Series(cols[3], dtype=object)})

    key = ["leaf", "rb", "qb"]
    met = (left.groupBy(*key).cogroup(right.groupBy(*key))
           .applyInPandas(meet, "q long, cls long, score double, ids array<long>"))
    best = met.groupBy("q", "cls").agg(F.max("score").alias("score"), F.any_value("ids").alias("ids"))
    ranked = (best.select("q", "score", F.explode("ids").alias("vec_id"))
              .withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
              .filter(F.col("n") <= k + 1).select("q", "vec_id", "score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.join(ranked, F.col("cls") == F.col("q")).filter("id <> vec_id")
            .select(F.col("id").alias("query_id"), "vec_id", "score")
            .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
