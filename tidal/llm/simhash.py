"""SimHash near-dedup: exact close pairs of 64-bit fingerprints from a vantage-point tree.

Distinct fingerprints are filed in the leaves of a tree that halves them by
their Hamming distance to vantage points; a fingerprint is also sent to every
leaf that the triangle inequality cannot rule out.  Each leaf finds its close
pairs with a tree of its own and keeps only the links that join something;
the links' components give the groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidal.llm.common import batch, filled, map_arrow, small_batches, steps
from tidal.llm.links import components
from tidal.session import materialize

#: Fingerprints of a shard, and guests from other shards, that one task holds at most (on average).
OWN_ROWS, GUEST_ROWS = 1 << 15, 1 << 18


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text",
                 key: str | None = None) -> DataFrame:
    """doc_id, fp (64 bits as a signed long): bit set where over half the shingles' hashes have it set.

    A long column named by ``key`` is carried along under its name.

    Letters A-Z are lowered; words are runs of anything but ASCII white space;
    shingles of ``shingle`` words, repeats included; fewer words: the whole
    sequence; no words (also a null text): zero.
    """
    carried = [key] if key else []
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *((c, pa.int64()) for c in carried)])
    hash64 = xxhash.xxh64_intdigest

    def run(batches):
        for part in steps(batches, 1):
            fps = []
            lists = pc.ascii_split_whitespace(pc.ascii_lower(filled(part.column(1))))
            joined = pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()
            todo: list[int] = []
            sizes: list[int] = []
            for line in joined:
                line = line.strip(b" ")
                raw = np.frombuffer(line, np.uint8)
                gaps = np.flatnonzero(raw == 32)
                n = len(gaps) + 1 if line else 0
                if n <= shingle:
                    hashes = [hash64(line, 42)] if n else []
                else:
                    begin = [0, *(gaps[:n - shingle] + 1).tolist()]
                    end = [*gaps[shingle - 1:].tolist(), len(line)]
                    hashes = [hash64(line[a:b], 42) for a, b in zip(begin, end)]
                todo += hashes
                sizes.append(len(hashes))
            size = np.array(sizes, np.int64)
            bits = np.zeros((len(size), 64), np.int64)
            if todo:
                h = np.array(todo, np.uint64)
                flat = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
                have = np.flatnonzero(size)
                first = (np.cumsum(size) - size)[have]
                bits[have] = np.add.reduceat(flat, first, axis=0, dtype=np.int32)
            on = 2 * bits > size[:, None]
            fps = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
            yield batch(schema, part.column(0), fps.view(np.int64), *part.columns[2:])

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carried)
    return map_arrow(cols, run, ", ".join(["doc_id long, fp long", *(f"`{c}` long" for c in carried)]))


class Tree:
    """A vantage-point tree over fingerprints; children below zero are leaves (``-1 - leaf``)."""

    def __init__(self, points: np.ndarray, leaf_rows: int, seed: int):
        self.point: list[int] = []
        self.radius: list[int] = []
        self.kids: list[tuple[int, int]] = []
        self.leaves = 0
        self.root = self._grow(points, leaf_rows, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> int:
        if len(points) > leaf_rows:
            best = None
            for v in rng.choice(points, min(5, len(points)), replace=False):  # the vantage point that spreads most
                d = np.bitwise_count(points ^ v).astype(np.int64)
                radius = int(np.median(d))
                near = d <= radius
                if near.all():
                    radius -= 1
                    near = d <= radius
                if near.any() and not near.all() and (best is None or d.var() > best[0]):
                    best = (d.var(), v, radius, near)
            if best:
                _, v, radius, near = best
                node = len(self.point)
                self.point.append(int(v))
                self.radius.append(radius)
                self.kids.append((0, 0))
                self.kids[node] = (self._grow(points[near], leaf_rows, rng), self._grow(points[~near], leaf_rows, rng))
                return node
        self.leaves += 1
        return -self.leaves

    def reach(self, points: np.ndarray, slack: int):
        """(leaf, rows of ``points`` whose ball of radius ``slack`` may meet it); slack 0 files each row once."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            d = np.bitwise_count(points[rows] ^ np.uint64(self.point[node])).astype(np.int64)
            todo += [(self.kids[node][0], rows[d <= self.radius[node] + slack]),
                     (self.kids[node][1], rows[d > self.radius[node] - slack])]


def _forest(own: np.ndarray, guests: np.ndarray, most: int, among: bool) -> np.ndarray:
    """Links (rows of two fingerprints) that join the same groups as all close pairs of own with guests.

    ``among``: and the pairs among own.
    """
    points = np.concatenate([own, guests])
    root = np.arange(len(points))

    def settle():
        while True:
            up = root[root]
            if np.array_equal(up, root):
                return
            root[:] = up

    links = []
    tree = Tree(own, 96, 1)
    mine: dict[int, np.ndarray] = dict(tree.reach(own, 0))
    for leaf, rows in tree.reach(points, most):
        home = mine.get(leaf)
        if home is None:
            continue
        if not among:
            rows = rows[rows >= len(own)]
        for at in range(0, len(rows), 4096):
            some = rows[at:at + 4096]
            i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[home][None, :]) <= most)
            a, b = some[i], home[j]
            while True:
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    break
                # each root joins one smaller root at a time; the pair that did so is kept as a link
                hi, lo = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
                hi, first = np.unique(hi, return_index=True)
                links.append(np.stack([points[a[first]], points[b[first]]], 1))
                root[hi] = lo[first]
                settle()
    return np.concatenate(links) if links else np.zeros((0, 2), np.uint64)


def close_links(fps: DataFrame, most: int = 4, sample_rows: int = 65536, leaf_rows: int = 1024) -> DataFrame:
    """a, b: links among distinct fingerprints that have the components of all pairs within ``most`` bits.

    The tree over shards is fitted on the ``sample_rows`` fingerprints of least
    hash (a stated bound); all fingerprints go through it.  A shard of more than
    OWN_ROWS fingerprints or GUEST_ROWS guests is a grid of blocks, so no task
    grows with the corpus.
    """
    spark = fps.sparkSession
    small_batches(spark)
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).select("fp").collect()  # bounded
    points = np.array([r["fp"] for r in sample], np.int64).view(np.uint64)
    tree = Tree(points, leaf_rows, 5)
    shared = spark.sparkContext.broadcast(tree)
    schema = pa.schema([("leaf", pa.int32()), ("own", pa.bool_()), ("fp", pa.int64())])

    def deal(batches):
        for part in batches:
            raw = part.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(raw), 16384):
                fp = raw[at:at + 16384]
                x = fp.view(np.uint64)
                home = np.empty(len(x), np.int32)
                for leaf, rows in shared.value.reach(x, 0):
                    home[rows] = leaf
                    yield batch(schema, np.full(len(rows), leaf, np.int32), np.ones(len(rows), bool), fp[rows])
                for leaf, rows in shared.value.reach(x, most):
                    # a pair across two leaves is found in the lower one
                    rows = rows[home[rows] > leaf]
                    yield batch(schema, np.full(len(rows), leaf, np.int32), np.zeros(len(rows), bool), fp[rows])

    dealt = map_arrow(fps.select("fp"), deal, "leaf int, own boolean, fp long")
    # a large shard is a grid of blocks: own rows x (own rows of lower blocks and guests)
    size = np.zeros((tree.leaves, 2), np.int64)
    for r in dealt.groupBy("leaf", "own").count().collect():  # two numbers per leaf of the bounded tree
        size[r["leaf"], int(r["own"])] = r["count"]
    rows_of = np.maximum(1, -(-size[:, 1] // OWN_ROWS))
    cols_of = np.maximum(1, -(-(size[:, 0] + size[:, 1] * (rows_of > 1)) // GUEST_ROWS))
    nr, nc = (F.element_at(F.array(*[F.lit(int(v)) for v in n]), F.col("leaf") + 1) for n in (rows_of, cols_of))
    mix = F.xxhash64("fp")
    block, column = F.pmod(mix, nr).cast("int"), F.pmod(F.shiftright(mix, 20), nc).cast("int")
    everywhere = F.sequence(F.lit(0), nc.cast("int") - 1)
    below = F.when(F.col("own"), block).otherwise(nr.cast("int"))  # blocks that a row visits as a guest
    as_own = F.when(F.col("own"), F.transform(everywhere, lambda c: F.struct(block.alias("b"), c.alias("c"),
                                                                             F.lit(True).alias("o"))))
    as_guest = F.when(below > 0, F.transform(F.sequence(F.lit(0), below - 1), lambda b: F.struct(
        b.alias("b"), column.alias("c"), F.lit(False).alias("o"))))
    none = F.expr("cast(array() as array<struct<b:int,c:int,o:boolean>>)")
    grid = dealt.select("leaf", "fp", F.explode(F.concat(F.coalesce(as_own, none), F.coalesce(as_guest, none))).alias("x")) \
        .select("leaf", "x.b", "x.c", "x.o", "fp")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["fp"].to_numpy().view(np.uint64)
        own = rows["o"].to_numpy().astype(bool)
        found = _forest(x[own], x[~own], most, bool(rows["c"].iloc[0] == 0)).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return grid.groupBy("leaf", "b", "c").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4, doc_id: str = "doc_id",
                    text: str = "text", key: str | None = None) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of ``most`` bits or fewer.

    With the name of a long column in ``key`` also ``root``, the fingerprint that
    stands for the row's group, and that column.

    Equal fingerprints (those of texts without words are zero) are linked and
    handled as one.  A null doc_id is no smallest id unless its group has no
    other.  Repeated rows stay, an empty table gives no rows, other columns are
    not read.
    """
    fps = materialize(fingerprints(docs, shingle, doc_id, text, key), "simhash-fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    links = materialize(close_links(distinct, most), "simhash-links")
    groups = components(links)  # fp -> representative, for linked ones only
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    more = ["root", key] if key else []
    by_fp = named.join(least, "root").select("fp", "component_id", *more[:1])
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id", *more)
