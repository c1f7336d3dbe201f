"""Vector retrieval: exact k-NN, band-dependent top-k, next-after-reject, context assembly.

Exact k-NN is a grid: each Arrow batch of the corpus becomes one block, the
queries become groups of at most ``BLOCK_BYTES``, and blocks meet groups in a
join by vector length and a salt, on which the groups are repeated.  No vector
passes the driver; Spark broadcasts the groups where they are small and deals
both sides by the key where they are not.  A task scores a block
against a group with one matrix product and emits the best k rows per query.  The
final ``row_number() <= k`` is pre-limited inside every map task (WindowGroupLimit),
so a query's group holds at most k rows per task, never the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidal.session import materialize, ship_package

BLOCK_BYTES = 4 << 20  # of query vectors in one group
SCORES_PER_STEP = 1 << 22  # products held at once in a task
RANK_DIGITS = 9  # scores are ranked at 1e-9 resolution so ties break by id, not by rounding noise


def as_double_array(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _sound(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null and holds finite numbers only."""
    ok = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(F.col(vec_col).isNotNull() & ok & (F.size(vec_col) > 0))


def _best_of_batch(ids: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest keys, ties by id."""
    at = np.arange(len(key))
    if len(key) > k:
        at = np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])
    return at[np.lexsort((ids[at], key[at]))[:k]]


def knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine",
        id_col: str = "vec_id", vec_col: str = "embedding", qid_col: str = "qid",
        qvec_col: str = "qvec", block_bytes: int | None = None) -> DataFrame:
    """Top-``k`` corpus rows per query: ``qid, rank, id, score``.

    cosine: highest similarity first; l2: smallest squared distance first;
    ties by id.  Vectors that are null, or hold null or non-finite numbers,
    take no part; nor do zero vectors under cosine.  A query meets the
    vectors of its own length.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    q = _sound(queries.select(F.col(qid_col).alias("qid"), as_double_array(F.col(qvec_col)).alias("vec")), "vec")
    c = _sound(corpus.select(F.col(id_col).alias("id"), as_double_array(F.col(vec_col)).alias("v")), "v")
    if metric == "cosine":
        q, c = q.filter(norm(F.col("vec")) > 0), c.filter(norm(F.col("v")) > 0)
    out = T.StructType([T.StructField("qid", q.schema["qid"].dataType), T.StructField("id", c.schema["id"].dataType),
                        T.StructField("score", T.DoubleType()), T.StructField("key", T.DoubleType())])
    spark = corpus.sparkSession
    ship_package(spark)
    q = materialize(q, "knn-queries")
    total = q.agg(F.sum(F.size("vec") * F.lit(8).cast("long"))).first()[0] or 0
    groups = int(-(-total // (block_bytes or BLOCK_BYTES))) or 1
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grouped = (q.withColumn("group", F.pmod(F.xxhash64("qid"), F.lit(groups)))
               .groupBy(F.size("vec").alias("length"), "group")
               .agg(F.collect_list("qid").alias("qids"), F.flatten(F.collect_list("vec")).alias("qvecs"))
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    id_type = c.schema["id"].dataType.simpleString()
    blocks = c.mapInArrow(_blocks, f"length int, ids array<{id_type}>, vecs array<double>").withColumn(
        "salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    met = blocks.join(grouped, ["length", "salt"]).select("length", "ids", "vecs", "qids", "qvecs")
    scored = met.mapInArrow(_scorer(k, metric), out)
    rn = F.row_number().over(Window.partitionBy("qid").orderBy("key", "id"))
    return (scored.withColumn("rank", rn).filter(F.col("rank") <= k)
            .select(F.col("qid").alias(qid_col), "rank", F.col("id").alias(id_col), "score"))


def _blocks(batches):
    """One row for each batch and vector length: length, ids, vectors end to end."""
    for part in batches:
        length = part.column(1).value_lengths().to_numpy()
        for n in np.unique(length):
            own = part.take(pa.array(np.flatnonzero(length == n)))
            ends = pa.array([0, own.num_rows], pa.int32())
            flat = own.column(1).flatten()
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.ListArray.from_arrays(ends, own.column(0)),
                 pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=["length", "ids", "vecs"])


def _scorer(k: int, metric: str):
    """Task function: the best ``k`` rows of each block for each query of the group beside it."""
    digits = RANK_DIGITS

    def run(batches):
        for part in batches:
            for row in range(part.num_rows):
                width = part.column(0)[row].as_py()
                ids, vecs, qids, qvecs = (part.column(c).slice(row, 1).flatten() for c in range(1, 5))
                v, matrix = (x.to_numpy(zero_copy_only=False).reshape(-1, width) for x in (vecs, qvecs))
                rank = np.empty(len(ids), np.int64)  # ids in order, of whatever type
                rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                step = max(1, SCORES_PER_STEP // (len(v) * (width if metric == "l2" else 1)))
                for at in range(0, len(matrix), step):
                    some = matrix[at:at + step]
                    if metric == "cosine":
                        score = (v @ some.T) / np.outer(np.sqrt((v * v).sum(1)), np.sqrt((some * some).sum(1)))
                    else:  # differences, not the expanded square: no cancellation between near vectors
                        score = ((v[:, None, :] - some[None]) ** 2).sum(2)
                    key = np.round(-score if metric == "cosine" else score, digits)
                    best = [_best_of_batch(rank, key[:, j], k) for j in range(len(some))]
                    rows, col = np.concatenate(best), np.repeat(np.arange(len(some)), [len(b) for b in best])
                    yield pa.RecordBatch.from_arrays(
                        [qids.take(pa.array(at + col)), ids.take(pa.array(rows)), pa.array(score[rows, col]),
                         pa.array(key[rows, col])], names=["qid", "id", "score", "key"])

    return run


def label_queries(emb: DataFrame, label: str = "label", id_col: str = "vec_id",
                  vec_col: str = "embedding") -> DataFrame:
    """One query per label: the label's lowest-id vector."""
    first = emb.groupBy(label).agg(F.min_by(F.struct(id_col, vec_col), F.col(id_col)).alias("f"))
    return first.select(F.col(label).alias("qid"), F.col(f"f.{vec_col}").alias("qvec"))


def recommend_by_band(keys: DataFrame, band_col: str, ranked: DataFrame, top_k: dict[str, int],
                      key: str = "key") -> DataFrame:
    """Per key: the first k ranked items, k by band (a band with k = 0 gets nothing).

    ``ranked`` is one query's top-max(k) list, so the non-equi join
    ``rank <= k`` meets a broadcast side of at most max(k) rows.
    """
    k = F.coalesce(*[F.when(F.col(band_col) == b, F.lit(n)) for b, n in top_k.items()], F.lit(0))
    kk = keys.select(key, band_col, k.alias("_k")).filter(F.col("_k") > 0)
    return (kk.join(F.broadcast(ranked), F.col("rank") <= F.col("_k"))
            .drop("_k"))


def next_recommendation(recs: DataFrame, rejected: DataFrame, key: str = "key",
                        item: str = "vec_id") -> DataFrame:
    """After rejections, the best-ranked remaining item per key."""
    left = recs.join(rejected.select(key, item), [key, item], "left_anti")
    return left.groupBy(key).agg(F.min_by(F.struct("rank", item), F.col("rank")).alias("n")) \
        .select(key, F.col("n.rank").alias("next_rank"), F.col(f"n.{item}").alias(item))


def requested_bands(requests: DataFrame, bands: DataFrame, key: str = "key", horizon: str = "horizon",
                    band: str = "band") -> DataFrame:
    """The band of every requested (key, horizon); ``medium`` for an unknown key or horizon."""
    found = requests.join(bands.select(key, horizon, F.col(band).alias("_band")), [key, horizon], "left")
    return found.withColumn(band, F.coalesce("_band", F.lit("medium"))).drop("_band")


def context_with_sources(ranked: DataFrame, group: str, text_col: str, source: str = "source", url: str = "url",
                         rank: str = "rank", sep: str = "\n\n---\n\n") -> DataFrame:
    """``[i] (Source: .., URL: ..)`` headers over whole texts, in rank order; missing parts are empty.

    Groups hold at most k rows (the retrieval limit), so collecting them is bounded.
    """
    def part(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    block = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] (Source: "), part(source), F.lit(", URL: "),
                     part(url), F.lit(")\n"), part(text_col))
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("t"))))
    return ranked.groupBy(group).agg(F.array_join(F.transform(items, lambda x: x["t"]), sep).alias("context"))


def assemble_context(ranked: DataFrame, group: str, text_col: str, rank: str = "rank",
                     sep: str = "\n\n") -> DataFrame:
    """Numbered ``[i] text`` blocks per group, in rank order (collect_list alone is unordered).

    Groups hold at most k rows (the retrieval limit), so collecting them is bounded.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text_col).alias("t"))))
    numbered = F.transform(items, lambda x: F.concat(F.lit("["), x["r"].cast("string"), F.lit("] "), x["t"]))
    return ranked.groupBy(group).agg(F.array_join(numbered, sep).alias("context"))
