"""Approximate nearest neighbours: an inverted file of k-means cells, and MLlib random-projection LSH.

The inverted file is a table partitioned by cell.  Cells are fitted on a
bounded sample, every vector is in one; a query probes its nearest cells until
they hold a given share of the vectors (and enough for k), so only the files of probed
cells are read, and their vectors are ranked by exact cosine.

For LSH vectors are L2-normalised so Euclidean distance orders like cosine
similarity.  Candidates come from ``approxSimilarityJoin`` (bucket
collisions, a distributed join), then the exact cosine re-ranks them and
``row_number() <= k`` keeps the top per query.  Recall against the exact
scan is checked in the tests.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidal.operators.retrieve import RANK_DIGITS, dot, norm
from tidal.session import ship_package

#: Rows the cells are fitted on at most.
SAMPLE = 100_000
#: Share of the vectors whose cells a query probes.
PROBED = 0.7


def _unit(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    v = F.col(vec_col).cast("array<double>")
    n = norm(v)
    unit = F.transform(v, lambda x: F.try_divide(x, n))
    return df.select(F.col(id_col).alias("id"), unit.alias("u"),
                     array_to_vector(unit).alias("features"))


def knn_lsh(corpus: DataFrame, queries: DataFrame, k: int, bucket_length: float = 1.0,
            num_tables: int = 8, max_dist: float = 2.01, seed: int = 42, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """Approximate top-``k`` cosine neighbours per query: qid, rank, vec_id, score.

    ``max_dist`` covers the whole unit sphere: no candidate is dropped by distance.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    c = _unit(corpus, id_col, vec_col)
    q = _unit(queries.withColumnRenamed("qid", "_qid").withColumnRenamed("qvec", "_qvec"), "_qid", "_qvec")
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes",
                                      bucketLength=bucket_length, numHashTables=num_tables, seed=seed)
    model = lsh.fit(c)
    pairs = model.approxSimilarityJoin(q, c, max_dist, distCol="dist")
    cand = pairs.select(F.col("datasetA.id").alias("qid"), F.col("datasetB.id").alias(id_col),
                        dot(F.col("datasetA.u"), F.col("datasetB.u")).alias("score"))
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", RANK_DIGITS).desc(),
                                                               F.col(id_col)))
    return cand.withColumn("rank", rn).filter(F.col("rank") <= k).select("qid", "rank", id_col, "score")


@dataclass(frozen=True)
class CellIndex:
    """An inverted file: unit vectors under ``path`` by cell, with the centre and size of each cell."""

    path: str
    centres: np.ndarray
    sizes: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """id, u (unit vector), cell (the partition)."""
        return spark.read.parquet(self.path)


def build_cells(corpus: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 42,
                id_col: str = "vec_id", vec_col: str = "embedding") -> CellIndex:
    """Write the inverted file of ``corpus`` under ``path``.

    Vectors that are null, zero, empty or hold null or non-finite numbers are not
    indexed; vectors must be of one length.  ``cells`` is the square root of the
    number of rows, 4096 at most; the cells are fitted on ``sample`` rows at most, and every
    vector goes to the cell of its nearest centre.
    """
    from pyspark.ml.clustering import KMeans
    ok = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    unit = _unit(corpus.filter(F.col(vec_col).isNotNull() & ok & (norm(F.col(vec_col).cast("array<double>")) > 0)),
                 id_col, vec_col)
    n = unit.count()
    if not n:
        unit.select("id", "u", F.lit(0).alias("cell")).write.partitionBy("cell").parquet(path)
        return CellIndex(path, np.zeros((0, 0)), np.zeros(0, np.int64))
    cells = cells or max(1, min(4096, round(n ** 0.5)))
    some = unit if n <= sample else unit.orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample)
    model = KMeans(k=cells, maxIter=10, seed=seed, featuresCol="features", predictionCol="cell").fit(some.select("features"))
    model.transform(unit).select("id", "u", "cell").repartition("cell").write.partitionBy("cell").parquet(path)
    sizes = np.zeros(len(model.clusterCenters()), np.int64)
    for r in corpus.sparkSession.read.parquet(path).groupBy("cell").count().collect():  # one row a cell
        sizes[r["cell"]] = r["count"]
    return CellIndex(path, np.array(model.clusterCenters()), sizes)


def probes(index: CellIndex, queries: DataFrame, k: int, probed: float = PROBED) -> DataFrame:
    """qid, qu, cell: the nearest cells of each query that hold ``probed`` of the vectors, and ``k`` at least."""
    spark = queries.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((index.centres, index.sizes))  # 4096 centres at most
    need = max(k, int(np.ceil(probed * index.sizes.sum())))
    kind = queries.schema["qid"].dataType.simpleString()

    def run(batches):
        centres, sizes = shared.value
        for part in batches:
            if not part.num_rows or not len(centres):
                continue
            q = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            order = np.argsort(((centres * centres).sum(1) - 2 * q @ centres.T), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            row, col = np.nonzero((before < need) & (sizes[order] > 0))
            took = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(order[row, col].astype(np.int32))],
                                             names=["qid", "qu", "cell"])

    unit = _unit(queries, "qid", "qvec").select(F.col("id").alias("qid"), F.col("u").alias("qu"))
    sound = unit.filter(F.forall("qu", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("qu") > 0))
    return sound.mapInArrow(run, f"qid {kind}, qu array<double>, cell int")


def knn_cells(index: CellIndex, queries: DataFrame, k: int, probed: float = PROBED, id_col: str = "vec_id") -> DataFrame:
    """Top-``k`` cosine neighbours per query among its probed cells: qid, rank, vec_id, score.

    Every sound query gets ``k`` rows (all, where the index has fewer).  The cells that any
    query probes, at most 4096 numbers, prune the partitions that are read.
    """
    spark = queries.sparkSession
    wanted = probes(index, queries, k, probed)
    cells = [r["cell"] for r in wanted.select("cell").distinct().collect()]
    rows = index.table(spark).filter(F.col("cell").isin(cells))
    found = rows.join(wanted, "cell").select("qid", F.col("id").alias(id_col), dot(F.col("qu"), F.col("u")).alias("score"))
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", RANK_DIGITS).desc(), F.col(id_col)))
    return found.withColumn("rank", rn).filter(F.col("rank") <= k).select("qid", "rank", id_col, "score")
