"""Incremental loading: apply each micro-batch of a stream as an upsert.

The reference loads forecast and risk rows into keyed tables with
``INSERT ... ON CONFLICT DO UPDATE``.  When those rows arrive continuously
(new forecast files landing in a folder), the same merge runs per
micro-batch through ``foreachBatch``: each batch is de-duplicated on the
keys (last row by an ordering column wins), merged into the key buckets
of the parquet table that it touches, and the stream's checkpoint (under the shared
``spark.checkpoint.dir``) makes the load restartable after executor or
driver loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidal.session import checkpoint_dir
from tidal.sources.io import upsert_table


def dedupe_batch(batch: DataFrame, keys: list[str], order_col: str | None) -> DataFrame:
    """One row per key within a micro-batch (the last by ``order_col``)."""
    if order_col is None:
        return batch.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
    return batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def start_upsert_stream(stream: DataFrame, table_path: str, keys: list[str], update_cols: list[str],
                        name: str, order_col: str | None = None, touch: str | None = None,
                        trigger_once: bool = False) -> StreamingQuery:
    """Start a stream that merges every micro-batch into ``table_path``."""
    spark = stream.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"

    def merge(batch: DataFrame, epoch_id: int) -> None:
        rows = dedupe_batch(batch, keys, order_col)
        upsert_table(batch.sparkSession, table_path, rows, keys, update_cols, touch)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", ckpt).queryName(name)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
