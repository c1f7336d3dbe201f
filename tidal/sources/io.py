"""Readers and writers: observation CSVs, CSV / JSON outputs, set-based upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidal.functions.scalar import standardize_name, to_numeric
from tidal.session import materialize

# Text tokens read as missing (the pandas CSV defaults).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _na(c: Column) -> Column:
    return F.when(c.isin(*NA_TOKENS), F.lit(None)).otherwise(c)


#: Why a row of an observation file is left out; the first reason that holds counts.
REASONS = ("missing_key", "missing_period", "missing_value", "bad_period", "bad_value")


def tag_observations(spark: SparkSession, path: str, key: str = "Country", period: str = "Year",
                     value: str = "Catch") -> DataFrame:
    """Header CSV -> every row as ``(key, period, value, reason, raw_key, raw_period, raw_value)``.

    ``reason`` is NULL for a sound row, else one of ``REASONS``: a missing token in a required column, a period
    that is no whole number, a value that is no finite number.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in (key, period, value) if c not in raw.columns]
    if missing:
        raise ValueError(f"Missing required columns in source CSV: {missing}")
    df = raw.select(*[_na(F.col(c)).alias(n) for c, n in ((key, "raw_key"), (period, "raw_period"), (value, "raw_value"))])
    p = to_numeric(F.col("raw_period"))
    df = df.select(standardize_name(F.col("raw_key")).alias("key"),
                   F.when(p == F.floor(p), p.try_cast("int")).alias("period"),
                   to_numeric(F.col("raw_value")).alias("value"), "raw_key", "raw_period", "raw_value")
    checks = zip(REASONS, ("raw_key", "raw_period", "raw_value", "period", "value"))
    return df.withColumn("reason", F.coalesce(*[F.when(F.col(c).isNull(), r) for r, c in checks]))


def read_observations(spark: SparkSession, path: str, key: str = "Country", period: str = "Year",
                      value: str = "Catch") -> DataFrame:
    """Header CSV -> clean long table ``(key STRING, period INT, value DOUBLE)``.

    Every column is read as text (no inference pass), required columns are
    checked before any job runs, missing tokens become NULL, rows missing a
    field are dropped before and after coercion, names are standardised and
    a non-integral period is treated as missing.
    """
    return tag_observations(spark, path, key, period, value).filter(F.col("reason").isNull()).select("key", "period", "value")


def load_observations(spark: SparkSession, path: str, out: str, **columns: str) -> dict[str, int]:
    """Write the rows of an observation file to ``out`` and count them, kept and by reason, in the same pass.

    ``out`` is parquet partitioned by ``status``: ``kept`` rows, and ``rejected`` ones with their reason and raw
    fields.  The counts are Spark observations of the write itself; reasons without rows count 0.
    """
    seen = Observation()
    reason = F.coalesce("reason", F.lit("kept"))
    status = F.when(F.col("reason").isNull(), "kept").otherwise("rejected")
    tagged = tag_observations(spark, path, **columns).withColumn("status", status)
    tagged = tagged.observe(seen, *[F.count_if(reason == r).alias(r) for r in ("kept", *REASONS)])
    tagged.write.mode("overwrite").partitionBy("status").parquet(out)
    return seen.get


def aggregate_observations(obs: DataFrame) -> DataFrame:
    """Sum per (key, period); partial aggregation happens before the shuffle."""
    return obs.groupBy("key", "period").agg(F.sum("value").alias("value"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV (a directory of part files, one per task)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one object per row."""
    df.write.mode(mode).json(path)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """A batch may not carry a key twice (a database upsert would reject it)."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"duplicate keys {keys} in upsert batch")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], update_cols: list[str],
           touch: str | None = None, now: Column | None = None, check: bool = True) -> DataFrame:
    """``INSERT ... ON CONFLICT (keys) DO UPDATE SET update_cols`` as one full outer join.

    Matched rows take ``update_cols`` from the batch and keep every other
    target column; unmatched target rows stay; new keys are inserted with all
    columns the batch carries and NULL in the others.  ``touch`` (if given) is
    set to ``now`` on inserted and updated rows only.  Matching uses a
    constant flag column, never the NULL-ness of a value.
    """
    if check:
        assert_unique(batch, keys)
    t = target.withColumn("_in_t", F.lit(True))
    carried = [c for c in batch.columns if c not in keys and c in target.columns]
    s = batch.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in carried], F.lit(True).alias("_in_s"))
    j = t.join(s, keys, "full")
    matched = F.coalesce(F.col("_in_s"), F.lit(False))
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in update_cols:
            cols.append(F.when(matched, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        elif touch is not None and c == touch:
            cols.append(F.when(matched, now if now is not None else F.current_timestamp())
                        .otherwise(F.col(c)).alias(c))
        elif c in carried:
            cols.append(F.when(F.col("_in_t").isNull(), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


#: Number of key buckets of a new table; one bucket is what a merge rewrites at least.
BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _pending(base: str) -> str:
    return f"{base.rstrip('/')}-pending"


def _replace_buckets(spark: SparkSession, base: str) -> None:
    """Replace the buckets of ``base`` that the pending merge holds, then remove it.

    Its bucket folders are moved, none of their rows is read again.  One that is cut off goes on with the folders
    that are still there.  A pending merge without folders is written bucket by bucket.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    pending = path(_pending(base))
    fs = pending.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.globStatus(path(pending, "buckets=*")):
        for folder in fs.globStatus(path(pending, "buckets=*/bucket=*")):  # at most as many as there are buckets
            source = folder.getPath()
            target = path(path(base, source.getParent().getName()), source.getName())
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            if not fs.rename(source, target):
                raise OSError(f"cannot move {source} to {target}")
    else:
        rows = spark.read.parquet(_pending(base)).hint("rebalance", "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket").parquet(base)
    fs.delete(pending, True)


def read_upsert_table(spark: SparkSession, base: str) -> DataFrame | None:
    """The table that ``upsert_table`` keeps at ``base`` (with its ``buckets`` and ``bucket``), or None before its first load.

    A merge that was cut off after it had been decided is finished first.
    """
    if _exists(spark, f"{_pending(base)}/_SUCCESS"):
        _replace_buckets(spark, base)
    return spark.read.parquet(base) if _exists(spark, base) else None


def upsert_table(spark: SparkSession, base: str, batch: DataFrame, keys: list[str], update_cols: list[str],
                 touch: str | None = None, buckets: int = BUCKETS) -> str:
    """Merge ``batch`` into the parquet table at ``base``, partitioned by key bucket; returns ``base``.

    Only buckets that hold a key of the batch are read, merged and replaced (dynamic partition
    overwrite); files of all others stay.  ``buckets`` counts for the first load, later ones read it from
    the table's folders; it should grow with the table, so that one bucket stays a task's work.  The
    merged buckets are written beside the table before they replace anything: a folder is removed
    before the new one is moved there, and a job that ends in between is finished from them by the next reader or
    merge.  Merging a batch again gives the same rows (``touch`` excepted), so a retry does no harm.  One
    writer at a time.  An empty batch changes nothing; a key twice in a batch is an error; rows with a null key match none.
    """
    stored = read_upsert_table(spark, base)
    if stored is not None:
        buckets = stored.select("buckets").first()[0]
        types = dict(stored.dtypes)  # a key hashes by its type
        batch = batch.select([F.col(c).cast(types.get(c, t)).alias(c) for c, t in batch.dtypes])
    bucket = F.pmod(F.xxhash64(*sorted(keys)), F.lit(buckets)).cast("int")
    batch = materialize(batch.withColumn("bucket", bucket), "upsert_batch")
    touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return base
    if stored is None:  # nothing to join with
        assert_unique(batch, [*keys, "bucket"])
        merged = batch if touch is None or touch in update_cols else batch.withColumn(touch, F.current_timestamp())
        if touch is not None and touch not in merged.columns:
            merged = merged.withColumn(touch, F.lit(None).cast("timestamp"))
    else:
        target = stored.filter(F.col("bucket").isin(touched)).drop("buckets")
        merged = upsert(target, batch, [*keys, "bucket"], update_cols, touch)
    merged = merged.withColumn("buckets", F.lit(buckets)).hint("rebalance", "bucket")
    merged.write.mode("overwrite").partitionBy("buckets", "bucket").parquet(_pending(base))
    _replace_buckets(spark, base)
    return base


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> None:
    """Write a split-tagged table partitioned by split folder.

    Readers filtering on the split then prune whole folders
    (``PartitionFilters`` in the scan) instead of reading every file.
    """
    df.write.mode(mode).partitionBy(split).parquet(path)
