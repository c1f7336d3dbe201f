"""Sources, sinks, upserts (batch and streaming)."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidal.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="tidal-test-")


def test_read_observations(spark):
    d = Path(_tmp())
    (d / "obs.csv").write_text(
        "Country,Year,Catch,Other\n"
        " usa ,2001,10,x\n"
        "USA,2001,5,y\n"
        "norway,2002,NA,z\n"
        "norway,2002.5,3,z\n"
        ",2003,4,z\n"
        '"Korea, Republic of",2004,1,z\n')
    obs = io.read_observations(spark, str(d / "obs.csv"))
    rows = sorted(tuple(r) for r in io.aggregate_observations(obs).collect())
    assert rows == [("South Korea", 2004, 1.0), ("United States", 2001, 5.0), ("Usa", 2001, 10.0)]


def test_load_observations_counts_and_keeps_rejected_rows(spark):
    d = Path(_tmp())
    (d / "obs.csv").write_text(
        "Country,Year,Catch\n"
        " usa ,2001,10\n,2001,1\nnorway,NA,1\nnorway,2002,n/a\nnorway,2002.5,3\nnorway,x,3\n"
        "norway,99999999999,3\nnorway,2002,inf\nnorway,2002,ten\n,,\n")
    counts = io.load_observations(spark, str(d / "obs.csv"), str(d / "out"))
    assert counts == {"kept": 1, "missing_key": 2, "missing_period": 1, "missing_value": 1, "bad_period": 3, "bad_value": 2}
    out = spark.read.parquet(str(d / "out"))
    left = {(r.reason, r.raw_period, r.raw_value) for r in out.filter("status = 'rejected'").collect()}
    assert ("bad_value", "2002", "ten") in left and ("bad_period", "2002.5", "3") in left and out.count() == 10
    (d / "none.csv").write_text("Country,Year,Catch\n")
    assert set(io.load_observations(spark, str(d / "none.csv"), str(d / "out2")).values()) == {0}


def test_read_observations_missing_columns(spark):
    d = Path(_tmp())
    (d / "bad.csv").write_text("Country,Year\nA,2001\n")
    with pytest.raises(ValueError, match="Catch"):
        io.read_observations(spark, str(d / "bad.csv"))


def test_write_csv_json_roundtrip(spark):
    df = spark.createDataFrame([("a", 1, 2.5)], "key string, period int, value double")
    out = _tmp()
    io.write_csv(df, f"{out}/csv")
    io.write_json(df, f"{out}/json")
    back = spark.read.option("header", True).csv(f"{out}/csv").collect()
    assert back[0].key == "a" and back[0].value == "2.5"
    assert spark.read.json(f"{out}/json").collect()[0].value == 2.5


def _target(spark):
    return spark.createDataFrame(
        [("a", 1, "5", 1.0, "keep me", None), ("b", 1, "5", 2.0, "ctx b", None)],
        "key string, period int, horizon string, v double, context_meaning string, updated_at timestamp")


def test_upsert_semantics(spark):
    batch = spark.createDataFrame([("a", 1, "5", 10.0), ("c", 1, "5", 30.0)],
                                  "key string, period int, horizon string, v double")
    out = io.upsert(_target(spark), batch, ["key", "period", "horizon"], ["v"], touch="updated_at",
                    now=F.lit("2026-01-01 00:00:00").cast("timestamp"))
    got = {r.key: r for r in out.collect()}
    assert got["a"].v == 10.0 and got["a"].context_meaning == "keep me" and got["a"].updated_at is not None
    assert got["b"].v == 2.0 and got["b"].updated_at is None
    assert got["c"].v == 30.0 and got["c"].context_meaning is None


def test_upsert_null_value_still_updates(spark):
    batch = spark.createDataFrame([("a", 1, "5", None)], "key string, period int, horizon string, v double")
    out = io.upsert(_target(spark), batch, ["key", "period", "horizon"], ["v"])
    assert {r.key: r.v for r in out.collect()}["a"] is None


def test_upsert_rejects_duplicate_batch_keys(spark):
    batch = spark.createDataFrame([("a", 1, "5", 1.0), ("a", 1, "5", 2.0)],
                                  "key string, period int, horizon string, v double")
    with pytest.raises(ValueError):
        io.upsert(_target(spark), batch, ["key", "period", "horizon"], ["v"])


def _times(base):
    return {str(f): f.stat().st_mtime_ns for f in Path(base).rglob("*.parquet")}


def test_upsert_table_rewrites_only_touched_buckets(spark):
    base = f"{_tmp()}/table"
    first = spark.range(2000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v"), F.lit("c").alias("note"))
    assert io.read_upsert_table(spark, base) is None
    io.upsert_table(spark, base, first, ["k"], ["v"], buckets=16)
    before = _times(base)
    assert len({Path(f).parent for f in before}) == 16
    one = spark.createDataFrame([(7, -1.0)], "k int, v double")  # a narrower key type meets the stored one
    io.upsert_table(spark, base, one, ["k"], ["v"], buckets=3)   # the table's own number holds
    after = _times(base)
    changed = {Path(f).parent for f in before.keys() ^ after.keys()} | {
        Path(f).parent for f in before.keys() & after.keys() if before[f] != after[f]}
    assert len(changed) == 1
    rows = {r.k: r for r in io.read_upsert_table(spark, base).collect()}
    assert len(rows) == 2000 and rows[7].v == -1.0 and rows[7].note == "c" and rows[8].v == 8.0


def test_upsert_table_reads_only_touched_buckets(spark):
    base = f"{_tmp()}/table"
    io.upsert_table(spark, base, spark.range(100).withColumn("v", F.lit(1)), ["id"], ["v"], buckets=8)
    plan = io.read_upsert_table(spark, base).filter(F.col("bucket").isin([1, 2]))._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [bucket" in plan.toString()


def test_upsert_table_finishes_a_merge_that_was_cut_off(spark):
    import shutil
    base = f"{_tmp()}/table"
    io.upsert_table(spark, base, spark.range(50).withColumn("v", F.lit(1)), ["id"], ["v"], buckets=4)
    rows = spark.read.parquet(base)
    rows.filter("bucket < 2").withColumn("v", F.lit(2)).write.parquet(f"{base}-pending")  # decided, not yet moved
    shutil.rmtree(f"{base}/buckets=4/bucket=0")  # removed, its new folder not yet in place
    got = io.read_upsert_table(spark, base)
    assert got.count() == 50 and got.filter("bucket < 2 AND v <> 2").isEmpty() and got.filter("bucket > 1 AND v <> 1").isEmpty()
    assert not Path(f"{base}-pending").exists()


def test_upsert_table_empty_batch_and_null_keys(spark):
    base = f"{_tmp()}/table"
    none = spark.createDataFrame([], "k string, v double")
    io.upsert_table(spark, base, none, ["k"], ["v"])
    assert io.read_upsert_table(spark, base) is None
    io.upsert_table(spark, base, spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, v double"), ["k"], ["v"])
    io.upsert_table(spark, base, none, ["k"], ["v"])
    io.upsert_table(spark, base, spark.createDataFrame([(None, 3.0)], "k string, v double"), ["k"], ["v"])
    rows = [(r.k, r.v) for r in io.read_upsert_table(spark, base).collect()]
    assert sorted(rows, key=str) == sorted([("a", 1.0), (None, 2.0), (None, 3.0)], key=str)


def test_streaming_upsert(spark):
    from tidal.streaming.upsert_stream import start_upsert_stream
    src = _tmp()
    table = f"{_tmp()}/t"
    schema = "key string, period int, v double, ts long"
    spark.createDataFrame([("a", 1, 1.0, 1), ("a", 1, 9.0, 2), ("b", 1, 2.0, 1)], schema) \
        .write.mode("overwrite").parquet(f"{src}/batch1")
    stream = spark.readStream.schema(schema).parquet(f"{src}/batch1")
    import uuid
    q = start_upsert_stream(stream, table, ["key", "period"], ["v"], name=f"t_upsert_{uuid.uuid4().hex}",
                            order_col="ts", trigger_once=True)
    q.awaitTermination(120)
    out = sorted(tuple(r)[:3] for r in io.read_upsert_table(spark, table).collect())
    assert out == [("a", 1, 9.0), ("b", 1, 2.0)]


def test_split_partitions_are_pruned(spark):
    from tidal.operators.evaluate import SPLIT_NAMES
    df = spark.createDataFrame([("a", i, float(i), SPLIT_NAMES[i % 3]) for i in range(30)],
                               "key string, period int, value double, split string")
    out = f"{_tmp()}/splits"
    io.write_splits(df, out)
    val = spark.read.parquet(out).filter(F.col("split") == "val")
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and val.count() == 10


def test_merged_buckets_are_moved_not_written_again(spark, tmp_path, monkeypatch):
    """Each merge writes its rows once, beside the table; a merge cut off among its moves is finished."""
    import shutil
    base = str(tmp_path / "t")
    pending, replace = Path(f"{base}-pending"), io._replace_buckets
    written = {}

    def cut_off(spark, base):
        written.update({p.name: p.stat().st_size for p in pending.rglob("*.parquet")})
        raise InterruptedError

    for turn in (1, 2):
        rows = spark.range(60).withColumn("v", F.lit(turn))
        monkeypatch.setattr(io, "_replace_buckets", cut_off)
        with pytest.raises(InterruptedError):
            io.upsert_table(spark, base, rows, ["id"], ["v"], touch="at", buckets=4)
        monkeypatch.setattr(io, "_replace_buckets", replace)
        target = Path(f"{base}/buckets=4/bucket=1")
        target.parent.mkdir(parents=True, exist_ok=True)
        if target.exists():
            shutil.rmtree(target)
        (pending / "buckets=4/bucket=1").rename(target)  # moved before the job ended
        got = io.read_upsert_table(spark, base)
        assert sorted((r.id, r.v) for r in got.collect()) == [(i, turn) for i in range(60)]
        assert got.filter("at IS NULL").count() == 0 and not pending.exists()
        assert {p.name for p in Path(base).rglob("*.parquet")} <= written.keys()
    (pending / "buckets=4").mkdir(parents=True)  # all moved, not yet removed
    (pending / "_SUCCESS").touch()
    assert io.read_upsert_table(spark, base).count() == 60 and not pending.exists()
