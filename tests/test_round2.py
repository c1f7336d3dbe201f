"""Period axis from the data, whole inputs, shared folder, shipping, white space, upsert retries."""

import os
import re
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT, SF_SMALL
from tidal import session
from tidal.functions import scalar
from tidal.plans import views
from tidal.sources import io


def test_earlier_and_later_rows_are_seen(spark, tmp_path):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    far = F.col("l_shipdate") + F.expr("INTERVAL 14 MONTHS")
    early = F.col("l_shipdate") - F.expr("INTERVAL 9 MONTHS")
    d = str(tmp_path / "sf")
    li.unionByName(li.withColumn("l_shipdate", far.cast(dict(li.dtypes)["l_shipdate"]))).unionByName(
        li.withColumn("l_shipdate", early.cast(dict(li.dtypes)["l_shipdate"]))).write.parquet(f"{d}/lineitem.parquet")
    a, b = views.supplier_bounds(spark, SF_SMALL), views.supplier_bounds(spark, d)
    assert b[0] < a[0] and b[1] > a[1]
    p = views.predictions(spark, d)
    total = p.agg(F.sum("actual")).first()[0]
    assert float(total) == pytest.approx(3 * float(li.agg(F.sum("l_quantity")).first()[0]))
    lo, hi = p.agg(F.min("period"), F.max("period")).first()
    assert (lo, hi) == (views.first_period(b), views.FUTURE[1])
    assert p.filter(F.col("period") > views.TEST[1]).filter("actual IS NOT NULL").isEmpty()


def test_white_space_of_all_kinds_is_stripped(spark):
    df = spark.createDataFrame([("\tnorway",), (" usa\n",), ("\u00a0new\t zealand\r",)], "n string")
    got = [r[0] for r in df.select(scalar.standardize_name("n")).collect()]
    assert got[0] == "Norway" and got[1].strip() == got[1] and got[2] == "New Zealand"
    band = spark.createDataFrame([("\tHigh\n", 0.1)], "p string, s double")
    assert band.select(scalar.effective_band("p", F.col("s"))).first()[0] == "high"


def test_upsert_first_load_and_retry(spark, tmp_path):
    base = str(tmp_path / "t")
    batch = spark.createDataFrame([(1, 2.0, "a")], "k int, v double, note string")
    out = io.upsert_table(spark, base, batch, ["k"], ["v"], touch="updated_at")
    row = spark.read.parquet(out).first()
    assert row["note"] == "a" and row["updated_at"] is not None
    with pytest.raises(ValueError):
        io.upsert_table(spark, base, batch.unionAll(batch), ["k"], ["v"])
    left = Path(f"{base}-pending")  # an aborted write: files, no success mark
    left.mkdir()
    (left / "part-0.parquet").write_bytes(b"x")
    out = io.upsert_table(spark, base, batch.withColumn("v", F.lit(3.0)), ["k"], ["v"], touch="updated_at")
    assert out == base and spark.read.parquet(out).first()["v"] == 3.0 and not left.exists()


def test_python_tasks_run_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from tidal.session import get_spark
spark = get_spark("local[2]", 2)
print("ROWS", entry.queries()["backtest"](spark, {SF_SMALL!r}).count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"TIDAL_DRIVER_MEMORY": "2g"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240, env=env)
    assert re.search(r"ROWS [1-9]", got.stdout), got.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_an_error():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(SimpleNamespace(sparkContext=context, conf=conf))
