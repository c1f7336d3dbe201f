"""The composed job: a wide CSV of monthly columns to features and splits in one saved pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidal.operators.stages import feature_job
from tidal.plans import sql
from tidal.plans.registry import register, rounded
from tidal.plans.views import EPOCH_YEAR, TEST, TRAIN, VAL, month_index, supplier_bounds
from tidal.session import checkpoint_dir
from tidal.sources import io
from tidal.sources.tables import read_table

#: Months are counted from year 0 in the column names, which are digits only.
OFFSET = EPOCH_YEAR * 12 + 1


def wide_csv(spark, sf_dir) -> tuple[str, int]:
    """``lineitem`` as a file with a row per supplier and return flag and a column per month; its path and last month."""
    first, last = (m + OFFSET for m in supplier_bounds(spark, sf_dir))
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/wide-{uuid.uuid4().hex}"
    li = read_table(spark, sf_dir, "lineitem").withColumn("month", month_index(F.col("l_shipdate")) + OFFSET)
    name = F.concat(F.lit(" supplier  "), F.col("l_suppkey").cast("string"))
    io.write_csv(li.groupBy(name.alias("Country"), F.col("l_returnflag").alias("Flag"))
                 .pivot("month", list(range(first, last + 1))).agg(F.sum("l_quantity")), path)
    return path, last


def _filled(c: str) -> str:
    return f"round(coalesce({sql.finite('f.' + c)}, (SELECT median({sql.finite(c)}) FROM feat)), 6) + 0.0 AS {c}"


@register("feature_job", f"""WITH {sql.SUPPLIER_MONTH},
axis AS (SELECT unnest(range(min(m), max(m) + 1)) AS m FROM supplier_raw),
grid AS (SELECT k.key, CAST(a.m AS INTEGER) AS period, r.value
         FROM (SELECT DISTINCT key FROM supplier_raw) k CROSS JOIN axis a
         LEFT JOIN supplier_raw r ON r.key = k.key AND r.m = a.m),
{sql.feature_chain('grid')},
feat AS (SELECT key, arg_max_null(ofr, period) AS ofr, arg_max_null(ofr_change, period) AS ofr_change,
                arg_max_null(price_index, period) AS price_index FROM fc GROUP BY key),
ends AS (SELECT max(m) AS hi FROM supplier_raw)
SELECT 'Supplier ' || g.key AS key, g.period, round(g.value, 6) + 0.0 AS value,
       {_filled('ofr')}, {_filled('ofr_change')}, {_filled('price_index')},
       CASE WHEN g.period > ends.hi - {TEST[1] - VAL[1]} THEN 'test'
            WHEN g.period > ends.hi - {TEST[1] - TRAIN[1]} THEN 'val' ELSE 'train' END AS split
FROM grid g JOIN feat f ON f.key = g.key CROSS JOIN ends""")
def q_feature_job(spark, sf_dir):
    """Wide CSV -> names and values cleaned -> sums -> features -> medians -> splits, through the saved pipeline."""
    path, last = wide_csv(spark, sf_dir)
    shift = last - TEST[1]
    bounds = {name: (lo + shift, hi + shift) for name, (lo, hi) in (("train", TRAIN), ("val", VAL), ("test", TEST))}
    return rounded(feature_job(spark, path, f"{path}-job", bounds))
