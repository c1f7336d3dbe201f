"""Cleaning, coercion, name standardisation and lookup joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidal.functions import scalar
from tidal.plans import sql
from tidal.plans.registry import register, rounded
from tidal.operators import series
from tidal.plans.views import month_index, supplier_month, supplier_month_zero
from tidal.session import checkpoint_dir
from tidal.sources import io
from tidal.sources.tables import read_table

WS = scalar.WS


def _sql_to_numeric(x: str) -> str:
    v = f"TRY_CAST(trim(CAST({x} AS VARCHAR), ' ') AS DOUBLE)"
    return f"CASE WHEN isfinite({v}) THEN {v} END"


@register("to_numeric", f"""SELECT event_id,
  {_sql_to_numeric("json_extract_string(props, '$.k')")} AS k_num,
  {_sql_to_numeric("event_type")} AS type_num,
  {_sql_to_numeric("CAST(value AS VARCHAR)")} AS value_num
FROM events""")
def q_to_numeric(spark, sf_dir):
    """Text -> double with unparseable, NaN and +-inf as NULL."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id",
                     scalar.to_numeric(F.get_json_object("props", "$.k")).alias("k_num"),
                     scalar.to_numeric(F.col("event_type")).alias("type_num"),
                     scalar.to_numeric(F.col("value")).alias("value_num"))


@register("finite_or_null", f"""WITH {sql.SUPPLIER_MONTH_ZERO},
b AS (SELECT key, arg_min(value, period) FILTER (WHERE value <> 0) AS base FROM supplier_month_zero GROUP BY key),
o AS (SELECT s.key, s.period, CASE WHEN b.base IS NOT NULL THEN s.value / b.base * 100 END AS ofr
      FROM supplier_month_zero s JOIN b ON s.key = b.key),
c AS (SELECT key, period, CASE WHEN lag(ofr) OVER (PARTITION BY key ORDER BY period) = 0
                               THEN CASE WHEN ofr > 0 THEN 'inf'::DOUBLE WHEN ofr < 0 THEN '-inf'::DOUBLE END
                               ELSE (ofr / lag(ofr) OVER (PARTITION BY key ORDER BY period) - 1) * 100 END AS chg
      FROM o)
SELECT key, period, round(CASE WHEN isfinite(chg) THEN chg END, 6) + 0.0 AS chg_finite FROM c""")
def q_finite_or_null(spark, sf_dir):
    """Percent changes with x/0 = +-inf, then +-inf / NaN turned into NULL."""
    df = series.relative_index(supplier_month_zero(spark, sf_dir), "value", "ofr", zero="keep")
    df = series.pct_change(df, "ofr", "chg", zero="keep")
    return rounded(df.select("key", "period", scalar.finite_or_null(F.col("chg")).alias("chg_finite")))


@register("clean_observations", f"""WITH raw AS (
  SELECT event_id, event_type AS key, CAST((year(ts) - 1995) * 12 + month(ts) - 1 AS INTEGER) AS period,
         {_sql_to_numeric("json_extract_string(props, '$.k')")} AS value
  FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND props IS NOT NULL)
SELECT event_id, key, period, value FROM raw WHERE value IS NOT NULL""")
def q_clean_observations(spark, sf_dir):
    """Drop rows missing key/time/value before coercion, coerce, drop again."""
    ev = read_table(spark, sf_dir, "events").na.drop(subset=["event_type", "ts", "props"])
    obs = ev.select("event_id", F.col("event_type").alias("key"),
                    month_index(F.col("ts")).alias("period"),
                    scalar.to_numeric(F.get_json_object("props", "$.k")).alias("value"))
    return obs.na.drop(subset=["period", "value"])


def _sql_title(x: str) -> str:
    parts = f"regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)')"
    return f"array_to_string(list_transform({parts}, lambda p: upper(p[1]) || p[2:]), '')"


def _sql_alias(x: str) -> str:
    whens = " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in scalar.NAME_ALIASES.items())
    return f"CASE {x} {whens} END"


def _sql_standardize(x: str) -> str:
    raw = f"regexp_replace(CAST({x} AS VARCHAR), '^{WS}+|{WS}+$', '', 'g')"
    norm = _sql_title(f"regexp_replace({raw}, '{WS}+', ' ', 'g')")
    return f"CASE WHEN {raw} = '' THEN {raw} ELSE coalesce({_sql_alias(norm)}, {_sql_alias(raw)}, {norm}) END"


@register("standardize_name", f"""SELECT p_partkey, {_sql_standardize('p_name')} AS name_std,
  {_sql_standardize('p_type')} AS type_std FROM part""")
def q_standardize_name(spark, sf_dir):
    """strip -> collapse whitespace -> Python-style title case -> alias table."""
    part = read_table(spark, sf_dir, "part")
    return part.select("p_partkey", scalar.standardize_name(F.col("p_name")).alias("name_std"),
                       scalar.standardize_name(F.col("p_type")).alias("type_std"))


def _sql_safe(x: str) -> str:
    inner = WS[1:-1]
    kept = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_{inner}-]', '', 'g')"
    stripped = f"regexp_replace({kept}, '^{WS}+|{WS}+$', '', 'g')"
    under = f"replace({stripped}, ' ', '_')"
    return f"CASE WHEN {under} = '' THEN 'Unknown' ELSE {under} END"


@register("safe_name", f"""SELECT p_partkey, {_sql_safe("p_brand || ' ' || p_name")} AS file_stem FROM part""")
def q_safe_name(spark, sf_dir):
    """File-safe stem of a label: non-word characters removed, spaces to underscores."""
    part = read_table(spark, sf_dir, "part")
    label = F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"))
    return part.select("p_partkey", scalar.safe_filename(label).alias("file_stem"))


def coordinates(spark, sf_dir):
    """Coordinates lookup per supplier key (stand-in for a geocode cache).

    Derived from supplier columns so it grows with the data; suppliers with a
    negative balance have no entry, so the lookup has misses.
    """
    sup = read_table(spark, sf_dir, "supplier")
    return (sup.filter(F.col("s_acctbal") >= 0)
            .select(F.col("s_suppkey").cast("string").alias("key"),
                    (F.col("s_acctbal") / 10000 * 90).alias("lat"),
                    (F.col("s_nationkey") * 14.4 - 180).alias("lon")))


@register("attach_coordinates", f"""WITH {sql.SUPPLIER_MONTH},
geo AS (SELECT CAST(s_suppkey AS VARCHAR) AS key, s_acctbal / 10000 * 90 AS lat,
               CAST(s_nationkey AS DOUBLE) * 14.4 - 180 AS lon FROM supplier WHERE s_acctbal >= 0)
SELECT m.key, m.period, m.value, round(g.lat, 6) + 0.0 AS lat, round(g.lon, 6) + 0.0 AS lon
FROM supplier_month m LEFT JOIN geo g ON m.key = g.key""")
def q_attach_coordinates(spark, sf_dir):
    """Left lookup key -> (lat, lon); NULL when the key is unknown.

    The lookup has one row per supplier and grows with the data, so it is a
    plain equi-join and AQE decides at run time whether it is small enough
    to broadcast.
    """
    out = supplier_month(spark, sf_dir).join(coordinates(spark, sf_dir), "key", "left")
    return rounded(out)


# Observations as text, some unusable: fields left out, quarters of periods, words and infinities for values.
_SQL_OBSERVATIONS = """WITH n AS (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
raw AS (SELECT CASE WHEN k <> 10 THEN event_type END AS country,
               CASE WHEN k <> 20 THEN k / 4.0 END AS year_,
               CASE WHEN k = 30 THEN 'missing_value' WHEN k IN (41, 44) THEN 'bad_value' END AS bad, value FROM n),
tagged AS (SELECT *, CASE WHEN country IS NULL THEN 'missing_key' WHEN year_ IS NULL THEN 'missing_period'
                          WHEN bad = 'missing_value' THEN bad WHEN year_ <> floor(year_) THEN 'bad_period'
                          WHEN bad = 'bad_value' THEN bad ELSE 'kept' END AS reason FROM raw)"""


def observations_csv(spark, sf_dir) -> str:
    """``events`` written as an observation file (Country, Year, Catch) into the shared folder; its path."""
    k = F.get_json_object("props", "$.k").cast("long")
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/observations-{uuid.uuid4().hex}"
    io.write_csv(read_table(spark, sf_dir, "events").select(
        F.when(k != 10, F.concat(F.lit(" "), "event_type")).alias("Country"),
        F.when(k != 20, (k / 4).cast("string")).otherwise("").alias("Year"),
        F.when(k == 30, "NA").when(k == 41, "inf").when(k == 44, "none given")
        .otherwise(F.col("value").cast("string")).alias("Catch")), path)
    return path


@register("observation_rejects", _SQL_OBSERVATIONS + f"""
SELECT r AS reason, count(t.reason) AS n_rows
FROM (VALUES ('kept'), {", ".join(f"('{r}')" for r in io.REASONS)}) v(r) LEFT JOIN tagged t ON t.reason = r GROUP BY r""")
def q_observation_rejects(spark, sf_dir):
    """Rows of an observation file, kept and left out by reason, as counted by the write of both."""
    path = observations_csv(spark, sf_dir)
    counts = io.load_observations(spark, path, f"{path}-loaded")
    return spark.createDataFrame(sorted(counts.items()), "reason string, n_rows long")


@register("observation_load", _SQL_OBSERVATIONS + """
SELECT upper(country[1]) || lower(country[2:]) AS key, CAST(year_ AS INTEGER) AS period, round(sum(value), 6) + 0.0 AS value
FROM tagged WHERE reason = 'kept' GROUP BY 1, 2""")
def q_observation_load(spark, sf_dir):
    """The sound rows of the loaded file, summed per key and period."""
    path = observations_csv(spark, sf_dir)
    io.load_observations(spark, path, f"{path}-loaded")
    return rounded(io.aggregate_observations(spark.read.parquet(f"{path}-loaded").filter("status = 'kept'")))
