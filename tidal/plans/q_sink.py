"""Loading queries: upsert, row descriptions, source unions, embeddings, approximate k-NN."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidal.functions import scalar
from tidal.operators import bands, embed, reshape, series
from tidal.plans import sql
from tidal.plans.q_forecast import (RISK_CTE, SQL_HORIZON, horizon_rows, horizons_from, q_forecast_horizons,
                                    q_risk_from_horizons, risk_and_horizons)
from tidal.plans.q_text import _SQL_SENT, _sql_html_text, _sql_lines, _sql_pack, q_page_chunks, q_pack_chunks
from tidal.plans.registry import register, rounded
from tidal.plans.views import FUTURE, shared_predictions
from tidal.session import checkpoint_dir, materialize
from tidal.sources import io
from tidal.sources.tables import read_table
from tidal.operators import text

KEYS = ["key", "period", "horizon"]


def upsert_batch(p):
    """New forecast rows: the naive-forecast chain over the future periods.

    Tagged horizon '10' they hit existing keys (update); tagged '3' they are new.
    """
    e = series.enrich_predictions(p).select("key", "period", "ofr_change", "inflation_pct")
    return rounded(reshape.tag_ranges(e, {"10": FUTURE, "3": (FUTURE[0], FUTURE[0] + 2)}, "horizon"))


_SQL_BATCH = f""",
pc AS (SELECT key, period, actual, forecast, coalesce(actual, forecast) AS value FROM predictions),
{sql.index_chain('pc', prefix='ex')},
src AS (SELECT key, period, round(ofr_change, 6) + 0.0 AS ofr_change, round(inflation_pct, 6) + 0.0 AS inflation_pct,
               '10' AS horizon FROM ex WHERE period BETWEEN {FUTURE[0]} AND {FUTURE[1]}
        UNION ALL
        SELECT key, period, round(ofr_change, 6) + 0.0, round(inflation_pct, 6) + 0.0, '3'
        FROM ex WHERE period BETWEEN {FUTURE[0]} AND {FUTURE[0] + 2}),
tgt AS (SELECT key, period, round(ofr_change, 6) + 0.0 AS ofr_change, round(inflation_pct, 6) + 0.0 AS inflation_pct,
               h AS horizon, 'base forecast' AS context_meaning
        FROM ix, (VALUES ('5', {FUTURE[0]}, {FUTURE[0] + 4}), ('10', {FUTURE[0]}, {FUTURE[0] + 9})) v(h, lo, hi)
        WHERE period BETWEEN lo AND hi)"""


_SQL_UPSERT = SQL_HORIZON + _SQL_BATCH + """
SELECT coalesce(t.key, s.key) AS key, coalesce(t.period, s.period) AS period,
       CASE WHEN s.key IS NOT NULL THEN s.ofr_change ELSE t.ofr_change END AS ofr_change,
       CASE WHEN s.key IS NOT NULL THEN s.inflation_pct ELSE t.inflation_pct END AS inflation_pct,
       coalesce(t.horizon, s.horizon) AS horizon, t.context_meaning
FROM tgt t FULL OUTER JOIN src s ON t.key = s.key AND t.period = s.period AND t.horizon = s.horizon"""


@register("upsert_forecast", _SQL_UPSERT)
def q_upsert_forecast(spark, sf_dir):
    """ON CONFLICT (key, period, horizon) DO UPDATE of the two value columns; context survives."""
    p = shared_predictions(spark, sf_dir)
    target = horizons_from(horizon_rows(spark, sf_dir, p)).withColumn("context_meaning", F.lit("base forecast"))
    return io.upsert(target, upsert_batch(p), KEYS, ["ofr_change", "inflation_pct"])


@register("upsert_loads", _SQL_UPSERT)
def q_upsert_loads(spark, sf_dir):
    """The same merge as two loads of a stored table, partitioned by key bucket: horizons first, then the batch."""
    p = shared_predictions(spark, sf_dir)
    base = f"{checkpoint_dir(spark).rstrip('/')}/tables/forecast-{uuid.uuid4().hex}"
    first = horizons_from(horizon_rows(spark, sf_dir, p)).withColumn("context_meaning", F.lit("base forecast"))
    values = ["ofr_change", "inflation_pct"]
    for batch in (first, upsert_batch(p)):
        io.upsert_table(spark, base, batch, KEYS, values)
    return io.read_upsert_table(spark, base).drop("buckets", "bucket")


@register("forecast_sink_types", SQL_HORIZON + f"""
SELECT key, period, horizon, CAST(CAST(round(ofr_change, 6) AS DECIMAL(38,12)) AS DECIMAL(12,6)) AS ofr_change,
       CAST(CAST(round(inflation_pct, 6) AS DECIMAL(38,12)) AS DECIMAL(12,6)) AS inflation_pct
FROM (SELECT key, period, CASE WHEN isfinite(ofr_change) THEN ofr_change END AS ofr_change,
             CASE WHEN isfinite(inflation_pct) THEN inflation_pct END AS inflation_pct, h AS horizon
      FROM ix, (VALUES ('5', {FUTURE[0]}, {FUTURE[0] + 4}), ('10', {FUTURE[0]}, {FUTURE[0] + 9})) v(h, lo, hi)
      WHERE period BETWEEN lo AND hi)""")
def q_forecast_sink_types(spark, sf_dir):
    """Forecast rows in the sink's types: DECIMAL(12,6), NaN and inf as NULL."""
    f = q_forecast_horizons(spark, sf_dir)
    return f.select("key", "period", "horizon", *[
        bands.to_sink_decimal(F.col(c), 12, 6).alias(c) for c in ("ofr_change", "inflation_pct")])


#: The moment that the risk upsert stamps (a constant, so that reruns agree).
STAMP = "2024-01-01 00:00:00"


@register("upsert_risk", RISK_CTE + f""",
s AS (SELECT key, CAST(CAST(risk_score_5 AS DECIMAL(38,12)) AS DECIMAL(6,4)) AS s5,
             CAST(CAST(risk_score_10 AS DECIMAL(38,12)) AS DECIMAL(6,4)) AS s10 FROM risk)
SELECT key, CASE WHEN CAST(key AS BIGINT) % 2 = 0 THEN s5 ELSE NULL END AS risk_score_5,
       CASE WHEN CAST(key AS BIGINT) % 2 = 0 THEN s10 ELSE NULL END AS risk_score_10,
       CASE WHEN CAST(key AS BIGINT) % 3 = 0 THEN 'stored' END AS context_meaning,
       CASE WHEN CAST(key AS BIGINT) % 2 = 0 THEN TIMESTAMP '{STAMP}' END AS updated_at
FROM s WHERE CAST(key AS BIGINT) % 2 = 0 OR CAST(key AS BIGINT) % 3 = 0""")
def q_upsert_risk(spark, sf_dir):
    """Risk rows upserted on the key: new scores and ``updated_at``; contexts and other rows survive.

    The stored table holds every third key without scores; the batch, the scores of every second.
    """
    risk = q_risk_from_horizons(spark, sf_dir).select("key", *[
        bands.to_sink_decimal(F.col(c), 6, 4).alias(c) for c in ("risk_score_5", "risk_score_10")])
    risk = materialize(risk, "risk_sink")
    n = F.col("key").cast("long")
    none = F.lit(None)
    stored = risk.filter(n % 3 == 0).select(
        "key", none.cast("decimal(6,4)").alias("risk_score_5"), none.cast("decimal(6,4)").alias("risk_score_10"),
        F.lit("stored").alias("context_meaning"), none.cast("timestamp_ntz").alias("updated_at"))
    return io.upsert(stored, risk.filter(n % 2 == 0), ["key"], ["risk_score_5", "risk_score_10"], touch="updated_at",
                     now=F.lit(STAMP).cast("timestamp_ntz"))


def _band_sql(s: str) -> str:
    lo, mid = scalar.BAND_LOW_MAX, scalar.BAND_MEDIUM_MAX
    return (f"CASE WHEN {s} IS NULL OR isnan({s}) THEN 'medium' WHEN {s} < 0 THEN 'low' "
            f"WHEN {s} < {lo} THEN 'low' WHEN {s} < {mid} THEN 'medium' ELSE 'high' END")


def _num(x: str, kind: str) -> str:
    return f"coalesce(CAST(CAST(CAST({x} AS DECIMAL(38,12)) AS {kind}) AS VARCHAR), 'None')"


def _score(x: str) -> str:
    return _num(x, "DECIMAL(6,4)")


def _metric(x: str) -> str:
    return _num(f"round(CASE WHEN isfinite({x}) THEN {x} END, 6)", "DECIMAL(12,6)")


_BAND_VALUES = ", ".join(f"('{b}', '{ctx}')" for b, _, _, ctx, _ in bands.BAND_ROWS)


_SQL_FH = RISK_CTE + f""",
fh AS (SELECT key, period, ofr_change, inflation_pct, '5' AS horizon FROM ix WHERE period BETWEEN {FUTURE[0]} AND {FUTURE[0] + 4}
       UNION ALL
       SELECT key, period, ofr_change, inflation_pct, '10' FROM ix WHERE period BETWEEN {FUTURE[0]} AND {FUTURE[0] + 9})"""
_SQL_DESCRIBE = f"""
SELECT 'country_risk_category' AS source_type, key AS source_id,
       CASE WHEN s_acctbal < 0 THEN s_name || ' owes ' || CAST(CAST(-s_acctbal AS BIGINT) AS VARCHAR) ELSE
       'Country: ' || key || '. 5-year risk: ' || {_band_sql('risk_score_5')} || ' (score ' || {_score('risk_score_5')}
       || '). 10-year risk: ' || {_band_sql('risk_score_10')} || ' (score ' || {_score('risk_score_10')} || ').' END AS content
FROM risk LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = key
UNION ALL
SELECT 'risk_score_intervals', b, ctx FROM (VALUES {_BAND_VALUES}) v(b, ctx)
UNION ALL
SELECT 'forecast_metrics', key || '|' || CAST(period AS VARCHAR) || '|' || horizon,
       'Country: ' || key || ', Year: ' || CAST(period AS VARCHAR) || ', Horizon: ' || horizon || '. OFR change: '
       || {_metric('ofr_change')} || ', Inflation %: ' || {_metric('inflation_pct')} || '.'
FROM fh"""


@register("describe_rows", _SQL_FH + _SQL_DESCRIBE)
def q_describe_rows(spark, sf_dir):
    """Embedding source rows from three tables: context text if present, else a sentence."""
    return describe_rows(spark, sf_dir)


def describe_rows(spark, sf_dir):
    risk, fh = risk_and_horizons(spark, sf_dir)
    no_ctx = F.lit(None).cast("string")
    b5 = scalar.risk_band(F.col("risk_score_5"), "raw")
    b10 = scalar.risk_band(F.col("risk_score_10"), "raw")
    # the stored context of a supplier: a remark on its debts, blank for the others
    owes = F.concat("s_name", F.lit(" owes "), F.round(-F.col("s_acctbal")).cast("long").cast("string"))
    ctx = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("key"), F.when(F.col("s_acctbal") < 0, owes).otherwise(" \n").alias("ctx"))
    r = risk.join(ctx, "key", "left").select(
                    F.lit("country_risk_category").alias("source_type"), F.col("key").alias("source_id"),
                    embed.describe_row(F.col("ctx"), F.concat(
                        F.lit("Country: "), F.col("key"), F.lit(". 5-year risk: "), b5, F.lit(" (score "),
                        embed.fmt(F.col("risk_score_5"), 6, 4), F.lit("). 10-year risk: "), b10,
                        F.lit(" (score "), embed.fmt(F.col("risk_score_10"), 6, 4), F.lit(")."))).alias("content"))
    dim = bands.band_dimension(spark).select(
        F.lit("risk_score_intervals").alias("source_type"), F.col("band_name").alias("source_id"),
        F.col("context_meaning").alias("content")).filter(F.length(F.trim("content")) > 0)
    f = fh.select(F.lit("forecast_metrics").alias("source_type"),
                  F.concat_ws("|", "key", F.col("period").cast("string"), "horizon").alias("source_id"),
                  embed.describe_row(no_ctx, F.concat(
                      F.lit("Country: "), F.col("key"), F.lit(", Year: "), F.col("period").cast("string"),
                      F.lit(", Horizon: "), F.col("horizon"), F.lit(". OFR change: "),
                      embed.fmt(F.col("ofr_change"), 12, 6), F.lit(", Inflation %: "),
                      embed.fmt(F.col("inflation_pct"), 12, 6), F.lit("."))).alias("content"))
    return r.unionByName(dim).unionByName(f)


@register("union_sources", f"""WITH RECURSIVE {_SQL_SENT}, {_sql_pack('sent', 'doc_id', 'd_')},
arr AS (SELECT page_id, {_sql_lines(_sql_html_text('html'), text.MIN_LINE_CHARS)} AS a FROM pages),
{_sql_pack('arr', 'page_id', 'p_')}
SELECT 'documents' AS source, CAST(k AS VARCHAR) AS source_id, chunk_no, content FROM d_chunks
UNION ALL
SELECT 'pages', CAST(k AS VARCHAR), chunk_no, content FROM p_chunks""")
def q_union_sources(spark, sf_dir):
    """Chunks from documents and from pages appended into one chunk table."""
    d = q_pack_chunks(spark, sf_dir).select(F.lit("documents").alias("source"),
                                            F.col("doc_id").cast("string").alias("source_id"),
                                            "chunk_no", "content")
    p = q_page_chunks(spark, sf_dir).select(F.lit("pages").alias("source"),
                                            F.col("page_id").cast("string").alias("source_id"),
                                            "chunk_no", "content")
    return d.unionByName(p)


@register("embed_hash")
def q_embed_hash(spark, sf_dir):
    """Every document chunk embedded with the built-in TF-IDF hashing embedder."""
    # written once: the embedder reads the texts for the term statistics and again for the vectors
    chunks = materialize(q_pack_chunks(spark, sf_dir).select("doc_id", "chunk_no", "content"), "chunks")
    return embed.embed_texts(chunks).select("doc_id", "chunk_no", "embedding")


def embedding_loads(spark, sf_dir):
    """Three loads of one embedding table: without the risk rows and with outdated bands, everything, everything again.

    Returns the table's path and the number of texts that each load embedded.
    """
    rows = materialize(describe_rows(spark, sf_dir), "described")
    model = embed.fit_hashing(rows)
    base = f"{checkpoint_dir(spark).rstrip('/')}/tables/embeddings-{uuid.uuid4().hex}"
    outdated = F.when(F.col("source_type") == "risk_score_intervals", F.concat(F.lit("outdated "), "source_id")).otherwise(F.col("content"))
    first = rows.filter("source_type <> 'country_risk_category'").withColumn("content", outdated)
    return base, [embed.refresh_embeddings(base, r, ["source_type", "source_id"], lambda t: embed.apply_hashing(model, t), "hashing")
                  for r in (first, rows, rows)]


@register("embedding_table")
def q_embedding_table(spark, sf_dir):
    """Row descriptions embedded into a stored table keyed by (source_type, source_id).

    The first load holds the forecast rows and the bands with an outdated text; the second embeds only the
    changed bands and the new risk rows.
    """
    base, _ = embedding_loads(spark, sf_dir)
    return io.read_upsert_table(spark, base).select("source_type", "source_id", "content", "embedding")


@register("embedding_loads", _SQL_FH + f""",
d AS ({_SQL_DESCRIBE})
SELECT 1 AS load, count(DISTINCT CASE WHEN source_type = 'risk_score_intervals' THEN 'outdated ' || source_id ELSE content END) AS n_embedded
FROM d WHERE source_type <> 'country_risk_category'
UNION ALL SELECT 2, count(DISTINCT content) FROM d WHERE source_type <> 'forecast_metrics'
UNION ALL SELECT 3, 0""")
def q_embedding_loads(spark, sf_dir):
    """Distinct texts embedded by a first load, a load with changed and new texts, and one with nothing new."""
    _, counts = embedding_loads(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(counts, 1)), "load int, n_embedded long")


@register("knn_lsh")
def q_knn_lsh(spark, sf_dir):
    """Approximate cosine neighbours: random-projection LSH on unit vectors, exact re-rank."""
    from tidal.operators.ann import knn_lsh
    from tidal.operators.retrieve import label_queries
    emb = read_table(spark, sf_dir, "embeddings")
    return knn_lsh(emb, label_queries(emb), 5)


@register("knn_cells")
def q_knn_cells(spark, sf_dir):
    """Approximate cosine neighbours from an inverted file of k-means cells, exact re-rank."""
    from tidal.operators import ann
    from tidal.operators.retrieve import label_queries
    emb = read_table(spark, sf_dir, "embeddings")
    index = ann.build_cells(emb, f"{checkpoint_dir(spark).rstrip('/')}/tables/cells-{uuid.uuid4().hex}")
    return ann.knn_cells(index, label_queries(emb), 5)
