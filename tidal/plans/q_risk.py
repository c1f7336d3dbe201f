"""Risk queries: components, normalisation, score (flagship), bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidal.operators import risk, series
from tidal.plans import sql
from tidal.plans.registry import register, rounded
from tidal.plans.views import nation_month
from tidal.session import materialize
from tidal.sources.tables import read_table

_COMP = [f"{c}_{h}" for h in (5, 10) for c in risk.COMPONENTS]


def risk_table(spark, sf_dir):
    """Risk components and scores per nation over its last 5 and 10 periods."""
    chain = series.index_chain(nation_month(spark, sf_dir))
    return risk.risk_score(risk.tail_risk(chain), horizons=("5", "10"))


def _sql_components() -> str:
    aggs = []
    for h in (5, 10):
        for c in ("ofr_change", "inflation_pct"):
            y = f"CASE WHEN rn <= {h} THEN {c} END"
            x = f"CASE WHEN rn <= {h} THEN period END"
            aggs.append(f"{sql.slope(y, x)} AS slope_{c}_{h}")
        for c in ("ofr_change", "inflation_pct"):
            aggs.append(f"{sql.fsum(f'CASE WHEN rn <= {h} THEN {c} END')} AS sum_{c}_{h}")
    return f"""
WITH {sql.NATION_MONTH},
{sql.index_chain('nation_month')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY period DESC) AS rn FROM ix),
comp AS (SELECT key, {', '.join(aggs)} FROM ranked WHERE rn <= 10 GROUP BY key)"""


def _sql_norm(c: str) -> str:
    return (f"CASE WHEN max({c}) OVER () = min({c}) OVER () OR max({c}) OVER () IS NULL THEN 0.5 "
            f"ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END")


def _sql_score(h: int) -> str:
    parts = " + ".join(_sql_norm(f"{c}_{h}") for c in risk.COMPONENTS)
    return f"round_even(({parts}) / 4, 6)"


RISK_SCORE_SQL = _sql_components() + f"""
SELECT key, round({_sql_score(5)}, 6) + 0.0 AS risk_score_5, round({_sql_score(10)}, 6) + 0.0 AS risk_score_10,
       {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _COMP)}
FROM comp"""


@register("risk_score", RISK_SCORE_SQL)
def q_risk_score(spark, sf_dir):
    """Flagship: index chain -> tail-window components -> min-max -> mean score."""
    return rounded(risk_table(spark, sf_dir).select("key", "risk_score_5", "risk_score_10", *_COMP))


@register("risk_components", _sql_components() + f"""
SELECT key, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _COMP)} FROM comp""")
def q_risk_components(spark, sf_dir):
    chain = series.index_chain(nation_month(spark, sf_dir))
    return rounded(risk.tail_risk(chain))


@register("minmax_norm", _sql_components() + f"""
SELECT key, {', '.join(f'round({_sql_norm(c)}, 6) + 0.0 AS norm_{c}' for c in _COMP)} FROM comp""")
def q_minmax_norm(spark, sf_dir):
    chain = series.index_chain(nation_month(spark, sf_dir))
    normed = risk.min_max_norm(materialize(risk.tail_risk(chain), "risk_components"), _COMP)
    return rounded(normed.select("key", *[f"norm_{c}" for c in _COMP]))


# ----------------------------------------------------------------- bands
from tidal.functions import scalar  # noqa: E402
from tidal.operators import bands  # noqa: E402
from tidal.plans.q_forecast import RISK_CTE, q_risk_from_horizons  # noqa: E402


def risk_rows(spark, sf_dir):
    """Per-supplier risk table of the forecast path (scores rounded to 6)."""
    return q_risk_from_horizons(spark, sf_dir)


def _sql_band(s: str, policy: str) -> str:
    lo, mid = scalar.BAND_LOW_MAX, scalar.BAND_MEDIUM_MAX
    if policy == "raw":
        return (f"CASE WHEN {s} IS NULL OR isnan({s}) THEN 'medium' WHEN {s} < 0 THEN 'low' "
                f"WHEN {s} < {lo} THEN 'low' WHEN {s} < {mid} THEN 'medium' ELSE 'high' END")
    if policy == "rounded":
        r = f"round_even({s}, 3)"
        return (f"CASE WHEN {s} IS NULL OR isnan({s}) OR {s} < 0 THEN 'medium' "
                f"WHEN {r} < {lo} THEN 'low' WHEN {r} < {mid} THEN 'medium' ELSE 'high' END")
    return (f"CASE WHEN {s} IS NULL OR isnan({s}) OR {s} < 0 THEN 'medium' "
            f"WHEN {s} < {lo} THEN 'low' WHEN {s} < {mid} THEN 'medium' ELSE 'high' END")


@register("risk_band", RISK_CTE + f"""
SELECT key, risk_score_5, {_sql_band('risk_score_5', 'raw')} AS band_raw,
       {_sql_band('risk_score_5', 'rounded')} AS band_rounded,
       {_sql_band('risk_score_5', 'recommend')} AS band_recommend FROM risk""")
def q_risk_band(spark, sf_dir):
    """The three banding policies (raw, rounded to 3 places, recommendation) side by side."""
    r = risk_rows(spark, sf_dir)
    return r.select("key", "risk_score_5",
                    scalar.risk_band(F.col("risk_score_5"), "raw").alias("band_raw"),
                    scalar.risk_band(F.col("risk_score_5"), "rounded").alias("band_rounded"),
                    scalar.risk_band(F.col("risk_score_5"), "recommend").alias("band_recommend"))


def _pred_label(s5: str, s10: str, band10: str):
    return f"CASE WHEN {s10} >= {s5} THEN ' ' || upper({band10}) || ' ' ELSE '' END"


@register("effective_band", RISK_CTE + f"""
SELECT key, CASE WHEN lower(trim(p, ' ')) IN ('low', 'medium', 'high') THEN lower(trim(p, ' '))
                 ELSE {_sql_band('risk_score_5', 'recommend')} END AS band
FROM (SELECT *, {_pred_label('risk_score_5', 'risk_score_10', _sql_band('risk_score_10', 'raw'))} AS p FROM risk)""")
def q_effective_band(spark, sf_dir):
    """A predicted label if it is a known band (after trim/lower-case), else the score's band.

    The predicted label is the padded upper-case 10-period band where that
    score is at least the 5-period one, and blank elsewhere.
    """
    r = risk_rows(spark, sf_dir)
    b10 = scalar.risk_band(F.col("risk_score_10"), "raw")
    pred = F.when(F.col("risk_score_10") >= F.col("risk_score_5"),
                  F.concat(F.lit(" "), F.upper(b10), F.lit(" "))).otherwise(F.lit(""))
    return r.select("key", scalar.effective_band(pred, F.col("risk_score_5")).alias("band"))


def _sql_topk(band: str) -> str:
    return "CASE " + " ".join(f"WHEN {band} = '{b}' THEN {k}" for b, k in bands.TOP_K.items()) + " END"


@register("risk_reduction", RISK_CTE + f""",
b AS (SELECT key, risk_score_5, {_sql_topk(_sql_band('risk_score_5', 'recommend'))} AS n FROM risk)
SELECT key, n, round((1 - risk_score_5) / CASE WHEN n >= 3 THEN 3.0 WHEN n = 1 THEN 9.0
                                              WHEN n = 0 THEN NULL ELSE 9.0 / n END * 100, 6) + 0.0 AS reduction_pct
FROM b""")
def q_risk_reduction(spark, sf_dir):
    """Share of risk headroom removed by the recommended policies (n = band's top-k)."""
    r = risk_rows(spark, sf_dir)
    band = scalar.risk_band(F.col("risk_score_5"), "recommend")
    n = F.coalesce(*[F.when(band == b, F.lit(k)) for b, k in bands.TOP_K.items()])
    out = r.select("key", n.alias("n"), "risk_score_5")
    return rounded(out.select("key", "n", scalar.risk_reduction_pct(F.col("risk_score_5"), F.col("n"))
                              .alias("reduction_pct")))


_EXPL_SQL = "CASE " + " ".join(
    f"WHEN b = '{k}' THEN '{v}'" for k, v in bands.EXPLANATIONS.items()) + " END"


@register("band_explanation", RISK_CTE + f"""
SELECT key, b AS band, {_EXPL_SQL} AS explanation
FROM (SELECT key, {_sql_band('risk_score_10', 'raw')} AS b FROM risk)""")
def q_band_explanation(spark, sf_dir):
    """Fixed explanation sentence per band via a join to the 3-row band dimension."""
    r = risk_rows(spark, sf_dir).select("key", scalar.risk_band(F.col("risk_score_10"), "raw").alias("band"))
    return bands.explain_band(r, "band", bands.band_dimension(spark)).select("key", "band", "explanation")


@register("band_range_join", RISK_CTE + """,
dim AS (SELECT * FROM (VALUES ('low', 0.00::DECIMAL(4,2), 0.45::DECIMAL(4,2), 1),
                              ('medium', 0.45::DECIMAL(4,2), 0.55::DECIMAL(4,2), 2),
                              ('high', 0.55::DECIMAL(4,2), 1.00::DECIMAL(4,2), 3)) v(band_name, min_score, max_score, sort_order))
SELECT r.key, r.risk_score_5, d.band_name, d.sort_order
FROM risk r LEFT JOIN dim d ON r.risk_score_5 >= d.min_score
     AND (r.risk_score_5 < d.max_score OR (d.sort_order = 3 AND r.risk_score_5 <= d.max_score))""")
def q_band_range_join(spark, sf_dir):
    """Score -> band through the min/max band table (non-equi join, top band closed)."""
    r = risk_rows(spark, sf_dir).select("key", "risk_score_5")
    out = bands.band_for_score(r, "risk_score_5", bands.band_dimension(spark))
    return out.select("key", "risk_score_5", "band_name", "sort_order")


_CM_SQL = RISK_CTE + f""",
yp AS (SELECT key, {_sql_band('risk_score_5', 'raw')} AS y, {_sql_band('risk_score_10', 'raw')} AS pred FROM risk)"""


@register("confusion_matrix", _CM_SQL + """,
labs AS (SELECT * FROM (VALUES ('low'), ('medium'), ('high')) v(l))
SELECT a.l AS actual, p.l AS predicted, count(yp.key) AS n
FROM labs a CROSS JOIN labs p LEFT JOIN yp ON yp.y = a.l AND yp.pred = p.l
GROUP BY 1, 2""")
def q_confusion_matrix(spark, sf_dir):
    """Counts of (5-period band, 10-period band) pairs, all nine cells."""
    r = risk_rows(spark, sf_dir)
    yp = r.select(scalar.risk_band(F.col("risk_score_5"), "raw").alias("y"),
                  scalar.risk_band(F.col("risk_score_10"), "raw").alias("pred"))
    return bands.confusion_matrix(yp, "y", "pred")


def _sql_report() -> str:
    per = []
    for lab in bands.LABELS:
        tp = f"sum(CASE WHEN y = '{lab}' AND pred = '{lab}' THEN 1 ELSE 0 END)"
        pp = f"sum(CASE WHEN pred = '{lab}' THEN 1 ELSE 0 END)"
        sup = f"sum(CASE WHEN y = '{lab}' THEN 1 ELSE 0 END)"
        per.append(f"""SELECT '{lab}' AS label,
  coalesce(CAST({tp} AS DOUBLE) / nullif({pp}, 0), 0.0) AS precision,
  coalesce(CAST({tp} AS DOUBLE) / nullif({sup}, 0), 0.0) AS recall,
  CAST({sup} AS BIGINT) AS support FROM yp""")
    return " UNION ALL ".join(per)


@register("class_report", _CM_SQL + f""",
per AS (SELECT label, precision, recall,
               coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1, support
        FROM ({_sql_report()})),
tot AS (SELECT count(*) AS n, sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS k FROM yp)
SELECT label, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall,
       round(f1, 6) + 0.0 AS f1, support FROM per
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(k AS DOUBLE) / n, 6) + 0.0, n FROM tot
UNION ALL SELECT 'macro avg', round(avg(precision), 6) + 0.0, round(avg(recall), 6) + 0.0,
                 round(avg(f1), 6) + 0.0, (SELECT n FROM tot) FROM per
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6) + 0.0,
                 round(sum(recall * support) / sum(support), 6) + 0.0,
                 round(sum(f1 * support) / sum(support), 6) + 0.0, (SELECT n FROM tot) FROM per""")
def q_class_report(spark, sf_dir):
    """Precision / recall / F1 / support per band, accuracy, macro and weighted averages."""
    r = risk_rows(spark, sf_dir)
    yp = r.select(scalar.risk_band(F.col("risk_score_5"), "raw").alias("y"),
                  scalar.risk_band(F.col("risk_score_10"), "raw").alias("pred"))
    return rounded(bands.classification_report(yp, "y", "pred"))


@register("stratified_split", """
WITH h AS (SELECT doc_id, quality, md5(CAST(doc_id AS VARCHAR) || ':42') AS hh FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY hh, doc_id) AS rn,
             count(*) OVER (PARTITION BY quality) AS n FROM h)
SELECT doc_id, quality, CASE WHEN rn * 100 <= n * 60 THEN 'train' WHEN rn * 100 <= n * 80 THEN 'val'
                             ELSE 'test' END AS split FROM r""")
def q_stratified_split(spark, sf_dir):
    """Deterministic exact 60/20/20 split per label (hash order, integer cut points)."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return bands.stratified_split(lab, "doc_id", "quality")


@register("risk_sink_types", RISK_CTE + f"""
SELECT key, CAST(CAST(risk_score_5 AS DECIMAL(38,12)) AS DECIMAL(6,4)) AS risk_score_5,
       CAST(CAST(risk_score_10 AS DECIMAL(38,12)) AS DECIMAL(6,4)) AS risk_score_10,
       {_sql_band('risk_score_5', 'raw')} AS risk_5, {_sql_band('risk_score_10', 'raw')} AS risk_10
FROM risk""")
def q_risk_sink_types(spark, sf_dir):
    """Risk rows in sink types: DECIMAL(6,4) scores (half away from zero) and raw bands."""
    r = risk_rows(spark, sf_dir)
    return r.select("key", bands.to_sink_decimal(F.col("risk_score_5"), 6, 4).alias("risk_score_5"),
                    bands.to_sink_decimal(F.col("risk_score_10"), 6, 4).alias("risk_score_10"),
                    scalar.risk_band(F.col("risk_score_5"), "raw").alias("risk_5"),
                    scalar.risk_band(F.col("risk_score_10"), "raw").alias("risk_10"))
