"""Retrieval queries over ``embeddings`` (corpus) with data-derived queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidal.functions import scalar
from tidal.session import materialize
from tidal.operators import bands, retrieve
from tidal.plans.q_forecast import RISK_CTE, q_risk_from_horizons
from tidal.plans.registry import register, rounded
from tidal.sources.tables import read_table

K = 5
TOP_MAX = max(bands.TOP_K.values())

_SQL_VEC = """
q AS (SELECT label AS qid, arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings GROUP BY label),
c AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"""


def _sql_knn(score: str, desc: bool, k: int) -> str:
    """CTEs ending in ``nn(qid, rank, vec_id, score)``: top-k per query."""
    order = "DESC" if desc else "ASC"
    return f"""
s AS (SELECT q.qid, c.vec_id, {score} AS score FROM q CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, {retrieve.RANK_DIGITS}) {order}, vec_id) AS rank
      FROM s),
nn AS (SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k})"""


_NN_OUT = " SELECT qid, rank, vec_id, round(score, 6) + 0.0 AS score FROM nn"


_COS = "list_dot_product(c.v, q.qv) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(q.qv, q.qv)))"
_L2 = "list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (c.v[i] - q.qv[i]) * (c.v[i] - q.qv[i])))"


def _queries(spark, sf_dir):
    return retrieve.label_queries(read_table(spark, sf_dir, "embeddings"))


@register("knn_cosine", f"WITH {_SQL_VEC}," + _sql_knn(_COS, True, K) + _NN_OUT)
def q_knn_cosine(spark, sf_dir):
    """Top-5 cosine neighbours of each label's first vector over the whole corpus."""
    emb = read_table(spark, sf_dir, "embeddings")
    return rounded(retrieve.knn(emb, _queries(spark, sf_dir), K, "cosine").select(
        "qid", "rank", "vec_id", "score"))


@register("knn_l2", f"WITH {_SQL_VEC}," + _sql_knn(_L2, False, K) + _NN_OUT)
def q_knn_l2(spark, sf_dir):
    """Top-5 squared-L2 neighbours (the vector store's default metric)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return rounded(retrieve.knn(emb, _queries(spark, sf_dir), K, "l2").select(
        "qid", "rank", "vec_id", "score"))


def single_query(spark, sf_dir):
    """The retrieval query: the corpus vector with the lowest id."""
    emb = read_table(spark, sf_dir, "embeddings")
    first = emb.agg(F.min_by("embedding", "vec_id").alias("qvec"))
    return first.select(F.lit(0).alias("qid"), "qvec")


def ranked_for_query(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return retrieve.knn(emb, single_query(spark, sf_dir), TOP_MAX, "l2").select("rank", "vec_id")


def _sql_band(s: str) -> str:
    lo, mid = scalar.BAND_LOW_MAX, scalar.BAND_MEDIUM_MAX
    return (f"CASE WHEN {s} IS NULL OR isnan({s}) OR {s} < 0 THEN 'medium' "
            f"WHEN {s} < {lo} THEN 'low' WHEN {s} < {mid} THEN 'medium' ELSE 'high' END")


def _sql_raw(s: str) -> str:
    lo, mid = scalar.BAND_LOW_MAX, scalar.BAND_MEDIUM_MAX
    return (f"CASE WHEN {s} IS NULL OR isnan({s}) THEN 'medium' WHEN {s} < 0 THEN 'low' "
            f"WHEN {s} < {lo} THEN 'low' WHEN {s} < {mid} THEN 'medium' ELSE 'high' END")


_SQL_TOPK = "CASE " + " ".join(f"WHEN band = '{b}' THEN {k}" for b, k in bands.TOP_K.items()) + " END"

SQL_RECS = RISK_CTE + f""",
qq AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings),
rk AS (SELECT vec_id, row_number() OVER (ORDER BY round(list_sum(list_transform(range(1, len(e.v) + 1),
                 lambda i: (e.v[i] - qq.qv[i]) * (e.v[i] - qq.qv[i]))), {retrieve.RANK_DIGITS}), vec_id) AS rank
       FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e CROSS JOIN qq),
kb AS (SELECT key, band, {_SQL_TOPK} AS k FROM (SELECT key, {_sql_band('risk_score_5')} AS band FROM risk)),
recs AS (SELECT kb.key, kb.band, CAST(rk.rank AS INTEGER) AS rank, rk.vec_id
         FROM kb JOIN rk ON rk.rank <= kb.k)"""


def recommendations(spark, sf_dir):
    risk = q_risk_from_horizons(spark, sf_dir)
    # scored once: the score's expression would otherwise be compiled into every use of the band
    keys = materialize(risk.select("key", scalar.risk_band(F.col("risk_score_5"), "recommend").alias("band")), "risk-bands")
    return retrieve.recommend_by_band(keys, "band", ranked_for_query(spark, sf_dir), bands.TOP_K)


@register("recommend_by_band", SQL_RECS + " SELECT key, band, rank, vec_id FROM recs")
def q_recommend_by_band(spark, sf_dir):
    """low -> nothing, medium -> top 3, high -> top 15 nearest items to the query."""
    return recommendations(spark, sf_dir).select("key", "band", "rank", "vec_id")


@register("next_recommendation", SQL_RECS + """,
lab AS (SELECT r.key, r.rank, r.vec_id, e.label FROM recs r JOIN embeddings e ON e.vec_id = r.vec_id),
rej AS (SELECT l.key, l.vec_id FROM lab l JOIN lab t ON t.key = l.key AND t.rank = 1 AND t.label = l.label),
left_ AS (SELECT * FROM recs r WHERE NOT EXISTS (SELECT 1 FROM rej WHERE rej.key = r.key AND rej.vec_id = r.vec_id))
SELECT key, min(rank) AS next_rank, arg_min(vec_id, rank) AS vec_id FROM left_ GROUP BY key""")
def q_next_recommendation(spark, sf_dir):
    """After rejecting the first recommendation's whole label, the next best item per key."""
    recs = recommendations(spark, sf_dir)
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    lab = recs.join(emb, "vec_id")
    top = lab.filter(F.col("rank") == 1).select("key", F.col("label").alias("_rl"))
    rejected = lab.join(top, "key").filter(F.col("label") == F.col("_rl")).select("key", "vec_id")
    return retrieve.next_recommendation(recs, rejected)


@register("assemble_context", f"""WITH {_SQL_VEC}, {_sql_knn(_COS, True, K)},
t AS (SELECT nn.qid, nn.rank, coalesce(d.text, '') AS txt FROM nn LEFT JOIN documents d ON d.doc_id = nn.vec_id)
SELECT qid, string_agg('[' || CAST(rank AS VARCHAR) || '] ' || txt, chr(10) || chr(10) ORDER BY rank) AS context
FROM t GROUP BY qid""")
def q_assemble_context(spark, sf_dir):
    """Numbered context text per query from its ranked neighbours' source documents, empty where there is none."""
    emb = read_table(spark, sf_dir, "embeddings")
    top = retrieve.knn(emb, _queries(spark, sf_dir), K, "cosine")
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("text").alias("txt"))
    found = top.join(docs, "vec_id", "left").withColumn("txt", F.coalesce("txt", F.lit("")))
    return retrieve.assemble_context(found, "qid", "txt")


@register("context_with_sources", f"""WITH {_SQL_VEC}, {_sql_knn(_COS, True, K)},
t AS (SELECT nn.qid, nn.rank, '[' || CAST(nn.rank AS VARCHAR) || '] (Source: ' || coalesce(d.source, '') || ', URL: '
             || coalesce(p.url, '') || ')' || chr(10) || coalesce(d.text, '') AS txt
      FROM nn LEFT JOIN documents d ON d.doc_id = nn.vec_id LEFT JOIN pages p ON p.page_id = nn.vec_id)
SELECT qid, string_agg(txt, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM t GROUP BY qid""")
def q_context_with_sources(spark, sf_dir):
    """Context blocks with source and URL headers; a neighbour without a document keeps its empty block."""
    emb = read_table(spark, sf_dir, "embeddings")
    top = retrieve.knn(emb, _queries(spark, sf_dir), K, "cosine")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text")
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("vec_id"), "url")
    return retrieve.context_with_sources(top.join(docs, "vec_id", "left").join(pages, "vec_id", "left"), "qid", "text")


@register("recommend_by_horizon", RISK_CTE + f""",
pred AS (SELECT key, risk_score_5, risk_score_10, CASE WHEN risk_score_10 >= risk_score_5 THEN {_sql_raw('risk_score_10')} END AS label FROM risk),
bands AS (SELECT key, '5' AS horizon, coalesce(label, {_sql_band('risk_score_5')}) AS band FROM pred
          UNION ALL SELECT key, '10', {_sql_band('risk_score_10')} FROM pred),
req AS (SELECT CAST(s_suppkey AS VARCHAR) AS key, h AS horizon FROM supplier, (VALUES ('5'), ('10'), ('20')) v(h)
        UNION ALL SELECT 'no such key', '5'),
b AS (SELECT r.key, r.horizon, coalesce(bands.band, 'medium') AS band FROM req r
      LEFT JOIN bands ON bands.key = r.key AND bands.horizon = r.horizon),
qq AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings),
rk AS (SELECT vec_id, row_number() OVER (ORDER BY round(list_sum(list_transform(range(1, len(e.v) + 1),
                 lambda i: (e.v[i] - qq.qv[i]) * (e.v[i] - qq.qv[i]))), {retrieve.RANK_DIGITS}), vec_id) AS rank
       FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e CROSS JOIN qq)
SELECT b.key, b.horizon, b.band, CAST(rk.rank AS INTEGER) AS rank, rk.vec_id
FROM b JOIN rk ON rk.rank <= {_SQL_TOPK}""")
def q_recommend_by_horizon(spark, sf_dir):
    """Items per requested key and horizon: the predicted label or the score's band, ``medium`` where unknown.

    The predicted label of the 5-period horizon is the 10-period band where that score is at least as high.
    """
    risk = q_risk_from_horizons(spark, sf_dir)
    s5, s10 = F.col("risk_score_5"), F.col("risk_score_10")
    label = F.when(s10 >= s5, scalar.risk_band(s10, "raw")).otherwise("")
    # written once: the score's expression would otherwise be compiled into every use of the band
    by_key = materialize(risk.select("key", F.array(
        F.struct(F.lit("5").alias("horizon"), scalar.effective_band(label, s5).alias("band")),
        F.struct(F.lit("10").alias("horizon"), scalar.risk_band(s10, "recommend").alias("band"))).alias("b")), "risk-horizon-bands")
    known = by_key.select("key", F.explode("b").alias("b")).select("key", "b.*")
    horizons = F.explode(F.array(*[F.lit(h) for h in ("5", "10", "20")])).alias("horizon")
    asked = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), horizons)
    asked = asked.unionByName(spark.createDataFrame([("no such key", "5")], "key string, horizon string"))
    bands_ = retrieve.requested_bands(asked, known)
    k = F.coalesce(*[F.when(F.col("band") == b, F.lit(n)) for b, n in bands.TOP_K.items()], F.lit(0))
    ranked = ranked_for_query(spark, sf_dir)  # at most max(TOP_K) rows
    return (bands_.withColumn("_k", k).filter("_k > 0").join(F.broadcast(ranked), F.col("rank") <= F.col("_k"))
            .select("key", "horizon", "band", "rank", "vec_id"))


@register("embedding_source_join", """
SELECT e.vec_id, 'document' AS source_type, CAST(d.doc_id AS VARCHAR) AS source_id, d.lang, d.n_chars
FROM embeddings e JOIN documents d ON CAST(e.vec_id AS VARCHAR) = CAST(d.doc_id AS VARCHAR)""")
def q_embedding_source_join(spark, sf_dir):
    """Embedding rows joined to their source through the composed (source_type, source_id) key."""
    emb = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.lit("document").alias("source_type"), F.col("vec_id").cast("string").alias("source_id"))
    docs = read_table(spark, sf_dir, "documents").select(
        F.lit("document").alias("source_type"), F.col("doc_id").cast("string").alias("source_id"),
        "lang", "n_chars")
    return emb.join(docs, ["source_type", "source_id"]).select(
        "vec_id", "source_type", "source_id", "lang", "n_chars")
