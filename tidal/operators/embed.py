"""Text embedding jobs and the embedding table.

The default embedder is fully distributed MLlib (tokenise -> hashing TF ->
IDF -> L2 normalise).  A caller-supplied embedder (e.g. a model client)
runs through ``mapInPandas`` in fixed-size batches, the way a hosted
embedding service is called, with Spark spreading the batches over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidal.functions.scalar import strip
from pyspark.sql import types as T
from tidal.operators.bands import to_sink_decimal
from tidal.session import materialize, ship_package
from tidal.sources import io

EMBED_BATCH = 96       # texts per embedder call
HASH_FEATURES = 1024   # vector width of the built-in embedder


def fit_hashing(df: DataFrame, text_col: str = "content", num_features: int = HASH_FEATURES):
    """The built-in embedder fitted on the term statistics of ``df``; a fitted model gives equal texts equal vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0),
    ]).fit(df)


def apply_hashing(model, df: DataFrame, out: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).withColumn(out, vector_to_array("_vec", "float32")).drop("_tok", "_tf", "_tfidf", "_vec")


def embed_hashing(df: DataFrame, text_col: str = "content", out: str = "embedding",
                  num_features: int = HASH_FEATURES) -> DataFrame:
    """Built-in offline embedder: hashed term frequencies weighted by IDF, L2-normalised."""
    return apply_hashing(fit_hashing(df, text_col, num_features), df, out)


def embed_with(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]],
               text_col: str = "content", out: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """Apply ``embedder`` to texts in batches of ``batch`` inside ``mapInPandas``."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            vecs: list[list[float]] = []
            texts = pdf[text_col].fillna("").tolist()
            for i in range(0, len(texts), batch):
                vecs.extend(embedder(texts[i:i + batch]))
            pdf = pdf.copy()
            pdf[out] = vecs
            yield pdf

    ship_package(df.sparkSession)
    return df.mapInPandas(run, schema)


def embed_texts(df: DataFrame, text_col: str = "content", embedder=None, out: str = "embedding") -> DataFrame:
    if embedder is None:
        return embed_hashing(df, text_col, out)
    return embed_with(df, embedder, text_col, out)


def refresh_embeddings(base: str, rows: DataFrame, keys: list[str], embed: Callable[[DataFrame], DataFrame],
                       version: str, text_col: str = "content") -> int:
    """Bring the embedding table at ``base`` up to date with ``rows``; returns how many texts were embedded.

    A row is stored with a hash of its text and of ``version`` (the embedder's name: another one embeds all
    again).  Rows whose key and hash are stored already go no further; of the others, each distinct text
    reaches ``embed`` once (a frame of ``content_hash`` and the text, to which it adds ``embedding``), and only the key
    buckets that they fall into are rewritten.  Null texts count as empty.  Rows gone from the input stay stored.
    """
    spark = rows.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = rows.select(*keys, text.alias(text_col), F.sha2(F.concat(F.lit(version + "\n"), text), 256).alias("content_hash"))
    stored = io.read_upsert_table(spark, base)
    if stored is not None:
        known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("content_hash").alias("_hash"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("content_hash") == F.col("_hash")]
        rows = rows.join(known, reduce(Column.__and__, same), "left_anti")
    todo = materialize(rows, "to_embed")
    texts = materialize(todo.groupBy("content_hash").agg(F.first(text_col).alias(text_col)), "texts_to_embed")
    n = texts.count()  # row counts of the written files
    if n:
        vecs = embed(texts).select("content_hash", "embedding")
        io.upsert_table(spark, base, todo.join(vecs, "content_hash").select(*keys, text_col, "content_hash", "embedding"),
                        keys, [text_col, "content_hash", "embedding"], touch="embedded_at")
    return n


def describe_row(ctx, fallback) -> F.Column:
    """Stored context text if non-blank, else the formatted description."""
    return F.when(F.coalesce(F.length(strip(ctx)), F.lit(0)) > 0, ctx).otherwise(fallback)


def fmt(c, precision: int, scale: int) -> F.Column:
    """A number as text in the decimal type of its sink column; NULL, NaN and inf as ``None``."""
    return F.coalesce(to_sink_decimal(c, precision, scale).cast("string"), F.lit("None"))
