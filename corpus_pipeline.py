"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet to the shared folder and read again as the next one's ``docs``.  All but
the last return the columns of ``documents`` as they came in.  The rows of an
empty table pass through all stages; a null text counts as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidal.llm import mixing, packing, simhash, suffix_dedup, toxicity
from tidal.llm.common import documents
from tidal.session import materialize


#: Bytes of a repeated passage: 50 words of 5 bytes each, with their spaces.  Words of most texts are longer (6 to 7
#: bytes in the four languages of the given tables), so a passage of over 50 words holds a match of this length.
PASSAGE = 50 * 5


def _keyed(docs: DataFrame, *cols: str) -> DataFrame:
    """``docs`` with ``_row``, a hash of all that a stage's verdict on a row depends on; ids may be null or repeated."""
    return docs.withColumn("_row", F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))]))


def _own(found: DataFrame, docs: DataFrame):
    """Whether a verdict is that of a row, by hash and id; the hash spreads the rows, so texts are not sorted."""
    return (docs["_row"] == found["_key"]) & docs["doc_id"].eqNullSafe(found["_id"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity operator rejects go; those it cannot judge stay."""
    docs = _keyed(docs, "doc_id", "text")
    found = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), key="_row")
    bad = found.filter("predicted = 1").select(F.col("_row").alias("_key"), F.col("doc_id").alias("_id")).distinct()
    return docs.join(bad.hint("shuffle_hash"), _own(bad, docs), "left_anti").drop("_row")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: one of its smallest id, null only where the group has no other."""
    docs = _keyed(docs, "doc_id", "text")
    found = simhash.near_duplicates(docs, key="_row").filter("doc_id <=> component_id")
    # a group may have several rows of its smallest id: of different texts the least hash, of equal ones any
    keep = materialize(found.groupBy("root", F.col("doc_id").alias("_id"), F.col("_row").alias("_key"))
                       .agg(F.count("*").alias("_rows")).groupBy("root", "_id")
                       .agg(F.min(F.struct("_key", "_rows")).alias("_least")).select("_id", "_least.*"), "pipeline-kept")
    out = docs.join(keep.select("_key", "_id").hint("shuffle_hash"), _own(keep, docs), "left_semi")
    return (out if keep.filter("_rows > 1").isEmpty() else out.dropDuplicates(["doc_id", "_row"])).drop("_row")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their passages of ``PASSAGE`` bytes that repeat; halves of characters at the cuts go too; n_chars follows."""
    carry = tuple(docs.columns)
    out = suffix_dedup.remove_repeats(docs, match=PASSAGE, carry=tuple(c for c in carry if c != "text"))
    cols = [F.col("kept_text").alias(c) if c == "text" else F.col(f"carried.{c}").alias(c) for c in carry]
    out = out.select(*cols)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in carry else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (none to three times)."""
    cols = [F.col(c) for c in docs.columns]
    docs = _keyed(docs, *docs.columns)
    found = (mixing.mix(docs, key="_row").groupBy(F.col("_row").alias("_key"), F.col("doc_id").alias("_id"))
             .agg(F.sum("repeats").alias("_times"), F.count("*").alias("_rows")))
    found = materialize(found.filter("_times > 0"), "pipeline-mixed")
    # rows equal in all columns may be taken differently often: one of them stands for all, with their sum
    if not found.filter("_rows > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "_row"])
    return (docs.join(found.hint("shuffle_hash"), _own(found, docs))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*cols))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Trained models, hashes and removed byte runs are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
