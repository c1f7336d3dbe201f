"""Risk band dimension, range lookup, explanations and classification metrics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The band dimension (name, min, max, context meaning, sort order)
# and the fixed explanation sentence of each band.
BAND_ROWS = (
    ("low", Decimal("0.00"), Decimal("0.45"), "Low risk: risk score 0.00 to 0.45 for next 5y or 10y.", 1),
    ("medium", Decimal("0.45"), Decimal("0.55"), "Medium risk: risk score 0.45 to 0.55 for next 5y or 10y.", 2),
    ("high", Decimal("0.55"), Decimal("1.00"), "High risk: risk score 0.55 to 1.0 for next 5y or 10y.", 3),
)
EXPLANATIONS = {
    "low": ("The overfishing risk is currently Low. This means that overfishing has no "
            "significance on the inflation price of fish in this region."),
    "medium": ("The overfishing risk is currently Medium. This indicates a moderately "
               "significant effect of overfishing on fish price inflation."),
    "high": ("The overfishing risk is currently High. This signifies a definitely "
             "significant impact of overfishing on the inflation price of fish, "
             "requiring urgent policy intervention."),
}
# Number of retrieved items per band (low: none, medium: 3, high: 15).
TOP_K = {"low": 0, "medium": 3, "high": 15}

BAND_SCHEMA = T.StructType([
    T.StructField("band_name", T.StringType(), False),
    T.StructField("min_score", T.DecimalType(4, 2), False),
    T.StructField("max_score", T.DecimalType(4, 2), False),
    T.StructField("context_meaning", T.StringType(), False),
    T.StructField("sort_order", T.IntegerType(), False),
    T.StructField("explanation", T.StringType(), False),
    T.StructField("top_k", T.IntegerType(), False),
])


def band_dimension(spark: SparkSession) -> DataFrame:
    """The 3-row band table (a fixed dimension: safe to broadcast)."""
    rows = [r + (EXPLANATIONS[r[0]], TOP_K[r[0]]) for r in BAND_ROWS]
    return spark.createDataFrame(rows, BAND_SCHEMA)


def band_for_score(df: DataFrame, score: str, bands: DataFrame, prefix: str = "") -> DataFrame:
    """Range join score -> band: min <= score < max, the top band closed at max.

    The dimension has three rows, so the non-equi join is a broadcast
    nested-loop join whose cost is three comparisons per row.
    """
    top = bands.agg(F.max("sort_order")).scalar()
    b = bands.select(*[F.col(c).alias(prefix + c) for c in bands.columns],
                     (F.col("sort_order") == top).alias("_is_top"))
    s = F.col(score)
    cond = (s >= F.col(prefix + "min_score")) & (
        (s < F.col(prefix + "max_score")) | (F.col("_is_top") & (s <= F.col(prefix + "max_score"))))
    return df.join(F.broadcast(b), cond, "left").drop("_is_top")


def explain_band(df: DataFrame, band: str, bands: DataFrame, unknown: str = "error") -> DataFrame:
    """Attach the fixed explanation of each band, whatever its case.

    A band that the table does not have, NULL included, is an error once its row is read; with
    ``unknown="drop"`` such rows are left out.
    """
    if unknown not in ("error", "drop"):
        raise ValueError("unknown must be 'error' or 'drop'")
    b = bands.select(F.col("band_name").alias("_band"), F.col("explanation"))
    out = df.join(F.broadcast(b), F.lower(df[band]) == F.col("_band"), "inner" if unknown == "drop" else "left")
    bad = F.raise_error(F.lit("band must be low, medium or high"))
    return out.withColumn("explanation", F.when(F.col("_band").isNull(), bad).otherwise(F.col("explanation"))).drop("_band")


LABELS = ("low", "medium", "high")


def confusion_matrix(df: DataFrame, y: str, pred: str, labels=LABELS) -> DataFrame:
    """Counts for every (actual, predicted) label pair, zeros included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    counts = df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")))


def classification_report(df: DataFrame, y: str, pred: str, labels=LABELS) -> DataFrame:
    """Per label precision / recall / F1 / support, then accuracy, macro and weighted averages.

    Divisions by zero give 0.  One aggregation produces a single row of
    counts; every report line is column arithmetic on that row, exploded
    into rows at the end (the input is read once).
    """
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum((F.col(y) == F.col(pred)).cast("long")).alias("_k")]
    for lab in labels:
        aggs += [F.sum(((F.col(y) == lab) & (F.col(pred) == lab)).cast("long")).alias(f"tp_{lab}"),
                 F.sum((F.col(pred) == lab).cast("long")).alias(f"pp_{lab}"),
                 F.sum((F.col(y) == lab).cast("long")).alias(f"sup_{lab}")]

    def z(num, den):
        return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))

    c = df.agg(*aggs)
    cols = []
    for lab in labels:
        p = z(F.col(f"tp_{lab}"), F.col(f"pp_{lab}"))
        r = z(F.col(f"tp_{lab}"), F.col(f"sup_{lab}"))
        cols += [p.alias(f"p_{lab}"), r.alias(f"r_{lab}")]
    c = c.select("*", *cols)
    c = c.select("*", *[z(2 * F.col(f"p_{lab}") * F.col(f"r_{lab}"), F.col(f"p_{lab}") + F.col(f"r_{lab}"))
                        .alias(f"f_{lab}") for lab in labels])
    n_lab = float(len(labels))
    sup_total = sum((F.col(f"sup_{lab}") for lab in labels), F.lit(0))

    def mean(m):
        return sum((F.col(f"{m}_{lab}") for lab in labels), F.lit(0.0)) / n_lab

    def weighted(m):
        return z(sum((F.col(f"{m}_{lab}") * F.col(f"sup_{lab}") for lab in labels), F.lit(0.0)), sup_total)

    def row(label, p, r, f, support):
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), support.cast("long").alias("support"))

    none = F.lit(None).cast("double")
    rows = [row(lab, F.col(f"p_{lab}"), F.col(f"r_{lab}"), F.col(f"f_{lab}"), F.col(f"sup_{lab}"))
            for lab in labels]
    rows += [row("accuracy", none, none, z(F.col("_k"), F.col("_n")), F.col("_n")),
             row("macro avg", mean("p"), mean("r"), mean("f"), F.col("_n")),
             row("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("_n"))]
    return c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42,
                     fractions=(0.6, 0.2, 0.2)) -> DataFrame:
    """Exact, deterministic stratified train / val / test split.

    Within each label, rows are ordered by ``md5(key:seed)`` and cut at the
    cumulative fractions (integer arithmetic on per-label counts).  Positions
    come from ``global_index`` bucketed on the first three hex digits of the
    hash, so even a label that holds a third of all rows is ranked in 4096
    independent pieces rather than in one task.
    """
    from tidal.operators.text import global_index
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    d = df.withColumn("_h", h)
    d = global_index(d, ["_h", key], F.substring("_h", 1, 3), out="_pos", partition_by=(label,))
    rn = F.col("_pos") + 1
    n = F.col("_pos_total")
    a = int(round(fractions[0] * 100))
    b = int(round((fractions[0] + fractions[1]) * 100))
    split = F.when(rn * 100 <= n * a, "train").when(rn * 100 <= n * b, "val").otherwise("test")
    return d.withColumn("split", split).drop("_h", "_pos", "_pos_total")


def to_sink_decimal(c, precision: int, scale: int):
    """Numeric sink type: NaN/inf -> NULL, rounded half away from zero at ``scale``.

    Goes through DECIMAL(38, 12) first so the rounding acts on the decimal
    value rather than on the binary double.
    """
    from tidal.functions.scalar import finite_or_null
    return finite_or_null(c).cast("decimal(38,12)").cast(T.DecimalType(precision, scale))
