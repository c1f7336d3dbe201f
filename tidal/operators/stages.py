"""The way from a wide observation file to split feature rows as ``pyspark.ml`` stages in one saved pipeline.

Each stage is an ordinary DataFrame step; as stages they are fitted, saved, loaded and applied as one.  Year columns
are found in the table at hand, when a stage is applied.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidal.functions.scalar import finite_or_null, standardize_name, to_numeric
from tidal.operators import series
from tidal.operators.order_stats import exact_quantile
from tidal.session import materialize
from tidal.sources.io import write_splits

FEATURES = ("ofr", "ofr_change", "price_index")


class _Stage(Params, DefaultParamsReadable, DefaultParamsWritable):
    """A stage set by keyword and saved with its parameters."""

    def __init__(self, **params):
        super().__init__()
        self._set(**params)

    def value(self, name: str, default=None):
        return self.getOrDefault(name) if self.isDefined(name) else default


class YearsToLong(_Stage, Transformer):
    """Wide rows -> ``(key, period, value)``; names are standardised and rows without one left out.

    Years are the columns named by digits within ``lo``..``hi``, all such columns where none is within, in the order of their
    numbers; a table without any is an error.  A value that is no finite number becomes NULL.
    """

    keyCol = Param(Params._dummy(), "keyCol", "column of the names", TypeConverters.toString)
    lo = Param(Params._dummy(), "lo", "first year", TypeConverters.toInt)
    hi = Param(Params._dummy(), "hi", "last year", TypeConverters.toInt)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key = self.value("keyCol", "Country")
        years = sorted((c for c in dataset.columns if c.isascii() and c.isdigit()), key=int)
        if not years or key not in dataset.columns:
            raise ValueError(f"a wide table needs a column {key} and year columns, not {dataset.columns}")
        lo, hi = self.value("lo", int(years[0])), self.value("hi", int(years[-1]))
        years = [c for c in years if lo <= int(c) <= hi] or years
        name = standardize_name(F.nullif(F.trim(F.col(f"`{key}`")), F.lit("")))
        wide = dataset.select(name.alias("key"), *[to_numeric(F.col(f"`{c}`")).alias(c) for c in years])
        wide = wide.filter(F.col("key").isNotNull())
        long = wide.unpivot("key", [F.col(f"`{c}`") for c in years], "_year", "value")
        return long.select("key", F.col("_year").cast("int").alias("period"), "value")


class SeriesFeatures(_Stage, Transformer):
    """Values summed per key and period, and on each row the key's features at its last period.

    A sum of missing values only stays NULL.  All windows share one exchange by key, after the sums.
    """

    beta = Param(Params._dummy(), "beta", "sensitivity of the price index", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sums = dataset.groupBy("key", "period").agg(F.sum("value").alias("value"))
        chain = series.feature_chain(sums, beta=self.value("beta", 0.5))
        whole = Window.partitionBy("key").orderBy("period").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)
        return chain.select("key", "period", "value", *[F.last(c).over(whole).alias(c) for c in FEATURES])


class MedianFillModel(_Stage, Model):
    """Values that are not finite, or missing, replaced by the stored medians (where there is one)."""

    medians = Param(Params._dummy(), "medians", "median of each column")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: F.coalesce(finite_or_null(F.col(c)), F.lit(m).cast("double"))
                                    for c, m in self.value("medians", {}).items()})


class MedianFill(_Stage, Estimator):
    """Exact medians of per-key columns over the keys, each key counted once."""

    inputCols = Param(Params._dummy(), "inputCols", "columns constant per key", TypeConverters.toListString)

    def _fit(self, dataset: DataFrame) -> MedianFillModel:
        cols = self.value("inputCols", list(FEATURES))
        per_key = dataset.groupBy("key").agg(*[F.first(finite_or_null(F.col(c))).alias(c) for c in cols])
        long = materialize(per_key.unpivot("key", cols, "name", "value").select("name", "value"), "feature_values")
        found = {r["name"]: r["median"] for r in exact_quantile(long, "value", 0.5, ("name",), "median").collect()}
        return MedianFillModel(medians={c: found.get(c) for c in cols})


class PeriodSplit(_Stage, Transformer):
    """Rows tagged ``split`` by inclusive period ranges; rows outside all of them are left out."""

    bounds = Param(Params._dummy(), "bounds", "split name -> [first period, last period]")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        tags = [F.when(F.col("period").between(lo, hi), F.lit(name)) for name, (lo, hi) in self.value("bounds").items()]
        return dataset.withColumn("split", F.coalesce(*tags)).filter(F.col("split").isNotNull())


def feature_pipeline(bounds: dict[str, tuple[int, int]], key: str = "Country", beta: float = 0.5,
                     years: tuple[int, int] | None = None) -> Pipeline:
    """Wide rows -> long rows -> features -> medians -> splits."""
    within = {"lo": years[0], "hi": years[1]} if years else {}
    return Pipeline(stages=[YearsToLong(keyCol=key, **within), SeriesFeatures(beta=beta), MedianFill(inputCols=list(FEATURES)),
                            PeriodSplit(bounds={k: list(v) for k, v in bounds.items()})])


def feature_job(spark: SparkSession, csv: str, out: str, bounds: dict[str, tuple[int, int]], **options) -> DataFrame:
    """One call from a wide CSV to split feature rows; returns them.

    ``out`` (shared storage) gets ``model``, the fitted pipeline, and ``splits``, its rows, a folder per split.  The
    pipeline is read back before it is applied; the file is scanned once to fit the medians and once to apply them.
    """
    raw, out = spark.read.option("header", True).csv(csv), out.rstrip("/")
    feature_pipeline(bounds, **options).fit(raw).write().overwrite().save(f"{out}/model")
    write_splits(PipelineModel.load(f"{out}/model").transform(raw), f"{out}/splits")
    return spark.read.parquet(f"{out}/splits")
