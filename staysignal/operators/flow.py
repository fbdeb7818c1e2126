"""Training as one flow: raw customers in, a saved ``PipelineModel`` out.

* ``CleanInput`` and ``FeaturesModel`` are persistable stages of expressions only, so a saved flow scores raw
  customers by itself: levels, means and deviations are its parameters, no file lies beside it.
* A ``FitOnly`` stage changes the rows a flow is *fitted* on and is no part of the fitted model: incomplete rows are
  dropped, the minority class is oversampled, weights are added.  Rows that are scored or validated never pass it.
* ``Flow.prepare`` fits everything but the classifier and writes the fitting rows once; any number of classifiers can
  be fitted on them (comparison, folds, draws of a search).
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import BINARY_COLS, CATEGORICAL_FEATURES, ID_COL, NUMERIC_FEATURES, TARGET
from ..session import drop_path, shared_path, written
from .clean import category_levels, preprocess_score_input
from .neighbors_lsh import knn_lsh
from .oversample import smote

POSITIVE_WEIGHT_COL, POSITIVE_WEIGHT = "positive_weight", 3.0  # of boosting
# Of fitting rows: iterative learners start a task per partition in every round, and each task of a forest keeps and
# sends statistics of all nodes.  So partitions of the first size up to one per core, then growing up to the second.
ROWS_PER_PARTITION, MOST_ROWS_PER_PARTITION = 20_000, 250_000


class CleanInput(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Raw attributes cleaned as in batch scoring: a total that doesn't parse is the monthly charge times the tenure.
    No row is dropped.  Flags that are numbers already are taken as clean."""

    def _transform(self, df: DataFrame) -> DataFrame:
        df = preprocess_score_input(df, [c for c in BINARY_COLS if isinstance(df.schema[c].dataType, StringType)])
        return df.withColumn("TotalCharges", F.coalesce("TotalCharges", F.col("MonthlyCharges") * F.col("tenure")))


class Features(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns levels, means and population deviations; see ``FeaturesModel``."""

    def _fit(self, df: DataFrame) -> "FeaturesModel":
        levels = category_levels(df, CATEGORICAL_FEATURES)
        row = df.agg(*[f(c).alias(f"{i}{c}") for i, f in enumerate((F.avg, F.stddev_pop)) for c in NUMERIC_FEATURES]).first()
        scales = {c: [float(row[f"0{c}"] or 0.0), float(row[f"1{c}"] or 0.0) or 1.0] for c in NUMERIC_FEATURES}
        return FeaturesModel(levels={c: [v for v in levels[c][1:]] for c in levels}, scales=scales)


class FeaturesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """``features``: z-scores of the numeric columns, then an indicator for every level but the first (unknown levels
    are all zeros).  A null number is NaN."""

    learned = Param(Params._dummy(), "learned", "levels and scales as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, levels: dict | None = None, scales: dict | None = None):
        super().__init__()
        if levels is not None:
            self._set(learned=json.dumps({"levels": levels, "scales": scales}))

    def _learned(self) -> dict:
        return json.loads(self.getOrDefault(self.learned))

    def names(self) -> list[str]:
        own = self._learned()
        return [*own["scales"], *(f"{c}_{v}" for c, vs in own["levels"].items() for v in vs)]

    def source(self) -> list[str]:
        """The column behind each feature."""
        own = self._learned()
        return [*own["scales"], *(c for c, vs in own["levels"].items() for _ in vs)]

    def _transform(self, df: DataFrame) -> DataFrame:
        own = self._learned()
        nan = F.lit(float("nan"))
        cols = [F.coalesce((F.col(c).cast("double") - F.lit(m)) / F.lit(s), nan) for c, (m, s) in own["scales"].items()]
        cols += [F.when(F.col(c) == v, 1.0).otherwise(0.0) for c, vs in own["levels"].items() for v in vs]
        names = self.names()
        meta = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]},
                            "num_attrs": len(names)}}
        return df.withColumn("features", array_to_vector(F.array(*cols)).alias("features", metadata=meta))


class FitOnly(Transformer):
    """A step on the rows a flow is fitted on; it is left out of the fitted model."""


class DropIncomplete(FitOnly):
    """Rows with a null attribute or label are not learned from."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.dropna(how="any", subset=[*NUMERIC_FEATURES, *CATEGORICAL_FEATURES, TARGET])


class Oversample(FitOnly):
    """Synthetic minority rows up to ``ratio`` of the majority, between near neighbours."""

    def __init__(self, ratio: float = 0.8, k: int = 5, seed: int = 42):
        super().__init__()
        self.ratio, self.k, self.seed = ratio, k, seed

    def _transform(self, df: DataFrame) -> DataFrame:
        meta = df.schema["features"].metadata
        # written: the search, the picks and the synthetic rows each read the features instead of computing them
        rows = written(df.select(ID_COL, F.col(TARGET).cast("int").alias(TARGET), vector_to_array("features").alias("x")), "rows")
        near = lambda m, key, vec, k, seed: knn_lsh(m, key, vec, k=k, seed=seed)[0]
        out = smote(rows, ID_COL, "x", TARGET, ratio=self.ratio, k=self.k, seed=self.seed, neighbours=near)
        return written(out.select(ID_COL, TARGET, "synthetic", array_to_vector("x").alias("features", metadata=meta)), "resampled")


class Weigh(FitOnly):
    """Balanced class weights of the rows it sees, and boosting's fixed weight of the positive class."""

    def _transform(self, df: DataFrame) -> DataFrame:
        counts = {r[TARGET]: r["n"] for r in df.groupBy(TARGET).agg(F.count("*").alias("n")).collect()}  # two classes
        total = sum(counts.values())
        weight = reduce(lambda when, y: when.when(F.col(TARGET) == y, total / (len(counts) * counts[y])), sorted(counts),
                        F.when(F.lit(False), 1.0))
        return df.withColumn("weight", weight).withColumn(
            POSITIVE_WEIGHT_COL, F.when(F.col(TARGET) == 1, POSITIVE_WEIGHT).otherwise(1.0))


def preparation(ratio: float | None = 0.8, seed: int = 42) -> list:
    """The stages before the classifier; ``ratio=None`` leaves out the oversampling."""
    return [CleanInput(), DropIncomplete(), Features(), *([Oversample(ratio, seed=seed)] if ratio else []), Weigh()]


def partitions(rows: int, cores: int) -> int:
    """Partitions of a table of fitting rows that ``cores`` cores work on."""
    return max(1, min(math.ceil(rows / ROWS_PER_PARTITION), cores), math.ceil(rows / MOST_ROWS_PER_PARTITION))


def few_rows(rows: int) -> bool:
    """Whether a fit takes so little of every round that cutting its rows costs more than it saves."""
    return rows <= 5 * ROWS_PER_PARTITION


def sized(df: DataFrame, rows: int, cores: int | None = None) -> DataFrame:
    """``df`` in no more than ``partitions``; ``cores`` is the session's unless given."""
    return df.coalesce(partitions(rows, cores or df.sparkSession.sparkContext.defaultParallelism))


class Prepared:
    """Fitted preparation stages and the rows (id, label, features, weights) a classifier is fitted on, a written table."""

    def __init__(self, stages: list, frame: DataFrame, cores: int | None = None):
        self.stages, spark = stages, frame.sparkSession
        cores = cores or spark.sparkContext.defaultParallelism
        self.path = shared_path(spark, "fit-rows")
        frame.write.parquet(self.path)
        read = spark.read.schema(frame.schema).parquet(self.path)  # the schema keeps the features' names
        self.rows = read.count()
        want = partitions(self.rows, cores)
        if read.rdd.getNumPartitions() < want:  # a few large files would leave cores idle in every round
            first, self.path = self.path, shared_path(spark, "fit-rows")
            read.repartition(want).write.parquet(self.path)
            read = spark.read.schema(frame.schema).parquet(self.path)
            drop_path(spark, first)
            if read.rdd.getNumPartitions() < want:  # reading packs files into about as many partitions as there are cores
                read = read.repartition(want)
        self.frame = sized(read, self.rows, cores)

    def fit(self, classifier) -> PipelineModel:
        return PipelineModel([*self.stages, classifier.fit(self.frame)])

    def drop(self) -> None:
        """Delete the written rows."""
        drop_path(self.frame.sparkSession, self.path)

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows as a classifier sees them when it scores."""
        return PipelineModel(self.stages).transform(df)


class Flow(Estimator):
    """Preparation stages and a classifier, fitted in order; ``FitOnly`` stages only change the fitting rows."""

    def __init__(self, stages: list, classifier):
        super().__init__()
        self.stages, self.classifier = stages, classifier

    def prepare(self, df: DataFrame, cores: int | None = None) -> Prepared:
        """``cores``: those a fit may count on, all of the session's unless given."""
        kept = []
        for stage in self.stages:
            if isinstance(stage, Estimator):
                stage = stage.fit(df)
            df = stage.transform(df)
            if not isinstance(stage, FitOnly):
                kept.append(stage)
        named = [c for c in (ID_COL, TARGET, "synthetic", "features", "weight", POSITIVE_WEIGHT_COL) if c in df.columns]
        return Prepared(kept, df.select(*named), cores)

    def _fit(self, df: DataFrame) -> PipelineModel:
        return self.prepare(df).fit(self.classifier)


def save(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"no saved model at {path}") from e


def probability(col: str = "probability"):
    return vector_to_array(F.col(col))[1]


def scorer(model: PipelineModel):
    """A fitted flow as ``DataFrame -> DataFrame`` adding ``p``, for every operator that takes a scorer."""
    def run(df: DataFrame) -> DataFrame:
        return model.transform(df).select(*df.columns, probability().alias("p"))
    return run
