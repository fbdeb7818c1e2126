"""Spark ML models: classifiers, comparison with resampling inside the folds, soft vote, selection, tuning of the
selected family by racing, importances (SURVEY 2.10).

Everything trains with Spark ML estimators on the fitting rows of a ``flow.Flow``; the driver only sees per-model
metrics (a few numbers per model and fold).  Fits that don't depend on each other run from one pool of driver
threads; each is an independent set of Spark jobs.
"""

from __future__ import annotations

import json
import random
from multiprocessing.pool import ThreadPool
from queue import SimpleQueue

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ID_COL, TARGET
from ..session import drop_path, shared_path
from . import evaluate as EV
from .flow import POSITIVE_WEIGHT_COL, Flow, Prepared, few_rows, preparation, sized

# Models taken in this order if they are about as good as a best one that isn't among them.
PREFERRED = ("gbt", "gbt_balanced", "random_forest")
VOTE, VOTE_STANDS_FOR = "soft_vote", "gbt"
POOL = 8  # fits at a time; of few rows as many as there are cores, if that is more
LONGEST_FIRST = ("random_forest", "gbt_balanced", "gbt", "logistic_regression", "decision_tree")  # by CPU time of a fit
# Boosting: a round is a chain of Spark jobs whatever the rows, so a few larger steps; rounds x step stays the same.
ROUNDS, SHRINKAGE = 40, 10.0


def estimators(seed: int = 42, rounds: int = ROUNDS) -> dict:
    """The compared classifiers: two boosting configurations (a fixed weight of the positive class, sampled rows and
    columns; or balanced weights and all of both)."""
    common = {"featuresCol": "features", "labelCol": TARGET}
    return {
        "logistic_regression": LogisticRegression(maxIter=2000, weightCol="weight", **common),
        "decision_tree": DecisionTreeClassifier(maxDepth=8, seed=seed, weightCol="weight", **common),
        # node ids kept beside the rows: a pass doesn't walk every tree from its root again
        "random_forest": RandomForestClassifier(numTrees=200, maxDepth=12, seed=seed, weightCol="weight", cacheNodeIds=True,
                                                maxMemoryInMB=512, **common),
        "gbt": GBTClassifier(maxIter=rounds, maxDepth=5, stepSize=SHRINKAGE / rounds, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                             seed=seed, weightCol=POSITIVE_WEIGHT_COL, **common),
        "gbt_balanced": GBTClassifier(maxIter=rounds, maxDepth=5, stepSize=SHRINKAGE / rounds, seed=seed, weightCol="weight", **common),
    }


def p1(col: str = "probability"):
    return vector_to_array(F.col(col))[1]


def predicted(model, rows: DataFrame) -> DataFrame:
    """(id, y, p) of rows with a known label."""
    return model.transform(rows).select(ID_COL, F.col(TARGET).cast("int").alias("y"), p1().alias("p"))


def metrics_row(name: str, pred: DataFrame, cv_auc=(None, None)) -> dict:
    """Small per-model metric dict (collected: a handful of numbers)."""
    m = EV.metrics_at_threshold(pred).first()
    auc = EV.roc_auc(pred).first()["roc_auc"]
    return {"name": name, "accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"],
            "f1": m["f1"], "roc_auc": auc, "cv_auc_mean": cv_auc[0], "cv_auc_std": cv_auc[1]}


LEADERBOARD_SCHEMA = ("name string, accuracy double, precision double, recall double, f1 double, roc_auc double, "
                      "cv_auc_mean double, cv_auc_std double")


class Fold:
    """One fold: fitting rows prepared (scaled, oversampled, weighed) by themselves, and the held-out rows, both written
    once.  A fit reads them cut for its share of the cores (``share``): at small sizes each further partition only adds
    tasks, and copies of a forest's node statistics, to every pass."""

    def __init__(self, stages: list, fitting: DataFrame, held: DataFrame):
        spark = held.sparkSession
        self.prepared = Flow(stages, None).prepare(fitting)
        rows = self.prepared.transform(held).select(ID_COL, TARGET, "features")
        self.path = shared_path(spark, "held-rows")
        rows.write.parquet(self.path)
        self.held = spark.read.schema(rows.schema).parquet(self.path)
        self.held_rows = self.held.count()
        self.share(POOL)

    def share(self, fits: int) -> None:
        """Cut the rows for fits of which ``fits`` run at a time, ``POOL`` at most; for two cores at least, or the last
        fits of a pool would leave the others idle.  Few rows stay in one piece while the fits keep most cores busy: a
        round's tasks take longer to send and merge than to compute."""
        every = self.held.sparkSession.sparkContext.defaultParallelism
        cores = max(2, -(-every // max(1, min(fits, POOL))))
        if few_rows(self.prepared.rows) and 3 * fits >= 2 * every:
            cores = 1
        self.fitting = sized(self.prepared.frame, self.prepared.rows, cores)
        self.scored = sized(self.held, self.held_rows, cores)

    def auc(self, classifier) -> float:
        """AUC on the held-out rows of ``classifier`` fitted on the others."""
        ev = BinaryClassificationEvaluator(labelCol=TARGET, rawPredictionCol="rawPrediction", metricName="areaUnderROC",
                                           numBins=0)
        return float(ev.evaluate(classifier.copy().fit(self.fitting).transform(self.scored)))

    def drop(self) -> None:
        self.prepared.drop()
        drop_path(self.held.sparkSession, self.path)


def cv_folds(train: DataFrame, folds: int = 5, fold_col: str = "fold", ratio: float | None = 0.8) -> list[Fold]:
    """Every fold of ``train`` (raw attributes, label, fold number), prepared at the same time."""
    one = lambda i: Fold(preparation(ratio), train.filter(F.col(fold_col) != i), train.filter(F.col(fold_col) == i))
    with ThreadPool(min(POOL, folds)) as pool:
        return pool.map(one, range(folds), chunksize=1)


def release(folds: list[Fold]) -> None:
    for f in folds:
        f.drop()


def at_a_time(folds: list[Fold]) -> int:
    """Fits on ``folds`` that run at a time."""
    cores = max((f.held.sparkSession.sparkContext.defaultParallelism for f in folds if few_rows(f.prepared.rows)), default=0)
    return max(POOL, cores)


def _start(name: str) -> int:
    """Place of a model's fits in a pool, so that a long one isn't left alone at the end."""
    return LONGEST_FIRST.index(name) if name in LONGEST_FIRST else len(LONGEST_FIRST)


def cross_validated(ests: dict, folds: list[Fold], finished=None) -> dict[str, list[float]]:
    """AUC of every model on every fold, all fits from one pool; ``finished(name, aucs)`` is called model by model."""
    for f in folds:
        f.share(len(ests) * len(folds))
    with ThreadPool(at_a_time(folds)) as pool:
        running = {n: [pool.apply_async(f.auc, (ests[n],)) for f in folds] for n in sorted(ests, key=_start)}
        out = {}
        for name in ests:
            out[name] = [j.get() for j in running[name]]
            if finished:
                finished(name, out[name])
    return out


def soft_vote(preds: list[DataFrame]) -> DataFrame:
    """Mean probability of several models, joined on the customer id."""
    out = preds[0].select(ID_COL, "y", F.col("p").alias("p0"))
    for i, p in enumerate(preds[1:], start=1):
        out = out.join(p.select(ID_COL, F.col("p").alias(f"p{i}")), ID_COL)
    mean = sum((F.col(f"p{i}") for i in range(len(preds))), F.lit(0.0)) / float(len(preds))
    return out.select(ID_COL, "y", mean.alias("p"))


def leaderboard(lb: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("roc_auc"), F.asc("name"))  # one row per model
    return lb.withColumn("rank", F.row_number().over(w))


def _place(name: Column, names: tuple[str, ...]) -> Column:
    """0-based place among ``names``, their number if absent."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(at > 0, at - 1).otherwise(len(names)).cast("int")


def select_best(lb: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """The model with the best test AUC (ties by name) if it is one of ``PREFERRED``; otherwise the first of
    ``PREFERRED`` within ``tolerance`` of it, or else itself, where the ensemble stands for boosting.  One row per
    model comes in."""
    order = Window.orderBy(F.desc("roc_auc"), F.asc("name"))
    ranked = lb.withColumns({"__best": F.first("name").over(order), "__top": F.max("roc_auc").over(Window.partitionBy())})
    kept = _place(F.col("__best"), PREFERRED) < len(PREFERRED)
    near = ~kept & (F.col("roc_auc") >= F.col("__top") - tolerance)
    choice = Window.orderBy(F.when(near, _place(F.col("name"), PREFERRED)).otherwise(len(PREFERRED)),
                            F.desc("roc_auc"), F.asc("name"))
    first = ranked.withColumn("__r", F.row_number().over(choice)).filter(F.col("__r") == 1)
    name = F.when(F.col("name") == VOTE, VOTE_STANDS_FOR).otherwise(F.col("name"))
    return first.select(name.alias("name"), F.col("roc_auc").alias("score"), "roc_auc", "cv_auc_mean")


# ---- tuning -------------------------------------------------------------------------------------------------------
def grid(family: str) -> dict[str, list]:
    """Values tried for the parameters of a family (names of the Spark estimator's)."""
    boosting = {"maxIter": [ROUNDS, 3 * ROUNDS // 2, 2 * ROUNDS], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.125, 0.25],
                "subsamplingRate": [0.7, 0.8, 1.0], "featureSubsetStrategy": ["0.7", "0.8", "all"],
                "minInstancesPerNode": [1, 3, 5], "minInfoGain": [0.0, 0.001, 0.003]}
    return {
        "gbt": boosting,
        "gbt_balanced": {**boosting, "minInstancesPerNode": [10, 20, 30]},
        "random_forest": {"numTrees": [200, 300], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 4],
                          "minInfoGain": [0.0, 0.001]},
        "decision_tree": {"maxDepth": [4, 6, 8, 10], "minInstancesPerNode": [1, 2, 4, 8], "impurity": ["gini", "entropy"]},
        "logistic_regression": {"regParam": [0.0, 0.001, 0.01, 0.03, 0.1, 0.3, 1.0],
                                "elasticNetParam": [0.0, 0.25, 0.5, 0.75, 1.0], "standardization": [True, False]},
    }[family]


def draws(family: str, n: int = 20, seed: int = 42) -> list[dict]:
    """``n`` different seeded points of the family's grid (all, if it has fewer)."""
    values = grid(family)
    size = int(np.prod([len(v) for v in values.values()]))
    out = []
    for at in random.Random(seed).sample(range(size), min(n, size)):
        point = {}
        for name, v in values.items():
            at, i = divmod(at, len(v))
            point[name] = v[i]
        out.append(point)
    return out


def race(candidates: list, folds: list, score, finalists: int = 2, work=None, start=None, workers: int = POOL) -> list[list[float]]:
    """Scores of every candidate, fold by fold: after each fold the better half by mean score goes on, at least
    ``finalists``.  ``score(candidate, fold)`` runs from a pool of ``workers``, candidates of the most ``work(candidate)``
    first; ``start(fold, n)`` is called before the first of the ``n`` candidates left is scored on a fold.

    A candidate goes on as soon as those that may still come before it are too few to drop it, so nobody waits for the
    last score of a fold, and none is scored in vain."""
    seen: list[list[float]] = [[] for _ in candidates]
    left = [len(candidates)]  # candidates by fold
    for _ in folds:
        left.append(min(left[-1], max(finalists, -(-left[-1] // 2))))
    means: list[dict[int, float]] = [{} for _ in folds]  # by fold and candidate, of those scored
    sent: list[set[int]] = [set() for _ in folds]
    done: SimpleQueue = SimpleQueue()
    with ThreadPool(workers) as pool:
        def send(at: int, who: list[int]) -> None:
            if who and start and not sent[at]:
                start(folds[at], left[at])
            sent[at].update(who)
            for i in sorted(who, key=lambda i: -work(candidates[i])) if work else who:
                pool.apply_async(score, (candidates[i], folds[at]), callback=lambda x, i=i: done.put((at, i, x)),
                                 error_callback=done.put)

        send(0, list(range(len(candidates)) if folds else []))
        for _ in range(sum(left[:-1])):
            got = done.get()
            if isinstance(got, BaseException):
                raise got
            at, i, x = got
            seen[i].append(x)
            means[at][i] = np.mean(seen[i])
            if at + 1 < len(folds):
                ranked = sorted(means[at], key=lambda i: (-means[at][i], i))
                sure = left[at + 1] - (left[at] - len(ranked))  # all that are missing may come before
                send(at + 1, [i for i in ranked[:max(0, sure)] if i not in sent[at + 1]])
    return seen


def work(point: dict) -> int:
    """Passes over the rows that trees of these parameters take, in proportion; 1 if it says nothing about them."""
    return point.get("maxIter", 1) * point.get("numTrees", 1) * point.get("maxDepth", 1)


def tune(family: str, folds: list[Fold], n: int = 20, seed: int = 42) -> tuple[list[tuple], dict]:
    """Rows (draw, family, params, folds, cv_auc, winner) of a raced search, and the winning parameters."""
    tried = draws(family, n, seed)
    seen = race(tried, folds, lambda point, fold: fold.auc(configured(family, point)), work=work, start=Fold.share,
                workers=at_a_time(folds))
    full = [i for i, x in enumerate(seen) if len(x) == len(folds)]
    best = max(full, key=lambda i: (np.mean(seen[i]), -i))
    rows = [(i, family, json.dumps(point, sort_keys=True), len(x), float(np.mean(x)), i == best)
            for i, (point, x) in enumerate(zip(tried, seen))]
    return rows, tried[best]


def configured(family: str, point: dict):
    """The family's classifier with the parameters of ``point``."""
    est = estimators()[family].copy()
    return est.setParams(**point) if point else est


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray()
    else:
        vals = [abs(v) for v in model.coefficients.toArray()]
    return [(n, float(v)) for n, v in zip(names, vals)]


def classifier_of(model: PipelineModel):
    """The classifier at the end of a fitted flow."""
    return model.stages[-1]


def features_of(model: PipelineModel):
    """The fitted feature stage of a flow."""
    return next(s for s in model.stages if hasattr(s, "names"))


def prepare(train: DataFrame, ratio: float | None = 0.8) -> Prepared:
    """Fitting rows of the whole training side."""
    return Flow(preparation(ratio), None).prepare(train)
