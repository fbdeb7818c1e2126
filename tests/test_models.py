"""Fitted-model properties on the smallest fixture (rows-only plans)."""

import itertools

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from staysignal.operators import evaluate as EV
from staysignal.operators import flow as FL
from staysignal.operators import models as M
from staysignal.operators.clean import clean, learnable

from .conftest import SF


def test_logistic_predictions_are_probabilities_and_repeatable(spark):
    from staysignal.plans.q_ml import train_test
    train, test = train_test(spark, SF)
    ready = M.prepare(train)
    est = M.estimators()["logistic_regression"]
    a, b = (sorted(map(tuple, M.predicted(ready.fit(est), test).collect())) for _ in range(2))
    assert a == b and len(a) == test.count()
    assert all(0.0 <= r[2] <= 1.0 for r in a)


def test_scorecard_auc_above_chance(spark):
    from staysignal.plans.q_value import eval_table
    auc = EV.roc_auc(eval_table(spark, SF)).first().roc_auc
    assert auc > 0.6


def reference_choice(scores: dict[str, float]) -> str:
    """The selection rule, step by step."""
    best = max(sorted(scores), key=scores.get)
    top = scores[best]
    if best not in M.PREFERRED:
        for name in M.PREFERRED:
            if scores.get(name, 0) >= top - 0.005:
                best = name
                break
    return "gbt" if best == M.VOTE else best


def test_selection_on_all_orderings(spark):
    names = ["logistic_regression", "random_forest", "gbt", "gbt_balanced", "soft_vote"]
    cases = [dict(zip(names, aucs)) for aucs in itertools.permutations([0.850, 0.846, 0.843, 0.840, 0.800])]
    cases += [{"random_forest": 0.850, "gbt": 0.846, "logistic_regression": 0.840},
              {"logistic_regression": 0.850, "random_forest": 0.830, "gbt": 0.820},
              {"soft_vote": 0.9, "logistic_regression": 0.85, "gbt": 0.83}]
    assert reference_choice(cases[-3]) == "random_forest"
    rows = [(i, n, a) for i, c in enumerate(cases) for n, a in c.items()]
    lb = spark.createDataFrame(rows, "case int, name string, roc_auc double").withColumn("cv_auc_mean", F.lit(None).cast("double"))
    lb = lb.checkpoint()
    for i in (0, 7, 33, 61, 95, 119, 120, 121, 122):
        got = M.select_best(lb.filter(F.col("case") == i).drop("case")).first()
        assert got.name == reference_choice(cases[i]) and got.roc_auc in cases[i].values()


def test_auc_of_raw_scores_equals_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    import numpy as np
    rng = np.random.default_rng(1)
    p = rng.random(3000)
    y = (rng.random(3000) < p).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    want = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0).evaluate(df)
    assert abs(EV.roc_auc(df).first().roc_auc - want) < 1e-6


def test_kmeans_labels_and_silhouette(spark):
    q = E.queries()
    km = q["kmeans"](spark, SF)
    labels = {r.Cluster for r in km.select("Cluster").distinct().collect()}
    assert labels <= {f"Cluster {i}" for i in range(1, 5)} and len(labels) >= 2
    sw = q["silhouette_sweep"](spark, SF).collect()
    assert [r.k for r in sw] == [2, 3, 4, 5, 6, 7] and sum(r.is_best for r in sw) == 1


def test_memo_is_reentrant_and_builds_once(spark):
    from staysignal.plans import q_ml
    calls = []

    def inner():
        calls.append("inner")
        return spark.createDataFrame([(1,)], "x int")

    def outer():
        calls.append("outer")
        v = q_ml._memo_table(spark, "/memo-test", "inner", inner).first().x
        return spark.createDataFrame([(v + 1,)], "x int")

    assert q_ml._memo_table(spark, "/memo-test", "outer", outer).first().x == 2
    assert q_ml._memo_table(spark, "/memo-test", "outer", outer).first().x == 2
    assert calls == ["outer", "inner"]


# ---- the flow -----------------------------------------------------------------------------------------------------
def test_learnable_rows_are_those_cleaning_keeps(spark):
    from staysignal.plans.context import raw
    rows = raw(spark, SF)
    own = learnable(rows)
    assert own.drop("Churn").columns == rows.drop("Churn").columns
    want = clean(rows, keep_id=True).select("customerID", "Churn")
    assert sorted(map(tuple, own.select("customerID", "Churn").collect())) == sorted(map(tuple, want.collect()))


def test_folds_resample_their_fitting_side_alone(spark):
    from staysignal.plans.q_ml import train_test
    train, _ = train_test(spark, SF)
    folds = M.cv_folds(train, 3)
    held = set()
    for i, f in enumerate(folds):
        n = {(r[0], r[1]): r[2] for r in f.prepared.frame.groupBy("synthetic", "Churn").count().collect()}
        fitting = train.filter(F.col("fold") != i)
        own = {r[0]: r[1] for r in fitting.groupBy("Churn").count().collect()}
        assert n[(False, 0)] == own[0] and n[(False, 1)] == own[1]
        assert n[(False, 1)] + n[(True, 1)] == int(0.8 * own[0]) and (True, 0) not in n
        ids = {r[0] for r in f.held.select("customerID").collect()}
        assert ids == {r[0] for r in train.filter(F.col("fold") == i).select("customerID").collect()}
        assert not held & ids
        held |= ids
        x = FL.vector_to_array(F.col("features"))[3]  # tenure
        real = f.prepared.frame.filter("not synthetic")
        m, s = real.agg(F.avg(x), F.stddev_pop(x)).first()
        assert abs(m) < 1e-9 and abs(s - 1) < 1e-9  # its own mean and population deviation
        assert abs(real.join(f.held, "customerID").count()) == 0
        w = {r[0]: r[1] for r in f.prepared.frame.groupBy("Churn").agg(F.sum("weight")).collect()}
        assert abs(w[0] - w[1]) < 1e-6
    assert held == {r[0] for r in train.filter("fold < 3").select("customerID").collect()}
    seen = []
    aucs = M.cross_validated({"decision_tree": M.estimators()["decision_tree"]}, folds, lambda n, a: seen.append(n))
    assert seen == ["decision_tree"] and all(0.3 < a <= 1.0 for a in aucs["decision_tree"])
    M.release(folds)


def test_saved_flow_scores_raw_customers_alike(spark, tmp_path):
    from staysignal.plans.context import raw
    from staysignal.plans.q_ml import train_test
    train, _ = train_test(spark, SF)
    flow = FL.Flow(FL.preparation(), M.estimators()["decision_tree"]).fit(train)
    assert not any(isinstance(s, FL.FitOnly) for s in flow.stages)
    again = FL.load(FL.save(flow, str(tmp_path / "flow")))
    rows = raw(spark, SF).drop("Churn")  # unlabelled
    assert rows.filter("trim(TotalCharges) = ''").count() > 0  # scored by monthly charge times tenure
    a, b = (sorted(map(tuple, FL.scorer(m)(rows).select("customerID", "p").collect())) for m in (flow, again))
    assert a == b and len(a) == rows.count() and all(0 <= p <= 1 for _, p in a)
    assert M.features_of(again).names() == M.features_of(flow).names()
    odd = rows.limit(1).withColumns({"Contract": F.lit("Ten year"), "TotalCharges": F.lit("n/a"),
                                     "MonthlyCharges": F.lit(None).cast("double")})
    x = FL.vector_to_array(F.col("features"))
    got = dict(zip(M.features_of(again).names(), again.transform(odd).select(x).first()[0]))
    assert got["Contract_One year"] == got["Contract_Two year"] == 0.0 and got["TotalCharges"] != got["TotalCharges"]
    with pytest.raises(FileNotFoundError):
        FL.load(str(tmp_path / "nothing"))


def test_race_drops_losing_draws():
    truth = [0.1 * i for i in range(10)]
    seen = M.race(list(range(10)), [0.0, 0.01, -0.01, 0.02], lambda c, f: truth[c] + f)
    assert [len(s) for s in seen] == [1, 1, 1, 1, 1, 2, 2, 3, 4, 4]
    assert seen[9] == [0.9, 0.91, 0.89, 0.92]


@pytest.mark.parametrize("family", ["gbt", "gbt_balanced", "random_forest", "decision_tree", "logistic_regression"])
def test_draws_are_seeded_points_of_the_grid(spark, family):
    points = M.draws(family, 20)
    assert points == M.draws(family, 20) and len({str(p) for p in points}) == len(points) == 20
    for p in points:
        est = M.configured(family, p)
        assert all(est.getOrDefault(k) == v and v in M.grid(family)[k] for k, v in p.items())


def test_tuning_returns_the_winner_of_all_folds(spark):
    from staysignal.plans.q_ml import train_test
    folds = M.cv_folds(train_test(spark, SF)[0], 3, ratio=None)
    rows, point = M.tune("decision_tree", folds, n=5)
    won = [r for r in rows if r[-1]]
    assert len(won) == 1 and won[0][3] == 3 and won[0][2] == __import__("json").dumps(point, sort_keys=True)
    assert won[0][4] == max(r[4] for r in rows if r[3] == 3)


def test_fitting_rows_have_a_bounded_number_of_partitions():
    assert FL.partitions(0, 12) == 1 and FL.partitions(15_000, 12) == 1 and FL.partitions(90_000, 12) == 5
    assert FL.partitions(900_000, 12) == 12  # one per core, not one per 20,000 rows
    assert FL.partitions(900_000, 4) == 4 and FL.partitions(6_000_000, 12) == 24


def test_few_files_of_fitting_rows_are_spread(spark):
    rows = spark.range(50_000).coalesce(1).select(F.col("id").cast("string").alias("customerID"), F.lit(1.0).alias("weight"))
    ready = FL.Prepared([], rows)
    assert ready.rows == 50_000 and ready.frame.rdd.getNumPartitions() == 3
    ready.drop()


def test_fitting_rows_keep_their_bound_beyond_one_partition_per_core(spark, monkeypatch):
    monkeypatch.setattr(FL, "MOST_ROWS_PER_PARTITION", 500)
    rows = spark.range(12_000).select(F.col("id").cast("string").alias("customerID"), F.lit(1.0).alias("weight"))
    ready = FL.Prepared([], rows)
    sizes = [r["count"] for r in ready.frame.groupBy(F.spark_partition_id()).count().collect()]
    assert ready.frame.rdd.getNumPartitions() == 24 and max(sizes) <= 550 and sum(sizes) == 12_000
    assert ready.frame.select("customerID").distinct().count() == 12_000
    ready.drop()


def test_forest_keeps_node_ids_beside_its_rows(spark):
    assert M.estimators()["random_forest"].getCacheNodeIds()


def test_restarts_run_together_and_the_cheapest_wins(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from staysignal.operators import cluster as CL
    rows = [(float(i % 3) * 10 + i % 7 / 10, float(i % 2)) for i in range(120)]
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double"))
    fits = CL.fits_of(data, [(3, s) for s in range(4)])
    assert [m.getSeed() if hasattr(m, "getSeed") else i for i, m in enumerate(fits)] == list(range(4))
    best = CL.best_kmeans(data, 3, 0, 4)
    assert best.summary.trainingCost == min(m.summary.trainingCost for m in fits)


def test_race_runs_long_draws_first_and_tells_a_fold_how_many_run():
    told, asked = [], []
    truth = {1: 0.1, 5: 0.5, 3: 0.9, 2: 0.7}
    seen = M.race([1, 5, 3, 2], [0.0, 0.01, -0.01], lambda c, f: asked.append(c) or truth[c] + f, work=lambda c: c,
                  start=lambda f, n: told.append((f, n)))
    assert told == [(0.0, 4), (0.01, 2), (-0.01, 2)] and len(asked) == 8
    assert [len(s) for s in seen] == [1, 1, 3, 3] and seen[2] == [0.9, 0.91, 0.89] and seen[3][0] == 0.7
    assert M.work({"numTrees": 200, "maxDepth": 10}) > M.work({"numTrees": 300, "maxDepth": 5})
    assert M.work({"maxIter": 80, "maxDepth": 3}) > M.work({"regParam": 0.1}) == 1


def test_every_model_has_a_place_in_the_pool(spark):
    assert sorted(M.LONGEST_FIRST) == sorted(M.estimators()) and sorted(["x", *M.LONGEST_FIRST], key=M._start)[-1] == "x"


def test_a_fold_cuts_its_rows_for_the_fits_that_run_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(FL, "ROWS_PER_PARTITION", 100)
    rows = spark.range(0, 3000, 1, 12).selectExpr("string(id) customerID", "int(id % 2) Churn", "double(id) features")
    fold = M.Fold([], rows, rows)
    cores = spark.sparkContext.defaultParallelism
    for fits in (100, M.POOL, 3, 2, 1, 0):
        fold.share(fits)
        own = max(2, -(-cores // max(1, min(fits, M.POOL))))
        assert fold.fitting.rdd.getNumPartitions() == min(own, fold.prepared.frame.rdd.getNumPartitions())
        assert fold.fitting.count() == 3000 and fold.scored.count() == 3000
    fold.share(100)
    assert fold.fitting.rdd.getNumPartitions() == max(2, -(-cores // M.POOL))
    fold.drop()


def test_race_does_not_wait_for_the_last_score_of_a_fold():
    """The best of four is sure to go on once three are scored; the fourth is scored until that one has been seen again."""
    import threading
    truth, again = [0.4, 0.3, 0.2, 0.1], threading.Event()

    def score(c, f):
        if f:
            again.set()
        return truth[c] + f if c < 3 or again.wait(20) else 1.0
    seen = M.race(list(range(4)), [0.0, 0.01], score, finalists=2)
    assert [len(s) for s in seen] == [2, 2, 1, 1] and seen[3] == [0.1]


def test_race_raises_what_a_score_raises():
    def score(c, f):
        raise ValueError("no score")
    with pytest.raises(ValueError, match="no score"):
        M.race([1, 2, 3], [0, 1], score)


def test_few_rows_stay_in_one_piece_while_fits_keep_the_cores_busy(spark):
    rows = spark.range(0, 50_000, 1, 12).selectExpr("string(id) customerID", "int(id % 2) Churn", "double(id) features")
    fold, cores = M.Fold([], rows, rows), spark.sparkContext.defaultParallelism
    for fits, want in ((25, 1), (cores, 1), (1, min(cores, 3))):
        fold.share(fits)
        assert fold.fitting.rdd.getNumPartitions() == want and fold.fitting.count() == 50_000
    assert M.at_a_time([fold]) == max(M.POOL, cores)
    fold.drop()
