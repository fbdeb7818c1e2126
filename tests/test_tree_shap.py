"""Attributions of trees against enumerating all feature subsets, and their sums."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from staysignal.operators import evaluate as EV
from staysignal.operators import tree_shap as TS


def data(spark, n=300, width=4):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((n, width)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.random(n)) > 0.8).astype(int)
    rows = [(f"r{i}", *map(float, x[i]), int(y[i]), float(1 + i % 3)) for i in range(n)]
    names = [f"x{j}" for j in range(width)]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{c} double" for c in names) + ", label int, w double")
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).checkpoint(), names, x


def nodes_of(classifier):
    table, _ = TS.node_table(classifier)
    out = {}
    for r in table.collect():
        out.setdefault(r.tree, {})[r.id] = r
    return [out[t] for t in sorted(out)]


def expected(nodes, x, known, at=0):
    """Value of a tree for a row of which only the features ``known`` are seen."""
    n = nodes[at]
    if n.feature < 0:
        return n.value
    if n.feature in known:
        return expected(nodes, x, known, n.left if x[n.feature] <= n.threshold else n.right)
    return sum(nodes[c].cover / n.cover * expected(nodes, x, known, c) for c in (n.left, n.right))


def shapley(trees, x):
    d, out = len(x), np.zeros(len(x))
    value = {s: sum(expected(t, x, set(s)) for t in trees) for k in range(d + 1) for s in itertools.combinations(range(d), k)}
    for i in range(d):
        for s in value:
            if i not in s:
                w = math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d)
                out[i] += w * (value[tuple(sorted((*s, i)))] - value[s])
    return out


@pytest.mark.parametrize("make", [
    lambda: DecisionTreeClassifier(maxDepth=3, weightCol="w"), lambda: DecisionTreeClassifier(maxDepth=7),
    lambda: RandomForestClassifier(numTrees=4, maxDepth=3, seed=3, weightCol="w"),
    lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=3), lambda: DecisionTreeClassifier(maxDepth=0)])
def test_equal_to_all_subsets(spark, make):
    df, names, x = data(spark)
    model = make().fit(df)
    trees = nodes_of(model)
    got = TS.attributions(x[:25], TS.trees_of(model))
    assert np.allclose(got, [shapley(trees, row) for row in x[:25]], atol=1e-12)


@pytest.mark.parametrize("boosted", [False, True])
def test_sums_are_the_prediction_less_the_base(spark, boosted):
    df, names, x = data(spark)
    est = GBTClassifier(maxIter=10, maxDepth=4, seed=3) if boosted else RandomForestClassifier(numTrees=20, maxDepth=9, seed=3)
    flow = PipelineModel([est.fit(df)])
    found, base = TS.tree_shap(flow, df.select("id", "features").union(df.limit(1).select("id", "features")), "id", names)
    rows = found.groupBy("id").agg(F.sum("contribution").alias("s"), F.first("p").alias("p"), F.count("*").alias("n")).collect()
    assert len(rows) == 300 and sorted({r.n for r in rows}) == [4, 8]
    for r in rows:
        target = math.log(r.p / (1 - r.p)) if boosted else r.p
        assert math.isclose(r.s / (r.n // 4), target - base, abs_tol=1e-8)
    values = {(r.id, r.feature): r.x for r in found.collect()}
    assert all(values[(f"r{i}", names[j])] == x[i, j] for i in range(300) for j in range(4))


def test_empty_table(spark):
    df, names, _ = data(spark)
    flow = PipelineModel([DecisionTreeClassifier(maxDepth=2).fit(df)])
    assert TS.tree_shap(flow, df.limit(0), "id", names)[0].count() == 0


def test_attribution_bins(spark):
    rows = [("a", float(i), 2.0 * i) for i in range(100)] + [("a", None, 1.0), ("a", float("nan"), 1.0), ("b", 3.0, 1.0), ("b", 3.0, 3.0)]
    got = {(r.feature, r.bin): r for r in EV.attribution_bins(
        spark.createDataFrame(rows, "feature string, x double, contribution double").repartition(5), bins=10).collect()}
    assert len(got) == 11 and got[("b", 0)][2:] == (2, 3.0, 2.0, 1.0)
    assert sum(r.n for k, r in got.items() if k[0] == "a") == 100 and got[("a", 9)].value == 94.5
    assert all(abs(r.contribution - 2 * r.value) < 1e-6 for k, r in got.items() if k[0] == "a")
    assert EV.attribution_bins(spark.createDataFrame([], "feature string, x double, contribution double")).count() == 0


def test_long_paths_compute_the_patterns_of_their_rows(monkeypatch):
    """A chain that splits on 14 features: 2^14 patterns a leaf, of which 50 rows show at most 50."""
    d = 14
    nodes = {}
    for i in range(d):
        nodes[2 * i] = (i, 0.5, 2 * i + 1, 2 * i + 2, float(2 * d - i), 0.0)
        nodes[2 * i + 1] = (-1, None, -1, -1, 1.0, i / d)
    nodes[2 * d] = (-1, None, -1, -1, float(d), 1.0)
    tree, x, sizes, plain = TS.Tree(nodes), np.random.default_rng(3).random((50, d)), [], TS.shares
    monkeypatch.setattr(TS, "shares", lambda *a: (lambda t: sizes.append(t.shape[1]) or t)(plain(*a)))
    got = TS.attributions(x, [tree])
    assert max(sizes) <= TS.MOST_PATTERNS
    monkeypatch.setattr(TS, "MOST_PATTERNS", 1 << d)
    assert np.allclose(got, TS.attributions(x, [tree]), atol=1e-12)
    first = np.where((x <= 0.5).any(axis=1), (x <= 0.5).argmax(axis=1) / d, 1.0)
    assert np.allclose(got.sum(axis=1), first - tree.base)


def test_rows_share_the_work_of_a_pattern(monkeypatch):
    """The shares of a leaf are computed once a batch, however many rows it has."""
    nodes = {0: (0, 0.5, 1, 2, 10.0, 0.0), 1: (-1, None, -1, -1, 4.0, 0.2), 2: (1, 0.5, 3, 4, 6.0, 0.0),
             3: (-1, None, -1, -1, 3.0, 0.5), 4: (-1, None, -1, -1, 3.0, 0.9)}
    sizes, plain = [], TS.shares
    monkeypatch.setattr(TS, "shares", lambda *a: (lambda t: sizes.append(t.size) or t)(plain(*a)))
    TS.attributions(np.random.default_rng(1).random((5000, 2)), [TS.Tree(nodes)])
    assert sizes and sum(sizes) <= 2 + 8 + 8


def test_any_cut_into_blocks_gives_the_same(spark, monkeypatch):
    """One block for as many leaves as fit, or one for each leaf, with all patterns or those of the rows."""
    df, names, x = data(spark)
    trees = TS.trees_of(RandomForestClassifier(numTrees=5, maxDepth=6, seed=3, weightCol="w").fit(df))
    x = np.vstack([x, np.full((1, 4), np.nan)])
    blocks = lambda: sum(block is not None for t in trees for *_, block in t.steps(len(x)))
    monkeypatch.setattr(TS, "LOOKUP", 10**6)
    few, want = blocks(), TS.attributions(x, trees)
    monkeypatch.setattr(TS, "EACH", 10**12)
    many = blocks()
    assert many > 2 * few and np.allclose(TS.attributions(x, trees), want, atol=1e-12)
    monkeypatch.setattr(TS, "MOST_PATTERNS", 1)
    assert np.allclose(TS.attributions(x, trees), want, atol=1e-12)


def test_neighbouring_leaves_are_looked_up_together(monkeypatch):
    """Eight leaves under seven splits: one table for many rows, where each leaf had its own."""
    nodes = {i: (i % 3, 0.1 * (i + 1), 2 * i + 1, 2 * i + 2, float(8 >> (i + 1).bit_length() - 1), 0.0) for i in range(7)}
    nodes |= {7 + i: (-1, None, -1, -1, 1.0, i / 8) for i in range(8)}
    calls, plain = [], TS.shares
    monkeypatch.setattr(TS, "shares", lambda *a: calls.append(1) or plain(*a))
    x, tree = np.random.default_rng(2).random((20_000, 3)), TS.Tree(nodes)
    got = TS.attributions(x, [tree])
    assert len(calls) == 1
    leaf = np.zeros(len(x), int)
    for _ in range(3):
        leaf = np.where(x[np.arange(len(x)), leaf % 3] <= 0.1 * (leaf + 1), 2 * leaf + 1, 2 * leaf + 2)
    assert np.allclose(got.sum(axis=1), (leaf - 7) / 8 - tree.base)


def test_tables_are_computed_once_a_core(spark):
    """A task computes the tables of all blocks, so there are no more tasks than cores and chunks of rows need."""
    df, names, _ = data(spark)
    flow, rows = PipelineModel([DecisionTreeClassifier(maxDepth=3).fit(df)]), df.select("id", "features")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found, _ = TS.tree_shap(flow, rows, "id", names)
        assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and found.count() == 1200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
