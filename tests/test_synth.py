"""SMOTE, k-NN, label propagation and permutation attributions."""

import numpy as np
from pyspark.sql import functions as F

from staysignal.operators.neighbors import knn
from staysignal.operators.oversample import smote
from staysignal.operators.semi import label_propagation


def points(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(i % 4 == 0)
        x = (rng.normal(size=3) + (2.5 if y else 0.0)).tolist()
        rows.append((i + 1, y, x))
    return spark.createDataFrame(rows, "k long, y int, x array<double>"), rows


def test_knn_equals_brute_force_with_duplicates(spark):
    # integer coordinates: squared distances are exact, so ties resolve by id
    rng = np.random.default_rng(3)
    rows = [(i + 1, (rng.integers(-6, 7, size=4) + (8 if i % 4 == 0 else 0)).astype(float).tolist())
            for i in range(300)]
    rows += [(1000 + j, [0.0, 0.0, 0.0, 0.0]) for j in range(50)]  # one hot vector
    rows += [(2000 + j, [400.0 * (j + 1), -300.0 * j, 7.0, 0.0]) for j in range(6)]  # far outliers
    rows += [(3000 + j, [50.0 + j % 2, 50.0 + j % 3, 50.0 + j % 5, 50.0]) for j in range(30)]  # dense cluster
    df = spark.createDataFrame(rows, "k long, x array<double>")
    got = {}
    for r in knn(df, "k", "x", k=5, block_size=16).collect():
        got.setdefault(r.k, []).append((r.nbr_rank, r.nbr_id, r.dist2))
    reps = {}
    for k, x in rows:
        reps[tuple(x)] = min(reps.get(tuple(x), 10 ** 9), k)
    assert len(got) == len(rows)
    for k, x in rows:
        want = sorted((sum((a - b) ** 2 for a, b in zip(x, v)), rid) for v, rid in reps.items() if v != tuple(x))[:5]
        assert [(rid, d2) for d2, rid in want] == [(i, d) for _, i, d in sorted(got[k])]


def test_smote_count_and_convexity(spark):
    df, rows = points(spark)
    out = smote(df, "k", "x", "y", ratio=0.8, k=5, block_size=32)
    n_min, n_maj = 60, 180
    syn = out.filter("synthetic")
    assert syn.count() == int(0.8 * n_maj - n_min)
    assert out.filter(~F.col("synthetic")).count() == len(rows)
    X = {r[0]: np.array(r[2]) for r in rows}
    for r in syn.collect():
        a, b, v = X[r.parent_key], X[r.neighbor_key], np.array(r.x)
        lo, hi = np.minimum(a, b) - 1e-9, np.maximum(a, b) + 1e-9
        assert ((v >= lo) & (v <= hi)).all()
        assert r.y == 1 and r.k is None
    assert syn.select("parent_key", "child").distinct().count() == syn.count()
    named = df.withColumn("k", F.concat(F.lit("id-"), F.col("k").cast("string")))
    assert smote(named, "k", "x", "y", ratio=0.8, k=5, block_size=32).filter("synthetic").count() == syn.count()


def test_label_propagation_recovers_separable_labels(spark):
    df, rows = points(spark, n=200)
    masked = df.withColumn("masked_label", F.when(F.col("k") % 5 == 0, F.col("y")).otherwise(F.lit(-1)))
    out = label_propagation(masked, "k", "x", "masked_label", k=7, block_size=32).join(df.select("k", "y"), "k")
    hidden = out.filter(F.col("masked_label") < 0)
    acc = hidden.agg(F.avg((F.col("propagated_label") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.8


def by_rows(rows, near, gamma, rounds):
    """Propagation row by row over (key, label, vector): {key: (f0, f1)}; ``near`` is the neighbours' table."""
    rep, node = {}, {}
    for k, _, v in rows:
        rep[v] = min(rep.get(v, k), k)
    for k, _, v in rows:
        node[k] = rep[v]
    f = {k: (float(y == 0), float(y == 1)) for k, y, _ in rows}
    for _ in range(rounds):
        mean = {}
        for n in set(node.values()):
            held = [f[k] for k in node if node[k] == n]
            mean[n] = np.mean(held, axis=0)
        nxt = {}
        for k, y, _ in rows:
            edges = [(node[k], 1.0), *((r.nbr_id, np.exp(-gamma * r.dist2)) for r in near if r.k == k)]
            new = sum(w * mean[n] for n, w in edges) / sum(w for _, w in edges)
            nxt[k] = f[k] if y >= 0 else tuple(new)
        f = nxt
    return f


def test_label_propagation_rounds_work_on_nodes_and_equal_those_on_rows(spark, monkeypatch):
    from staysignal.operators import semi
    rng = np.random.default_rng(7)
    rows = [(i + 1, int(rng.integers(-1, 2)) if i % 3 == 0 else -1, (float(rng.integers(4)), float(rng.integers(4))))
            for i in range(120)]  # at most 16 nodes
    df = spark.createDataFrame([(k, y, list(v)) for k, y, v in rows], "k long, masked_label int, x array<double>")
    sizes = {}

    def written(table, name):
        out = real(table, name)
        sizes[name] = out.count()
        return out
    real = semi.written
    monkeypatch.setattr(semi, "written", written)
    got = {r.k: r for r in label_propagation(df, "k", "x", k=3, max_iter=4, gamma=0.5, exact=True).collect()}
    nodes = len({v for _, _, v in rows})
    assert sizes["edges"] == 4 * nodes and sizes["propagated"] == sizes["members"] == nodes
    want = by_rows(rows, knn(df, "k", "x", k=3).collect(), 0.5, 4)
    assert len(got) == len(rows)
    for k, (f0, f1) in want.items():
        assert got[k].rounds == 4 and not got[k].converged
        assert got[k].p_churn is None if f0 + f1 == 0 else abs(got[k].p_churn - f1 / (f0 + f1)) < 1e-9


def test_label_propagation_of_repeated_and_null_keys(spark):
    rows = [(1, 1, [0.0, 0.0]), (1, -1, [0.0, 0.0]), (2, -1, [0.0, 0.0]), (2, -1, [5.0, 0.0]), (3, 0, [5.0, 0.0]),
            (None, -1, [0.0, 0.0]), (None, 1, [9.0, 9.0]), (4, -1, [9.0, 9.0]), (5, None, [5.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, masked_label int, x array<double>")
    out = label_propagation(df, "k", "x", k=1, max_iter=1, gamma=1.0, exact=True).collect()
    assert sorted(str(r.k) for r in out) == sorted(str(r[0]) for r in rows)
    got = {(r.k, r.masked_label): r for r in out}
    assert got[(None, -1)].p_churn is None and got[(None, 1)].p_churn == 1.0  # a row without id only keeps its label
    assert got[(1, 1)].p_churn == 1.0 and got[(3, 0)].p_churn == 0.0
    assert got[(2, -1)].p_churn == got[(2, -1)].p_churn and 0.0 < got[(2, -1)].p_churn < 1.0  # hears both its nodes


def test_permutation_shapley_sums_to_prediction_gap(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from staysignal.operators.explain import permutation_shapley
    df, rows = points(spark, n=120)
    data = df.withColumn("features", array_to_vector("x")).withColumn("label", F.col("y").cast("double"))
    model = LogisticRegression().fit(data)
    base = [0.0, 0.0, 0.0]
    contrib = permutation_shapley(model, data.limit(10), "k", base, ["a", "b", "c"], permutations=4)
    sums = {r.k: r.s for r in contrib.groupBy("k").agg(F.sum("contribution").alias("s")).collect()}
    from pyspark.ml.functions import vector_to_array
    pb = model.transform(spark.createDataFrame([(base,)], "x array<double>")
                         .withColumn("features", array_to_vector("x"))).select(
        vector_to_array("probability")[1]).first()[0]
    preds = model.transform(data.limit(10)).select("k", vector_to_array("probability")[1].alias("p")).collect()
    for r in preds:
        assert abs(sums[r.k] - (r.p - pb)) < 1e-4


def test_knn_result_does_not_depend_on_the_projections(spark):
    # exact search: different random projections (seeds, block sizes) only
    # change the work, never the neighbours
    df, _ = points(spark, n=200, seed=4)
    a = sorted(tuple(r) for r in knn(df.select("k", "x"), "k", "x", k=4, block_size=16, seed=1).collect())
    b = sorted(tuple(r) for r in knn(df.select("k", "x"), "k", "x", k=4, block_size=48, seed=9).collect())
    assert a == b and len(a) == 4 * 200
