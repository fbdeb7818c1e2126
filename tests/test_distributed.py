"""Distributed building blocks: prefix sums over range partitions and the
window-free categorical profile."""

import numpy as np
from pyspark.sql import functions as F

from staysignal.operators.common import running_sums
from staysignal.operators.profile import categorical_profile


def test_running_sums_match_sequential_cumsum_on_clustered_keys(spark):
    rng = np.random.default_rng(11)
    # most keys crowd into a tiny interval, a few spread far out
    keys = np.concatenate([0.5 + rng.random(900) * 1e-6, rng.random(100) * 1000.0])
    keys = np.unique(keys)
    a, b = rng.integers(0, 5, size=len(keys)), rng.integers(0, 3, size=len(keys))
    df = spark.createDataFrame([(float(k), int(x), int(y)) for k, x, y in zip(keys, a, b)],
                               "p double, a long, b long").repartition(7)
    got = {r.p: (r.cum_a, r.cum_b) for r in running_sums(df, F.desc("p"), ["a", "b"]).collect()}
    order = np.argsort(-keys)
    ca, cb = np.cumsum(a[order]), np.cumsum(b[order])
    assert got == {float(keys[i]): (int(ca[j]), int(cb[j])) for j, i in enumerate(order)}


def test_categorical_profile_ties_and_high_cardinality(spark):
    rows = [(f"id{i}", "x" if i < 3 else ("y" if i < 6 else f"z{i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "uid string, c string")
    got = {r.column_name: (r.n_distinct, r.top_value, r.top_count)
           for r in categorical_profile(df, ["uid", "c"]).collect()}
    assert got["c"] == (36, "x", 3)      # x and y tie at 3: the smaller value wins
    assert got["uid"] == (40, "id0", 1)  # all distinct: smallest value


def test_curves_have_one_path_for_any_precision(spark):
    from staysignal.operators import evaluate as EV
    rng = np.random.default_rng(2)
    for p in (np.round(rng.random(500), 2), rng.random(500)):
        y = (rng.random(500) < p).astype(int)
        df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                                   "id long, y int, p double")
        pos, neg = p[y == 1], p[y == 0]
        auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
        assert abs(EV.roc_auc(df).first()[0] - auc) < 1e-6
        roc, pr = EV.roc_curve(df).collect(), EV.pr_curve(df).collect()
        assert len(roc) == len(pr) == len(np.unique(p)) + 1  # and the point where nothing is positive
        assert [(r.fpr, r.tpr) for r in roc if r.threshold is None] == [(0.0, 0.0)]
        assert [(r.precision, r.recall) for r in pr if r.threshold is None] == [(1.0, 0.0)]


def test_cluster_session_needs_a_shared_checkpoint_folder():
    import pytest
    from staysignal.session import ensure_checkpoint_dir

    class _SC:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class _Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class _Session:
        def __init__(self, master, configured=None):
            self.sparkContext, self.conf = _SC(master), _Conf(configured)

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("yarn"))
    assert ensure_checkpoint_dir(_Session("yarn", "hdfs:///shared/chk")) == "hdfs:///shared/chk"
    assert ensure_checkpoint_dir(_Session("local[2]"))  # tests get a folder of their own


def test_quantiles_equal_numpy(spark):
    from staysignal.operators.common import quantiles
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 301)] + [("b", float(v)) for v in rng.normal(size=64)]
    rows += [("c", 7.0), (None, 2.0), (None, 3.0), ("a", None)]
    counts = spark.createDataFrame(rows, "g string, value double").groupBy("g", "value") \
        .agg(F.count(F.lit(1)).alias("n"))
    qs = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q95": 0.95}
    got = {r.g: [r[k] for k in qs] for r in quantiles(counts, qs, ("g",)).collect()}
    for g in ("a", "b", "c", None):
        vals = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(got[g], np.quantile(vals, list(qs.values())))
    whole = quantiles(counts.groupBy("value").agg(F.sum("n").alias("n")), qs).first()
    assert np.allclose(list(whole), np.quantile([v for _, v in rows if v is not None], list(qs.values())))
