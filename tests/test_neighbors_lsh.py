"""Hashed neighbour search: bounded candidates, recall against brute force, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staysignal.operators import neighbors_lsh as L


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(4)


def brute(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("block", [20, 60])
def test_recall_in_thirty_dimensions(spark, block):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (150, 30)) for c in rng.normal(0, 1, (4, 30))])
    got, said = L.knn_lsh(table(spark, x), "id", "v", k=5, block=block)
    far = brute(x, 5)[:, -1]
    rows = got.collect()
    hits = sum(r.dist2 <= far[r.id] * (1 + 1e-9) for r in rows)
    assert said >= 0.9 and hits >= 0.88 * 5 * len(x)
    for r in rows:
        assert r.nbr_id != r.id and np.isclose(r.dist2, ((x[r.id] - x[r.nbr_id]) ** 2).sum())
    assert max(r.nbr_rank for r in rows) == 5


def test_candidates_are_bounded_by_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((500, 1)) < 0.7, 1e-9, 1.0) * rng.normal(size=(500, 8))  # a dense cluster of most rows
    base = table(spark, x).select("id", F.col("v").alias("vec"))
    directions = rng.normal(size=(3, 3, 8))
    hashed = L._hashed(base, 0, 3, directions, np.zeros((3, 3)), "bigint")
    n = L._block_pairs(hashed, 1000, 40, "bigint").groupBy("a").agg(F.countDistinct("b").alias("n")).agg(F.max("n")).first()[0]
    assert n <= 3 * 60


def test_all_rows_in_one_block_is_exact(spark):
    x = np.random.default_rng(3).normal(size=(40, 3))
    got, said = L.knn_lsh(table(spark, x), "id", "v", k=4)
    want = brute(x, 4)
    assert said == 1.0
    for i in range(40):
        own = sorted(r.dist2 for r in got.filter(F.col("id") == i).collect()) if i < 5 else None
        assert own is None or np.allclose(own, want[i])


def test_repeated_vectors_and_tiny_tables(spark):
    x = np.array([[0.0, 0.0]] * 30 + [[1.0, 0.0], [0.0, 2.0]])
    got = L.knn_lsh(table(spark, x), "id", "v", k=2)[0].collect()
    assert len(got) == 64 and all(r.dist2 > 0 for r in got)  # neighbours are distinct vectors
    assert L.knn_lsh(table(spark, x[:1]), "id", "v", k=2)[0].count() == 0
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert L.knn_lsh(empty, "id", "v", k=2)[0].count() == 0


def test_recall_counts_true_neighbours_and_sends_a_bounded_number_of_rows(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(600, 6))
    base = table(spark, x).select("id", F.col("v").alias("vec"))
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1)
    rows = [(i, int(j), float(d[i, j])) for i in range(600) for j in [*order[i, :3], order[i, 9]]]  # 3 of 4 are true
    best = spark.createDataFrame(rows, "a long, b long, d2 double")
    assert abs(L.measured_recall(best, base, 4, 6, queries=50) - 0.75) < 1e-9
    frames = []
    of = type(base).mapInArrow
    monkeypatch.setattr(type(base), "mapInArrow", lambda self, *a, **k: frames.append(of(self, *a, **k)) or frames[-1])
    L.measured_recall(best, base, 4, 6, queries=50)
    assert len(frames) == 1 and frames[0].count() <= 4 * 50 * 4  # partitions x queries x k


def test_a_task_sends_no_whole_sample_to_the_driver(spark, monkeypatch):
    """The rows of the lowest hashes, found among those below a bound; all rows if these are too few."""
    base = spark.range(0, 20_000, 1, 16).selectExpr("string(id) id", "array(double(id)) vec").checkpoint()
    want = base.orderBy(F.xxhash64("id", F.lit(7))).limit(100).collect()
    asked, plain = [], type(base).orderBy
    monkeypatch.setattr(type(base), "orderBy", lambda self, *a: asked.append(self.count()) or plain(self, *a))
    assert L._lowest(base, 20_000, 100, 7) == want and len(asked) == 1 and 100 <= asked[0] < 400
    assert L._lowest(base, 20_000_000, 100, 7) == want and len(asked) == 3  # far fewer rows than said
