import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from staysignal.llm import graph, op6_itq, op9_exact, op10_chosenpath
from tests.llm.fixtures import documents, empty, rows, words


def test_exact_against_brute_force(spark):
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    want = []
    for r in rows():
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, op9_exact.exact_dedup(documents(spark)).collect()), key=str) == sorted(want, key=str)
    assert op9_exact.digest(empty(spark)).count() == 0


def test_exact_keeps_one_row_of_each_text(spark):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    kept = op9_exact.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def jaccard_brute(data):
    sets = []
    for _, t in data:
        ws = words(t)
        n = min(5, len(ws))
        sets.append({tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if ws else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i]
             and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    root, links = roots(len(sets), pairs), defaultdict(int)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    low = defaultdict(list)
    for k, r in enumerate(root):
        low[r].append(data[k][0])
    least = {r: None if None in ids else min(ids) for r, ids in low.items()}
    return sorted(((data[k][0], least[root[k]], links[k], len(sets[k])) for k in range(len(sets))), key=str)


def test_jaccard_against_brute_force(spark):
    got = sorted(map(tuple, op10_chosenpath.jaccard_groups(documents(spark)).collect()), key=str)
    assert got == jaccard_brute([(r[0], r[1]) for r in rows()])
    assert op10_chosenpath.digest(empty(spark)).count() == 0


def test_jaccard_splits_large_nodes_and_compares_the_rest_in_blocks(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(90):  # more than a block of near copies of one text, and others
        ws = list(base) if i < 60 else [f"v{x}" for x in rng.integers(0, 9999, 40)]
        ws[rng.integers(0, len(ws))] = f"new{i}"
        data.append((i, " ".join(ws)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(map(tuple, op10_chosenpath.jaccard_groups(docs, block=7).collect()), key=str)
    assert got == jaccard_brute(data)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(pairs, "a long, b long"), "test").collect()))
    want = roots(200, pairs)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in nodes}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    data = []
    for c in range(40):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 9))):
            data.append((centre + rng.standard_normal(32) * 0.12).tolist())
    data += [data[0], data[0], [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, None, [], [1.0, 2.0], [2.0, 4.0], [1e300, 1e300]]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(data)],
                                  "vec_id long, embedding array<double>, bucket string, size int")

    def cosine(a, b):
        if len(a) != len(b):
            return 0
        a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b))
    ok = [bool(v) and None not in v and np.isfinite(v).all() and any(v) for v in data]
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if ok[i] and ok[j] and cosine(data[i], data[j]) >= 0.95]
    got = {r["vec_id"]: r for r in op6_itq.near_vectors(table, block=5).collect()}
    links = defaultdict(int)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.97 * 2 * len(pairs) and all(r["n_links"] <= links[i] for i, r in got.items())
    root = roots(len(data), pairs)
    assert sum(got[i]["component_id"] == root[i] for i in range(len(data))) >= 0.97 * len(data)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert op6_itq.digest(table.limit(0)).count() == 0
