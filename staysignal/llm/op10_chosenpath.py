"""Word-shingle Jaccard self-join by chosen paths.

Sets are collapsed to distinct ones first.  In each of several runs every
set walks down a random tree: a node picks one of the ``SKETCH`` minhash
coordinates, and sets that share the sampled token (their minhash there) go
on together.  A node of at most ``BLOCK`` sets is compared by brute force on
the sketches; larger nodes split again, down to ``DEPTH``, where what is
still large (sets that share nearly everything) is compared in pairs of
blocks, so no node is capped.  The number of runs follows from the target
recall: a pair at the threshold t stays together for d levels with chance
t**d per run.

Sketch matches only say which sets to compare: their connected groups get
their whole shingle sets, once per set, and exact Jaccard decides the links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, written
from .graph import components, grouped, in_blocks, local_roots
from .shingles import minhashes, sets

WORDS = 5
THRESHOLD = 0.8
SKETCH = 64
BLOCK = 1000
DEPTH = 3
RECALL = 0.9999


def runs_for(threshold: float, recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** depth))


def _sketches(docs: DataFrame, key: str, text: str, words: int, sketch: int) -> DataFrame:
    def f(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                values, cuts, k1, k2 = sets(part.column(1), words)
                sig = minhashes(values, cuts, sketch)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(cuts)), pa.array(k1), pa.array(k2),
                     pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "n", "k1", "k2", "sig"])

    return docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(
        f, "doc_id long, n long, k1 long, k2 long, sig binary")


def _sig(column, sketch: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, sketch)


def _first_paths(rows: DataFrame, runs: int, sketch: int) -> DataFrame:
    """(path, rid) of each set in each run: the run's root node has one coordinate."""
    def f(batches):
        for b in batches:
            sig, rid = _sig(b.column("sig"), sketch), b.column("rid")
            for r in range(runs):
                root = mix64(np.full(1, r + 1, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(_child(root, sig, sketch).view(np.int64)), rid],
                                                 names=["path", "rid"])
    return rows.select("rid", "sig").mapInArrow(f, "path long, rid long")


def _child(path: np.ndarray, sig: np.ndarray, sketch: int) -> np.ndarray:
    path = np.broadcast_to(path, len(sig))
    at = (mix64(path + np.uint64(0x51)) % np.uint64(sketch)).astype(np.int64)
    token = sig[np.arange(len(sig)), at].astype(np.uint64)
    return mix64(path ^ mix64(token + (at.astype(np.uint64) << np.uint64(32)) + np.uint64(1)))


def _next_paths(rows: DataFrame, sketch: int) -> DataFrame:
    def f(batches):
        for b in batches:
            path = b.column("path").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_child(path, _sig(b.column("sig"), sketch), sketch).view(np.int64)), b.column("rid"),
                 b.column("sig")], names=["path", "rid", "sig"])
    return rows.select("path", "rid", "sig").mapInArrow(f, "path long, rid long, sig binary")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a block group's two sides (the same ones in a diagonal group)."""
    blk, bi, bj = group.column("blk").to_numpy(), group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
    return np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)


def _sketch_pairs(sketch: int, least: int):
    def f(group: pa.Table) -> pa.Table | None:
        left, right = _sides(group)
        if not len(left) or not len(right) or group.num_rows < 2:
            return None
        sig, rid = _sig(group.column("sig"), sketch), group.column("rid").to_numpy()
        same = np.zeros((len(left), len(right)), np.uint8)
        for c in range(sketch):
            same += sig[left, c][:, None] == sig[right, c][None, :]
        i, j = np.nonzero(same >= least)
        return _stars(group, left[i], right[j], rid, None)
    return f


def _stars(group: pa.Table, a: np.ndarray, b: np.ndarray, rid: np.ndarray, links: np.ndarray | None):
    """Per row with a pair: an edge to its local root and, if counted, its links."""
    differ = a != b
    a, b = a[differ], b[differ]
    if not len(a):
        return None
    root = local_roots(len(rid), a, b)
    rows = np.unique(np.concatenate([a, b]))
    columns = [pa.array(rid[rows]), pa.array(rid[root[rows]])]
    if links is not None:
        columns.append(pa.array(links[rows]))
    return pa.table(columns, names=["a", "b"] + ["links"] * (links is not None))


def _exact_pairs(threshold: float):
    def f(group: pa.Table) -> pa.Table | None:
        left, right = _sides(group)
        if not len(left) or not len(right) or group.num_rows < 2:
            return None
        rid, copies = group.column("rid").to_numpy(), group.column("copies").to_numpy()
        parts = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        size = np.array([len(p) for p in parts])
        every = np.concatenate([parts[k] for k in right])
        owner = np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]  # postings of the right side
        found_a, found_b = [], []
        for k in left:
            lo, hi = np.searchsorted(every, parts[k], "left"), np.searchsorted(every, parts[k], "right")
            n = hi - lo
            at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(right))
            ok = np.flatnonzero(shared >= threshold * (size[k] + size[right] - shared) - 1e-9)
            found_a.append(np.full(len(ok), k))
            found_b.append(right[ok])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        links = np.zeros(len(rid), np.int64)
        once = a != b
        np.add.at(links, a[once], copies[b[once]])
        if group.column("bi")[0].as_py() != group.column("bj")[0].as_py():
            np.add.at(links, b[once], copies[a[once]])
        return _stars(group, a, b, rid, links)
    return f


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                   threshold: float = THRESHOLD, recall: float = RECALL, sketch: int = SKETCH, depth: int = DEPTH,
                   block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, class_id (least id of its connected group),
    n_links (other rows with Jaccard >= ``threshold``, copies included), n_shingles.

    Texts without a word (null, empty, blank) have no shingles and link with
    nothing.  Rows with equal sets are linked; a null id counts as the least.
    An empty table gives an empty result.
    """
    runs = runs_for(threshold, recall, depth)
    all_rows = written(_sketches(docs, key, text, words, sketch), "sketches")
    low = F.coalesce("doc_id", F.lit(-(1 << 63)))
    distinct = written(all_rows.filter("n > 0").groupBy("k1", "k2", "n")
                       .agg(F.min(low).alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
                       .withColumn("rid", F.monotonically_increasing_id()), "sets")
    # nodes of the first level that have company
    paths = _first_paths(distinct, runs, sketch)
    met = written(paths.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), "nodes")
    nodes = paths.join(met, "path").join(distinct.select("rid", "sig"), "rid")
    matched = None
    least = math.floor(sketch * threshold - 4.5 * math.sqrt(sketch * threshold * (1 - threshold)))
    for level in range(1, depth + 1):
        nodes = written(nodes, f"nodes-{level}")
        ready = nodes if level == depth else nodes.filter(F.col("size") <= block)
        dealt = in_blocks(ready, "path", "size", "rid", block)
        stars = grouped(dealt.select("path", "bi", "bj", "blk", "rid", "sig"), ["path", "bi", "bj"],
                        _sketch_pairs(sketch, least), "a long, b long").distinct()
        matched = stars if matched is None else matched.unionByName(stars)
        large = nodes.filter(F.col("size") > block)
        if level == depth or large.isEmpty():
            break
        below = _next_paths(large, sketch)
        met = written(below.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), f"split-{level}")
        nodes = below.join(met, "path")
    candidate = written(components(matched, "candidates"), "candidate-groups")
    sizes = written(candidate.groupBy("root").agg(F.count("*").alias("size")), "candidate-sizes")
    asked_for = written(candidate.join(sizes, "root").withColumnRenamed("id", "rid")
                        .join(distinct.drop("sig"), "rid"), "to-compare")
    ids = asked_for.select(F.col("least").alias("__id")).distinct()
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{text}`").alias("__text"))
    texts = texts.join(ids, F.coalesce("__key", F.lit(-(1 << 63))) == F.col("__id"), "left_semi").select("__text")

    def whole(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                values, cuts, k1, k2 = sets(b.column(0).slice(at, 2000), words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1), pa.array(k2), pa.array(np.diff(cuts)),
                     pa.array([values[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())],
                    names=["k1", "k2", "n", "shingles"])

    full = texts.mapInArrow(whole, "k1 long, k2 long, n long, shingles binary")
    full = full.join(asked_for, ["k1", "k2", "n"]).dropDuplicates(["rid"])
    dealt = in_blocks(full.select("root", "size", "rid", "copies", "shingles"), "root", "size", "rid", block)
    links = written(grouped(dealt.select("root", "bi", "bj", "blk", "rid", "copies", "shingles"), ["root", "bi", "bj"],
                            _exact_pairs(threshold), "a long, b long, links long"), "links")
    group = components(links.select("a", "b"), "groups")
    counted = links.groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    grouped_sets = (distinct.drop("sig").join(counted, "rid", "left")
                    .join(group.withColumnRenamed("id", "rid"), "rid", "left")
                    .withColumn("root", F.coalesce("root", "rid")))
    grouped_sets = written(grouped_sets, "grouped-sets")
    named = written(grouped_sets.groupBy("root").agg(F.min("least").alias("class_id")), "classes")
    result = written(grouped_sets.join(named, "root").select(
        "k1", "k2", "n", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "set-classes")
    known = all_rows.drop("sig").filter("n > 0").join(result, ["k1", "k2", "n"]).select(
        "doc_id", F.nullif("class_id", F.lit(-(1 << 63))).alias("class_id"), "n_links", F.col("n").alias("n_shingles"))
    alone = all_rows.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                            F.col("n").alias("n_shingles"))
    return known.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, that of the least id."""
    classes = jaccard_groups(docs)
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")


def digest(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, UNNEST(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
r(id, low) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b)
SELECT w.doc_id, (SELECT min(low) FROM r WHERE r.id = w.doc_id) AS class_id,
  (SELECT count(*) FROM l WHERE l.a = w.doc_id) AS n_links,
  CAST(coalesce((SELECT n FROM n WHERE n.doc_id = w.doc_id), 0) AS BIGINT) AS n_shingles
FROM w
"""
