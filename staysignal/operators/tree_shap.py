"""Attributions of tree models from the paths of their trees.

A leaf gives a row's feature i the share v * (o_i - z_i) * sum over subsets S of the path's other features of
|S|! (d - |S| - 1)! / d! * prod_{j in S} o_j * prod_{j not in S} z_j, where o_j says whether the row follows all of the
path's splits on j and z_j is the share of training weight (cover) that does.  The subset weights are the integrals of
t^|S| (1 - t)^(d - |S| - 1) over 0..1, so the sum is the integral of prod_j (z_j (1 - t) + o_j t), a polynomial that
Gauss-Legendre points integrate exactly.  The shares of a leaf depend on a row only through the o_j of its path, one
bit for each feature; those of neighbouring leaves together through the bits of the path to their common node and the
outcomes of the splits below it.  So a tree is cut into such blocks of leaves, the shares of a block are computed once
for every pattern of bits (a product of what the path and what the block asks, summed over the points by a matrix
product) and looked up by all rows of a chunk.  Rows aren't copied, and nothing is sampled.

The node table is read from the saved model; it is as large as the model and travels to the tasks as arrays.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, shared_path

ROWS = 65_536  # rows explained at once in a task
MOST_PATTERNS = 8_192  # a leaf with more patterns has those computed that the rows at hand show
# What steps cost, in about nanoseconds: a block, an edge above the blocks, a row's lookup, an entry of a block's table.
BLOCK, EDGE, LOOKUP, EACH = 150_000, 10_000, 2, 8


def node_table(classifier) -> tuple[DataFrame, str]:
    """The nodes (tree, id, feature, threshold, left, right, cover, value) of all nodes; ``feature`` is -1 in a leaf;
    and the folder of the saved model they are read from.

    ``value`` adds up to the probability over the trees of a forest (or to that of the one tree), and to the log odds
    over the rounds of boosting.
    """
    spark, path = SparkSession.getActiveSession(), shared_path(SparkSession.getActiveSession(), "trees")
    classifier.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    stats = F.col("n.impurityStats")
    cover = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    if "treeID" in data.columns:
        nodes = data.select(F.col("treeID").alias("tree"), F.col("nodeData").alias("n"))
    else:
        nodes = data.select(F.lit(0).alias("tree"), F.struct(*data.columns).alias("n"))
    if isinstance(classifier, GBTClassificationModel):
        weights = F.create_map(*[F.lit(x) for i, w in enumerate(classifier.treeWeights) for x in (i, 2.0 * w)])
        cover, value = stats[0], F.col("n.prediction") * weights[F.col("tree")]
    else:
        trees = max(1, getattr(classifier, "getNumTrees", 1))
        value = stats[1] / cover / F.lit(float(trees))
    leaf = F.col("n.leftChild") < 0
    return nodes.select("tree", "n.id", F.when(leaf, -1).otherwise(F.col("n.split.featureIndex")).alias("feature"),
                        F.when(~leaf, F.col("n.split.leftCategoriesOrThreshold")[0]).alias("threshold"),
                        F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"),
                        cover.alias("cover"), value.alias("value")), path


class Block:
    """A part of a tree below one node: its leaves answer a row together.

    A pattern has a bit for each feature of the path to the node (does the row follow all its splits there?), then one
    for each condition (feature, threshold) of the splits below.
    """

    def __init__(self, path: dict[int, tuple[int, float]], conditions: list[tuple[int, float]], leaves: list[tuple]):
        """``leaves``: (value, {feature split on below the node: (z, bits of its conditions, those that must be set)})."""
        self.conditions, self.first, self.bits = conditions, len(path), len(path) + len(conditions)
        self.own = sorted({f for f, _ in conditions})  # features split on in the block
        kept = [f for f in path if f not in self.own]
        self.features = [*kept, *self.own]
        self.kept = [path[f][0] for f in kept]  # their bits
        self.held = [path[f][0] for f in self.own if f in path]
        self.z = np.array([path[f][1] for f in kept])
        self.values = np.array([v for v, _ in leaves])
        # what a leaf asks of a feature: bits of (held, conditions) and which must be set; z = 1 asks nothing
        self.own_z = np.ones((len(leaves), len(self.own)))
        self.mask = np.zeros(self.own_z.shape, np.int64)
        self.want = np.zeros(self.own_z.shape, np.int64)
        most, bit_of = 0, {f: self.held.index(path[f][0]) for f in self.own if f in path}
        for i, (_, asked) in enumerate(leaves):
            met = len(kept)
            for j, f in enumerate(self.own):
                if f in asked or f in path:
                    z, mask, want = asked.get(f, (path.get(f, (0, 1.0))[1], 0, 0))
                    before = 1 << bit_of[f] if f in path else 0
                    self.own_z[i, j], self.mask[i, j], self.want[i, j] = z, mask << len(self.held) | before, want << len(self.held) | before
                    met += 1
            most = max(most, met)
        self.points = (most + 1) // 2  # the product over a path's other features has one degree less than features


class Tree:
    """One tree, cut into blocks of leaves that rows look up together.

    Attributions of a block depend on a row through its pattern alone, so they are computed once a pattern and looked up
    by the rows.  Blocks are as large as pays for the rows at hand: one of many leaves saves lookups, but has more
    patterns.
    """

    def __init__(self, nodes: dict[int, tuple]):
        self.nodes = nodes  # (feature, threshold, left, right, cover, value) by node
        self.base = sum(n[5] * n[4] for n in nodes.values() if n[0] < 0) / nodes[0][4]

    def roots(self, rows: int) -> set[int]:
        """Nodes whose blocks cost least for so many rows, in about nanoseconds."""
        nodes, order, paths = self.nodes, [0], {0: frozenset()}
        for at in order:
            feature, _, left, right, _, _ = nodes[at]
            if feature >= 0:
                order += [left, right]
                paths[left] = paths[right] = paths[at] if feature in paths[at] else paths[at] | {feature}
        cost, below, roots = {}, {}, set()
        for at in reversed(order):
            feature, threshold, left, right, _, _ = nodes[at]
            parts, own = float("inf"), frozenset()
            if feature >= 0:
                parts = cost[left] + cost[right] + EDGE + 3 * rows
                if below[left] is not None and below[right] is not None:
                    own = below[left] | below[right] | {(feature, threshold)}
                else:
                    own = None
            below[at] = own
            whole = float("inf")
            if own is not None:
                bits, n = len(paths[at]) + len(own), len(paths[at].union(f for f, _ in own))
                if feature >= 0 and 1 << bits > MOST_PATTERNS:
                    below[at] = None
                else:
                    whole = BLOCK + n * (LOOKUP * rows + EACH * min(1 << bits, MOST_PATTERNS)) + 2 * rows * (1 + len(own))
            cost[at] = min(parts, whole)
            if whole <= parts:
                roots.add(at)
        return roots

    def steps(self, rows: int):
        """Depth first: (depth, feature, threshold, is_left, bit, is_new, block or None) of the edges down to the blocks."""
        nodes, roots = self.nodes, self.roots(rows)
        todo = [(0, 0, {}, None)]  # node, depth, {feature: (bit, z)} in bit order, the edge that leads to it
        while todo:
            node, depth, path, edge = todo.pop()
            feature, threshold, left, right, cover, _ = nodes[node]
            block = self.block(node, path) if node in roots else None
            if edge or block:
                yield depth, edge, block
            for child, is_left in ((right, False), (left, True)) if block is None else ():
                bit, z = path.get(feature, (len(path), 1.0))
                share = z * nodes[child][4] / cover
                todo.append((child, depth + 1, {**path, feature: (bit, share)}, (feature, threshold, is_left, bit, feature not in path)))

    def block(self, root: int, path: dict) -> Block:
        nodes, conditions, leaves = self.nodes, {}, []
        todo = [(root, {})]
        while todo:
            node, asked = todo.pop()
            feature, threshold, left, right, cover, value = nodes[node]
            if feature < 0:
                leaves.append((value, asked))
                continue
            bit = 1 << conditions.setdefault((feature, threshold), len(conditions))
            z, mask, want = asked.get(feature, (path.get(feature, (0, 1.0))[1], 0, 0))
            for child, is_left in ((right, False), (left, True)):
                # a condition met before on the path leaves the other child without rows: it asks for the bit both ways
                todo.append((child, {**asked, feature: (z * nodes[child][4] / cover, mask | bit, want | bit if is_left else want)}))
        return Block(path, list(conditions), leaves)

    def add(self, columns: np.ndarray, own: np.ndarray) -> None:
        """Add the attributions of rows, given by ``columns``, to ``own`` (both features x rows)."""
        rows = columns.shape[1]
        found, index = np.empty(rows), np.empty(rows, np.intp)
        at = [np.zeros(rows, np.uint64)]  # patterns of the current path, by depth
        room = np.empty((2, len(columns) * MOST_PATTERNS))  # of tables: new memory for each would cost more than its sums
        for depth, edge, block in self.steps(rows):
            if edge:
                feature, threshold, is_left, bit, is_new = edge
                follows = columns[feature] <= threshold
                if is_left != is_new:  # the rows whose bit is set, or to be cleared
                    np.logical_not(follows, out=follows)
                moved = follows.astype(np.uint64) << np.uint64(bit)
                at[depth:] = [at[depth - 1] | moved if is_new else at[depth - 1] & ~moved]
            if block is None or not block.features:
                continue
            np.copyto(index, at[depth], casting="unsafe")
            for i, (feature, threshold) in enumerate(block.conditions):
                index |= (columns[feature] <= threshold).astype(np.intp) << (block.first + i)
            pattern = index
            if 1 << block.bits > MOST_PATTERNS:
                met, pattern = np.unique(index, return_inverse=True)
                table = shares(block, room, met)
            else:
                table = shares(block, room)
            for j, f in enumerate(block.features):
                np.take(table[j], pattern, out=found, mode="clip")
                own[f] += found


def shares(block: Block, room: np.ndarray, patterns: np.ndarray | None = None) -> np.ndarray:
    """Attributions (features x patterns) of a block's features for each of ``patterns`` (all unless given, then in ``room``)."""
    t, weights = _points(block.points)
    missed, held, kept = -1 / (1 - t), len(block.held), len(block.kept)
    # the features split on in the block, by pattern of their bits: leaves x features x patterns x points
    z = block.own_z[:, :, None, None]
    follows = (np.arange(1 << held + len(block.conditions)) & block.mask[:, :, None]) == block.want[:, :, None]
    follows = follows[..., None]
    left_out = z * (1 - t)
    met = left_out + t
    product = np.where(follows, met, left_out).prod(axis=1) * (block.values[:, None, None] * weights)
    total = product.sum(axis=0)  # patterns x points
    own = (np.where(follows, (1 - z) / met, missed) * product[:, None]).sum(axis=0)  # features x patterns x points
    # the path's other features: points x patterns
    left_out = block.z[:, None] * (1 - t)
    met = left_out + t
    if patterns is None:
        bits = _bits(kept)
        product = np.ones((len(t), 1))
        for j in range(kept):
            product = np.concatenate([product * left_out[j][:, None], product * met[j][:, None]], axis=1)
    else:
        bits = (patterns >> np.array(block.kept, np.int64)[:, None] & 1).astype(bool)
        product = np.where(bits[:, None], met[:, :, None], left_out[:, :, None]).prod(axis=0)
    each = np.where(bits[:, None], ((1 - block.z)[:, None] / met)[:, :, None], missed[:, None]) * product  # features x points x patterns
    if patterns is not None:
        place = patterns >> block.first << held
        for i, bit in enumerate(block.held):
            place |= (patterns >> bit & 1) << i
        return np.concatenate([(each * total[place].T).sum(axis=1), (own[:, place] * product.T).sum(axis=2)])
    shape = (kept + len(block.own), len(total), product.shape[1])
    out = room[0, :math.prod(shape)].reshape(shape)
    np.matmul(total, each, out=out[:kept])
    np.matmul(own, product, out=out[kept:])
    if held:  # bits back in the order of the path, the first bit last
        by_place = [*reversed(range(block.first, block.bits)), *reversed(block.held), *reversed(block.kept)]
        moved = out.reshape(-1, *[2] * block.bits).transpose(0, *(1 + by_place.index(b) for b in reversed(range(block.bits))))
        out = room[1, :out.size].reshape(moved.shape)
        np.copyto(out, moved)
    return out.reshape(shape[0], -1)


@lru_cache(maxsize=None)
def _points(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre points of 0..1 and their weights."""
    points, weights = np.polynomial.legendre.leggauss(max(1, n))
    return (points + 1) / 2, weights / 2


@lru_cache(maxsize=16)
def _bits(n: int) -> np.ndarray:
    """Whether a bit is set (bits x patterns)."""
    return (np.arange(1 << n) >> np.arange(n)[:, None] & 1).astype(bool)


def attributions(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    columns, out = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1])
    for tree in trees:
        tree.add(columns, out)
    return np.ascontiguousarray(out.T)


def trees_of(classifier) -> list[Tree]:
    """The classifier's trees, from its node table (as large as the model)."""
    table, path = node_table(classifier)
    found: dict[int, dict[int, tuple]] = {}
    for r in table.collect():
        found.setdefault(r["tree"], {})[r["id"]] = (r["feature"], r["threshold"], r["left"], r["right"], r["cover"], r["value"])
    drop_path(SparkSession.getActiveSession(), path)
    return [Tree(found[t]) for t in sorted(found)]


def tree_shap(flow: PipelineModel, rows: DataFrame, id_col: str, names: list[str]) -> tuple[DataFrame, float]:
    """((id, feature, x, contribution, p), base) for every row and feature: a row's contributions add up to its
    probability (its log odds for boosting) less ``base``, the expected value over the training weight."""
    trees = trees_of(flow.stages[-1])
    sent = rows.sparkSession.sparkContext.broadcast(trees)  # as large as the model
    p = vector_to_array(F.col("probability"))[1]
    # a task computes the tables of all blocks: one task a core, and more only if rows wouldn't fit a chunk
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(cores * max(1, math.ceil(rows.count() / (cores * ROWS))))
    scored = flow.transform(rows).select(F.col(id_col).cast("string").alias(id_col), vector_to_array("features").alias("x"),
                                         p.alias("p"))

    def f(batches):
        held, n = [], 0
        for b in chain(batches, [None]):  # batches are joined: the tables are computed once a chunk
            if b is not None:
                held, n = [*held, b], n + b.num_rows
            if n >= ROWS or (b is None and n):
                table, held, n = pa.Table.from_batches(held).combine_chunks(), [], 0
                for part in table.to_batches(max_chunksize=2 * ROWS):
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                    phi = attributions(flat.reshape(part.num_rows, -1), sent.value)
                    own = pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, phi.shape[1], dtype=np.int32)), pa.array(phi.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, own], names=[id_col, "x", "p", "phi"])

    found = scored.mapInArrow(f, f"{id_col} string, x array<double>, p double, phi array<double>")
    each = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("x"), F.col("phi").alias("contribution"))
    found = found.select(id_col, "p", F.explode(each).alias("e"))
    return found.select(id_col, "e.feature", "e.x", "e.contribution", "p"), float(sum(t.base for t in trees))
