"""Extremely randomised regression trees, all trees of all folds grown level by level from mergeable statistics.

A level takes two passes over the rows. The first finds the smallest and largest value of every feature in every open node; where
these meet, a share of the features that vary there gets a cut drawn uniformly between both ends. The second adds up counts and
targets left of every cut; where they meet, the cut that lowers the squared error most (over all targets) wins. Draws are hashes
of (seed, tree, node, feature), so trees do not depend on how rows are partitioned or on retries.

Rows stay where they are: tasks send one matrix per block of trees, and the trees grown so far, the only thing that is broadcast,
are kept below TREE_BYTES by growing the ensemble in portions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import hash_rank
from ..session import durable
from .stats import unpivot

TREE_BYTES = 64 * 1024 * 1024
TREES_A_GROUP = 32
LEAF, OPEN = -1, -2


def uniform(*parts) -> np.ndarray:
    """Numbers in [0, 1) from integers, by the splitmix64 finaliser over their chain."""
    with np.errstate(over="ignore"):
        state = np.uint64(0x9E3779B97F4A7C15)
        for part in parts:
            x = (state ^ np.asarray(part, dtype=np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            state = x ^ (x >> np.uint64(31))
    return (state >> np.uint64(11)).astype(np.float64) / (1 << 53)


class Tree:
    """Growing arrays of one tree; node 0 is the root."""

    def __init__(self, targets: int):
        self.feature, self.cut = np.array([OPEN]), np.zeros(1)
        self.left, self.right = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.value = np.zeros((1, targets))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf or open node that each row is in."""
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.arange(len(x))
        while len(moving):
            moving = moving[self.feature[at[moving]] >= 0]
            node = at[moving]
            at[moving] = np.where(x[moving, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return at

    def grow(self, nodes: np.ndarray, features: np.ndarray, cuts: np.ndarray, values: np.ndarray) -> None:
        """Close the open nodes: feature LEAF makes a leaf, another one two open children."""
        split = features >= 0
        fresh = len(self.feature) + 2 * np.arange(split.sum())
        self.feature[nodes], self.cut[nodes], self.value[nodes] = features, cuts, values
        self.left[nodes[split]], self.right[nodes[split]] = fresh, fresh + 1
        more = 2 * split.sum()
        pad = lambda a, v: np.concatenate([a, np.full((more, *a.shape[1:]), v, dtype=a.dtype)])
        self.feature, self.cut, self.left, self.right, self.value = pad(self.feature, OPEN), pad(self.cut, 0), pad(self.left, 0), pad(self.right, 0), pad(self.value, 0)


def cuts_for(low: np.ndarray, high: np.ndarray, tree: np.ndarray, node: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Cuts of the chosen features of each node, NaN elsewhere. Features without spread are never chosen."""
    n, width = low.shape
    wanted = max(1, int(share * width))
    column = np.arange(width)[None, :]
    order = uniform(seed, tree[:, None], node[:, None], 2 * column)
    order = np.where(high > low, order, 2.0)
    chosen = (np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1, kind="stable") < wanted) & (high > low)
    cut = low + uniform(seed, tree[:, None], node[:, None], 2 * column + 1) * (high - low)
    return np.where(chosen, np.minimum(cut, np.nextafter(high, low)), np.nan)


def best_cuts(total: np.ndarray, left: np.ndarray, cuts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut and mean of each node. ``total`` is (n, sums, squares) per node, ``left`` (n, sums) per node and feature."""
    targets = left.shape[2] - 1
    n, sums, squares = total[:, 0], total[:, 1 : 1 + targets], total[:, 1 + targets :]
    mean = sums / n[:, None]
    scatter = np.maximum(squares - sums * mean, 0.0).sum(axis=1)
    pure = scatter <= 1e-12 * np.maximum(squares.sum(axis=1), 1e-300)
    nl, sl = left[:, :, 0], left[:, :, 1:]
    nr, sr = n[:, None] - nl, sums[:, None, :] - sl
    valid = ~np.isnan(cuts) & (nl >= least) & (nr >= least)
    gain = (sl**2).sum(axis=2) / np.maximum(nl, 1) + (sr**2).sum(axis=2) / np.maximum(nr, 1)
    gain = np.where(valid, gain, -np.inf)
    best = gain.argmax(axis=1)
    stop = pure | ~valid.any(axis=1)
    return np.where(stop, LEAF, best), np.where(stop, 0.0, cuts[np.arange(len(n)), best]), mean


def _runs(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(node, kind="stable")
    return order, np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]]) if len(node) else np.zeros(0, dtype=int)


def _pass(rows: DataFrame, of_tree: Callable, finish: Callable, trees: range) -> dict[int, tuple]:
    """One pass: ``of_tree(tree, x, y, fold)`` gives (nodes, matrix) of a task's rows; ``finish`` merges a group of trees and answers per node."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, folds = [], [], []
        for batch in batches:
            if batch.num_rows:
                get = lambda name: np.asarray(batch.column(name).flatten()).reshape(batch.num_rows, -1)
                xs.append(get("x"))
                ys.append(get("y"))
                folds.append(np.asarray(batch.column("fold")))
        if not xs:
            return
        x, y, fold = np.concatenate(xs), np.concatenate(ys), np.concatenate(folds)
        for start in range(trees.start, trees.stop, TREES_A_GROUP):
            found = [(t, *of_tree(t, x, y, fold)) for t in range(start, min(start + TREES_A_GROUP, trees.stop))]
            found = [f for f in found if len(f[1])]
            if found:
                keys = np.concatenate([np.c_[np.full(len(n), t), n] for t, n, _ in found]).astype(np.int64)
                matrix = np.concatenate([m for _, _, m in found])
                yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(matrix).tobytes()], pa.binary())], names=["g", "keys", "matrix"])

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k.as_py(), dtype=np.int64).reshape(-1, 2) for k in table["keys"]])
        matrix = np.concatenate([np.frombuffer(m.as_py()) for m in table["matrix"]]).reshape(len(keys), -1)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, matrix = keys[order], matrix[order]
        heads = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        out = finish(keys[heads], matrix, heads)
        return pa.table({"g": pa.array([table["g"][0].as_py()], pa.int64()), "keys": pa.array([keys[heads].tobytes()], pa.binary()), "matrix": pa.array([np.ascontiguousarray(out).tobytes()], pa.binary())})

    schema = "g long, keys binary, matrix binary"
    answers: dict[int, tuple] = {}
    for r in rows.mapInArrow(partial, schema).groupBy("g").applyInArrow(merge, schema).collect():
        keys = np.frombuffer(bytes(r["keys"]), dtype=np.int64).reshape(-1, 2)
        matrix = np.frombuffer(bytes(r["matrix"])).reshape(len(keys), -1)
        for t in np.unique(keys[:, 0]):
            answers[int(t)] = keys[keys[:, 0] == t, 1], matrix[keys[:, 0] == t]
    return answers


def grow(rows: DataFrame, trees: range, per_fold: int, width: int, targets: int, share: float, least: int, seed: int) -> dict[int, Tree]:
    """The trees of ``rows`` (x, y, fold); tree t is trained on the rows outside fold t // per_fold."""
    context = rows.sparkSession.sparkContext
    grown = {t: Tree(targets) for t in trees}
    while any((tree.feature == OPEN).any() for tree in grown.values()):
        shared = context.broadcast(grown)

        def placed(t: int, x: np.ndarray, fold: np.ndarray, known: dict[int, Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Training rows in open nodes ordered by node, their nodes, and where each node starts."""
            tree = known[t]
            if not (tree.feature == OPEN).any():
                return (np.zeros(0, dtype=int),) * 3
            train = np.flatnonzero(fold != t // per_fold)
            node = tree.nodes(x[train])
            train, node = train[tree.feature[node] == OPEN], node[tree.feature[node] == OPEN]
            order, heads = _runs(node)
            return train[order], node[order], heads

        def extremes(t: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray, shared=shared) -> tuple[np.ndarray, np.ndarray]:
            pick, node, heads = placed(t, x, fold, shared.value)
            if not len(pick):
                return node, np.zeros((0, 2 * width))
            own = x[pick]
            return node[heads], np.c_[np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)]

        def draw(keys: np.ndarray, matrix: np.ndarray, heads: np.ndarray) -> np.ndarray:
            low, high = np.minimum.reduceat(matrix[:, :width], heads), np.maximum.reduceat(matrix[:, width:], heads)
            return cuts_for(low, high, keys[:, 0], keys[:, 1], share, seed)

        drawn = _pass(rows, extremes, draw, trees)
        given = context.broadcast(drawn)

        def sums(t: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray, shared=shared, given=given) -> tuple[np.ndarray, np.ndarray]:
            pick, node, heads = placed(t, x, fold, shared.value)
            size = 1 + 2 * targets + width * (1 + targets)
            if not len(pick):
                return node, np.zeros((0, size))
            nodes, cuts = given.value[t]
            low = x[pick] <= cuts[np.searchsorted(nodes, node)]  # never true where the cut is NaN
            ones, own = np.ones((len(pick), 1)), y[pick]
            total = np.add.reduceat(np.c_[ones, own, own * own], heads)
            left = np.add.reduceat((low[:, :, None] * np.c_[ones, own][:, None, :]).reshape(len(pick), -1), heads)
            return node[heads], np.c_[total, left]

        def choose(keys: np.ndarray, matrix: np.ndarray, heads: np.ndarray, given=given) -> np.ndarray:
            matrix = np.add.reduceat(matrix, heads)
            cuts = np.concatenate([given.value[t][1] for t in np.unique(keys[:, 0])])
            split = 1 + 2 * targets
            feature, cut, mean = best_cuts(matrix[:, :split], matrix[:, split:].reshape(len(keys), width, 1 + targets), cuts, least)
            return np.c_[feature, cut, mean]

        decided = _pass(rows, sums, choose, trees)
        shared.destroy()
        given.destroy()
        for t, tree in grown.items():
            if t in decided:
                nodes, answer = decided[t]
                tree.grow(nodes, answer[:, 0].astype(np.int64), answer[:, 1], answer[:, 2:])
            else:  # no training rows at all
                tree.feature[tree.feature == OPEN] = LEAF
    return grown


def learnability(features: DataFrame, parameters: DataFrame, names: list[str], folds: int, seed: int, trees: int = 300, share: float = 0.7, least: int = 2) -> DataFrame:
    """(parameter, r2, nrmse) of cross-validated extremely randomised trees for all varying parameters together.

    features(candidate_id, x), parameters(candidate_id, <names>). Folds are ranks of a seeded shuffle modulo ``folds``; each has ``trees`` trees of its own,
    with ``share`` of the features tried in a node and at least ``least`` rows in a leaf.
    """
    spark = features.sparkSession
    spans = parameters.agg(*[(F.max(n) - F.min(n)).alias(n) for n in names]).first()
    varying = [n for n in names if spans[n] is not None and spans[n] > 2.220446049250313e-16]
    if not varying:
        return spark.createDataFrame([], "parameter string, r2 double, nrmse double")
    joined = hash_rank(features.join(parameters, "candidate_id").withColumn("_g", F.lit(0)), ["_g"], seed, "candidate_id", "_r")
    rows = durable(joined.select("candidate_id", F.col("x").cast("array<double>").alias("x"), F.array(*[F.col(n).cast("double") for n in varying]).alias("y"), ((F.col("_r") - 1) % folds).cast("int").alias("fold")))
    count, width, *means = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), *[F.avg(F.get("y", F.lit(i))) for i in range(len(varying))]).first()
    targets = len(varying)
    centred = durable(rows.withColumn("y", F.zip_with("y", F.array(*[F.lit(m) for m in means]), lambda a, b: a - b)))
    portion = max(1, TREE_BYTES // (max(1, count) * (40 + 8 * targets)))
    whole, kind, predicted = folds * trees, dict(rows.dtypes)["candidate_id"], None
    for start in range(0, whole, portion):
        grown = grow(centred, range(start, min(start + portion, whole)), trees, width, targets, share, least, seed)
        shared = spark.sparkContext.broadcast(grown)

        def predict(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, fold = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column("fold"))
                out = np.zeros((batch.num_rows, targets))
                for t, tree in shared.value.items():
                    held = np.flatnonzero(fold == t // trees)
                    out[held] += tree.value[tree.nodes(x[held])] / trees
                offsets = pa.array(np.arange(batch.num_rows + 1) * targets, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("candidate_id"), batch.column("y"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["candidate_id", "y", "p"])

        part = durable(centred.mapInArrow(predict, f"candidate_id {kind}, y array<double>, p array<double>"))
        predicted = part if predicted is None else predicted.unionByName(part)
        shared.destroy()
    sums = predicted.groupBy("candidate_id").agg(F.first("y").alias("y"), *[F.sum(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(varying)])
    tall = unpivot(sums, ["candidate_id", "y"], varying).select("parameter", F.col("value").alias("p"), F.get("y", F.array_position(F.array(*[F.lit(n) for n in varying]), F.col("parameter")).cast("int") - 1).alias("y"))
    error = F.pow(F.col("y") - F.col("p"), F.lit(2))
    return tall.groupBy("parameter").agg(
        (F.lit(1.0) - F.sum(error) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"), (F.sqrt(F.avg(error)) / (F.max("y") - F.min("y"))).alias("nrmse"))


def learnability_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Median R2 and number of parameters with positive R2."""
    return rows.groupBy(*by).agg(F.median("r2").alias("median_r2"), F.count_if(F.col("r2") > 0).alias("positive"), F.count(F.lit(1)).alias("parameters"))
