"""Distributed tree growing against trees grown one node at a time."""

import hashlib

import numpy as np
import pytest

from specframe.operators import tree_ensemble


def plain_tree(x, y, tree, share, least, seed):
    """{node: (feature, cut, left, right, mean)}, nodes numbered level by level."""
    out, level, fresh = {}, [(0, np.arange(len(x)))], 1
    while level:
        following = []
        for node, rows in level:
            own, target, choice = x[rows], y[rows], None
            if ((target - target.mean(axis=0)) ** 2).sum() > 1e-12 * (target**2).sum():
                spread = [j for j in range(x.shape[1]) if own[:, j].max() > own[:, j].min()]
                draw = {j: float(tree_ensemble.uniform(seed, tree, node, 2 * j)) for j in spread}
                for j in sorted(sorted(spread, key=lambda j: draw[j])[: max(1, int(share * x.shape[1]))]):
                    low, high = own[:, j].min(), own[:, j].max()
                    cut = min(low + float(tree_ensemble.uniform(seed, tree, node, 2 * j + 1)) * (high - low), np.nextafter(high, low))
                    side = own[:, j] <= cut
                    if min(side.sum(), (~side).sum()) >= least:
                        error = sum(((target[s] - target[s].mean(axis=0)) ** 2).sum() for s in (side, ~side))
                        if choice is None or error < choice[0] - 1e-12:
                            choice = (error, j, cut, side)
            if choice is None:
                out[node] = (-1, 0.0, 0, 0, target.mean(axis=0))
            else:
                _, j, cut, side = choice
                out[node] = (j, cut, fresh, fresh + 1, target.mean(axis=0))
                following += [(fresh, rows[side]), (fresh + 1, rows[~side])]
                fresh += 2
        level = following
    return out


def plain_prediction(tree, row):
    node = 0
    while tree[node][0] >= 0:
        node = tree[node][2] if row[tree[node][0]] <= tree[node][1] else tree[node][3]
    return tree[node][4]


@pytest.mark.parametrize("bytes_kept", [1 << 26, 4000])
def test_equals_plain_trees(spark, monkeypatch, bytes_kept):
    monkeypatch.setattr(tree_ensemble, "TREE_BYTES", bytes_kept)
    rng = np.random.default_rng(8)
    n, d, folds, trees, seed = 45, 5, 3, 7, 4
    x = np.round(rng.normal(size=(n, d)), 1)
    x[:, 4] = 1.0  # a feature without spread
    y = np.c_[x[:, 0] * 2 + rng.normal(size=n) * 0.1, np.where(x[:, 1] > 0, 3.0, 1.0)]
    features = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "candidate_id long, x array<double>").repartition(3)
    parameters = spark.createDataFrame([(i, float(y[i, 0]), float(y[i, 1]), 7.0) for i in range(n)], "candidate_id long, a double, b double, fixed double")
    got = {r["parameter"]: r for r in tree_ensemble.learnability(features, parameters, ["a", "fixed", "b"], folds, seed, trees).collect()}
    assert sorted(got) == ["a", "b"]
    fold = np.empty(n, dtype=int)
    fold[sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())] = np.arange(n) % folds
    centred, predicted = y - y.mean(axis=0), np.zeros_like(y)
    for t in range(folds * trees):
        train = fold != t // trees
        grown = plain_tree(x[train], centred[train], t, 0.7, 2, seed)
        for i in np.flatnonzero(~train):
            predicted[i] += plain_prediction(grown, x[i]) / trees
    for k, name in enumerate("ab"):
        error = ((centred[:, k] - predicted[:, k]) ** 2).sum()
        assert got[name]["r2"] == pytest.approx(1 - error / (centred[:, k] ** 2).sum()) and got[name]["r2"] > 0.2
        assert got[name]["nrmse"] == pytest.approx(np.sqrt(error / n) / np.ptp(y[:, k]))


def test_draws_are_even():
    u = tree_ensemble.uniform(3, np.arange(200)[:, None], np.arange(50)[None, :])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and len(np.unique(u)) == u.size
