"""Cross-validated logistic models against plain fits, one at a time."""

import hashlib

import numpy as np
import pytest

from specframe.operators import group_signal


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_folds(ids, label, k, seed):
    fold = {}
    for c in (0, 1):
        for rank, i in enumerate(sorted((i for i in ids if label[i] == c), key=lambda i: md5(f"{seed}:{i}"))):
            fold[i] = rank % k
    return fold


def plain_model(x, z, y, k, c, adjust):
    slopes = np.zeros((z.shape[1], x.shape[1]))
    if adjust:
        slopes = np.linalg.lstsq(np.c_[np.ones(len(z)), z], x, rcond=None)[0][1:]
    r = x - z @ slopes
    mean, sd = r.mean(axis=0), r.std(axis=0)
    groups = [r[y == g] for g in (0, 1)]
    between = sum(len(g) * (g.mean(axis=0) - mean) ** 2 for g in groups)
    within = sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in groups)
    keep = np.argsort(-between * (len(y) - 2) / within, kind="stable")[: k or None]
    balance = len(y) / (2 * np.bincount(y))[y]
    design = np.c_[((r - mean) / sd)[:, keep], np.ones(len(y))]
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(np.eye(len(w)) + c * design.T @ (design * (balance * p * (1 - p))[:, None]), w + c * design.T @ (balance * (p - y)))
    return lambda a, b: 1 / (1 + np.exp(-np.c_[((a - b @ slopes - mean) / sd)[:, keep], np.ones(len(a))] @ w))


def auc(score, y):
    a, b = score[y == 1][:, None], score[y == 0][None]
    return ((a > b) + 0.5 * (a == b)).mean()


@pytest.mark.parametrize("adjust", [False, True])
def test_equals_plain_fits(spark, adjust):
    rng = np.random.default_rng(6)
    n, d, repeats, outer, inner, seed = 90, 6, 2, 3, 2, 11
    y = (rng.random(n) < 0.4).astype(int)
    z = np.c_[rng.normal(40, 9, n), rng.integers(0, 2, n)]
    x = 5 + rng.normal(size=(n, d)) + y[:, None] * np.array([0.8, 0, 0.5, 0, 0, 0.2]) + z[:, :1] * 0.05
    u = x + rng.normal(size=(n, d)) * 0.5
    frame = lambda v: spark.createDataFrame([(i, int(y[i]), v[i].tolist(), z[i].tolist()) for i in range(n)], "entity_id long, label int, x array<double>, z array<double>")
    got = {r["repeat"]: r for r in group_signal.cv_group_signal(frame(x), frame(u), repeats, outer, inner, [2, 4, 50], [0.03, 3.0], seed, adjust=adjust).collect()}
    ids, label = list(range(n)), dict(enumerate(y))
    for r in range(repeats):
        fold, score = plain_folds(ids, label, outer, seed + r), np.zeros(n)
        for o in range(outer):
            train = [i for i in ids if fold[i] != o]
            part = plain_folds(train, label, inner, seed + 1000 + 100 * r + o)
            best, choice = -1.0, None
            for c in (0.03, 3.0):
                for k in (2, 4, 0):
                    values = []
                    for f in range(inner):
                        a, b = [i for i in train if part[i] != f], [i for i in train if part[i] == f]
                        values.append(auc(plain_model(x[a], z[a], y[a], k, c, adjust)(x[b], z[b]), y[b]))
                    if np.round(np.mean(values), 12) > best:
                        best, choice = np.round(np.mean(values), 12), (k, c)
            held = [i for i in ids if fold[i] == o]
            score[held] = plain_model(x[train], z[train], y[train], *choice, adjust)(u[held], z[held])
        high = score >= 0.5
        assert got[r]["roc_auc"] == pytest.approx(auc(score, y)) and got[r]["brier"] == pytest.approx(((score - y) ** 2).mean(), rel=1e-5)
        assert got[r]["balanced_accuracy"] == pytest.approx((high[y == 1].mean() + (~high[y == 0]).mean()) / 2)
