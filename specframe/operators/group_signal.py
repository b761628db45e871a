"""Cross-validated group signal: all logistic models of all repeats, folds and grid points fitted in the same passes.

A model belongs to a training set: the rows of an outer fold's training part, or those less one inner fold. Scaling,
covariate slopes and F statistics of every training set come from co-moments per (repeat, outer fold, inner fold, label), inner training
sets by subtraction. A Newton step for all models is one pass: each task adds up gradients and curvatures of its rows, sums
meet by model, and the group solves its own step. The driver holds one weight per model and feature, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_running, hash_rank
from ..session import durable

ALL = 0  # as a number of selected features: every one


def _key(seed, *parts):
    return F.md5(F.concat_ws(":", (F.lit(seed) + sum(parts[:-1], F.lit(0))).cast("string"), parts[-1].cast("string")).cast("binary"))


def fold_cells(people: DataFrame, repeats: int, outer: int, inner: int, seed: int) -> DataFrame:
    """(entity_id, cells): for each repeat and outer fold the entity's inner fold, -1 where the fold holds it out.

    Folds are stratified: rank modulo the number of folds in a seeded shuffle (seed + repeat; inner: seed + 1000 + 100 repeat + outer).
    """
    each = people.select("entity_id", "label", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("r"))
    folded = hash_rank(each, ["r", "label"], seed, "entity_id", "_n", key=_key(seed, F.col("r"), F.col("entity_id")))
    tall = folded.select("entity_id", "label", "r", ((F.col("_n") - 1) % outer).alias("fold"), F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("o"))
    inside = hash_rank(tall.where("fold <> o"), ["r", "o", "label"], seed, "entity_id", "_n", key=_key(seed + 1000, F.col("r") * 100, F.col("o"), F.col("entity_id")))
    cells = inside.select("entity_id", "r", "o", ((F.col("_n") - 1) % inner).cast("int").alias("c")).unionByName(tall.where("fold = o").select("entity_id", "r", "o", F.lit(-1).alias("c")))
    ordered = F.array_sort(F.collect_list(F.struct("r", "o", "c")))
    return cells.groupBy("entity_id").agg(F.transform(ordered, lambda x: x["c"]).alias("cells"))


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {}
    for name in batch.schema.names:
        column = batch.column(name)
        if pa.types.is_list(column.type):
            out[name] = np.asarray(column.flatten()).reshape(batch.num_rows, -1)
        elif name != "entity_id":
            out[name] = np.asarray(column)
    return out


def _summed(rows: DataFrame, function: Callable, finish: Callable | None = None) -> dict[int, np.ndarray]:
    """Sums by key of the vectors that ``function(arrays)`` yields; ``finish(key, sum)`` runs where the sums meet."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, vector in function(_arrays(batch)):
                    held[key] = held[key] + vector if key in held else vector
        keys = list(held)
        flat = [held[k] for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([v.tolist() for v in flat], pa.list_(pa.float64()))], names=["k", "v"])

    def merge(table: pa.Table) -> pa.Table:
        width = len(table["v"][0].as_py())
        total = np.asarray(table["v"].combine_chunks().flatten()).reshape(-1, width).sum(axis=0)
        key = table["k"][0].as_py()
        out = total if finish is None else finish(key, total)
        return pa.table({"k": pa.array([key], pa.int64()), "v": pa.array([out.tolist()], pa.list_(pa.float64()))})

    schema = "k long, v array<double>"
    return {r["k"]: np.array(r["v"]) for r in rows.mapInArrow(partial, schema).groupBy("k").applyInArrow(merge, schema).collect()}


class Plan:
    """Training sets and what was fitted on each: slopes, mean, scale and the order of features by F."""

    def __init__(self, outer_sets: int, inner: int, shift_x: np.ndarray, shift_z: np.ndarray):
        self.outer_sets, self.inner, self.shift_x, self.shift_z = outer_sets, inner, shift_x, shift_z
        self.sets: dict[int, dict] = {}

    def number(self, outer_set: int, inner_fold: int) -> int:
        """Inner training sets leave out an inner fold; ``inner_fold`` -1 is the whole outer training set."""
        return outer_set * (self.inner + 1) + inner_fold + 1

    def of(self, number: int) -> tuple[int, int]:
        return number // (self.inner + 1), number % (self.inner + 1) - 1

    def design(self, x: np.ndarray, z: np.ndarray, number: int) -> np.ndarray:
        """Adjusted and scaled features of a training set, with a column of ones."""
        s = self.sets[number]
        out = (x - self.shift_x - (z - self.shift_z) @ s["slopes"] - s["mean"]) / s["scale"]
        return np.concatenate([out, np.ones((len(out), 1))], axis=1)

    def fit(self, moments: dict[int, np.ndarray], width: int, covariates: int) -> None:
        """``moments`` by cell (outer set, inner fold, label): n, sum x, sum x^2, sum z, sum z z', sum z x."""
        def cell(o: int, i: int, c: int) -> np.ndarray:
            return moments.get((o * self.inner + i) * 2 + c, np.zeros(1 + 2 * width + covariates * (1 + covariates + width)))

        for o in range(self.outer_sets):
            whole = [sum(cell(o, i, c) for i in range(self.inner)) for c in (0, 1)]
            for i in range(-1, self.inner):
                both = [whole[c] - (cell(o, i, c) if i >= 0 else 0.0) for c in (0, 1)]
                self.sets[self.number(o, i)] = self._solve(both, width, covariates)

    @staticmethod
    def _solve(both: list[np.ndarray], width: int, covariates: int) -> dict:
        cuts = np.cumsum([1, width, width, covariates, covariates * covariates])
        (n0, x0, q0, z0, zz0, zx0), (n1, x1, q1, z1, zz1, zx1) = (np.split(v, cuts) for v in both)
        n, sx, sq, sz = n0 + n1, x0 + x1, q0 + q1, z0 + z1
        zz, zx = (zz0 + zz1).reshape(covariates, covariates), (zx0 + zx1).reshape(covariates, width)
        slopes = np.zeros((0, width))
        if covariates:
            slopes = np.linalg.lstsq(zz - np.outer(sz, sz) / n, zx - np.outer(sz, sx) / n, rcond=None)[0]
        sums = [x - z @ slopes for x, z in ((x0, z0), (x1, z1))]
        squares = sq - 2 * (slopes * zx).sum(axis=0) + (slopes * (zz @ slopes)).sum(axis=0)
        mean = (sums[0] + sums[1]) / n
        scatter = np.maximum(squares - n * mean**2, 0.0)
        between = sum(s**2 / np.maximum(k, 1) for s, k in zip(sums, (n0, n1))) - n * mean**2
        within = np.maximum(scatter - between, 0.0)
        scale = np.sqrt(scatter / n)
        flat = scale <= 1e-12 * (1.0 + np.abs(mean))
        f = np.divide(between * (n - 2), within, out=np.where(flat, -1.0, np.inf), where=(within > 0) & ~flat)
        balance = np.array([n[0] / (2 * max(n0[0], 1.0)), n[0] / (2 * max(n1[0], 1.0))])
        return {"slopes": slopes, "mean": mean, "scale": np.where(flat, 1.0, scale), "order": np.argsort(-f, kind="stable"), "balance": balance}

    def kept(self, number: int, k: int) -> np.ndarray:
        order = self.sets[number]["order"]
        return np.sort(order if k == ALL else order[:k])


def newton(rows: DataFrame, plan: Plan, models: list[tuple[int, int, float]], iterations: int, tolerance: float = 1e-8) -> np.ndarray:
    """Weights (models x (features + 1), the last one the constant) of penalised, class-balanced logistic fits.

    A model is (training set, number of features, C): minimise w'w / 2 + C sum(balance x log loss), constant included. A step that raises
    the loss is halved. Models whose gradient is within ``tolerance`` of the start's are done and take no part in later passes.
    """
    context = rows.sparkSession.sparkContext
    width = len(plan.shift_x)
    weights = np.zeros((len(models), width + 1))
    kept = [np.r_[plan.kept(t, k), width] for t, k, _ in models]
    state = [{"loss": np.inf, "step": None, "from": None, "scale": None} for _ in models]
    active = list(range(len(models)))
    for _ in range(iterations):
        if not active:
            break
        shared = context.broadcast((plan, models, kept, weights, active))

        def sums(a: dict, shared=shared) -> Iterator[tuple[int, np.ndarray]]:
            p, models, kept, w, active = shared.value
            by_set: dict[int, list[int]] = {}
            for m in active:
                by_set.setdefault(models[m][0], []).append(m)
            for number, members in by_set.items():
                outer_set, left_out = p.of(number)
                cell = a["cells"][:, outer_set]
                inside = (cell >= 0) & (cell != left_out)
                if not inside.any():
                    continue
                x, y = p.design(a["x"][inside], a["z"][inside], number), a["label"][inside]
                balance = p.sets[number]["balance"][y]
                for m in members:
                    own = x[:, kept[m]]
                    score = own @ w[m, kept[m]]
                    chance = 0.5 * (1.0 + np.tanh(0.5 * score))
                    loss = (balance * (np.logaddexp(0.0, score) - y * score)).sum()
                    curve = own.T @ (own * (balance * chance * (1.0 - chance))[:, None])
                    yield m, np.r_[loss, own.T @ (balance * (chance - y)), curve.ravel()]

        def step(m: int, total: np.ndarray, shared=shared) -> np.ndarray:
            _, models, kept, w, _ = shared.value
            c, own = models[m][2], w[m, kept[m]]
            d = len(own)
            gradient = own + c * total[1 : d + 1]
            move = np.linalg.solve(np.eye(d) + c * total[d + 1 :].reshape(d, d), gradient)
            return np.r_[0.5 * own @ own + c * total[0], np.abs(gradient).max(), move]

        found = _summed(rows, sums, step)
        still = []
        for m in active:
            loss, gradient, move, s = found[m][0], found[m][1], found[m][2:], state[m]
            s["scale"] = gradient if s["scale"] is None else s["scale"]
            if loss > s["loss"] + 1e-12 * abs(loss) and np.abs(s["step"]).max() > 1e-12:
                s["step"] = s["step"] / 2
                weights[m, kept[m]] = s["from"] - s["step"]
                still.append(m)
            elif gradient > tolerance * max(1.0, s["scale"]):
                s.update(loss=loss, step=move, **{"from": weights[m, kept[m]].copy()})
                weights[m, kept[m]] = s["from"] - move
                still.append(m)
        active = still
        shared.destroy()
    return weights


def scored(rows: DataFrame, plan: Plan, models: list[tuple[int, int, float]], weights: np.ndarray, features: str, held_out: bool) -> DataFrame:
    """(m, score, label) of each model on the rows its training set leaves out: the inner fold, or with ``held_out`` the outer one."""
    shared = rows.sparkSession.sparkContext.broadcast((plan, models, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, models, w = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            a = _arrays(batch)
            for m, (number, _, _) in enumerate(models):
                outer_set, left_out = p.of(number)
                pick = a["cells"][:, outer_set] == (-1 if held_out else left_out)
                if pick.any():
                    score = p.design(a[features][pick], a["z"][pick], number) @ w[m]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), m)), pa.array(0.5 * (1.0 + np.tanh(0.5 * score))), pa.array(a["label"][pick].astype(np.int32))], names=["m", "score", "label"])

    return rows.mapInArrow(run, "m long, score double, label int")


def grouped_metrics(scores: DataFrame, by: str) -> DataFrame:
    """Per group of scores(by, score, label): ROC AUC with mid-ranks, balanced accuracy at 0.5, Brier score."""
    counted = scores.groupBy(by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    ranked = global_running(counted, [F.col("score").asc()], {"cum_neg": "neg"}, [by])
    high, score = F.col("score") >= 0.5, F.col("score")
    pos, neg = F.sum("pos"), F.sum("neg")
    return ranked.groupBy(by).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * 0.5)), pos * neg.cast("double")).alias("roc_auc"),
        ((F.try_divide(F.sum(F.when(high, F.col("pos")).otherwise(0)), pos) + F.try_divide(F.sum(F.when(high, 0).otherwise(F.col("neg"))), neg)) / 2.0).alias("balanced_accuracy"),
        ((F.sum(F.pow(score - 1.0, F.lit(2)) * F.col("pos")) + F.sum(F.pow(score, F.lit(2)) * F.col("neg"))) / (pos + neg)).alias("brier"))


def cv_group_signal(fit: DataFrame, unseen: DataFrame, repeats: int, outer: int, inner: int, top_k: list[int], strengths: list[float], seed: int, iterations: int = 3000, adjust: bool = False) -> DataFrame:
    """(repeat, roc_auc, balanced_accuracy, brier) of class-balanced logistic models trained on fit halves, scored on unseen halves.

    fit/unseen(entity_id, label 0 or 1, x array[, z array]). ``top_k`` are numbers of features by F statistic (those below the number of
    features count; ``ALL`` always may), ``strengths`` are values of C. Inner folds choose both by mean AUC, the first of equal ones in the
    order (C, number). With ``adjust`` the linear effects of z, fitted on the training rows, are removed.
    """
    z = F.col("z") if adjust else F.array().cast("array<double>")
    people = fit.select("entity_id", F.col("label").cast("int").alias("label"), F.col("x").cast("array<double>").alias("x"), z.cast("array<double>").alias("z"))
    other = unseen.select("entity_id", F.col("x").cast("array<double>").alias("unseen"))
    rows = durable(people.join(other, "entity_id").join(fold_cells(people, repeats, outer, inner, seed), "entity_id"))

    def first(a: dict) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, np.r_[len(a["x"]), a["x"].sum(axis=0), a["z"].sum(axis=0)]

    whole = _summed(rows, first)
    if not whole:
        return rows.sparkSession.createDataFrame([], "repeat int, roc_auc double, balanced_accuracy double, brier double")
    covariates = rows.select(F.size("z")).first()[0]
    mean = whole[0][1:] / whole[0][0]
    width = len(mean) - covariates
    plan = Plan(repeats * outer, inner, mean[:width], mean[width:])
    shift_x, shift_z = plan.shift_x, plan.shift_z

    def moments(a: dict) -> Iterator[tuple[int, np.ndarray]]:
        x, z = a["x"] - shift_x, a["z"] - shift_z
        for o in range(a["cells"].shape[1]):
            code = np.where(a["cells"][:, o] < 0, -1, (o * inner + a["cells"][:, o]) * 2 + a["label"])
            for key in np.unique(code[code >= 0]):
                u, v = x[code == key], z[code == key]
                yield int(key), np.r_[len(u), u.sum(axis=0), (u * u).sum(axis=0), v.sum(axis=0), (v.T @ v).ravel(), (v.T @ u).ravel()]

    plan.fit(_summed(rows, moments), width, covariates)
    grid = [(k, c) for c in strengths for k in [*[k for k in top_k if k != ALL and k < width], ALL]]
    trials = [(plan.number(o, i), k, c) for o in range(repeats * outer) for i in range(inner) for k, c in grid]
    aucs = {r["m"]: r["roc_auc"] for r in grouped_metrics(scored(rows, plan, trials, newton(rows, plan, trials, iterations), "x", False), "m").select("m", "roc_auc").collect()}
    chosen = []
    for o in range(repeats * outer):
        means = [np.mean([aucs.get((o * inner + i) * len(grid) + g) or 0.0 for i in range(inner)]) for g in range(len(grid))]
        chosen.append((plan.number(o, -1), *grid[int(np.argmax(np.round(means, 12)))]))
    final = scored(rows, plan, chosen, newton(rows, plan, chosen, iterations), "unseen", True)
    by_repeat = final.select(F.floor(F.col("m") / outer).cast("int").alias("repeat"), "score", "label")
    return grouped_metrics(by_repeat, "repeat").select("repeat", "roc_auc", "balanced_accuracy", "brier")
