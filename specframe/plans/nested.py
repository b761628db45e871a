"""Nested evaluation with the outer fold as a key: every fold's fits come from the same passes.

Statistics are taken once per fold; those of a training set are the merged statistics of the other folds. Both sides of a distance are
scaled alike, so a fold's scaling, coordinate selection and block weights reduce to one weight per coordinate, and all folds
and temperatures score the same tiles of entities and states.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..functions.packing import declared_axis, dense
from ..functions.quantiles import exact_quantiles
from ..operators import features, scoring, tiled
from ..session import durable, small_side


def _others(parts: DataFrame, count: int, values: list[str]) -> DataFrame:
    """Statistics of all folds but one: parts(fold, block, coord, n, m_<v>, s_<v>_<w>) merged for every ``outer`` fold.

    s_<v>_<w> are centred co-moment sums; merging adds n x the product of the parts' distances from the merged means.
    """
    keys = ["outer", "block", "coord"]
    spread = parts.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).where(F.col("outer") != F.col("fold"))
    whole = Window.partitionBy(*keys)
    total = F.sum("n").over(whole)
    spread = spread.withColumns({f"whole_{v}": F.sum(F.col("n") * F.col(f"m_{v}")).over(whole) / total for v in values})
    off = lambda v: F.col(f"m_{v}") - F.col(f"whole_{v}")
    pairs = [(v, w) for i, v in enumerate(values) for w in values[i:]]
    return spread.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.first(f"whole_{v}").alias(f"m_{v}") for v in values],
                                     *[F.sum(F.col(f"s_{v}_{w}") + F.col("n") * off(v) * off(w)).alias(f"s_{v}_{w}") for v, w in pairs])


def _fold_parts(rows: DataFrame, values: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    pairs = [(v, w) for i, v in enumerate(values) for w in values[i:]]
    return rows.groupBy("fold", "block", "coord").agg(n.alias("n"), *[F.avg(v).alias(f"m_{v}") for v in values], *[(F.covar_pop(v, w) * n).alias(f"s_{v}_{w}") for v, w in pairs])


def fold_settings(rows: DataFrame, count: int, weights: dict[str, float], selection: tuple[float, dict[str, int], int] | None = None) -> DataFrame:
    """(outer, block, coord, mean, scale, w) fitted without the fold ``outer``; ``w`` is 0 for coordinates that are not selected.

    ``selection`` is (reliability threshold, most coordinates per block, fewest), fitted between segments rel_a and rel_b.
    """
    fit = _others(_fold_parts(rows.where("segment = 'fit'"), ["value"]), count, ["value"])
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("s_value_value") / (F.col("n") - 1)))
    scaled = fit.select("outer", "block", "coord", F.col("m_value").alias("mean"), sd.alias("sd"))
    floors = scaled.groupBy("outer", "block").agg(F.coalesce(F.percentile(F.when(F.col("sd") > 0, F.col("sd")), 0.1) * 0.1, F.lit(1.0)).alias("floor"))
    scaled = scaled.join(floors, ["outer", "block"]).withColumn("scale", F.when(F.col("sd") > F.col("floor"), F.col("sd")).otherwise(F.col("floor")))
    if selection is None:
        chosen = scaled.withColumn("used", F.lit(1))
    else:
        threshold, most, fewest = selection
        pairs = features.paired_segments(rows, "rel_a", "rel_b", ["entity_id", "fold", "block", "coord"]).where("x IS NOT NULL AND y IS NOT NULL")
        both = _others(_fold_parts(pairs, ["x", "y"]), count, ["x", "y"])
        constant = (F.col("s_x_x") <= 0) | (F.col("s_y_y") <= 0)
        r = F.when(constant, F.lit(float("-inf"))).otherwise(F.try_divide(F.col("s_x_y"), F.sqrt(F.col("s_x_x") * F.col("s_y_y"))))
        reliability = both.select("outer", "block", "coord", r.alias("r"))
        kept = [features.select_reliable(reliability.where(F.col("block") == b), threshold, k, fewest, ["outer", "block"]) for b, k in most.items()]
        used = reduce(DataFrame.unionByName, kept).select("outer", "block", "coord", F.lit(1).alias("used"))
        chosen = scaled.join(used, ["outer", "block", "coord"], "left")
    size = F.sum("used").over(Window.partitionBy("outer", "block"))
    block_weight = F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("block"))
    w = F.when(F.col("used") == 1, block_weight / size / (F.col("scale") * F.col("scale"))).otherwise(0.0)
    return chosen.select("outer", "block", "coord", "mean", "scale", w.alias("w"))


def _weighted(w, a, b) -> Column:
    return F.aggregate(F.zip_with(w, F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda k, d: k * d), F.lit(0.0), lambda s, v: s + v)


def _score(left: tiled.Side, bank: tiled.Side, kinds: dict[str, str], weight: dict[int, list[float]], variants: list[tuple[int, float]], held: bool) -> DataFrame:
    """(entity_id, variant, s, pred, best_f, oracle): posterior sums of each (outer fold, temperature) for the rows that the fold holds out, or trains on."""
    schema = f"entity_id {kinds['entity_id']}, variant int, m double, s double, best string, best_f array<double>, pred array<double>, oracle double"
    table = {o: np.array(w) for o, w in weight.items()}

    def parts(entities: dict, states: dict) -> Iterator[pa.RecordBatch]:
        fold = entities["fold"].ravel().astype(int)
        for outer in sorted({o for o, _ in variants}):
            mine = np.flatnonzero((fold == outer) == held)
            root = np.sqrt(table[outer])
            scaled, spread = states["f"] * root, states["v"] @ table[outer]
            step = max(1, tiled.CELLS // max(1, states["n"]))
            for start in range(0, len(mine), step):
                pick = mine[start : start + step]
                cost = tiled.squared(entities["fit"][pick] * root, scaled) + spread[None, :] + states["prior"].ravel()[None, :]
                oracle = tiled.squared(entities["unseen"][pick] * root, scaled).min(axis=1)
                for number, (o, temperature) in enumerate(variants):
                    if o != outer:
                        continue
                    logit = -0.5 * cost / temperature
                    best, m = logit.argmax(axis=1), logit.max(axis=1)
                    e = np.exp(logit - m[:, None])
                    yield pa.RecordBatch.from_arrays([
                        entities["entity_id"].take(pa.array(pick)), pa.array(np.full(len(pick), number), pa.int32()), pa.array(m), pa.array(e.sum(axis=1)), states["state_id"].take(pa.array(best)).cast(pa.string()),
                        tiled.lists(states["f"][best]), tiled.lists(e @ states["f"]), pa.array(oracle)], names=[c.split()[0] for c in schema.split(", ")])

    grouped = tiled.reduce_tiles(left, bank, parts, schema).groupBy("entity_id", "variant").agg(F.collect_list(F.struct("m", "s", "best", "best_f", "pred", "oracle")).alias("p"))
    grouped = grouped.withColumn("m", F.array_max(F.transform("p", lambda x: x["m"]))).withColumn("p", F.transform("p", lambda x: x.withField("k", F.exp(x["m"] - F.col("m")))))
    s = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["s"] * x["k"])
    first = F.transform(F.element_at("p", 1)["pred"], lambda v: v * F.element_at("p", 1)["k"])
    pred = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), first, lambda a, x: F.zip_with(a, x["pred"], lambda u, v: u + v * x["k"]))
    best = F.array_min(F.transform("p", lambda x: F.struct((-x["m"]).alias("m"), x["best"].alias("best"), x["best_f"].alias("best_f"))))
    summed = grouped.select("entity_id", "variant", s.alias("s"), pred.alias("pred"), best["best_f"].alias("best_f"), F.array_min(F.transform("p", lambda x: x["oracle"])).alias("oracle"))
    return summed.withColumn("pred", F.transform("pred", lambda v: v / F.col("s")))


def nested_evaluation(raw: DataFrame, bank: DataFrame, params: DataFrame, theta: list[str], prior: DataFrame, folds: DataFrame, count: int,
                      multipliers: list[float], weights: dict[str, float], selection: tuple[float, dict[str, int], int] | None = None, minimum: float = 1e-4) -> DataFrame:
    """Out-of-fold scores: per outer fold, scaling, coordinate selection, temperature and pooled mean are refitted on the other folds.

    raw(entity_id, grp, segment, block, coord, value), bank(candidate_id, state_id, replicate, block, coord, value), folds(entity_id, fold). Each
    entity appears once, in the fold that held it out. The driver holds the folds' weights and temperatures only.
    """
    placed = folds.select("entity_id", F.col("fold").cast("int").alias("fold"))
    rows = durable(raw.join(placed, "entity_id"))
    settings = durable(fold_settings(rows, count, weights, selection))
    arrays = F.array_sort(F.collect_list(F.struct("coord", "w", "mean")))
    by_fold = settings.groupBy("outer").agg(arrays.alias("a")).select("outer", F.transform("a", lambda x: x["w"]).alias("w"), F.transform("a", lambda x: x["mean"]).alias("pooled"))
    by_fold = small_side(by_fold)
    weight = {r["outer"]: r["w"] for r in by_fold.collect()}
    entities = durable(scoring.pack_entities(rows, {"fit": "fit", "validation": "unseen"}).join(placed, "entity_id"))
    means = bank.groupBy("state_id", "candidate_id", "coord").agg(F.avg("value").alias("value"), F.var_pop("value").alias("v"))
    cells = [F.array_sort(F.collect_list(F.struct("coord", F.col(c).alias("value")))).alias(name) for c, name in (("value", "_f"), ("v", "_v"))]
    states = dense(means.groupBy("state_id", "candidate_id").agg(*cells), {"_f": "f", "_v": "v"}, declared_axis(means, ["coord"]), ["coord"], "state_id")
    states = states.join(prior.select("candidate_id", "prior"), "candidate_id").join(params.select("candidate_id"), "candidate_id")

    each = entities.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(by_fold, "outer")
    distances = each.where(F.col("outer") != F.col("fold")).select("outer", _weighted("w", "fit", "unseen").alias("d"))
    base = {r["outer"]: r["base"] for r in exact_quantiles(distances, ["outer"], {"d": [(0.5, "base")]}).collect()}
    trials = [(o, max(minimum, base[o] * m)) for o in sorted(base) for m in multipliers]
    kinds = {"entity_id": dict(entities.dtypes)["entity_id"]}
    left = tiled.entity_side(entities, ["entity_id"], ["fit", "unseen", "fold"], None)
    right = tiled.Side(states, ["candidate_id", "state_id"], ["f", "v", "prior"], "bank", tiled.TILE_BYTES, cells=tiled.CELLS // 16)

    def described(scored: DataFrame, variants: list[tuple[int, float]]) -> DataFrame:
        outer = F.element_at(F.array(*[F.lit(o) for o, _ in variants]), F.col("variant") + 1)
        temperature = F.element_at(F.array(*[F.lit(float(t)) for _, t in variants]), F.col("variant") + 1)
        return scored.withColumn("outer", outer).withColumn("temperature", temperature).join(by_fold, "outer").join(entities, "entity_id")

    tried = described(_score(left, right, kinds, weight, trials, False), trials)
    ratios = durable(tried.select("outer", "temperature", ratio(_weighted("w", "pred", "unseen"), _weighted("w", "pooled", "unseen")).alias("r")))
    found = exact_quantiles(ratios, ["outer", "temperature"], {"r": [(0.5, "median")]}).join(ratios.groupBy("outer", "temperature").agg(F.avg("r").alias("mean")), ["outer", "temperature"])
    best = found.groupBy("outer").agg(F.min(F.struct("median", "mean", "temperature")).alias("b")).collect()
    chosen = sorted((r["outer"], r["b"]["temperature"]) for r in best)
    held = described(_score(left, right, kinds, weight, chosen, True), chosen)
    costs = {"fit_cost": ("pred", "fit"), "unseen_cost": ("pred", "unseen"), "map_fit_cost": ("best_f", "fit"), "map_unseen_cost": ("best_f", "unseen"),
             "pooled_fit_cost": ("pooled", "fit"), "pooled_unseen_cost": ("pooled", "unseen"), "persistence_cost": ("fit", "unseen")}
    out = held.select("entity_id", "grp", F.col("outer").alias("outer_fold"), "temperature", F.col("oracle").alias("oracle_unseen_cost"), *[_weighted("w", *pair).alias(n) for n, pair in costs.items()])
    return out.withColumns({"fit_ratio": ratio(F.col("fit_cost"), F.col("pooled_fit_cost")), **{f"{n}_ratio": ratio(F.col(c), F.col("pooled_unseen_cost")) for n, c in (
        ("unseen", "unseen_cost"), ("map", "map_unseen_cost"), ("oracle", "oracle_unseen_cost"), ("persistence", "persistence_cost"))}})
