"""Entities against a bank of candidate states: costs, nearest states, softmax posteriors and their summaries.

Pair costs are reduced where they are made (``tiled``): blocks of entities meet blocks of the bank in a keyed join, and one row of
mergeable partial sums per entity leaves a tile. Only ``pairwise_cost`` and ``kernel_posterior``, whose results are
the pairs, write pairs out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions.expr import correlation, ratio
from ..functions.packing import declared_axis, dense
from ..functions.quantiles import exact_quantiles
from . import tiled


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def pack_entities(features: DataFrame, segments: dict[str, str], axis: list | None = None) -> DataFrame:
    """One row per entity with an array per segment, ordered by coordinate.

    ``segments`` maps segment -> array name. Every array must hold the declared coordinates (``axis``, or all that occur) once
    each; a gap, or an entity without a segment, is an error that names the entity.
    """
    arrays = [F.array_sort(F.collect_list(F.when(F.col("segment") == s, F.struct("coord", "value")))).alias(f"_{name}") for s, name in segments.items()]
    extra = [c for c in ("grp", "split") if c in features.columns]
    wanted = features.where(F.col("segment").isin(*segments))
    packed = wanted.groupBy("entity_id", *extra).agg(*arrays)
    return dense(packed, {f"_{n}": n for n in segments.values()}, declared_axis(wanted, ["coord"], axis), ["coord"], "entity_id")


def pack_states(states: DataFrame, parameters: DataFrame | None = None, theta: list[str] = ()) -> DataFrame:
    """states(state_id, candidate_id, replicate, coord, value) -> one row per state: mean features, spread, parameters.

    mean_r |f_r - y|^2 = |mean f - y|^2 + mean_r |f_r - mean f|^2, so replicates fold into one array and one number.
    """
    means = states.groupBy("state_id", "candidate_id", "coord").agg(F.avg("value").alias("value"), F.var_pop("value").alias("_s"))
    packed = means.groupBy("state_id", "candidate_id").agg(
        F.array_sort(F.collect_list(F.struct("coord", "value"))).alias("_f"), F.sum("_s").alias("spread"))
    packed = dense(packed, {"_f": "f"}, declared_axis(means, ["coord"]), ["coord"], "state_id").select("state_id", "candidate_id", "f", "spread")
    if parameters is None:
        return packed.withColumn("theta", F.array().cast("array<double>"))
    return packed.join(parameters.select("candidate_id", F.array(*[F.col(t) for t in theta]).alias("theta")), "candidate_id")


def prior_cost(params: DataFrame, terms: list[tuple[list[str], float]], center: dict[str, float] | None = None,
               key: str = "candidate_id", name: str = "prior") -> DataFrame:
    """(id, prior): sum over terms of strength x mean squared (centred) parameter; pure column arithmetic."""
    total = F.lit(0.0)
    for columns, strength in terms:
        squares = [F.pow(F.col(c) - F.lit(float((center or {}).get(c, 0.0))), F.lit(2)) for c in columns]
        total = total + sum(squares, F.lit(0.0)) * (strength / len(columns))
    return params.select(key, total.alias(name))


def pairwise_cost(entities: DataFrame, states: DataFrame, method: str = "long", limit: int | None = None) -> DataFrame:
    """(entity_id, state_id, cost) for every pair: mean over replicates of the squared distance.

    ``long`` joins coordinates, with replicates reduced first; ``arrow`` multiplies batches with bank chunks.
    entities(entity_id, coord, value), states(state_id, candidate_id, replicate, coord, value).
    """
    if method == "long":
        means = states.groupBy("state_id", "coord").agg(F.avg("value").alias("f"), F.var_pop("value").alias("s"))
        return entities.join(means, "coord").groupBy("entity_id", "state_id").agg(
            F.sum(F.pow(F.col("f") - F.col("value"), F.lit(2)) + F.col("s")).alias("cost"))
    axis = [r["coord"] for r in states.select("coord").distinct().collect()]  # the coordinates are fixed by the design
    packed = pack_entities(entities.withColumn("segment", F.lit("fit")), {"fit": "fit"}, axis)
    bank = pack_states(states)
    kinds = {"entity_id": dict(entities.dtypes)["entity_id"], "state_id": dict(bank.dtypes)["state_id"]}
    return tiled.pair_costs(tiled.entity_side(packed, ["entity_id"], ["fit"], limit), tiled.bank_side(bank, [], limit), kinds)


def posterior_pass(entities: DataFrame, states: DataFrame, variants: list[tuple[str, float, str]], top_k: int = 10,
                   limit: int | None = None, quantiles: bool = True) -> DataFrame:
    """One row per entity and variant with everything the posterior summaries need.

    ``entities`` are packed rows (entity_id, fit[, unseen], ..); ``states`` packed rows plus prior columns; a variant is
    (name, temperature, prior column). Weights are softmax(-(cost + prior) / (2 T)). Columns: m (largest log
    weight), s, s2, c2 (sums of weights, squared weights and squared candidate weights, all relative to m), theta and pred
    (weighted sums), best_* (MAP state), oracle (smallest unseen distance), top (k heaviest states), q (5 and 95 % points of
    each parameter, null without ``quantiles``). ``limit`` is the size of a block in bytes; results do not depend on it.
    """
    return tiled.posterior(entities, states, variants, top_k, limit, quantiles)


def posterior_summary(passed: DataFrame, theta: list[str]) -> DataFrame:
    """MAP state and its probability, effective sample sizes, posterior means and 5/95 % points of each parameter."""
    columns = [F.col("best_state").alias("map_state"), F.col("best_candidate").alias("map_candidate"), (F.lit(1.0) / F.col("s")).alias("map_probability"),
               (F.col("s") * F.col("s") / F.col("s2")).alias("ess_states"), (F.col("s") * F.col("s") / F.col("c2")).alias("ess_candidates")]
    for i, name in enumerate(theta):
        columns += [(F.get("theta", F.lit(i)) / F.col("s")).alias(f"{name}_mean"), F.get("q", F.lit(2 * i)).alias(f"{name}_q05"), F.get("q", F.lit(2 * i + 1)).alias(f"{name}_q95")]
    return passed.select("entity_id", *columns)


def prediction(passed: DataFrame) -> DataFrame:
    return passed.withColumn("pred", F.transform("pred", lambda v: v / F.col("s")))


def posterior_top(passed: DataFrame) -> DataFrame:
    """(entity_id, rank, state_id, candidate_id, weight) of the heaviest states."""
    return passed.select("entity_id", "m", "s", F.posexplode("top").alias("rank", "t")).select(
        "entity_id", (F.col("rank") + 1).alias("rank"), "t.state_id", "t.candidate_id", (F.exp(F.col("t.l") - F.col("m")) / F.col("s")).alias("weight"))


def predictive_costs(passed: DataFrame, entities: DataFrame, pooled: list[float]) -> DataFrame:
    """Posterior-mean, MAP, oracle, pooled and persistence costs on both halves, with their ratios to pooled.

    ``pooled`` is the training mean, one number per coordinate.
    """
    base = F.array(*[F.lit(float(v)) for v in pooled])
    joined = prediction(passed).join(entities.select("entity_id", "fit", "unseen"), "entity_id")
    out = joined.select(
        "entity_id", squared_distance("pred", "fit").alias("fit_cost"), squared_distance("pred", "unseen").alias("unseen_cost"),
        squared_distance("best_f", "fit").alias("map_fit_cost"), squared_distance("best_f", "unseen").alias("map_unseen_cost"), F.col("oracle").alias("oracle_unseen_cost"),
        squared_distance(base, F.col("fit")).alias("pooled_fit_cost"), squared_distance(base, F.col("unseen")).alias("pooled_unseen_cost"),
        squared_distance("fit", "unseen").alias("persistence_cost"))
    return out.select("*", ratio(F.col("fit_cost"), F.col("pooled_fit_cost")).alias("fit_ratio"), *[
        ratio(F.col(c), F.col("pooled_unseen_cost")).alias(n) for c, n in (
            ("unseen_cost", "unseen_ratio"), ("map_unseen_cost", "map_ratio"), ("oracle_unseen_cost", "oracle_ratio"), ("persistence_cost", "persistence_ratio"))])


def block_cost_ratios(passed: DataFrame, entities: DataFrame, pooled: list[float], blocks: dict[str, list[int]]) -> DataFrame:
    """(entity_id, block, ratio): squared error of the prediction over that of the pooled mean, per block.

    ``blocks`` lists the array positions of each block; everything stays inside the entity's row.
    """
    joined = prediction(passed).join(entities.select("entity_id", "unseen"), "entity_id")

    def error(array, positions: list[int]) -> Column:
        return sum((F.pow(F.get(array, F.lit(i)) - F.get("unseen", F.lit(i)), F.lit(2)) for i in positions), F.lit(0.0))

    base = F.array(*[F.lit(float(v)) for v in pooled])
    cells = F.array(*[F.struct(F.lit(name).alias("block"), ratio(error("pred", where), error(base, where)).alias("ratio")) for name, where in blocks.items()])
    return joined.select("entity_id", F.explode(cells).alias("c")).select("entity_id", "c.block", "c.ratio")


def kernel_posterior(costs: DataFrame, temperature: float) -> DataFrame:
    """costs(entity_id, state_id, cost, prior) -> + weight, by a window over one entity's states."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    one = Window.partitionBy("entity_id")
    logit = (F.col("cost") + F.col("prior")) * (-0.5 / temperature)
    shifted = costs.withColumn("_l", logit).withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(one)))
    return shifted.withColumn("weight", F.col("_e") / F.sum("_e").over(one)).drop("_l", "_e")


def base_temperature(train: DataFrame) -> float:
    """Median over training entities of the squared distance between their halves."""
    distances = train.select(F.lit(0).alias("k"), squared_distance("fit", "unseen").alias("d"))
    return float(exact_quantiles(distances, ["k"], {"d": [(0.5, "median")]}).first()["median"])


def pooled_mean(train: DataFrame) -> list[float]:
    """Training mean of every coordinate of the fit array: as many numbers as there are coordinates."""
    rows = train.select(F.posexplode("fit").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def select_temperature(train: DataFrame, states: DataFrame, prior: str, base: float, multipliers: list[float], minimum: float,
                       pooled: list[float]) -> DataFrame:
    """Per temperature the training-only unseen ratios to the pooled null; the best row first (rank 1).

    All temperatures share one cost matrix per batch.
    """
    temperatures = sorted({max(minimum, base * m) for m in multipliers})
    labels = {repr(t): t for t in temperatures}
    passed = posterior_pass(train, states, [(label, t, prior) for label, t in labels.items()], top_k=1, quantiles=False)
    null = F.array(*[F.lit(float(v)) for v in pooled])
    ratios = prediction(passed).join(train.select("entity_id", "unseen"), "entity_id").select(
        F.col("variant").cast("double").alias("temperature"), ratio(squared_distance("pred", "unseen"), squared_distance(null, F.col("unseen"))).alias("r"))
    means = ratios.groupBy("temperature").agg(F.avg("r").alias("mean_ratio"), F.avg((F.col("r") < 1.0).cast("double")).alias("share_below_1"))
    table = means.join(exact_quantiles(ratios, ["temperature"], {"r": [(0.5, "median_ratio")]}), "temperature")
    order = Window.partitionBy(F.lit(0)).orderBy("median_ratio", "mean_ratio", "temperature")
    return table.select("temperature", (F.col("temperature") / base).alias("multiplier"), "median_ratio", "mean_ratio", "share_below_1",
                        F.row_number().over(order).alias("rank"))


def recovery_rows(targets: DataFrame, states: DataFrame, truth: DataFrame, theta: list[str], variants: list[tuple[str, float, str]]) -> DataFrame:
    """(variant, entity_id, parameter, truth, estimate) for targets whose parameters are known."""
    passed = posterior_pass(targets, states, variants, top_k=1, quantiles=False)
    estimate = F.array(*[F.struct(F.lit(t).alias("parameter"), (F.get("theta", F.lit(i)) / F.col("s")).alias("estimate"), F.col(t).alias("truth")) for i, t in enumerate(theta)])
    return passed.join(truth.withColumnRenamed("candidate_id", "entity_id"), "entity_id").select("variant", "entity_id", F.explode(estimate).alias("r")).select(
        "variant", "entity_id", "r.parameter", "r.truth", "r.estimate")


def recovery_summary(rows: DataFrame) -> DataFrame:
    """Per variant and parameter: correlation and RMSE between truth and estimate."""
    return rows.groupBy("variant", "parameter").agg(
        correlation(F.col("truth"), F.col("estimate"), 0.0).alias("correlation"),
        F.sqrt(F.avg(F.pow(F.col("truth") - F.col("estimate"), F.lit(2)))).alias("rmse"))


def nearest_pass(entities: DataFrame, states: DataFrame, strength: float = 0.0, exclude_self: bool = False, limit: int | None = None) -> DataFrame:
    """(entity_id, candidate_id, total, cost) of the state with the smallest cost + prior, lowest id on ties.

    The prior is strength x mean squared distance between the state's parameters and the entity's ``center`` array.
    Pivot distances leave most states out (``tiled.nearest``); the others use the difference form. One row per entity and bank block.
    """
    kinds = {"entity_id": dict(entities.dtypes)["entity_id"], "candidate_id": dict(states.dtypes)["candidate_id"]}
    left = tiled.entity_side(entities, ["entity_id"], ["fit", "center"] if strength else ["fit"], limit)
    out = tiled.nearest_parts(left, tiled.bank_side(states, [], limit), kinds, strength, exclude_self)
    return out.groupBy("entity_id").agg(F.min(F.struct("total", "candidate_id", "cost")).alias("b")).select(
        "entity_id", "b.candidate_id", "b.total", "b.cost").where(F.col("total") < float("inf"))


def map_select(targets: DataFrame, states: DataFrame, strength: float, center: DataFrame | list[float]) -> DataFrame:
    """(target, candidate_id, total) minimising cost + prior for packed targets (entity_id, fit).

    ``center`` is one parameter array for all targets, or (entity_id, center) per target.
    """
    if isinstance(center, list):
        placed = targets.withColumn("center", F.array(*[F.lit(float(v)) for v in center]))
    else:
        placed = targets.join(center, "entity_id")
    return nearest_pass(placed, states, strength).select(F.col("entity_id").alias("target"), "candidate_id", "total")


def nearest_other(states: DataFrame) -> DataFrame:
    """Leave-one-out nearest neighbour of every candidate: (id, nn_id, dist, rmse, abs_error array)."""
    entities = states.select(F.col("candidate_id").alias("entity_id"), F.col("f").alias("fit"))
    found = nearest_pass(entities, states.withColumn("spread", F.lit(0.0)), exclude_self=True)
    own, other = states.select(F.col("candidate_id").alias("entity_id"), F.col("theta").alias("a")), states.select("candidate_id", F.col("theta").alias("b"))
    return found.join(own, "entity_id").join(other, "candidate_id").select(
        F.col("entity_id").alias("id"), F.col("candidate_id").alias("nn_id"), F.col("cost").alias("dist"),
        F.sqrt(squared_distance("a", "b") / F.size("a")).alias("rmse"), F.zip_with("a", "b", lambda x, y: F.abs(x - y)).alias("abs_error"))


def recovery_errors(found: DataFrame, theta: list[str]) -> DataFrame:
    """One row: median and 90 % point of the RMSE, and the mean absolute error per parameter."""
    mae = found.agg(*[F.avg(F.get("abs_error", F.lit(i))).alias(f"mae_{t}") for i, t in enumerate(theta)])
    return exact_quantiles(found.withColumn("_k", F.lit(0)), ["_k"], {"rmse": [(0.5, "median_rmse"), (0.9, "p90_rmse")]}).drop("_k").join(F.broadcast(mae))


def fit_report(selection: DataFrame, features: DataFrame, bank: DataFrame, reference: str, entity_level: DataFrame, candidate_level: DataFrame) -> DataFrame:
    """Per entity: costs of the selected and the reference candidate on both halves, ratios, RMSE, improvement,
    block correlations, and the log-amplitude offset.

    selection(entity_id, candidate_id), features(entity_id, segment, block, coord, value), bank(candidate_id, block, coord, value),
    *_level(entity_id | candidate_id, level). One shuffle by entity after two bank joins.
    """
    halves = features.groupBy("entity_id", "block", "coord").agg(
        F.max(F.when(F.col("segment") == "fit", F.col("value"))).alias("fit"), F.max(F.when(F.col("segment") == "validation", F.col("value"))).alias("unseen"))
    base = bank.where(F.col("candidate_id") == reference).select("coord", F.col("value").alias("r"))
    rows = halves.join(selection, "entity_id").join(bank.select("candidate_id", "coord", F.col("value").alias("b")), ["candidate_id", "coord"]).join(base, "coord")

    def cost(x: str, y: str) -> Column:
        return F.sum(F.pow(F.col(x) - F.col(y), F.lit(2)))

    def corr_in(block: str, x: str) -> Column:
        inside = F.col("block") == block
        return correlation(F.when(inside, F.col(x)), F.when(inside, F.col("b")), 0.0)

    names = ["vowel", "consonant"] if "block" not in bank.columns else [r["block"] for r in bank.select("block").distinct().orderBy("block").collect()]
    out = rows.groupBy("entity_id", "candidate_id").agg(
        cost("fit", "b").alias("fit_cost"), cost("unseen", "b").alias("unseen_cost"), cost("fit", "r").alias("reference_fit_cost"), cost("unseen", "r").alias("reference_unseen_cost"),
        *[corr_in(n, x).alias(f"{x}_{n}_correlation") for n in names for x in ("fit", "unseen")])
    leveled = out.join(entity_level.select("entity_id", F.col("level").alias("_e")), "entity_id").join(candidate_level.select("candidate_id", F.col("level").alias("_c")), "candidate_id")
    improvement = F.when(F.col("reference_unseen_cost") > 0, (F.col("reference_unseen_cost") - F.col("unseen_cost")) / F.col("reference_unseen_cost")).otherwise(0.0)
    leveled = leveled.withColumn("fit_ratio", ratio(F.col("fit_cost"), F.col("reference_fit_cost"))).withColumn("unseen_ratio", ratio(F.col("unseen_cost"), F.col("reference_unseen_cost")))
    return leveled.select(*out.columns, "fit_ratio", "unseen_ratio", (F.col("unseen_ratio") - F.col("fit_ratio")).alias("gap"), F.sqrt("fit_cost").alias("fit_rmse"),
                          F.sqrt("unseen_cost").alias("unseen_rmse"), improvement.alias("improvement"), ((F.col("_e") - F.col("_c")) * 0.5).alias("level_offset"))


def predictive_csd(posterior: DataFrame, states: DataFrame, bank_csd: DataFrame, increments: DataFrame, covariance: DataFrame) -> DataFrame:
    """(entity_id, freq, ch_i, ch_j, re, im): posterior mixture of cross-spectra without a dense table per state.

    posterior(entity_id, state_id, weight), states(state_id, candidate_id), bank_csd(candidate_id, freq, ch_i, ch_j, re, im),
    increments(state_id, freq, diag_increment, source_power), covariance(ch_i, ch_j, cov). Three weighted sums: candidates, diagonal
    power and source power; the last two are per (entity, frequency) before they meet the channel pairs.
    """
    placed = posterior.join(states.select("state_id", "candidate_id"), "state_id")
    candidate = placed.groupBy("entity_id", "candidate_id").agg(F.sum("weight").alias("w"))
    mixed = candidate.join(bank_csd, "candidate_id").groupBy("entity_id", "freq", "ch_i", "ch_j").agg(
        F.sum(F.col("w") * F.col("re")).alias("re"), F.sum(F.col("w") * F.col("im")).alias("im"))
    power = posterior.join(increments, "state_id").groupBy("entity_id", "freq").agg(
        F.sum(F.col("weight") * F.col("diag_increment")).alias("_d"), F.sum(F.col("weight") * F.col("source_power")).alias("_s"))
    extra = F.col("_s") * F.col("cov") + F.when(F.col("ch_i") == F.col("ch_j"), F.col("_d")).otherwise(0.0)
    return mixed.join(power, ["entity_id", "freq"]).join(covariance, ["ch_i", "ch_j"]).select(
        "entity_id", "freq", "ch_i", "ch_j", (F.col("re") + extra).alias("re"), "im")


def parameter_sensitivity(parameters: DataFrame, bank: DataFrame, theta: list[str], ridge: float = 1e-6) -> DataFrame:
    """Ridge effect of each parameter on each block over the replicate noise, and its largest marginal correlation.

    parameters(candidate_id, <theta>), bank(candidate_id, replicate, block, coord, value). X'X and X'Y are centred co-moments from
    distributed sums; the parameters x parameters solve happens once, and its inverse is applied as columns.
    """
    import numpy as np

    cells = F.array(*[F.struct(F.lit(t).alias("parameter"), F.col(t).alias("x")) for t in theta])
    pairs = [(i, j) for i in range(len(theta)) for j in range(i, len(theta))]
    row = parameters.agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(theta[i], theta[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(theta), len(theta)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"c{i}_{j}"] * row["n"]
    inverse = np.linalg.inv(gram + ridge * np.eye(len(theta)))
    means = bank.groupBy("candidate_id", "block", "coord").agg(F.avg("value").alias("y"), F.var_pop("value").alias("noise"))
    tall = means.join(parameters.select("candidate_id", F.explode(cells).alias("c")), "candidate_id")
    moments = tall.groupBy("block", "coord", F.col("c.parameter").alias("parameter")).agg(
        (F.covar_pop("c.x", "y") * F.count(F.lit(1))).alias("xy"), F.coalesce(F.abs(correlation(F.col("c.x"), F.col("y"))), F.lit(0.0)).alias("r"))
    solve = parameters.sparkSession.createDataFrame([(theta[j], theta[i], float(inverse[i, j])) for i in range(len(theta)) for j in range(len(theta))],
                                                    "parameter string, target string, weight double")
    effects = moments.join(session.small_side(solve), "parameter").groupBy("block", "coord", "target").agg(F.sum(F.col("weight") * F.col("xy")).alias("beta"))
    effects = effects.groupBy("block", F.col("target").alias("parameter")).agg(F.sqrt(F.avg(F.col("beta") * F.col("beta"))).alias("effect_rms"))
    noise = means.groupBy("block").agg(F.sqrt(F.avg("noise")).alias("noise_rms"))
    marginal = moments.groupBy("block", "parameter").agg(F.max("r").alias("max_marginal_r"))
    return effects.join(noise, "block").join(marginal, ["block", "parameter"]).withColumn(
        "effect_to_noise", F.try_divide("effect_rms", F.greatest("noise_rms", F.lit(1e-300))))


def feature_coverage(bank: DataFrame, entities: DataFrame) -> DataFrame:
    """Per block: model SD over observed SD and replicate reliability, median and minimum over coordinates."""
    means = bank.groupBy("candidate_id", "block", "coord").agg(F.avg("value").alias("y"), F.var_pop("value").alias("_n"))
    model = means.groupBy("block", "coord").agg(F.stddev_samp("y").alias("model"), F.avg("_n").alias("noise"))
    observed = entities.groupBy("block", "coord").agg(F.stddev_samp("value").alias("observed"))
    both = model.join(observed, ["block", "coord"]).select(
        "block", F.try_divide(F.col("model"), F.greatest("observed", F.lit(1e-300))).alias("ratio"),
        F.try_divide(F.col("model") * F.col("model"), F.greatest(F.col("model") * F.col("model") + F.col("noise"), F.lit(1e-300))).alias("rel"))
    return both.groupBy("block").agg(F.count(F.lit(1)).alias("coordinates"), F.median("ratio").alias("median_sd_ratio"), F.min("ratio").alias("min_sd_ratio"),
                                     F.median("rel").alias("median_reliability"), F.min("rel").alias("min_reliability"))


def central_difference(features: DataFrame, delta: float, contrast: DataFrame, working: DataFrame) -> DataFrame:
    """(mode, block, ..) from features(mode, sign, block, coord, value) at gains 1 - delta and 1 + delta.

    RMS sensitivity, cosine with the group contrast(block, coord, diff), preferred direction, and the distances from
    working(block, coord, value).
    """
    sides = features.groupBy("mode", "block", "coord").agg(
        F.max(F.when(F.col("sign") > 0, F.col("value"))).alias("p"), F.max(F.when(F.col("sign") < 0, F.col("value"))).alias("m"))
    rows = sides.where(F.col("p").isNotNull() & F.col("m").isNotNull()).join(contrast, ["block", "coord"]).join(working.withColumnRenamed("value", "w"), ["block", "coord"])
    d = (F.col("p") - F.col("m")) / (2.0 * delta)
    rows = rows.withColumn("d", d)
    norm = F.sqrt(F.sum(F.col("d") * F.col("d"))) * F.sqrt(F.sum(F.col("diff") * F.col("diff")))
    out = rows.groupBy("mode", "block").agg(
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("sensitivity"),
        F.when(norm > 2.220446049250313e-16, F.sum(F.col("d") * F.col("diff")) / norm).alias("cosine"),
        F.sqrt(F.avg(F.pow(F.col("m") - F.col("w"), F.lit(2)))).alias("minus_distance"), F.sqrt(F.avg(F.pow(F.col("p") - F.col("w"), F.lit(2)))).alias("plus_distance"))
    return out.withColumn("direction", F.when(F.col("cosine") >= 0, "increase").otherwise("decrease"))
