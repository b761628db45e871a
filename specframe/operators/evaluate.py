"""Bootstraps, acceptance gates, classification metrics and model selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import correlation
from ..functions.packing import declared_axis, dense
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import global_running
from ..session import durable, small_side
from . import resampling


def boundary_check(states: DataFrame, cost: str, ident: str, grids: dict[str, list[float]]) -> DataFrame:
    """Is the best state's nuisance at its grid maximum? checks(check, passed, observed, threshold), one row per grid."""
    best = states.agg(F.min(F.struct(cost, ident, *grids)).alias("b"))
    cells = F.array(*[F.struct(F.lit(f"{name}_interior").alias("check"), (F.col(f"b.{name}") != max(values)).alias("passed"),
                               F.col(f"b.{name}").cast("double").alias("observed"), F.lit(float(max(values))).alias("threshold")) for name, values in grids.items()])
    return best.select(F.explode(cells).alias("c")).select("c.*")


def paired_bootstrap(paired: DataFrame, metrics: list[str], samples: int, seed: int, key: str = "entity_id") -> DataFrame:
    """Per metric: median of candidate - reference, its 95 % bootstrap interval, and the share improved (< 0).

    paired(entity_id, candidate_<m>, reference_<m>). Sample medians are exact whatever the number of entities.
    """
    # The differences are read by the draws, the point estimate and the share: one stored copy.
    diffs = paired.select(key, F.lit("all").alias("grp"), *[(F.col(f"candidate_{m}") - F.col(f"reference_{m}")).cast("double").alias(m) for m in metrics])
    diffs = durable(diffs)
    medians = resampling.sample_medians(diffs, metrics, samples, seed, "grp", key)
    # One row per metric and bootstrap sample: a fixed number.
    bounds = medians.groupBy("metric").agg(F.percentile("median", 0.025).alias("low"), F.percentile("median", 0.975).alias("high"))
    point = exact_quantiles(diffs, ["grp"], {m: [(0.5, m)] for m in metrics}).drop("grp")
    share = diffs.agg(*[F.avg((F.col(m) < 0).cast("double")).alias(f"{m}_share") for m in metrics])
    row = point.join(F.broadcast(share))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("median_difference"), F.col(f"{m}_share").alias("share_improved")) for m in metrics])
    named = row.select(F.explode(cells).alias("c")).select("c.*")
    return named.join(bounds, "metric").select("metric", "median_difference", "low", "high", "share_improved")


def effect_bootstrap(tables: dict[str, DataFrame], first: str, second: str, samples: int, seed: int) -> DataFrame:
    """Per block: effect correlation and norm retention of two models, their difference, and its 95 % interval.

    ``tables`` has observed, reference and candidate features(entity_id, grp, block, coord, value) over the same entities and
    coordinates. Each entity row carries its features as an array; a task makes the draw weights of its block of entities, multiplies the
    two and emits one samples x coordinates sum.
    """
    import numpy as np
    import pyarrow as pa

    names = ["observed", "reference", "candidate"]
    tagged = None
    for i, name in enumerate(names):
        part = tables[name].where(F.col("grp").isin(first, second)).select("entity_id", "grp", "block", "coord", F.lit(i).alias("t"), "value")
        tagged = part if tagged is None else tagged.unionByName(part)
    packed = tagged.groupBy("entity_id", "grp").agg(F.array_sort(F.collect_list(F.struct("block", "coord", "t", "value"))).alias("z"))
    order = ["block", "coord", "t"]
    axis = declared_axis(tagged, order)
    packed = durable(dense(packed, {"z": "z"}, axis, order, "entity_id"))

    def sums(group, weights, table):
        z = resampling.matrix(table, "z")
        sign = (1.0 if group == second else -1.0) / table["_n"][0].as_py()
        total = np.concatenate([weights @ z, z.sum(axis=0, keepdims=True)]) * sign
        columns = [np.repeat(np.arange(samples + 1, dtype=np.int32), z.shape[1]), np.tile(np.arange(z.shape[1], dtype=np.int32), samples + 1), total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["b", "i", "v"])

    effects = resampling.resampled(packed, samples, seed, sums, "b int, i int, v double").groupBy("b", "i").agg(F.sum("v").alias("v"))
    names_of = small_side(axis.select(F.posexplode("_axis").alias("i", "x")).select("i", "x.block", "x.coord", "x.t"))
    wide = effects.join(names_of, "i").groupBy("b", "block", "coord").agg(
        *[F.max(F.when(F.col("t") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])

    def norm(c: str) -> Column:
        return F.sqrt(F.sum(F.col(c) * F.col(c)))

    stats = wide.groupBy("b", "block").agg(
        correlation(F.col("observed"), F.col("reference"), 0.0).alias("rr"), correlation(F.col("observed"), F.col("candidate"), 0.0).alias("rc"),
        (norm("reference") / F.greatest(norm("observed"), F.lit(1e-300))).alias("nr"), (norm("candidate") / F.greatest(norm("observed"), F.lit(1e-300))).alias("nc"))
    stats = stats.withColumn("dr", F.col("rc") - F.col("rr")).withColumn("dn", F.col("nc") - F.col("nr"))
    drawn, whole = F.col("b") < samples, F.col("b") == samples

    def point(c: str) -> Column:
        return F.max(F.when(whole, F.col(c)))

    return stats.groupBy("block").agg(
        point("rr").alias("reference_correlation"), point("rc").alias("candidate_correlation"), point("nr").alias("reference_norm"), point("nc").alias("candidate_norm"),
        point("dr").alias("correlation_difference"), F.percentile(F.when(drawn, F.col("dr")), 0.025).alias("correlation_low"), F.percentile(F.when(drawn, F.col("dr")), 0.975).alias("correlation_high"),
        point("dn").alias("norm_difference"), F.percentile(F.when(drawn, F.col("dn")), 0.025).alias("norm_low"), F.percentile(F.when(drawn, F.col("dn")), 0.975).alias("norm_high"))


def _standardized(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean difference over pooled SD from sums(keys, parameter, side 0 or 1, n, s, q) of weights, weighted values and squares."""
    def part(side: int) -> list[Column]:
        return [F.sum(F.when(F.col("side") == side, F.col(c))).alias(f"{c}{side}") for c in "nsq"]

    both = sums.groupBy(*keys, "parameter").agg(*part(0), *part(1))
    scatter = [F.col(f"q{n}") - F.col(f"s{n}") * F.col(f"s{n}") / F.col(f"n{n}") for n in "01"]
    variance = F.try_divide(scatter[0] + scatter[1], F.col("n0") + F.col("n1") - 2)
    difference = F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")
    return both.select(*keys, "parameter", F.col("n0").cast("bigint").alias("n_first"), F.col("n1").cast("bigint").alias("n_second"), difference.alias("difference"),
                       F.when(variance > 2.2250738585072014e-308, difference / F.sqrt(variance)).alias("standardized"))


def parameter_effects(fits: DataFrame, parameters: list[str], first: str, second: str, recovery: dict[str, float], thresholds: dict[str, float],
                      samples: int, seed: int) -> DataFrame:
    """Group difference per parameter, standardised, with a bootstrap interval and the recovery-gate flag.

    Values are shifted by the overall mean first, so the sums of squares do not cancel. A task adds up the weighted sums of its
    block of entities for all samples; missing values count in neither.
    """
    import numpy as np
    import pyarrow as pa

    chosen = fits.where(F.col("grp").isin(first, second))
    means = chosen.agg(*[F.avg(p).alias(f"_m{i}") for i, p in enumerate(parameters)])
    shifted = F.array(*[F.col(p).cast("double") - F.col(f"_m{i}") for i, p in enumerate(parameters)])
    packed = durable(chosen.join(F.broadcast(means)).select("entity_id", "grp", F.transform(shifted, lambda v: F.coalesce(v, F.lit(float("nan")))).alias("z")))

    def moments(group, weights, table):
        z = resampling.matrix(table, "z")
        known = ~np.isnan(z)
        z = np.where(known, z, 0.0)
        counted = np.concatenate([weights, np.ones((1, len(z)), dtype=weights.dtype)])
        n, s, q = counted @ known, counted @ z, counted @ (z * z)
        samples_column = np.repeat(np.arange(samples + 1, dtype=np.int32), len(parameters))
        yield pa.RecordBatch.from_arrays([pa.array(samples_column), pa.array(parameters * (samples + 1)), pa.array(np.full(n.size, int(group == second), dtype=np.int32)), *[pa.array(x.astype(float).ravel()) for x in (n, s, q)]],
                                         names=["b", "parameter", "side", "n", "s", "q"])

    sums = durable(resampling.resampled(packed, samples, seed, moments, "b int, parameter string, side int, n double, s double, q double"))
    point = _standardized(sums.where(F.col("b") == samples), [])
    boot = _standardized(sums.where(F.col("b") < samples), ["b"]).groupBy("parameter").agg(
        F.percentile("standardized", 0.025).alias("low"), F.percentile("standardized", 0.975).alias("high"))
    known = F.create_map(*[F.lit(x) for p in parameters for x in (p, float(recovery[p]))])
    limit = F.create_map(*[F.lit(x) for p in parameters for x in (p, float(thresholds[p]))])
    out = point.join(boot, "parameter").withColumn("recovery", F.element_at(known, F.col("parameter"))).withColumn("recovery_threshold", F.element_at(limit, F.col("parameter")))
    return out.withColumn("passes_recovery", F.col("recovery") >= F.col("recovery_threshold"))


_OPERATIONS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b}


def acceptance_gates(metrics: DataFrame, gates: list[tuple[str, str, str, float]], accepted: str = "accepted", rejected: str = "not_accepted") -> DataFrame:
    """checks(check, passed, observed, threshold, status) from metrics(name, value) and (gate, metric, operator, limit).

    A gate whose metric is missing fails. ``status`` repeats the overall outcome.
    """
    wanted = F.array(*[F.struct(F.lit(g).alias("check"), F.lit(m).alias("name"), F.lit(float(v)).alias("threshold")) for g, m, _, v in gates])
    values = metrics.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("v"))
    rows = values.select("v", F.explode(wanted).alias("g")).select("g.check", F.try_element_at("v", F.col("g.name")).alias("observed"), "g.threshold")
    passed = F.lit(False)
    for gate, _, operator, _ in gates:
        passed = F.when(F.col("check") == gate, F.coalesce(_OPERATIONS[operator](F.col("observed"), F.col("threshold")), F.lit(False))).otherwise(passed)
    rows = rows.withColumn("passed", passed)
    whole = Window.partitionBy(F.lit(0))
    return rows.withColumn("status", F.when(F.bool_and("passed").over(whole), accepted).otherwise(rejected))


def lexicographic_select(models: DataFrame) -> DataFrame:
    """The preferred model of models(model, eligible, total, topography, connectivity, complexity), or no row.

    Ineligible models and totals >= 1 are dropped; then both spatial ratios below 1 come first, then the smaller worst
    spatial ratio, the smaller total, and the simpler model.
    """
    worst = F.greatest("topography", "connectivity")
    return models.where(F.col("eligible") & (F.col("total") < 1.0)).orderBy(
        F.desc((F.col("topography") < 1.0) & (F.col("connectivity") < 1.0)), worst, "total", "complexity", "model").limit(1)


def binary_metrics(scores: DataFrame) -> DataFrame:
    """One row from scores(score, label): ROC AUC with mid-ranks, balanced accuracy at 0.5, Brier score.

    Equal scores collapse first; the running count of negatives goes over range partitions.
    """
    counted = scores.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    ranked = global_running(counted, [F.col("score").asc()], {"cum_neg": "neg"})
    auc = ranked.agg(F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * 0.5)), F.sum("pos") * F.sum("neg").cast("double")).alias("roc_auc"))
    hit = (F.col("score") >= 0.5).cast("double")
    plain = scores.agg(((F.avg(F.when(F.col("label") == 1, hit)) + F.avg(F.when(F.col("label") == 0, F.lit(1.0) - hit))) / 2.0).alias("balanced_accuracy"),
                       F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("brier"))
    return auc.join(F.broadcast(plain))


def nonnegative_weights(design, target):
    """Least-squares weights without a negative one: columns join by steepest gain and leave when they would turn negative.

    At the end the gradient of every unused column is at most 0 and that of every used one is 0, which is the condition
    for the optimum.
    """
    import numpy as np

    columns = design.shape[1]
    used, weights = np.zeros(columns, dtype=bool), np.zeros(columns)
    slack = 1e-10 * max(1.0, float(np.abs(design).max() * np.abs(target).max()) * len(target))
    for _ in range(10 * columns):
        gain = design.T @ (target - design @ weights)
        gain[used] = -np.inf
        if used.all() or gain.max() <= slack:
            break
        used[gain.argmax()] = True
        while True:
            trial = np.zeros(columns)
            trial[used] = np.linalg.lstsq(design[:, used], target, rcond=None)[0]
            falling = used & (trial <= 0)
            if not falling.any():
                weights = trial
                break
            step = (weights[falling] / (weights[falling] - trial[falling] + 1e-300)).min()
            weights = weights + step * (trial - weights)
            weights[falling & (weights <= 1e-12)] = 0.0
            used &= weights > 0
    return weights


def nonneg_profile_fit(basis: DataFrame, profiles: DataFrame, pooled: dict[str, float]) -> DataFrame:
    """(entity_id, rmse, null_rmse, ratio): non-negative fit of the basis plus a constant to each fit profile, scored unseen.

    basis(sensor, block, value) is a small shared table; profiles(entity_id, segment, sensor, value). The weights
    come from an active-set search per entity, so the basis may have any number of columns.
    """
    import numpy as np

    cells = basis.collect()
    sensors, blocks = sorted({r["sensor"] for r in cells}), sorted({r["block"] for r in cells})
    design = np.ones((len(sensors), len(blocks) + 1))
    for r in cells:
        design[sensors.index(r["sensor"]), blocks.index(r["block"])] = r["value"]
    null = np.array([pooled[s] for s in sensors])
    value = F.struct("sensor", "value")
    packed = profiles.groupBy("entity_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("segment") == s, value))).alias(n) for s, n in (("fit", "f"), ("validation", "u"))])
    packed = dense(packed, {"f": "fit", "u": "unseen"}, declared_axis(profiles, ["sensor"], sensors), ["sensor"], "entity_id")
    kind = dict(profiles.dtypes)["entity_id"]

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            target, unseen = np.stack(pdf["fit"].to_numpy()), np.stack(pdf["unseen"].to_numpy())
            best = np.stack([design @ nonnegative_weights(design, row) for row in target])
            level = best.mean(axis=1, keepdims=True)
            best = np.divide(best, level, out=np.zeros_like(best), where=level > 0)
            rmse, base = np.sqrt(((best - unseen) ** 2).mean(axis=1)), np.sqrt(((null - unseen) ** 2).mean(axis=1))
            yield pd.DataFrame({"entity_id": pdf["entity_id"].to_numpy(), "rmse": rmse, "null_rmse": base, "ratio": np.divide(rmse, base, out=np.full(len(pdf), np.nan), where=base > 0)})

    return packed.mapInPandas(solve, f"entity_id {kind}, rmse double, null_rmse double, ratio double")


# Ridge of the block coefficients, as a share of the mean diagonal of the share products; a fixed value.
TOPOGRAPHY_RIDGE = 0.05


def block_shares(gain: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sensor, block, share): part of a sensor's squared gain that comes from a block's nodes, less the block's mean over the sensors."""
    power = gain.join(nodes.select("node_id", "block"), "node_id").groupBy("sensor", "block").agg(F.sum(F.col("g") * F.col("g")).alias("_p"))
    totals = power.groupBy("sensor").agg(F.sum("_p").alias("_t"))
    share = power.join(totals, "sensor").select("sensor", "block", F.coalesce(F.try_divide("_p", "_t"), F.lit(0.0)).alias("_s"))
    level = share.groupBy("block").agg(F.avg("_s").alias("_m"))
    return share.join(level, "block").select("sensor", "block", (F.col("_s") - F.col("_m")).alias("share"))


def _square(rows: list, names: list[str], first: str, second: str, value: str):
    """A names x names matrix from the rows of a block-pair table."""
    import numpy as np

    place = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in rows:
        out[place[r[first]], place[r[second]]] = r[value]
    return out


def network_topography(gain: DataFrame, nodes: DataFrame, topography: DataFrame, first: str, second: str, train: DataFrame | None = None) -> DataFrame:
    """Which blocks explain sensor topographies: report(kind, block, value).

    Kinds: ``effect_correlation`` (of a block's shares with the contrast ``second`` - ``first`` over the sensors; NULL if either is
    constant) and ``effect_coefficient`` per block; ``mode_1``/``mode_2`` coefficients (mean 0 over the nodes, largest absolute value 1);
    and, with block NULL, ``explained_1``, ``explained_2`` and ``multivariate_correlation``. topography(entity_id, grp, sensor,
    value); only ids in ``train`` count if it is given. Entities only enter through aggregates: block products, block coefficients
    and their co-moments are block x block tables, and these alone are solved on the driver.
    """
    import numpy as np

    spark = gain.sparkSession
    if train is not None:
        topography = topography.join(train.select("entity_id").distinct(), "entity_id", "left_semi")
    shares = durable(block_shares(gain, nodes))
    sizes = {r["block"]: r["n"] for r in nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    other = shares.select("sensor", F.col("block").alias("block2"), F.col("share").alias("share2"))
    products = _square(shares.join(other, "sensor").groupBy("block", "block2").agg(F.sum(F.col("share") * F.col("share2")).alias("v")).collect(), names, "block", "block2", "v")
    # Projecting a map on the shares and then solving in block space is the same as one sensor x block solver, with B x B numbers only.
    inverse = np.linalg.inv(products + TOPOGRAPHY_RIDGE * np.trace(products) / len(names) * np.eye(len(names)))
    projected = topography.join(shares, "sensor").groupBy("entity_id", "block").agg(F.sum(F.col("value") * F.col("share")).alias("c"))
    again = projected.select("entity_id", F.col("block").alias("block2"), F.col("c").alias("c2"))
    moments = _square(projected.join(again, "entity_id").groupBy("block", "block2").agg(F.covar_pop("c", "c2").alias("v")).collect(), names, "block", "block2", "v")
    strength, direction = np.linalg.eigh(inverse @ moments @ inverse)
    rows: list[tuple] = []
    for m in range(1, min(2, len(names)) + 1):
        mode = direction[:, -m]
        mode = mode - sum(mode[i] * sizes[n] for i, n in enumerate(names)) / sum(sizes.values())
        peak = mode[np.abs(mode).argmax()]
        rows += [(f"mode_{m}", n, float(mode[i] / peak) if peak else None) for i, n in enumerate(names)]
        rows.append((f"explained_{m}", None, float(strength[-m] / strength.sum()) if strength.sum() > 0 else None))
    side = [F.avg(F.when(F.col("grp") == g, F.col("value"))) for g in (first, second)]
    contrast = durable(topography.groupBy("sensor").agg((side[1] - side[0]).alias("d")))
    seen = shares.join(contrast, "sensor")
    single = seen.groupBy("block").agg(correlation(F.col("share"), F.col("d")).alias("value"), F.sum(F.col("share") * F.col("d")).alias("v"))
    per_block = {r["block"]: r for r in single.collect()}
    weight = np.linalg.pinv(products) @ np.array([per_block[n]["v"] if n in per_block else 0.0 for n in names])
    table = spark.createDataFrame([(n, float(w)) for n, w in zip(names, weight)], "block string, w double")
    fitted = seen.join(table, "block").groupBy("sensor").agg(F.sum(F.col("share") * F.col("w")).alias("f"), F.first("d").alias("d"))
    rows += [("effect_correlation", n, per_block[n]["value"] if n in per_block else None) for n in names]
    rows += [("effect_coefficient", n, float(w)) for n, w in zip(names, weight)]
    rows.append(("multivariate_correlation", None, fitted.agg(correlation(F.col("f"), F.col("d"))).first()[0]))
    return spark.createDataFrame(rows, "kind string, block string, value double")
