"""Summaries over entities, group contrasts, effects, and ranked selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS, correlation
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import global_running, hash_rank
from ..session import small_side
from .checks import guard


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "parameter", value: str = "value") -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, f"_c.{name}", f"_c.{value}")


def replicate_mean(bank: DataFrame, replicates: int) -> DataFrame:
    """Mean over replicates; a candidate coordinate without exactly that many replicates is an error."""
    keys = [c for c in bank.columns if c not in ("replicate", "value")]
    out = bank.groupBy(*keys).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") == replicates, F.col("value")).otherwise(F.raise_error(F.lit("incomplete replicates")).cast("double"))
    return out.withColumn("value", checked).drop("_n")


def group_summary(fits: DataFrame, group: str, parameters: list[str]) -> DataFrame:
    """Mean, SD, median and quartiles per group and parameter."""
    tall = unpivot(fits, [group], parameters)
    moments = tall.groupBy(group, "parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return moments.join(exact_quantiles(tall, [group, "parameter"], {"value": [(0.5, "median"), (0.25, "q25"), (0.75, "q75")]}), [group, "parameter"])


def split_summary(fits: DataFrame, by: list[str], ratios: list[str], selected: str, group_choice: str) -> DataFrame:
    """Per split: n, median of each ratio, share below 1, distinct selected candidates, share equal to the group choice."""
    sizes = fits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg((F.col(r) < 1.0).cast("double")).alias(f"share_{r}_below_1") for r in ratios],
        F.avg((F.col(selected) == F.col(group_choice)).cast("double")).alias("share_group_choice"))
    # Two-step distinct: pairs are reduced map-side before they are counted.
    distinct = fits.select(*by, selected).distinct().groupBy(*by).agg(F.count(selected).alias("unique_selected"))
    medians = exact_quantiles(fits, by, {r: [(0.5, f"median_{r}")] for r in ratios})
    return sizes.join(distinct, by).join(medians, by)


def coverage_ranges(bank: DataFrame, entities: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: bank minimum and maximum against the observed 5, 50 and 95 % points."""
    ranges = unpivot(bank, [], columns).groupBy("parameter").agg(F.min("value").alias("bank_min"), F.max("value").alias("bank_max"))
    observed = exact_quantiles(unpivot(entities, [], columns), ["parameter"], {"value": [(0.05, "p05"), (0.5, "p50"), (0.95, "p95")]})
    return ranges.join(observed, "parameter")


def group_contrast(features: DataFrame, first: str, second: str, name: str = "diff") -> DataFrame:
    """Second-group mean minus first-group mean per (block, coord)."""
    def mean(g: str) -> Column:
        return F.avg(F.when(F.col("grp") == g, F.col("value")))

    return features.groupBy("block", "coord").agg((mean(second) - mean(first)).alias(name))


def hedges_g(features: DataFrame, first: str, second: str, name: str = "g") -> DataFrame:
    """Pooled-SD effect size with the small-sample correction, per (block, coord)."""
    def pick(g: str) -> Column:
        return F.when(F.col("grp") == g, F.col("value"))

    parts = features.groupBy("block", "coord").agg(*[
        make(pick(g)).alias(f"{n}{i}") for i, g in enumerate((first, second)) for n, make in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    total = F.col("n0") + F.col("n1")
    variance = ((F.col("n0") - 1) * F.coalesce("v0", F.lit(0.0)) + (F.col("n1") - 1) * F.coalesce("v1", F.lit(0.0))) / F.greatest(total - 2, F.lit(1))
    correction = F.lit(1.0) - F.lit(3.0) / F.greatest(total * 4.0 - 9.0, F.lit(1.0))
    return parts.select("block", "coord", (correction * (F.col("m1") - F.col("m0")) / F.sqrt(F.greatest(variance, F.lit(EPS)))).alias(name))


def effect_replication(g_a: DataFrame, g_b: DataFrame, strong: float = 0.2) -> DataFrame:
    """Per block: correlation of two effect vectors, size of the first, and sign agreement of its strong entries."""
    both = g_a.select("block", "coord", F.col("g").alias("a")).join(g_b.select("block", "coord", F.col("g").alias("b")), ["block", "coord"])
    big = F.abs("a") >= strong
    return both.groupBy("block").agg(
        correlation(F.col("a"), F.col("b")).alias("r"), F.median(F.abs("a")).alias("median_abs"), F.max(F.abs("a")).alias("max_abs"),
        F.count_if(big).alias("strong"), F.avg(F.when(big, (F.signum("a") == F.signum("b")).cast("double"))).alias("sign_agreement"))


def reliability_summary(by_coord: DataFrame, by_entity: DataFrame) -> DataFrame:
    """Per block: dimensions, median r, share r >= 0.60 over coordinates, and median profile r over entities."""
    dims = by_coord.groupBy("block").agg(F.count(F.lit(1)).alias("dimensions"), F.median("r").alias("median_r"),
                                         F.avg(F.coalesce((F.col("r") >= 0.6).cast("double"), F.lit(0.0))).alias("share_r_060"))
    return dims.join(exact_quantiles(by_entity, ["block"], {"r": [(0.5, "median_profile_r")]}), "block", "left")


def effect_preservation(observed: DataFrame, predicted: DataFrame, first: str, second: str) -> DataFrame:
    """Per block: correlation and norm ratio of the predicted against the observed contrast, and both norms."""
    both = group_contrast(observed, first, second, "o").join(group_contrast(predicted, first, second, "p"), ["block", "coord"])
    norms = both.groupBy("block").agg(correlation(F.col("o"), F.col("p"), 0.0).alias("correlation"),
                                      F.sqrt(F.sum(F.col("o") * F.col("o"))).alias("observed_norm"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("predicted_norm"))
    return norms.withColumn("norm_retained", F.try_divide("predicted_norm", F.greatest("observed_norm", F.lit(1e-300))))


def axis_coverage(entities: DataFrame, bank: DataFrame, first: str, second: str) -> DataFrame:
    """Per block: do the candidates cover both group centroids along the contrast direction, and which are nearest."""
    def mean(g: str) -> Column:
        return F.avg(F.when(F.col("grp") == g, F.col("value")))

    centres = entities.groupBy("block", "coord").agg(mean(first).alias("a"), mean(second).alias("b"))
    norm = centres.groupBy("block").agg(F.sqrt(F.sum(F.pow(F.col("b") - F.col("a"), F.lit(2)))).alias("separation"))
    axis = centres.join(norm, "block").withColumn("d", (F.col("b") - F.col("a")) / F.greatest("separation", F.lit(EPS)))
    ends = axis.groupBy("block").agg(F.first("separation").alias("separation"), F.sum(F.col("a") * F.col("d")).alias("first_projection"),
                                     F.sum(F.col("b") * F.col("d")).alias("second_projection"))
    placed = bank.join(axis, ["block", "coord"]).groupBy("block", "candidate_id").agg(
        F.sum(F.col("value") * F.col("d")).alias("p"), F.avg(F.pow(F.col("value") - F.col("a"), F.lit(2))).alias("da"),
        F.avg(F.pow(F.col("value") - F.col("b"), F.lit(2))).alias("db"))
    spread = placed.groupBy("block").agg(
        F.min("p").alias("bank_min"), F.max("p").alias("bank_max"),
        F.min(F.struct("da", "candidate_id"))["candidate_id"].alias("nearest_first"), F.min(F.struct("db", "candidate_id"))["candidate_id"].alias("nearest_second"))
    return ends.join(spread, "block").select(
        "*", F.col("first_projection").between(F.col("bank_min"), F.col("bank_max")).alias("covers_first"),
        F.col("second_projection").between(F.col("bank_min"), F.col("bank_max")).alias("covers_second"))


# --- splits and ranked selections ---------------------------------------------------------------


def stratified_holdout(entities: DataFrame, group: str, fraction: float, seed: int, key: str = "entity_id") -> DataFrame:
    """+ split: in each group the first max(1, round(n * fraction)) ids of the seeded shuffle are the holdout."""
    sizes = entities.groupBy(group).agg(F.greatest(F.lit(1.0), F.bround(F.count(F.lit(1)) * F.lit(fraction))).alias("_k"))
    ranked = hash_rank(entities, [group], seed, key, "_r")
    return ranked.join(small_side(sizes), group).select(*entities.columns, F.when(F.col("_r") <= F.col("_k"), "holdout").otherwise("train").alias("split"))


def stratified_folds(entities: DataFrame, group: str, k: int, seed: int, key: str = "entity_id") -> DataFrame:
    """+ fold: shuffled rank modulo k inside each group."""
    return hash_rank(entities, [group], seed, key, "_r").select(*entities.columns, ((F.col("_r") - 1) % k).alias("fold"))


def nested_splits(entities: DataFrame, group: str, outer: int, inner: int, seed: int, key: str = "entity_id") -> DataFrame:
    """One row per entity and outer fold: role, and the inner fold of the training rows.

    Inner folds reshuffle each outer training set with seed + 1000 + fold.
    """
    folded = stratified_folds(entities.select(key, group), group, outer, seed, key)
    tall = folded.withColumn("outer_fold", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(outer)])))
    tall = tall.withColumn("outer_role", F.when(F.col("fold") == F.col("outer_fold"), "validation").otherwise("training")).drop("fold")
    inner_key = F.md5(F.concat_ws(":", (F.col("outer_fold") + (seed + 1000)).cast("string"), F.col(key).cast("string")).cast("binary"))
    training = hash_rank(tall.where("outer_role = 'training'"), ["outer_fold", group], seed, key, "_r", key=inner_key)
    training = training.select(*tall.columns, ((F.col("_r") - 1) % inner).alias("inner_fold"))
    return training.unionByName(tall.where("outer_role = 'validation'").withColumn("inner_fold", F.lit(None).cast("bigint")))


def fold_counts(splits: DataFrame, group: str) -> DataFrame:
    return splits.groupBy("outer_fold", "outer_role", group).agg(F.count(F.lit(1)).alias("n"))


def population_ranking(costs: DataFrame) -> DataFrame:
    """states ranked by cost + prior (then state id), by a range-partitioned sort."""
    scored = costs.withColumn("penalized", F.col("cost") + F.col("prior"))
    return global_running(scored, [F.col("penalized").asc(), F.col("state_id").asc()], {})


def top_states(posterior: DataFrame, k: int = 10) -> DataFrame:
    """The k heaviest states per entity with their rank; the planner keeps k rows per partition before the shuffle."""
    order = Window.partitionBy("entity_id").orderBy(F.desc("weight"), "state_id")
    return posterior.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weighted_quantile(df: DataFrame, value: str, weight: str, by: list[str], order_id: str, probabilities: dict[str, float]) -> DataFrame:
    """Interpolate value at the wanted cumulative weights; clamps below the first and above the last.

    Running sums go over range partitions, so a group of any size is spread over tasks; the two neighbours of each
    wanted weight are then plain combinable extremes.
    """
    rows = df.select(*by, value, order_id, weight)
    cumulative = global_running(rows, [F.col(value).asc(), F.col(order_id).asc()], {"_c": weight}, by, "_r")
    point = F.struct(F.col("_r").alias("r"), F.col("_c").alias("c"), F.col(value).cast("double").alias("v"))
    extremes = cumulative.groupBy(*by).agg(*[
        part for i, p in enumerate(probabilities.values())
        for part in (F.max(F.when(F.col("_c") < p, point)).alias(f"_l{i}"), F.min(F.when(F.col("_c") >= p, point)).alias(f"_u{i}"))])
    out = []
    for i, (name, p) in enumerate(probabilities.items()):
        low, high = F.col(f"_l{i}"), F.col(f"_u{i}")
        between = low["v"] + (F.lit(p) - low["c"]) * (high["v"] - low["v"]) / (high["c"] - low["c"])
        out.append(F.when(low.isNull(), high["v"]).when(high.isNull(), low["v"]).otherwise(between).alias(name))
    return extremes.select(*by, *out)


def representative_entity(fits: DataFrame, group: str, ratio: str, key: str = "entity_id") -> DataFrame:
    """Per group the entity whose ratio is closest to the group median (lowest id on ties)."""
    medians = exact_quantiles(fits, [group], {ratio: [(0.5, "median")]})
    return fits.join(small_side(medians), group).groupBy(group).agg(
        F.first("median").alias("median"), F.min(F.struct(F.abs(F.col(ratio) - F.col("median")).alias("d"), F.col(key).alias("k"), F.col(ratio).alias("r"))).alias("_b")).select(
        group, "median", F.col("_b.k").alias(key), F.col("_b.r").alias(ratio))


def sweep_ranking(runs: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """Named one-row results as one table, ranked by the given columns; a sweep has few runs."""
    out = None
    for name, row in runs.items():
        named = row.withColumn("variant", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, "variant")))
