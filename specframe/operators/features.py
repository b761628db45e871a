"""Feature tables features(entity_id, segment, block, coord, value): scaling, reliability, selection, projection.

Everything fitted is fitted on the rows the caller passes as training rows; group labels are never read.
Fitted tables have one row per coordinate, a number set by the feature design and not by the data volume,
so windows and exact percentiles over coordinates are bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packing import declared_axis, dense
from ..functions.expr import correlation
from ..session import small_side
from .checks import guard


def robust_standardize(train: DataFrame, floor: tuple[str, float] = ("p10", 0.1)) -> DataFrame:
    """transform_stats(block, coord, mean, scale); SDs at or below the block's floor are replaced by it.

    ``floor`` is ("p10", factor) or ("median", factor) of the block's positive SDs.
    """
    stats = train.groupBy("block", "coord").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("_sd"))
    probability = {"p10": 0.1, "median": 0.5}[floor[0]]
    positive = F.when((F.col("_sd") > 0) & ~F.isnan("_sd"), F.col("_sd"))
    floors = stats.groupBy("block").agg(F.coalesce(F.percentile(positive, probability) * floor[1], F.lit(1.0)).alias("_f"))
    return stats.join(floors, "block").select("block", "coord", "mean", F.when(F.col("_sd") > F.col("_f"), F.col("_sd")).otherwise(F.col("_f")).alias("scale"))


def apply_standardize(features: DataFrame, stats: DataFrame) -> DataFrame:
    joined = features.join(small_side(stats.select("block", "coord", "mean", "scale")), ["block", "coord"])
    return joined.withColumn("value", (F.col("value") - F.col("mean")) / F.col("scale")).select(*features.columns)


def paired_segments(features: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """(entity_id, block, coord, x, y): the two segments side by side, by one conditional aggregate."""
    keys = keys or ["entity_id", "block", "coord"]
    value = F.col("value")
    return features.where(F.col("segment").isin(a, b)).groupBy(*keys).agg(
        F.max(F.when(F.col("segment") == a, value)).alias("x"), F.max(F.when(F.col("segment") == b, value)).alias("y"))


def split_half_reliability(features: DataFrame, a: str, b: str, axis: str = "coord", on_constant: float | None = -math.inf) -> DataFrame:
    """Pearson r between two segments: per (block, coord) over entities, or per (entity, block) over coordinates."""
    keys = {"coord": ["block", "coord"], "entity": ["entity_id", "block"]}[axis]
    return paired_segments(features, a, b).groupBy(*keys).agg(correlation(F.col("x"), F.col("y"), on_constant).alias("r"))


def select_reliable(reliability: DataFrame, threshold: float, maximum: int, minimum: int, by: list[str] = ["block"]) -> DataFrame:
    """Coordinates with r >= threshold, best first, at most ``maximum``; if fewer than ``minimum`` pass, the best ``minimum``.

    Adds ``out_coord``, the 0-based position in that order. Ties go to the lower coordinate.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("r"), "coord")
    whole = Window.partitionBy(*by)
    ranked = (
        reliability.withColumn("_rank", F.row_number().over(order))
        .withColumn("_d", F.count(F.lit(1)).over(whole)).withColumn("_pass", F.count_if(F.col("r") >= threshold).over(whole))
    )
    enough = F.least(F.col("_pass"), F.lit(maximum)) >= F.least(F.lit(minimum), F.col("_d"))
    limit = F.when(enough, F.least(F.col("_pass"), F.lit(maximum))).otherwise(F.least(F.lit(minimum), F.lit(maximum), F.col("_d")))
    return ranked.where(F.col("_rank") <= limit).select(*reliability.columns, (F.col("_rank") - 1).cast("bigint").alias("out_coord"))


def select_balanced(reliability: DataFrame, threshold: float, maximum: int, minimum: int) -> DataFrame:
    """The same rule inside the real and the imaginary half (column ``part``), each with half of the limits."""
    return select_reliable(reliability, threshold, max(maximum // 2, 1), max(minimum // 2, 1), ["block", "part"])


def select_edges_by_band(reliability: DataFrame, bands: list[str], threshold: float, maximum: int) -> DataFrame:
    """Reliable coordinates of the allowed bands, best first; none at all is an error."""
    allowed = reliability.where(F.col("band").isin(bands) & (F.col("r") >= threshold))
    ranked = allowed.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("r"), "band", "coord")))
    none = allowed.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return guard(ranked.where(F.col("_rank") <= maximum).select(*reliability.columns, (F.col("_rank") - 1).cast("bigint").alias("out_coord")),
                 none, "no coordinate passes the reliability threshold")


def pack(features: DataFrame, keys: list[str], name: str = "f") -> DataFrame:
    """One dense array per entity, ordered by (block, coord) where present; an entity with a missing coordinate is an error."""
    order = [c for c in ("block", "coord") if c in features.columns]
    packed = features.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("_z"))
    return dense(packed, {"_z": name}, declared_axis(features, order), order, keys[0])


def pca_scores(standard: DataFrame, k: int) -> tuple[DataFrame | None, DataFrame]:
    """(components([block,] coord, comp, coord_index, loading, mean, width), scores(entity_id, coord, value)) of standardised training features.

    Components come from a tree of QR factors (``tall_qr``). k = 0 keeps all coordinates and fits nothing. Each component's largest loading is positive.
    """
    from ..session import durable
    from . import tall_qr

    if k <= 0:
        return None, standard.select("entity_id", "coord", "value")
    rows = standard.select("entity_id", *[c for c in ("block", "coord") if c in standard.columns], "value")
    components = durable(tall_qr.fit(rows, k))
    return components, tall_qr.project(rows, components, k)


def score_scales(scores: DataFrame) -> DataFrame:
    """(coord, score_scale): SD of each component score with the p10 floor."""
    return robust_standardize(scores.withColumn("block", F.lit("s"))).select("coord", F.col("scale").alias("score_scale"))


def pooled_matrix(csd: DataFrame) -> DataFrame:
    """(ch_i, ch_j, value): mean over recordings and frequencies of the trace-normalised real cross-spectrum."""
    key = "recording_id"
    trace = csd.where(F.col("ch_i") == F.col("ch_j")).groupBy(key, "freq").agg(F.sum("re").alias("_t")).groupBy(key).agg(F.avg("_t").alias("_t"))
    return csd.join(trace, key).groupBy("ch_i", "ch_j").agg(F.avg(F.col("re") / F.greatest("_t", F.lit(1e-300))).alias("value"))


def spatial_basis(train_csd: DataFrame, modes: int) -> DataFrame:
    """(channel, mode, loading): top eigenvectors of the pooled matrix, largest absolute entry positive.

    The pooled matrix is channels x channels whatever the number of recordings; it is solved on the driver.
    """
    import numpy as np

    cells = pooled_matrix(train_csd).collect()
    names = sorted({r["ch_i"] for r in cells})
    index = {c: i for i, c in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    for r in cells:
        matrix[index[r["ch_i"]], index[r["ch_j"]]] = matrix[index[r["ch_j"]], index[r["ch_i"]]] = r["value"]
    _, vectors = np.linalg.eigh(matrix)
    basis = vectors[:, ::-1][:, :modes]
    pivot = np.sign(basis[np.abs(basis).argmax(axis=0), range(basis.shape[1])])
    basis = basis * np.where(pivot == 0, 1.0, pivot)
    return train_csd.sparkSession.createDataFrame(
        [(c, m, float(basis[index[c], m])) for c in names for m in range(basis.shape[1])], "channel string, mode int, loading double")


def project_basis(csd: DataFrame, basis: DataFrame, shrinkage: float) -> DataFrame:
    """csd(.., freq, m_i, m_j, re, im) = B' S B with the off-diagonal shrunk by (1 - shrinkage), upper triangle.

    A Hermitian pair (i, j) adds re (B_ia B_jb + B_ja B_ib) and im (B_ia B_jb - B_ja B_ib) to mode pair (a, b). These
    weights form one small table (channel pairs x mode pairs), so the product is a single join-aggregate.
    """
    from .signal import rec_keys

    b1, b2 = basis.select(F.col("channel").alias("ch_i"), F.col("mode").alias("m1"), F.col("loading").alias("l1")), basis.select(
        F.col("channel").alias("ch_j"), F.col("mode").alias("m2"), F.col("loading").alias("l2"))
    # loadings of one channel as an array indexed by mode
    left = b1.groupBy("ch_i").agg(F.array_sort(F.collect_list(F.struct("m1", "l1"))).alias("a")).select("ch_i", F.col("a.l1").alias("a"))
    right = b2.groupBy("ch_j").agg(F.array_sort(F.collect_list(F.struct("m2", "l2"))).alias("b")).select("ch_j", F.col("b.l2").alias("b"))
    pairs = csd.select("ch_i", "ch_j").distinct().join(left, "ch_i").join(right, "ch_j")
    pairs = pairs.select("ch_i", "ch_j", "a", "b", F.explode(F.sequence(F.lit(0), F.size("a") - 1)).alias("m_i")).select(
        "*", F.explode(F.sequence(F.col("m_i"), F.size("a") - 1)).alias("m_j"))

    def at(array: str, i: str) -> Column:
        return F.get(array, F.col(i))

    one, two = at("a", "m_i") * at("b", "m_j"), at("a", "m_j") * at("b", "m_i")
    same = F.col("ch_i") == F.col("ch_j")
    weights = pairs.select("ch_i", "ch_j", "m_i", "m_j", F.when(same, one).otherwise(one + two).alias("wr"), F.when(same, 0.0).otherwise(one - two).alias("wi"))
    keys = [*rec_keys(csd), "freq"]
    keep = F.when(F.col("m_i") == F.col("m_j"), 1.0).otherwise(1.0 - shrinkage)
    return csd.join(weights, ["ch_i", "ch_j"]).groupBy(*keys, "m_i", "m_j").agg(
        F.sum(F.col("re") * F.col("wr")).alias("re"), F.sum(F.col("im") * F.col("wi")).alias("im")).select(
        *keys, "m_i", "m_j", (F.col("re") * keep).alias("re"), (F.col("im") * keep).alias("im"))


def weighted_features(standard: DataFrame, weights: dict[str, float]) -> DataFrame:
    """value x sqrt(block weight / block size); the sizes come from the distinct coordinates."""
    sizes = standard.select("block", "coord").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    weight = F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("block"))
    return standard.join(small_side(sizes), "block").withColumn("value", F.col("value") * F.sqrt(weight / F.col("_n"))).select(*standard.columns)


def feature_blocks(blocks: dict[str, DataFrame], all_name: str = "all") -> DataFrame:
    """Named blocks (entity_id, coord, value) as one feature table, plus a block with every coordinate."""
    out = None
    for name, df in blocks.items():
        named = df.select("entity_id", F.lit(name).alias("block"), F.col("coord").cast("string").alias("coord"), "value")
        out = named if out is None else out.unionByName(named)
    both = F.explode(F.array(F.struct("block", "coord"), F.struct(F.lit(all_name).alias("block"), F.concat_ws(":", "block", "coord").alias("coord"))))
    return out.select("entity_id", both.alias("b"), "value").select("entity_id", "b.block", "b.coord", "value")


def residualize(features: DataFrame, covariates: DataFrame, train: Column) -> DataFrame:
    """Remove linear age and sex effects fitted on the training rows; the intercept is kept.

    features(entity_id, coord, value), covariates(entity_id, age, sex, ..). Per coordinate the two slopes
    come from five centred co-moments, which are combinable aggregates.
    """
    scale = covariates.where(train).agg(F.avg("age").alias("_m"), F.stddev_samp("age").alias("_s"))
    people = covariates.join(F.broadcast(scale)).select(
        "entity_id", train.alias("_train"), ((F.col("age") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).alias("_a"), F.col("sex").alias("_x"))
    rows = features.join(people, "entity_id")

    def cov(p: str, q: str) -> Column:
        return F.covar_pop(F.when(F.col("_train"), F.col(p)), F.when(F.col("_train"), F.col(q)))

    moments = rows.groupBy("coord").agg(cov("_a", "_a").alias("aa"), cov("_x", "_x").alias("xx"), cov("_a", "_x").alias("ax"),
                                        cov("_a", "value").alias("ay"), cov("_x", "value").alias("xy"))
    det = F.col("aa") * F.col("xx") - F.col("ax") * F.col("ax")
    slopes = moments.select("coord", F.try_divide(F.col("ay") * F.col("xx") - F.col("xy") * F.col("ax"), det).alias("_ba"),
                            F.try_divide(F.col("xy") * F.col("aa") - F.col("ay") * F.col("ax"), det).alias("_bx"))
    return rows.join(slopes, "coord").select(
        *[(F.col("value") - F.col("_a") * F.col("_ba") - F.col("_x") * F.col("_bx")).alias("value") if c == "value" else F.col(c) for c in features.columns])


def anova_select(features: DataFrame, label: str, k: int) -> DataFrame:
    """(coord, f, rank) of the k coordinates with the largest one-way F statistic."""
    groups = features.groupBy("coord", label).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    total = F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / total
    within = F.sum(F.col("n") * F.col("v"))
    count = F.count(F.lit(1))
    scores = groups.groupBy("coord").agg(F.try_divide(between / (count - 1), within / (total - count)).alias("f"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("f"), "coord")).cast("bigint")).where(F.col("rank") <= k)
