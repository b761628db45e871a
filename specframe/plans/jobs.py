"""Multi-stage jobs composed of the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import features, spectral, stats, tree_ensemble
from ..session import durable
from .nested import nested_evaluation  # noqa: F401


def raw_blocks(csd: DataFrame, basis: DataFrame, metric: str, shrinkage: float, background: Column, alpha: tuple[float, float]) -> DataFrame:
    """features(recording_id[, segment], block, coord, value) of cross-spectra in a sensor basis.

    Blocks: ``auto`` (1/f-free log power of each mode and its exponent), ``cross`` (connectivity of mode pairs) and
    ``topography`` (band power per channel).
    """
    keys = [c for c in ("recording_id", "segment") if c in csd.columns]
    projected = durable(features.project_basis(csd, basis, shrinkage).select(
        *keys, "freq", F.lpad(F.col("m_i").cast("string"), 3, "0").alias("ch_i"), F.lpad(F.col("m_j").cast("string"), 3, "0").alias("ch_j"), "re", "im"))
    logp = spectral.diagonal(projected).withColumn("value", F.ln(F.greatest("p", F.lit(2.2250738585072014e-308)))).drop("p")
    fits, residuals = spectral.aperiodic_fit(logp, background)
    auto = residuals.select(*keys, F.concat_ws("@", F.col("channel"), F.col("freq").cast("string")).alias("coord"), "value").unionByName(
        fits.select(*keys, F.concat(F.col("channel"), F.lit("@exponent")).alias("coord"), F.col("exponent").alias("value")))
    cross = spectral.coherency(projected, metric).select(*keys, F.concat_ws("@", "part", "ch_i", "ch_j", F.col("freq").cast("string")).alias("coord"), "value")
    topography = spectral.csd_topography(csd, *alpha).select(*keys, F.col("channel").alias("coord"), "value")
    named = [df.withColumn("block", F.lit(name)) for name, df in (("auto", auto), ("cross", cross), ("topography", topography))]
    return reduce(DataFrame.unionByName, named)


def fit_transform(csd: DataFrame, train: DataFrame, modes: int, metric: str, shrinkage: float, background: Column, alpha: tuple[float, float],
                  threshold: float, maximum: dict[str, int], minimum: int) -> tuple[DataFrame, DataFrame]:
    """Fit the whole feature transform on the training recordings; labels are never read.

    csd has segments fit, rel_a and rel_b; train(recording_id). Returns (basis, transform(block, coord, mean, scale, r, out_coord)); only
    selected coordinates are listed. Both tables are small and are stored as they are.
    """
    # Stored once: the basis, the projection and each block read the cross-spectra again, and making them is most of the work.
    rows = durable(csd.where(F.col("segment").isin("fit", "rel_a", "rel_b")).join(train.select("recording_id"), "recording_id", "left_semi"))
    basis = features.spatial_basis(rows.where("segment = 'fit'").drop("segment"), modes)
    raw = durable(raw_blocks(rows, basis, metric, shrinkage, background, alpha)).withColumnRenamed("recording_id", "entity_id")
    scales = durable(features.robust_standardize(raw.where("segment = 'fit'")))
    standard = features.apply_standardize(raw.where(F.col("segment").isin("rel_a", "rel_b")), scales)
    reliability = durable(features.split_half_reliability(standard, "rel_a", "rel_b"))
    chosen = [features.select_reliable(reliability.where(F.col("block") == b), threshold, k, minimum) for b, k in maximum.items()]
    return basis, reduce(DataFrame.unionByName, chosen).join(scales, ["block", "coord"]).select("block", "coord", "mean", "scale", "r", "out_coord")


def apply_transform(raw: DataFrame, transform: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Selected, standardised and weighted features; the fitted table is joined to the rows."""
    kept = features.apply_standardize(raw.join(transform.select("block", "coord"), ["block", "coord"], "left_semi"), transform)
    return features.weighted_features(kept, weights)


def feature_audit(fit: DataFrame, unseen: DataFrame, bank: DataFrame, predicted: DataFrame, first: str, second: str, thresholds: dict[str, float],
                  signal: dict[str, DataFrame] | None = None, learned: DataFrame | None = None) -> DataFrame:
    """report(report, block, metric, value) of reliability, effect replication, axis coverage, preservation and the quality gate.

    ``signal`` adds the group signal: per adjustment, the rows of ``cv_group_signal``, reported as mean, smallest and largest over the repeats.
    ``learned`` adds the rows of ``learnability`` and their summary. In these reports ``block`` is the adjustment or the parameter.
    """
    fit, unseen, bank, predicted = durable(fit), durable(unseen), durable(bank), durable(predicted)
    both = fit.withColumn("segment", F.lit("fit")).unionByName(unseen.withColumn("segment", F.lit("validation")))
    tables = {
        "reliability": stats.reliability_summary(features.split_half_reliability(both, "fit", "validation", "coord", None),
                                                 features.split_half_reliability(both, "fit", "validation", "entity", None)),
        "replication": stats.effect_replication(stats.hedges_g(fit, first, second), stats.hedges_g(unseen, first, second)),
        "coverage": stats.axis_coverage(fit, bank, first, second).drop("nearest_first", "nearest_second"),
        "preservation": stats.effect_preservation(unseen, predicted, first, second)}
    gate = F.lit(None).cast("double")
    for block, limit in thresholds.items():
        gate = F.when(F.col("block") == block, (F.col("correlation") >= limit).cast("double")).otherwise(gate)
    tables["preservation"] = tables["preservation"].withColumn("passes_gate", gate)
    parts = []
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "block"]
        numeric = df.select("block", *[F.col(c).cast("double").alias(c) for c in columns])
        parts.append(stats.unpivot(numeric, ["block"], columns, "metric").select(F.lit(name).alias("report"), "block", "metric", "value"))
    for name, df in (signal or {}).items():
        measures = ("roc_auc", "balanced_accuracy", "brier")
        cells = {f"{kind}_{m}": f(m) for m in measures for kind, f in (("mean", F.avg), ("smallest", F.min), ("largest", F.max))}
        row = df.agg(F.count(F.lit(1)).alias("repeats"), *[c.alias(n) for n, c in cells.items()]).withColumn("block", F.lit(name))
        parts.append(stats.unpivot(row, ["block"], ["repeats", *cells], "metric").select(F.lit("group_signal").alias("report"), "block", "metric", "value"))
    if learned is not None:
        learned = durable(learned)
        each = learned.withColumnRenamed("parameter", "block")
        whole = tree_ensemble.learnability_summary(learned.withColumn("block", F.lit("all")), ["block"])
        for df, columns in ((each, ["r2", "nrmse"]), (whole, ["median_r2", "positive", "parameters"])):
            parts.append(stats.unpivot(df, ["block"], columns, "metric").select(F.lit("learnability").alias("report"), "block", "metric", "value"))
    return reduce(DataFrame.unionByName, parts)
