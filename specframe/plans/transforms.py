"""Feature transforms that are fitted once, saved, and applied to rows they have not seen.

Two kinds: standardised and weighted coordinates of high split-half reliability, and scaled principal component scores. Group labels are
never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, tall_qr
from ..session import durable, small_side
from ..sources import transform_store
from ..sources.transform_store import Fitted

SELECTION = "block string, mean double, scale double, r double, out_coord bigint"


def save_selection(spark: SparkSession, root: str, name: str, train: DataFrame, threshold: float, maximum: dict[str, int], minimum: int,
                   weights: dict[str, float]) -> int:
    """Fit on features(entity_id, segment, block, coord, value) with segments fit, rel_a and rel_b, and save; returns the version.

    Means and scales come from ``fit``; coordinates are chosen per block by the correlation of ``rel_a`` and ``rel_b``.
    """
    train = durable(train.where(F.col("segment").isin("fit", "rel_a", "rel_b")))
    scales = features.robust_standardize(train.where("segment = 'fit'"))
    reliability = features.split_half_reliability(train, "rel_a", "rel_b")
    chosen = [features.select_reliable(reliability.where(F.col("block") == b), threshold, k, minimum) for b, k in maximum.items()]
    selection = reduce(DataFrame.unionByName, chosen).join(scales, ["block", "coord"]).select("block", "coord", "mean", "scale", "r", "out_coord")
    return transform_store.save(spark, root, name, {"selection": selection}, {"kind": "selection", "threshold": threshold, "maximum": maximum, "minimum": minimum, "weights": weights})


def save_components(spark: SparkSession, root: str, name: str, train: DataFrame, k: int, partitions: int = 64) -> int:
    """Fit scaling, ``k`` principal components and the scale of each score on features(entity_id, block, coord, value), and save."""
    train = durable(train.select("entity_id", "block", "coord", "value"))
    scales = durable(features.robust_standardize(train))
    standard = durable(features.apply_standardize(train, scales))
    components = durable(tall_qr.fit(standard, k, partitions))
    found = components.agg(F.coalesce(F.max("comp") + 1, F.lit(0)).alias("n")).first()["n"]  # fewer than k where there are too few rows
    score_scales = features.score_scales(tall_qr.project(standard, components, found))
    return transform_store.save(spark, root, name, {"scales": scales, "components": components, "score_scales": score_scales}, {"kind": "components", "k": found})


def _selected(fitted: Fitted, rows: DataFrame) -> DataFrame:
    selection, weights = fitted.tables["selection"], fitted.parameters["weights"]
    kept = features.apply_standardize(rows, selection)
    # A block's size is that of the fitted selection, whatever coordinates the new rows have.
    sizes = selection.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    weight = F.element_at(F.create_map(*[F.lit(x) for b, w in weights.items() for x in (b, float(w))]), F.col("block"))
    return kept.join(small_side(sizes), "block").withColumn("value", F.col("value") * F.sqrt(weight / F.col("_n"))).select(*rows.columns)


def _scored(fitted: Fitted, rows: DataFrame) -> DataFrame:
    scores = tall_qr.project(features.apply_standardize(rows, fitted.tables["scales"]), fitted.tables["components"], fitted.parameters["k"])
    scaled = scores.join(small_side(fitted.tables["score_scales"]), "coord")
    return scaled.withColumn("value", F.col("value") / F.col("score_scale")).select(*scores.columns)


def apply_saved(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """The fitted transform of features(entity_id, .., block, coord, value); fitted tables are joined to the rows, nothing is fitted."""
    return {"selection": _selected, "components": _scored}[fitted.parameters["kind"]](fitted, rows)
