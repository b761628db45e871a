"""Queries that save a fitted transform, read it back, and apply it to entities outside the training split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..session import stage_path
from ..sources import transform_store
from . import transforms
from .feature_queries import letters
from .registry import query

_WEIGHTS = {"vowel": 0.6, "consonant": 0.4}


def _split(spark, sf):
    data = letters(spark, sf)
    return data.where("split = 'train'"), data.where("split <> 'train'").select("entity_id", "segment", "block", "coord", "value")


@query("saved_selection", f"""
k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY r DESC, coord) AS rk, count(*) OVER (PARTITION BY block) AS d, count(*) FILTER (r >= 0.6) OVER (PARTITION BY block) AS p FROM fx_rel),
ke AS (SELECT block, coord, count(*) OVER (PARTITION BY block) AS n FROM k WHERE rk <= CASE WHEN least(p, 8) >= least(4, d) THEN least(p, 8) ELSE least(4, 8, d) END)
SELECT z.entity_id, z.segment, z.block, z.coord, round(z.value * sqrt(CASE z.block WHEN 'vowel' THEN {_WEIGHTS["vowel"]}::DOUBLE ELSE {_WEIGHTS["consonant"]}::DOUBLE END / n), 6) + 0.0 AS value
FROM fx_z z JOIN ke ON ke.block = z.block AND ke.coord = z.coord WHERE z.split <> 'train'
""", ("fx_rel", "fx_z"))
def saved_selection(spark, sf):
    train, unseen = _split(spark, sf)
    root = stage_path(spark, "transforms")
    transforms.save_selection(spark, root, "letters", train, 0.6, {"vowel": 8, "consonant": 8}, 4, _WEIGHTS)
    fitted = transform_store.load(spark, root, "letters", expected={"selection": transforms.SELECTION})
    return transforms.apply_saved(fitted, unseen).select("entity_id", "segment", "block", "coord", rnd("value").alias("value"))


@query("saved_components")
def saved_components(spark, sf):
    train, unseen = _split(spark, sf)
    root = stage_path(spark, "transforms")
    transforms.save_components(spark, root, "letters", train.where("segment = 'fit'"), 4)
    out = transforms.apply_saved(transform_store.load(spark, root, "letters"), unseen)
    return out.select("entity_id", "segment", F.col("coord").cast("long").alias("coord"), rnd("value").alias("value"))


# Orthonormal components keep lengths: with all of them, an entity's squared scores add up to those of its centred features.
@query("component_lengths", """
m AS (SELECT block, coord, avg(value) AS m FROM fx_z WHERE split = 'train' AND segment = 'fit' GROUP BY 1, 2)
SELECT entity_id, segment, round(sum((value - m) ** 2), 4) + 0.0 AS squared FROM fx_z JOIN m USING (block, coord) WHERE split <> 'train' GROUP BY 1, 2
""", ("fx_z",))
def component_lengths(spark, sf):
    from ..operators import features, tall_qr
    from .feature_queries import train_stats

    train, unseen = _split(spark, sf)
    stat = train_stats(train)
    fitted = tall_qr.fit(features.apply_standardize(train.where("segment = 'fit'").select("entity_id", "block", "coord", "value"), stat), 26)
    scores = tall_qr.project(features.apply_standardize(unseen, stat), fitted, 26)
    return scores.groupBy("entity_id", "segment").agg(F.sum(F.col("value") * F.col("value")).alias("s")).select("entity_id", "segment", rnd("s", 4).alias("squared"))
