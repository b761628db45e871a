"""Exact, linearly interpolated quantiles of groups of any size.

A mergeable sketch brackets every wanted order statistic; only the rows inside the brackets are
then ranked. A group with a third of all rows contributes a sketch per partition plus the few rows
between its brackets, never its whole content, to any one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 2000


def exact_quantiles(df: DataFrame, by: list[str], values: dict[str, list[tuple[float, str]]],
                    accuracy: int = ACCURACY) -> DataFrame:
    """One row per group of ``by`` with every requested quantile.

    ``values`` maps a value column to ``[(probability, output name), ...]``. NULLs are skipped. The
    result equals the interpolation at position ``p * (n - 1)`` of the sorted values.
    """
    names = list(values)
    tall = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(n).alias("_v"), F.col(n).cast("double").alias("_x")) for n in names])).alias("_s")
    ).select(*by, "_s._v", "_s._x") if len(names) > 1 else df.select(
        *by, F.lit(names[0]).alias("_v"), F.col(names[0]).cast("double").alias("_x"))
    tall = tall.where(F.col("_x").isNotNull())
    keys = [*by, "_v"]
    probabilities = sorted({p for wanted in values.values() for p, _ in wanted})
    step = 2.0 / accuracy
    marks = [m for p in probabilities for m in (max(0.0, p - step), min(1.0, p + step))]
    sketch = tall.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_x", marks, accuracy).alias("_q"))
    # Map-side combined counts of distinct values; ties of any size collapse to one row.
    counted = tall.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    match = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = counted.alias("c").join(sketch.alias("s"), match).select(
        *[F.col(f"c.{k}") for k in keys], "c._x", "c._c", "s._n", "s._q")
    below, picked = [], []
    for i, p in enumerate(probabilities):
        # The sketch is off by at most n / accuracy ranks, so for larger groups a margin of twice that is
        # sure to bracket both neighbours; a small group is ranked whole.
        small = F.col("_n") <= 4 * accuracy
        low = F.when(small, F.lit(float("-inf"))).otherwise(F.element_at("_q", 2 * i + 1))
        high = F.when(small, F.lit(float("inf"))).otherwise(F.element_at("_q", 2 * i + 2))
        inside = (F.col("_x") >= low) & (F.col("_x") <= high)
        below.append(F.sum(F.when(F.col("_x") < low, F.col("_c")).otherwise(0)).alias(f"_b{i}"))
        picked.append(F.when(inside, F.lit(i)))
    bases = joined.groupBy(*keys).agg(F.first("_n").alias("_n"), *below)
    bases = bases.select(*keys, "_n", F.array(*[f"_b{i}" for i in range(len(probabilities))]).alias("_below"))
    kept = joined.select(*keys, "_x", "_c", F.explode(F.array_compact(F.array(*picked))).alias("_i"))
    running = Window.partitionBy(*keys, "_i").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_cum", F.sum("_c").over(running))
    match = [F.col(f"k.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    ranked = kept.alias("k").join(bases.alias("b"), match).select(
        *[F.col(f"k.{k}") for k in keys], "k._x", "k._c", "k._i", "b._n",
        (F.col("k._cum") + F.element_at("b._below", F.col("k._i") + 1)).alias("_upto"),
        F.element_at(F.array(*[F.lit(p) for p in probabilities]), F.col("k._i") + 1).alias("_p"))
    position = F.col("_p") * (F.col("_n") - 1)
    ranked = ranked.withColumn("_lo", F.floor(position)).withColumn("_frac", position - F.floor(position))
    points = ranked.groupBy(*keys, "_i").agg(
        F.min(F.when(F.col("_upto") > F.col("_lo"), F.col("_x"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.least(F.col("_lo") + 1, F.col("_n") - 1), F.col("_x"))).alias("_z"),
        F.first("_frac").alias("_frac"),
        # The first kept row must not lie beyond the wanted rank with rows missing below it.
        (F.min("_upto") - F.min_by("_c", "_x") <= F.first("_lo")).alias("_first"))
    # A bracket that missed its order statistic would give NULL or a wrong value: fail instead.
    held = points["_a"].isNotNull() & points["_z"].isNotNull() & points["_first"]
    value = F.col("_a") + F.col("_frac") * (F.col("_z") - F.col("_a"))
    points = points.withColumn("_value", F.when(held, value).otherwise(F.raise_error(F.lit("a quantile bracket missed its rank")).cast("double")))
    columns = []
    for n, wanted in values.items():
        for p, alias in wanted:
            hit = (F.col("_v") == n) & (F.col("_i") == probabilities.index(p))
            columns.append(F.max(F.when(hit, F.col("_value"))).alias(alias))
    return points.groupBy(*by).agg(*columns)
