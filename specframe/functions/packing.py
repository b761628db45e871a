"""Packing long features into arrays without losing which coordinate a value belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def declared_axis(features: DataFrame, order: list[str], axis: list | None = None) -> DataFrame:
    """One row with the sorted coordinates that every packed array must have: those given, or all that occur in ``features``."""
    if axis is not None:
        values = F.array(*[F.struct(F.lit(v).alias(order[0])) for v in sorted(axis)])
        return features.sparkSession.range(1).select(values.alias("_axis"))
    return features.agg(F.array_sort(F.collect_set(F.struct(*order))).alias("_axis"))


def dense(packed: DataFrame, arrays: dict[str, str], axis: DataFrame, order: list[str], ident: str) -> DataFrame:
    """Replace sorted (order.., value) arrays by plain values; an array with a missing, repeated or other coordinate is an error.

    ``arrays`` maps column -> new name. The error names the entity.
    """
    def values(column: str) -> Column:
        own = F.transform(column, lambda x: F.struct(*[x[c].alias(c) for c in order]))
        wrong = F.concat(F.lit("coordinates are missing, repeated or unknown for "), F.col(ident).cast("string"))
        return F.when(own == F.col("_axis"), F.transform(column, lambda x: x["value"])).otherwise(F.raise_error(wrong).cast("array<double>"))

    joined = packed.join(F.broadcast(axis))
    kept = [c for c in packed.columns if c not in arrays]
    return joined.select(*kept, *[values(column).alias(name) for column, name in arrays.items()])
