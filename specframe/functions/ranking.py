"""Ranks and running sums without sending a whole group to one task.

``hash_rank`` spreads a group over hash buckets, so any group size works with one shuffle of the rows.
``global_running`` sorts by range and adds per-partition offsets, so no unpartitioned window is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .expr import hash_hex


def hash_rank(df: DataFrame, groups: list[str], seed, ident: str, name: str = "shuffled_rank",
              hex_digits: int = 3, key: Column | None = None) -> DataFrame:
    """1-based rank of every row in its group, in the order of the seeded hash of ``ident``.

    Rows are bucketed by the leading hex digits of the hash. Bucket sizes are counted with map-side
    combining, their running sum gives each bucket's offset, and the row window only spans one bucket.
    """
    key = key if key is not None else hash_hex(seed, F.col(ident))
    keyed = df.withColumn("_h", key).withColumn("_b", F.substring("_h", 1, hex_digits))
    sizes = keyed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*groups, "_b").orderBy("_h", ident)
    ranked = keyed.withColumn("_r", F.row_number().over(inside))
    matched = None
    for column in [*groups, "_b"]:
        term = F.col(f"r.{column}").eqNullSafe(F.col(f"o.{column}"))
        matched = term if matched is None else matched & term
    return (
        ranked.alias("r").join(offsets.alias("o"), matched)
        .select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._r") + F.col("o._o")).cast("bigint").alias(name))
    )


def global_running(df: DataFrame, order: list[Column], sums: dict[str, str], groups: list[str] | None = None,
                   name: str = "rank") -> DataFrame:
    """Rank (1-based) and inclusive running sums along a global or per-group order.

    ``order`` must be total. Rows are range-partitioned by (groups, order) and written to the checkpoint
    folder, which pins the partition bounds; the per-partition totals (one small row per partition and
    group) give offsets that are joined back.
    """
    groups = groups or []
    keys = [F.col(g).asc_nulls_first() for g in groups] + order
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    placed = durable(placed.withColumn("_p", F.shiftright("_m", 33)))
    part_keys = [*groups, "_p"]
    totals = placed.groupBy(*part_keys).agg(
        F.min("_m").alias("_start"), F.count(F.lit(1)).alias("_n"),
        *[F.sum(source).alias(f"_s_{target}") for target, source in sums.items()])
    spec = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    before = spec.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part_keys, "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on"),
        *[F.coalesce(F.sum(f"_s_{t}").over(before), F.lit(0)).alias(f"_o_{t}") for t in sums])
    joined = placed.join(offsets, part_keys) if not groups else placed.alias("a").join(
        offsets.alias("b"),
        [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in part_keys]).select(
            "a.*", "b._start", "b._on", *[f"b._o_{t}" for t in sums])
    out = joined.withColumn(name, (F.col("_m") - F.col("_start") + 1 + F.col("_on")).cast("bigint"))
    if sums:
        local = Window.partitionBy(*part_keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
        for target, source in sums.items():
            out = out.withColumn(target, F.sum(source).over(local) + F.col(f"_o_{target}"))
    return out.select(*df.columns, name, *sums)
