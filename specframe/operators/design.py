"""Parameter ranges, candidate design tables and nuisance grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_running
from ..session import small_side
from .checks import dedupe_keep_first

Ranges = dict[str, tuple[float, float]]


def from_unit(column: Column, lo: float, hi: float, log: bool) -> Column:
    """Unit interval -> [lo, hi], linear or logarithmic."""
    if log:
        return F.exp(F.ln(F.lit(float(lo))) + column * F.ln(F.lit(float(hi) / float(lo))))
    return F.lit(float(lo)) + column * (float(hi) - float(lo))


def to_unit(column: Column, lo: float, hi: float, log: bool) -> Column:
    if log:
        return F.ln(column / float(lo)) / F.ln(F.lit(float(hi) / float(lo)))
    return (column - float(lo)) / (float(hi) - float(lo))


def normalize(column: Column, lo: float, hi: float, log: bool) -> Column:
    """[lo, hi] -> [-1, 1]."""
    return to_unit(column, lo, hi, log) * 2.0 - 1.0


def denormalize(column: Column, lo: float, hi: float, log: bool) -> Column:
    """[-1, 1] -> [lo, hi], clipped so that rounding cannot leave the range."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), from_unit((column + 1.0) / 2.0, lo, hi, log)))


def range_map(df: DataFrame, ranges: Ranges, log: set[str], direction: str) -> DataFrame:
    """Map every parameter column; ``direction`` is from_unit, normalize or denormalize."""
    change = {"from_unit": from_unit, "normalize": normalize, "denormalize": denormalize}[direction]
    return df.select(*[change(F.col(c), *ranges[c], c in log).alias(c) if c in ranges else F.col(c) for c in df.columns])


def mean_one_gains(raw: DataFrame, deviation: float) -> DataFrame:
    """raw(candidate_id, block, u) with u in [0, 1] -> (candidate_id, block, gain) with mean gain 1 per candidate.

    Windows span one candidate's blocks.
    """
    one = Window.partitionBy("candidate_id")
    centred = raw.withColumn("c", F.col("u") * 2.0 - 1.0).withColumn("c", F.col("c") - F.avg("c").over(one))
    clipped = centred.withColumn("_m", F.max(F.abs("c")).over(one)).withColumn("c", F.col("c") / F.greatest("_m", F.lit(1.0)))
    gains = clipped.withColumn("gain", F.col("c") * deviation + 1.0)
    return gains.select("candidate_id", "block", (F.col("gain") - F.avg("gain").over(one) + 1.0).alias("gain"))


def factorized_design(global_points: DataFrame, spatial_points: DataFrame, ranges: Ranges, log: set[str],
                      reference: dict[str, float], fixed: dict[str, float]) -> DataFrame:
    """Every global unit point with every spatial unit point, mapped to the ranges.

    Both inputs are (idx, <unit columns>) with idx 0..; point 0 of each is replaced by the reference, so
    candidate 0 is the exact reference. ``fixed`` columns hold one value. The two inputs are short design lists; their
    product is the result, ordered as candidate_id = global idx x spatial count + spatial idx.
    """
    def side(points: DataFrame, name: str) -> DataFrame:
        columns = [c for c in points.columns if c != "idx"]
        mapped = [F.when(F.col("idx") == 0, F.lit(reference[c])).otherwise(from_unit(F.col(c), *ranges[c], c in log)).alias(c) for c in columns]
        return points.select(F.col("idx").alias(name), *mapped)

    spatial = side(spatial_points, "_j")
    packed = spatial.agg(F.collect_list(F.struct(*spatial.columns)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    rows = side(global_points, "_i").join(F.broadcast(packed)).withColumn("_s", F.explode("_s"))
    names = [c for c in global_points.columns if c != "idx"] + [c for c in spatial_points.columns if c != "idx"]
    values = [F.lit(float(fixed[c])).alias(c) if c in fixed else (F.col(c) if c in global_points.columns else F.col(f"_s.{c}").alias(c)) for c in names]
    return rows.select((F.col("_i") * F.col("_n") + F.col("_s._j")).cast("bigint").alias("candidate_id"), *values)


def anchor_ranking(top_states: DataFrame, k: int) -> DataFrame:
    """Candidates by summed weight, then number of supporting entities: the first k with their rank."""
    per_entity = top_states.groupBy("entity_id", "candidate_id").agg(F.sum("weight").alias("w"))
    ranked = per_entity.groupBy("candidate_id").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("supporters")).orderBy(
        F.desc("weight"), F.desc("supporters"), "candidate_id").limit(k)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("weight"), F.desc("supporters"), "candidate_id")
    return ranked.withColumn("rank", F.row_number().over(order))


def adaptive_design(broad: DataFrame, bank: DataFrame, anchors: DataFrame, offsets: DataFrame, filler: DataFrame | None,
                    radius: dict[str, float], ranges: Ranges, log: set[str], n: int) -> DataFrame:
    """A broad design, then anchors shifted by scaled offsets, deduplicated and filled up to n rows.

    broad(idx, <params>), bank(candidate_id, <params>), anchors(candidate_id, rank 1..k), offsets(idx, <units in -1..1>),
    filler(idx, <params>), or None: the distinct rows are the design, n at most. Anchors are used round-robin.
    Result: candidate_id, origin, anchor_id, <params>.
    """
    names = list(radius)
    k = anchors.agg(F.max("rank").alias("_k"))
    home = range_map(bank.select("candidate_id", *names), ranges, log, "normalize").join(anchors, "candidate_id").select(
        (F.col("rank") - 1).alias("_slot"), F.col("candidate_id").cast("string").alias("anchor_id"), *[F.col(c).alias(f"_a_{c}") for c in names])
    local = offsets.join(F.broadcast(k)).withColumn("_slot", F.col("idx") % F.col("_k")).join(small_side(home), "_slot").select(
        "idx", "anchor_id", *[F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(f"_a_{c}") + F.col(c) * radius[c])).alias(c) for c in names])
    local = range_map(local, ranges, log, "denormalize")
    parts = [
        broad.select(F.struct(F.lit(0).alias("p"), F.col("idx").cast("bigint").alias("i")).alias("_pos"), F.lit("broad").alias("origin"),
                     F.lit(None).cast("string").alias("anchor_id"), *names),
        local.select(F.struct(F.lit(1).alias("p"), F.col("idx").cast("bigint").alias("i")).alias("_pos"), F.lit("adaptive_local").alias("origin"),
                     "anchor_id", *names)]
    kept = dedupe_keep_first(reduce(DataFrame.unionByName, parts), names, 12, "_pos")
    if filler is not None:
        kept = kept.unionByName(filler.select(
            F.struct(F.lit(2).alias("p"), F.col("idx").cast("bigint").alias("i")).alias("_pos"), F.lit("broad_fill").alias("origin"),
            F.lit(None).cast("string").alias("anchor_id"), *names))
    order = [F.col("_pos.p").asc(), F.col("_pos.i").asc()]
    ranked = global_running(kept, order, {}, name="_r").where(F.col("_r") <= n)
    return ranked.select((F.col("_r") - 1).alias("candidate_id"), "origin", "anchor_id", *names)


def _literal_rows(name: str, values: list) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def parameter_grid(df: DataFrame, lists: dict[str, list]) -> DataFrame:
    """Every row of ``df`` with every combination of the literal lists; expanded in place, without a join."""
    for name, values in lists.items():
        df = df.select("*", _literal_rows(name, values))
    return df


def nuisance_grid(candidates: DataFrame, fractions: list[float], exponents: list[float], source_fractions: list[float],
                  source_exponents: list[float]) -> DataFrame:
    """states(state_id, candidate_id, noise_fraction, noise_exponent, source_fraction, source_exponent).

    ``state_id`` is ``<candidate>#<position in the nuisance grid>`` with a fixed-width position, so it orders like
    the grid.
    """
    lists = {"noise_fraction": fractions, "noise_exponent": exponents, "source_fraction": source_fractions, "source_exponent": source_exponents}
    index = F.lit(0)
    for name, values in lists.items():
        index = index * len(values) + F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name)) - 1
    grid = parameter_grid(candidates.select("candidate_id"), lists)
    return grid.select(F.concat_ws("#", F.col("candidate_id").cast("string"), F.lpad(index.cast("string"), 4, "0")).alias("state_id"),
                       "candidate_id", *lists)


def perturbation_jobs(blocks: DataFrame, families: list[str], delta: float) -> tuple[DataFrame, DataFrame]:
    """Every unordered block pair and every (family, block), each at 1 - delta and 1 + delta.

    Blocks are a short list: it is packed into one row and expanded next to itself.
    """
    gains = [1.0 - delta, 1.0 + delta]
    packed = blocks.select("block").distinct().agg(F.array_sort(F.collect_set("block")).alias("b"))
    pairs = packed.select("b", F.posexplode("b").alias("i", "b1")).select(
        "b1", F.explode(F.slice("b", F.col("i") + 1, F.size("b") - F.col("i"))).alias("b2"))
    singles = packed.select(F.explode("b").alias("block"))
    return parameter_grid(pairs, {"gain": gains}), parameter_grid(singles, {"family": families, "gain": gains})


def halton(index: Column, base: int, digits: int = 12) -> Column:
    """Radical inverse of a 0-based index: unit points for self-contained designs."""
    value, scale = F.lit(0.0), 1.0
    for d in range(digits):
        scale /= base
        value = value + (F.floor((index + 1) / base ** d) % base) * scale
    return value
