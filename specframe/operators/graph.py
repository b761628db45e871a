"""Weighted, block-structured graphs as edge tables edges(src, dst, weight, ..) with both directions stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..session import durable
from .checks import guard


def parse_block_label(nodes: DataFrame, expected_blocks: int | None = None) -> DataFrame:
    """``<net>_<LH|RH>_<block>[_..]`` -> hemisphere and block; a malformed label or a wrong block count is an error."""
    parts = F.split("label", "_")
    good = (F.size(parts) >= 3) & F.element_at(parts, 2).isin("LH", "RH") & (F.length(F.element_at(parts, 3)) > 0)

    def field(i: int) -> Column:
        return F.when(good, F.element_at(parts, i)).otherwise(
            F.raise_error(F.concat(F.lit("malformed label "), F.col("label"))).cast("string"))

    out = nodes.withColumn("hemisphere", field(2)).withColumn("block", field(3))
    if expected_blocks is None:
        return out
    wrong = out.agg(F.count_distinct("block").alias("n")).where(F.col("n") != expected_blocks)
    return guard(out, wrong, f"expected {expected_blocks} blocks")


def node_multipliers(nodes: DataFrame, factors: DataFrame, targets: list[str]) -> DataFrame:
    """Multiply each target column by its block's factor from factors(block, target, factor); default 1."""
    wide = factors.groupBy("block").pivot("target", targets).agg(F.first("factor")).select(
        "block", *[F.col(t).alias(f"_f_{t}") for t in targets])
    joined = nodes.join(wide, "block", "left")
    scaled = {t: F.col(t) * F.coalesce(F.col(f"_f_{t}"), F.lit(1.0)) for t in targets}
    return joined.select(*[scaled.get(c, F.col(c)).alias(c) for c in nodes.columns])


def scale_edges(edges: DataFrame, transform: str, normalization: str) -> DataFrame:
    """Transform counts, then divide by one global factor; negative counts or a non-positive factor are errors.

    The factor is a single aggregated row, broadcast back.
    """
    count = F.when(F.col("count") >= 0, F.col("count")).otherwise(F.raise_error(F.lit("counts must be non-negative")).cast("double"))
    value = {"none": count, "log1p": F.log1p(count), "sqrt": F.sqrt(count)}[transform]
    changed = edges.withColumn("weight", value)
    if normalization == "none":
        return changed
    if normalization == "edge_max":
        factor = changed.agg(F.max(F.abs("weight")).alias("_f"))
    elif normalization == "region_sum":
        factor = changed.groupBy("src").agg(F.sum(F.abs("weight")).alias("_s")).agg(F.max("_s").alias("_f"))
    elif normalization == "frobenius":
        factor = changed.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_f"))
    else:
        raise ValueError(f"unknown normalization {normalization}")
    checked = factor.select(F.when(F.col("_f") > 0, F.col("_f")).otherwise(
        F.raise_error(F.lit("normalization factor must be positive")).cast("double")).alias("_f"))
    return changed.join(F.broadcast(checked)).withColumn("weight", F.col("weight") / F.col("_f")).drop("_f")


def _positive(column: str, message: str) -> Column:
    return F.when(F.col(column) > 0, F.col(column)).otherwise(F.raise_error(F.lit(message)).cast("double"))


def endpoint_gain(edges: DataFrame, nodes: DataFrame, gains: DataFrame) -> DataFrame:
    """weight x sqrt(gain of source block x gain of target block); a missing or non-positive gain is an error.

    Gains are resolved on the node table first, so each edge meets two node rows and nothing else.
    """
    resolved = nodes.join(gains, "block", "left").select("node_id", _positive("gain", "missing or non-positive block gain").alias("g"))
    return (
        edges.join(resolved.select(F.col("node_id").alias("src"), F.col("g").alias("_gs")), "src")
        .join(resolved.select(F.col("node_id").alias("dst"), F.col("g").alias("_gd")), "dst")
        .withColumn("weight", F.col("weight") * F.sqrt(F.col("_gs") * F.col("_gd"))).select(*edges.columns)
    )


def pair_gain(edges: DataFrame, nodes: DataFrame, pair_gains: DataFrame, preserve_total: bool = True,
              by: str | None = None) -> DataFrame:
    """weight x gain of the unordered block pair (default 1), optionally rescaled to keep the total weight.

    Unknown blocks, non-positive gains and two different gains for one pair are errors. With ``by`` the gains
    table has one set per candidate and the result holds one graph per candidate.
    """
    keys = [by] if by else []
    ordered = pair_gains.select(*keys, F.least("b1", "b2").alias("p1"), F.greatest("b1", "b2").alias("p2"), "gain")
    spread = ordered.groupBy(*keys, "p1", "p2").agg(F.min("gain").alias("gain"), F.max("gain").alias("_hi"))
    named = ordered.select(F.explode(F.array("p1", "p2")).alias("block")).distinct()
    unknown = named.join(nodes.select("block").distinct(), "block", "left_anti")
    bad = spread.where((F.col("gain") <= 0) | (F.abs(F.col("_hi") - F.col("gain")) > 1e-8))
    block = nodes.select("node_id", "block")
    placed = (
        edges.join(block.select(F.col("node_id").alias("src"), F.col("block").alias("_bs")), "src")
        .join(block.select(F.col("node_id").alias("dst"), F.col("block").alias("_bd")), "dst")
        .withColumn("p1", F.least("_bs", "_bd")).withColumn("p2", F.greatest("_bs", "_bd"))
    )
    clean = guard(guard(spread.drop("_hi"), bad, "non-positive or conflicting pair gains"), unknown, "unknown blocks in pair gains")
    if by:
        # One row per block pair with every candidate's gain: a join of edges with the gain list of their pair.
        clean = clean.groupBy("p1", "p2").agg(F.collect_list(F.struct(by, "gain")).alias("_g"))
        gained = placed.join(clean, ["p1", "p2"]).withColumn("_c", F.explode("_g")).select(
            F.col(f"_c.{by}").alias(by), *edges.columns, F.col("_c.gain").alias("_gain"))
    else:
        gained = placed.join(clean, ["p1", "p2"], "left").withColumn("_gain", F.coalesce("gain", F.lit(1.0))).select(*edges.columns, "_gain")
    if not preserve_total:
        return gained.withColumn("weight", F.col("weight") * F.col("_gain")).drop("_gain")
    totals = gained.groupBy(*keys).agg((F.sum("weight") / F.sum(F.col("weight") * F.col("_gain"))).alias("_scale"))
    joined = gained.join(totals, keys) if keys else gained.join(F.broadcast(totals))
    return joined.withColumn("weight", F.col("weight") * F.col("_gain") * F.col("_scale")).select(*keys, *edges.columns)


def mode_loadings(candidates: DataFrame, blocks: list[str], x: str, y: str, z: str) -> DataFrame:
    """(candidate_id, b1, b2, gain) for all block pairs b1 <= b2 from two coefficients a and b per candidate.

    gain = (1 + a [pair touches x]) (1 + b {+1 touches y only, -1 touches z only}). Block pairs are a fixed list.
    """
    names = sorted(blocks)
    pairs = F.array(*[F.struct(
        F.lit(p).alias("b1"), F.lit(q).alias("b2"), F.lit(1.0 if x in (p, q) else 0.0).alias("lx"),
        F.lit(1.0 if y in (p, q) and z not in (p, q) else -1.0 if z in (p, q) and y not in (p, q) else 0.0).alias("ly"))
        for i, p in enumerate(names) for q in names[i:]])
    return candidates.select("candidate_id", "a", "b", F.explode(pairs).alias("p")).select(
        "candidate_id", "p.b1", "p.b2",
        ((F.lit(1.0) + F.col("a") * F.col("p.lx")) * (F.lit(1.0) + F.col("b") * F.col("p.ly"))).alias("gain"))


def connected_components(nodes: DataFrame, edges: DataFrame, key: str = "node_id") -> DataFrame:
    """(node_id, component): the smallest node id of each undirected component.

    Alternates large-star and small-star steps, which need about log^2(n) rounds whatever the diameter. Minima
    are combinable aggregates joined back, so a node with very many neighbours is never one group. Each
    round is cut through the checkpoint folder.
    """
    pairs = durable(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    state = mark(pairs)
    while state[0]:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                     F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = durable(small.select("e.u", "e.v").where("u <> v").distinct())
        following = mark(pairs)
        if following == state:
            break
        state = following
    found = pairs.groupBy(F.col("u").alias(key)).agg(F.min("v").alias("component"))
    return nodes.select(key).join(found, key, "left").select(key, F.coalesce("component", key).alias("component"))


def graph_audit(nodes: DataFrame, edges: DataFrame, speed: float) -> DataFrame:
    """One row: sizes, density, components, ranges and medians of counts and lengths, longest delay, largest strength."""
    positive = edges.where(F.col("count") > 0)
    sizes = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    main = positive.agg(
        F.count_if(F.col("src") < F.col("dst")).alias("undirected_edges"), F.count(F.lit(1)).alias("_d"),
        F.min("count").alias("count_min"), F.max("count").alias("count_max"), F.min("length").alias("length_min"),
        F.max("length").alias("length_max"), F.max("weight").alias("weight_max"))
    strength = edges.groupBy("src").agg(F.sum("weight").alias("_s")).agg(F.max("_s").alias("strength_max"))
    medians = exact_quantiles(positive.select(F.lit(0).alias("_k"), "count", "length"), ["_k"],
                              {"count": [(0.5, "count_median")], "length": [(0.5, "length_median")]}).drop("_k")
    parts = connected_components(nodes, positive).agg(F.count_distinct("component").alias("components"))
    row = main
    for part in (sizes, strength, medians, parts):
        row = row.join(F.broadcast(part))
    return row.select("nodes", "undirected_edges", (F.col("_d") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"), "components",
                      "count_min", "count_median", "count_max", "length_min", "length_median", "length_max",
                      (F.col("length_max") / speed).alias("max_delay"), "weight_max", "strength_max")


def mean_one_contrast(nodes: DataFrame, contrasts: dict[str, float]) -> DataFrame:
    """(block, multiplier): 1 + contrast per named block, divided so that the node mean is 1."""
    if any(1.0 + v <= 0 for v in contrasts.values()):
        raise ValueError("a contrast makes a multiplier non-positive")
    raw = F.lit(1.0)
    for name, value in contrasts.items():
        raw = raw * F.when(F.col("block") == name, 1.0 + value).otherwise(1.0)
    sizes = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("raw", raw)
    mean = sizes.agg((F.sum(F.col("n") * F.col("raw")) / F.sum("n")).alias("_m"), F.collect_set("block").alias("_b"))
    known = mean.select("_m", F.when(F.size(F.array_intersect("_b", F.array(*[F.lit(c) for c in contrasts]))) == len(contrasts), True)
                        .otherwise(F.raise_error(F.lit("unknown block in contrasts")).cast("boolean")).alias("_ok"))
    return sizes.join(F.broadcast(known)).where("_ok").select("block", (F.col("raw") / F.col("_m")).alias("multiplier"))


def counter_gain(nodes: DataFrame, target: str, gain: float) -> DataFrame:
    """(block, multiplier): ``gain`` for one block and the common gain of the others that keeps the node mean at 1."""
    sizes = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("block") == target, F.col("n"))).alias("_t"))
    other = (F.col("_all") - F.col("_t") * gain) / (F.col("_all") - F.col("_t"))
    return sizes.join(F.broadcast(split)).select("block", F.when(F.col("block") == target, F.lit(gain)).otherwise(other).alias("multiplier"))


def block_noise_map(candidates: DataFrame, base: dict[str, str], modes: dict[str, dict[str, float]]) -> DataFrame:
    """(candidate_id, block, contrast): a base column for some blocks plus sum of mode coefficient x block loading.

    ``base`` maps block -> candidate column, ``modes`` maps coefficient column -> {block: loading}.
    """
    blocks = sorted(set(base) | {b for loading in modes.values() for b in loading})
    cells = []
    for block in blocks:
        value = F.col(base[block]) if block in base else F.lit(0.0)
        for column, loading in modes.items():
            if block in loading:
                value = value + F.col(column) * loading[block]
        cells.append(F.struct(F.lit(block).alias("block"), value.alias("contrast")))
    return candidates.select("candidate_id", F.explode(F.array(*cells)).alias("c")).select("candidate_id", "c.block", "c.contrast")


def sensor_source_gain(sensors: DataFrame, nodes: DataFrame, floor: float, sigma: float = 1.0) -> DataFrame:
    """gain(sensor, node_id, g, floored): radial point-source gain with a distance floor.

    Sensors are a fixed, short list; they travel as one packed row, so every node row expands in place
    without a shuffle. Node centre and radius are one aggregated row.
    """
    centre = nodes.agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    offset = nodes.join(F.broadcast(centre)).select(
        "node_id", *[F.col(a).alias(f"n{a}") for a in "xyz"], *[F.col(f"c{a}") for a in "xyz"],
        *[(F.col(a) - F.col(f"c{a}")).alias(f"o{a}") for a in "xyz"])
    norm = F.sqrt(sum((F.col(f"o{a}") * F.col(f"o{a}") for a in "xyz"), F.lit(0.0)))
    offset = offset.withColumn("r", F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("node at the common centre")).cast("double")))
    radius = offset.agg((F.max("r") * 1.05125).alias("radius"))
    unit = F.sqrt(sum((F.col(a) * F.col(a) for a in "xyz"), F.lit(0.0)))
    packed = sensors.agg(F.array_sort(F.collect_list(F.struct("sensor", *[(F.col(a) / unit).alias(f"u{a}") for a in "xyz"]))).alias("s"))
    cells = offset.join(F.broadcast(radius)).join(F.broadcast(packed)).withColumn("s", F.explode("s"))
    move = {a: F.col(f"s.u{a}") * F.col("radius") + F.col(f"c{a}") - F.col(f"n{a}") for a in "xyz"}
    cells = cells.select("node_id", F.col("s.sensor").alias("sensor"),
                         F.sqrt(sum((move[a] * move[a] for a in "xyz"), F.lit(0.0))).alias("d"),
                         (sum((F.col(f"o{a}") * move[a] for a in "xyz"), F.lit(0.0)) / F.col("r")).alias("dot"))
    near = F.greatest("d", F.lit(float(floor)))
    return cells.select("sensor", "node_id", (F.col("dot") / (near * near * near) / (4.0 * 3.141592653589793 * sigma)).alias("g"),
                        (F.col("d") < floor).alias("floored"))


def project_matrix(node_samples: DataFrame, gain: DataFrame, reference: str = "average") -> DataFrame:
    """samples(recording_id, channel, t, value) = node signals x gain, then referenced.

    The product is a join-aggregate with map-side partial sums; referencing spans one time point.
    """
    from .signal import rereference

    projected = node_samples.join(gain.select("sensor", "node_id", "g"), "node_id").groupBy(
        "recording_id", F.col("sensor").alias("channel"), "t").agg(F.sum(F.col("value") * F.col("g")).alias("value"))
    return rereference(projected, reference) if reference else projected


def weighted_rollup(detail: DataFrame, membership: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Area-weighted parcel columns, and their field retention.

    detail(sensor, vertex, value), membership(vertex, parcel, area), expected(parcel). Returns
    rollup(sensor, parcel, value) and audit(parcel, vertices, area, mean_vertex_norm, regional_norm, retention).
    Retention compares norms after the sensor mean is removed. Parcels missing or not expected are an error.
    """
    parcels = membership.select("parcel").distinct()
    mismatch = parcels.withColumn("_a", F.lit(1)).join(expected.select("parcel").distinct().withColumn("_b", F.lit(1)), "parcel", "full_outer").where(
        F.col("_a").isNull() | F.col("_b").isNull())
    active = membership.join(detail.select("vertex").distinct(), "vertex", "left_semi")
    area = active.groupBy("parcel").agg(F.sum("area").alias("_total"), F.count(F.lit(1)).alias("vertices"))
    weights = active.join(area, "parcel").select("vertex", "parcel", (F.col("area") / F.col("_total")).alias("w"))
    cells = detail.join(weights, "vertex")
    rollup = guard(cells.groupBy("sensor", "parcel").agg(F.sum(F.col("w") * F.col("value")).alias("value")), mismatch, "parcel mismatch")
    # ||x - mean||^2 = sum x^2 - (sum x)^2 / n per vertex: no per-vertex window over sensors.
    vertex = cells.groupBy("vertex", "parcel").agg(F.first("w").alias("w"), (F.stddev_pop("value") * F.sqrt(F.count(F.lit(1)))).alias("_n"))
    means = vertex.groupBy("parcel").agg(F.sum(F.col("w") * F.col("_n")).alias("mean_vertex_norm"))
    regional = rollup.groupBy("parcel").agg((F.stddev_pop("value") * F.sqrt(F.count(F.lit(1)))).alias("regional_norm"))
    audit = area.join(means, "parcel").join(regional, "parcel").select(
        "parcel", "vertices", F.col("_total").alias("area"), "mean_vertex_norm", "regional_norm",
        F.try_divide("regional_norm", F.greatest("mean_vertex_norm", F.lit(1e-300))).alias("retention"))
    return rollup, audit


def gram(gain: DataFrame) -> DataFrame:
    """Upper triangle of G G': products of sensor pairs summed over nodes."""
    from .spectral import channel_pairs

    rows = gain.select(F.lit(0).alias("recording_id"), F.col("node_id").alias("t"), F.col("sensor").alias("channel"), F.col("g").alias("value"))
    return channel_pairs(rows, {"c": lambda a, b: F.sum(a * b)}).select(F.col("ch_i").alias("s_i"), F.col("ch_j").alias("s_j"), "c")


def matrix_compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: flat correlation, per-column cosine (median, p5, p95, share negative), Gram upper-triangle correlation."""
    from ..functions.expr import correlation

    both = first.select("sensor", "node_id", F.col("g").alias("a")).join(second.select("sensor", "node_id", F.col("g").alias("b")), ["sensor", "node_id"])
    flat = both.agg(correlation(F.col("a"), F.col("b")).alias("flat_correlation"))
    cosine = both.groupBy("node_id").agg(F.try_divide(
        F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))).alias("c"))
    spread = exact_quantiles(cosine.select(F.lit(0).alias("_k"), "c"), ["_k"],
                             {"c": [(0.5, "cosine_median"), (0.05, "cosine_p05"), (0.95, "cosine_p95")]}).drop("_k")
    share = cosine.agg(F.avg((F.col("c") < 0).cast("double")).alias("cosine_negative"))
    grams = gram(first).where("s_i < s_j").withColumnRenamed("c", "a").join(
        gram(second).where("s_i < s_j").withColumnRenamed("c", "b"), ["s_i", "s_j"]).agg(correlation(F.col("a"), F.col("b")).alias("gram_correlation"))
    row = flat
    for part in (spread, share, grams):
        row = row.join(F.broadcast(part))
    return row


def angular_difference(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, degrees) between the directions of matching rows."""
    a, b = first.alias("a"), second.alias("b")

    def dot(p: str, q: str) -> Column:
        return sum((F.col(f"{p}.{c}") * F.col(f"{q}.{c}") for c in "xyz"), F.lit(0.0))

    cosine = dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(
        F.col(f"a.{key}").alias(key), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("degrees"))


def power_basis(gain: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sensor, block, value): sum of squared gains per sensor and block, each block scaled to sensor mean 1."""
    power = gain.join(nodes.select("node_id", "block"), "node_id").groupBy("sensor", "block").agg(F.sum(F.col("g") * F.col("g")).alias("_p"))
    mean = F.avg("_p").over(Window.partitionBy("block"))
    scaled = F.when(mean > 0, F.col("_p") / mean).otherwise(F.raise_error(F.lit("a block has zero power")).cast("double"))
    return power.select("sensor", "block", scaled.alias("value"))


def mode_map_cosine(bases: DataFrame, modes: DataFrame, reference: str) -> DataFrame:
    """(mode, basis, cosine) of centred sensor maps basis x mode against the reference basis.

    bases(basis, sensor, block, value), modes(mode, block, loading). Sensor x mode maps are small aggregates.
    """
    maps = bases.join(modes, "block").groupBy("basis", "mode", "sensor").agg(F.sum(F.col("value") * F.col("loading")).alias("v"))
    maps = maps.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("basis", "mode")))
    main = maps.where(F.col("basis") == reference).select("mode", "sensor", F.col("v").alias("w"))
    return maps.join(main, ["mode", "sensor"]).groupBy("mode", "basis").agg(F.try_divide(
        F.sum(F.col("v") * F.col("w")), F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(1e-300))).alias("cosine"))
