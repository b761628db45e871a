"""Summaries of power spectra and cross-spectra.

psd tables are (recording_id[, segment][, channel], freq, p); csd tables are (recording_id[, segment], freq,
ch_i, ch_j, re, im) with ch_i <= ch_j. Windows span one recording's frequency grid or one frequency's
channel pairs, both fixed by the estimator and not by the amount of data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import TINY, floor_tiny, ratio
from .comoments import pair_moments
from .signal import rec_keys


def mean_psd(psd: DataFrame) -> DataFrame:
    return psd.groupBy(*rec_keys(psd), "freq").agg(F.avg("p").alias("p"))


def spectrum_keys(df: DataFrame) -> list[str]:
    return [*rec_keys(df), *(["channel"] if "channel" in df.columns else [])]


def _band_rows(df: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows repeated for each half-open band they fall in; outside rows go before any shuffle."""
    freq = F.col("freq")
    labels = F.array_compact(F.array(*[F.when((freq >= lo) & (freq < hi), F.lit(n)) for n, (lo, hi) in bands.items()]))
    return df.withColumn("band", F.explode(labels))


def _trapezoid(df: DataFrame, keys: list[str], value: str = "p", name: str = "power") -> DataFrame:
    along = Window.partitionBy(*keys).orderBy("freq")
    step = (F.col(value) + F.lead(value).over(along)) / 2.0 * (F.lead("freq").over(along) - F.col("freq"))
    return df.select(*keys, step.alias("_a")).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias(name))


def band_power(psd: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Trapezoid of the PSD over each half-open band, per recording (and channel where present)."""
    return _trapezoid(_band_rows(psd, bands), [*spectrum_keys(psd), "band"])


def band_fraction(psd: DataFrame, bands: dict[str, tuple[float, float]], lo: float, hi: float) -> DataFrame:
    """Band power over the power in [lo, hi]."""
    keys = spectrum_keys(psd)
    inside = psd.where(F.col("freq").between(lo, hi))
    total = _trapezoid(inside, keys, name="_total")
    return band_power(inside, bands).join(total, keys).select(
        *keys, "band", F.try_divide(F.col("power"), floor_tiny(F.col("_total"))).alias("fraction"))


def psd_shape(psd: DataFrame, lo: float, hi: float) -> DataFrame:
    """Log of the channel-mean PSD in [lo, hi], centred over frequency."""
    keys = rec_keys(psd)
    logs = mean_psd(psd.where(F.col("freq").between(lo, hi))).withColumn("value", F.ln(F.col("p") + TINY))
    return logs.select(*keys, "freq", (F.col("value") - F.avg("value").over(Window.partitionBy(*keys))).alias("value"))


def peak_frequency(psd: DataFrame, lo: float, hi: float) -> DataFrame:
    """Frequency of the largest mean power in [lo, hi); the lowest frequency wins ties."""
    keys = rec_keys(psd)
    inside = mean_psd(psd.where((F.col("freq") >= lo) & (F.col("freq") < hi)))
    return inside.groupBy(*keys).agg(F.max_by("freq", F.struct(F.col("p"), -F.col("freq"))).alias("peak_hz"))


def spectral_entropy(psd: DataFrame, lo: float, hi: float) -> DataFrame:
    """-sum(q ln q) / ln(n) of the normalised mean spectrum in [lo, hi]."""
    keys = rec_keys(psd)
    inside = mean_psd(psd.where(F.col("freq").between(lo, hi)))
    share = F.try_divide(F.col("p"), F.sum("p").over(Window.partitionBy(*keys)))
    return inside.withColumn("_q", share).groupBy(*keys).agg(
        F.try_divide(-F.sum(F.col("_q") * F.ln(F.col("_q") + TINY)), F.ln(F.count(F.lit(1)))).alias("entropy"))


def total_log_power(psd: DataFrame, lo: float, hi: float) -> DataFrame:
    keys = rec_keys(psd)
    return _trapezoid(mean_psd(psd.where(F.col("freq").between(lo, hi))), keys).select(
        *keys, F.ln(F.col("power") + TINY).alias("value"))


def alpha_topography(psd: DataFrame, lo: float, hi: float) -> DataFrame:
    """Log band power per channel, centred over channels."""
    keys = rec_keys(psd)
    power = band_power(psd, {"a": (lo, hi)}).withColumn("value", F.ln(F.col("power") + TINY))
    return power.select(*keys, "channel", (F.col("value") - F.avg("value").over(Window.partitionBy(*keys))).alias("value"))


def diagonal(csd: DataFrame) -> DataFrame:
    """Power per channel from the CSD diagonal."""
    return csd.where(F.col("ch_i") == F.col("ch_j")).select(
        *rec_keys(csd), "freq", F.col("ch_i").alias("channel"), F.col("re").alias("p"))


def csd_topography(csd: DataFrame, lo: float, hi: float) -> DataFrame:
    """The cross-spectral form: log of the mean bin power per channel, centred over channels."""
    keys = rec_keys(csd)
    power = diagonal(csd).where((F.col("freq") >= lo) & (F.col("freq") < hi)).groupBy(*keys, "channel").agg(
        F.ln(F.avg(floor_tiny(F.col("p")))).alias("value"))
    return power.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))


def alpha_profile(csd: DataFrame, lo: float, hi: float) -> DataFrame:
    """Band power per channel over its channel mean; non-positive power is an error."""
    keys = rec_keys(csd)
    power = diagonal(csd).where((F.col("freq") >= lo) & (F.col("freq") < hi)).groupBy(*keys, "channel").agg(F.avg("p").alias("_p"))
    checked = F.when(F.col("_p") > 0, F.col("_p")).otherwise(F.raise_error(F.lit("band power must be positive")).cast("double"))
    return power.withColumn("_p", checked).select(
        *keys, "channel", (F.col("_p") / F.avg("_p").over(Window.partitionBy(*keys))).alias("value"))


def coherency(csd: DataFrame, metric: str) -> DataFrame:
    """(.., freq, ch_i, ch_j, part, value) of S_ij / sqrt(S_ii S_jj) above the diagonal.

    ``complex`` gives parts re and im, ``imaginary`` the imaginary part, ``lagged`` im / sqrt(max(1 - re^2, 1e-8)).
    The diagonal travels with its frequency's pairs, so one shuffle on (recording, frequency) is enough.
    """
    keys = rec_keys(csd)
    cell = csd.groupBy(*keys, "freq").agg(
        F.collect_list(F.when(F.col("ch_i") < F.col("ch_j"), F.struct("ch_i", "ch_j", "re", "im"))).alias("z"),
        F.map_from_entries(F.collect_list(F.when(F.col("ch_i") == F.col("ch_j"), F.struct("ch_i", floor_tiny(F.col("re")).alias("p"))))).alias("d"))
    z = F.col("z")
    flat = cell.select(*keys, "freq", "d", F.explode("z").alias("z")).select(
        *keys, "freq", z["ch_i"].alias("ch_i"), z["ch_j"].alias("ch_j"),
        F.sqrt(F.element_at("d", z["ch_i"]) * F.element_at("d", z["ch_j"])).alias("_n"), z["re"].alias("re"), z["im"].alias("im"))
    re, im = F.col("re") / F.col("_n"), F.col("im") / F.col("_n")
    base = [*keys, "freq", "ch_i", "ch_j"]
    if metric == "complex":
        return flat.select(*base, F.explode(F.array(
            F.struct(F.lit("re").alias("part"), re.alias("value")), F.struct(F.lit("im").alias("part"), im.alias("value")))).alias("_c")
        ).select(*base, "_c.part", "_c.value")
    if metric == "imaginary":
        return flat.select(*base, F.lit("imaginary").alias("part"), im.alias("value"))
    if metric == "lagged":
        return flat.select(*base, F.lit("lagged").alias("part"),
                           (im / F.sqrt(F.greatest(F.lit(1.0) - re * re, F.lit(1e-8)))).alias("value"))
    raise ValueError(f"unknown metric {metric}")


def channel_log_power(csd: DataFrame) -> DataFrame:
    """Log diagonal, centred over (frequency, channel) of each recording."""
    keys = rec_keys(csd)
    logs = diagonal(csd).withColumn("value", F.ln(floor_tiny(F.col("p"))))
    return logs.select(*keys, "freq", "channel", (F.col("value") - F.avg("value").over(Window.partitionBy(*keys))).alias("value"))


def aperiodic_fit(logp: DataFrame, background: Column, base: str = "e") -> tuple[DataFrame, DataFrame]:
    """Least-squares line of log power on log frequency over the background bins.

    Returns fits(.., exponent, intercept) with intercept at log frequency 0, and residuals(.., freq, value).
    """
    keys = spectrum_keys(logp)
    x = F.ln("freq") if base == "e" else F.log10("freq")
    fits = logp.where(background).groupBy(*keys).agg(
        (-F.regr_slope("value", x)).alias("exponent"), F.regr_intercept("value", x).alias("intercept"))
    residuals = logp.join(fits, keys).select(
        *keys, "freq", (F.col("value") - (F.col("intercept") - F.col("exponent") * x)).alias("value"))
    return fits, residuals


def peak_prominence_width(shape: DataFrame, band: tuple[float, float], shoulders: list[tuple[float, float]],
                          spacing: float) -> DataFrame:
    """Peak height over the mean shoulder, and the contiguous width at half that height around the peak."""
    keys = rec_keys(shape)
    freq = F.col("freq")
    inside = (freq >= band[0]) & (freq < band[1])
    beside = F.lit(False)
    for lo, hi in shoulders:
        beside = beside | ((freq >= lo) & (freq < hi))
    whole = Window.partitionBy(*keys)
    marked = (
        shape.where(inside | beside)
        .withColumn("_s", F.avg(F.when(beside, F.col("value"))).over(whole))
        .withColumn("_v", F.max(F.when(inside, F.col("value"))).over(whole))
        .withColumn("_f", F.max_by(F.when(inside, freq), F.when(inside, F.struct(F.col("value"), -freq))).over(whole))
        .where(inside)
        .withColumn("_above", F.col("value") >= F.col("_s") + 0.5 * (F.col("_v") - F.col("_s")))
        .withColumn("_left", F.max(F.when(~F.col("_above") & (freq < F.col("_f")), freq)).over(whole))
        .withColumn("_right", F.min(F.when(~F.col("_above") & (freq > F.col("_f")), freq)).over(whole))
    )
    near = (freq > F.coalesce("_left", F.lit(-1.0))) & (freq < F.coalesce("_right", F.lit(float("inf"))))
    return marked.groupBy(*keys).agg(
        (F.first("_v") - F.first("_s")).alias("prominence"), (F.count_if(near) * spacing).alias("width"))


def half_max_width(psd: DataFrame, band: tuple[float, float]) -> DataFrame:
    """Span of the frequencies in the band whose mean power is at least half the band maximum."""
    keys = rec_keys(psd)
    inside = mean_psd(psd.where((F.col("freq") >= band[0]) & (F.col("freq") < band[1])))
    top = F.max("p").over(Window.partitionBy(*keys))
    return inside.withColumn("_top", top).where(F.col("p") >= F.col("_top") / 2.0).groupBy(*keys).agg(
        (F.max("freq") - F.min("freq")).alias("width"))


def harmonic_ratio(psd: DataFrame, orders: list[int], tolerance: float, lo: float, hi: float) -> DataFrame:
    """Largest power within ``tolerance`` of each multiple of the peak, over the peak power; NULL above ``hi``."""
    keys = rec_keys(psd)
    whole = Window.partitionBy(*keys)
    valid = F.col("freq").between(lo, hi)
    peak = F.max(F.when(valid, F.struct(F.col("p"), -F.col("freq")))).over(whole)
    marked = mean_psd(psd).withColumn("_peak", peak).withColumn("order", F.explode(F.array(*[F.lit(o) for o in orders])))
    target = -F.col("_peak.col2") * F.col("order")
    near = (F.abs(F.col("freq") - target) <= tolerance) & (target <= hi)
    return marked.groupBy(*keys, "order").agg(
        F.try_divide(F.max(F.when(near, F.col("p"))), F.first("_peak.p")).alias("ratio"))


def region_ratio(power: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Mean power of one channel set over that of another."""
    return power.groupBy(*rec_keys(power)).agg(F.try_divide(
        F.avg(F.when(F.col("channel").isin(first), F.col("power"))),
        F.avg(F.when(F.col("channel").isin(second), F.col("power")))).alias("ratio"))


def channel_pairs(samples: DataFrame, aggregates: dict[str, callable]) -> DataFrame:
    """Aggregates over time of every channel pair.

    One shuffle brings the channels of a time point together; pair rows are reduced by map-side partial
    aggregates before the second, tiny shuffle.
    """
    keys = rec_keys(samples)
    points = samples.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("channel", "value"))).alias("z"))
    i, j = F.col("i"), F.col("j")
    pairs = points.select(*keys, "z", F.posexplode("z").alias("pi", "i")).select(
        *keys, "i", F.explode(F.slice("z", F.col("pi") + 1, F.size("z") - F.col("pi"))).alias("j"))
    return pairs.groupBy(*keys, i["channel"].alias("ch_i"), j["channel"].alias("ch_j")).agg(
        *[make(i["value"], j["value"]).alias(name) for name, make in aggregates.items()])


def correlation_summary(samples: DataFrame) -> DataFrame:
    """Median and 95th percentile of the absolute pairwise channel correlations of each recording."""
    pairs = pair_moments(samples, rec_keys(samples)).where(F.col("ch_i") < F.col("ch_j"))
    return pairs.groupBy(*rec_keys(samples)).agg(
        F.median(F.abs("r")).alias("median_abs"), F.percentile(F.abs("r"), 0.95).alias("p95_abs"))


def pc_variance(samples: DataFrame, counts: list[int]) -> DataFrame:
    """Share of the channel variance in the first k principal components.

    The covariance is a distributed aggregate; each task solves one channels x channels matrix.
    """
    import numpy as np

    keys = rec_keys(samples)
    cov = pair_moments(samples, keys).withColumnRenamed("cov", "c")
    types = dict(samples.dtypes)

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["ch_i"]))
        index = {c: i for i, c in enumerate(names)}
        matrix = np.zeros((len(names), len(names)))
        matrix[pdf["ch_i"].map(index), pdf["ch_j"].map(index)] = pdf["c"]
        matrix = np.maximum(np.linalg.eigvalsh(matrix, UPLO="U")[::-1], 0.0)
        out = pd.DataFrame({"k": counts, "share": [matrix[:k].sum() / matrix.sum() for k in counts]})
        for name, item in zip(reversed(keys), reversed(key)):
            out.insert(0, name, item)
        return out

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", k int, share double"
    return cov.groupBy(*keys).applyInPandas(solve, schema)


def block_band_power(psd: DataFrame, nodes: DataFrame, band: tuple[float, float]) -> DataFrame:
    """Mean band power of the nodes of each block; ``nodes`` is (channel, block)."""
    keys = rec_keys(psd)
    return band_power(psd, {"b": band}).join(nodes, "channel").groupBy(*keys, "block").agg(F.avg("power").alias("power"))


def gain_covariance(gain: DataFrame, reference: str = "average") -> DataFrame:
    """cov(s_i, s_j) of the referenced gain(sensor, node_id, g), scaled to mean diagonal 1, upper triangle."""
    node = Window.partitionBy("node_id")
    if reference == "average":
        base = F.avg("g").over(node)
    else:
        base = F.coalesce(F.max(F.when(F.col("sensor") == reference, F.col("g"))).over(node),
                          F.raise_error(F.lit(f"unknown reference {reference}")).cast("double"))
    rows = gain.withColumn("g", F.col("g") - base).select(
        F.lit(0).alias("recording_id"), F.col("node_id").alias("t"), F.col("sensor").alias("channel"), F.col("g").alias("value"))
    raw = channel_pairs(rows, {"c": lambda a, b: F.sum(a * b)}).select(
        F.col("ch_i").alias("s_i"), F.col("ch_j").alias("s_j"), "c")
    scale = raw.agg(F.avg(F.when(F.col("s_i") == F.col("s_j"), F.col("c"))).alias("_m"))
    return raw.join(F.broadcast(scale)).select("s_i", "s_j", (F.col("c") / F.col("_m")).alias("cov"))


def spectral_background(csd: DataFrame, fraction: float, exponent: float, name: str) -> DataFrame:
    """1/f power per (recording, frequency): mean signal power x r/(1-r) x f^-e scaled to mean 1."""
    if not 0.0 <= fraction < 1.0 or exponent < 0.0:
        raise ValueError("background needs 0 <= fraction < 1 and exponent >= 0")
    keys = rec_keys(csd)
    whole = Window.partitionBy(*keys)
    shape = F.pow("freq", F.lit(-float(exponent)))
    return diagonal(csd).groupBy(*keys, "freq").agg(F.avg("p").alias("_p")).select(
        *keys, "freq", (floor_tiny(F.avg("_p").over(whole)) * (fraction / (1.0 - fraction)) * shape / F.avg(shape).over(whole)).alias(name))


def add_background(csd: DataFrame, fraction: float, exponent: float, source_fraction: float, source_exponent: float,
                   covariance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add a diagonal and a covariance-shaped 1/f background.

    Returns (csd, increments(.., freq, diag_increment, source_power)); the small increments are enough to
    rebuild mixtures later without a dense table per state.
    """
    keys = rec_keys(csd)
    increments = spectral_background(csd, fraction, exponent, "diag_increment").join(
        spectral_background(csd, source_fraction, source_exponent, "source_power"), [*keys, "freq"])
    shape = covariance.select(F.col("s_i").alias("ch_i"), F.col("s_j").alias("ch_j"), "cov")
    mean_diag = shape.agg(F.avg(F.when(F.col("ch_i") == F.col("ch_j"), F.col("cov"))).alias("_m"))
    shape = shape.join(F.broadcast(mean_diag)).select("ch_i", "ch_j", (F.col("cov") / F.col("_m")).alias("cov"))
    extra = F.col("source_power") * F.col("cov") + F.when(F.col("ch_i") == F.col("ch_j"), F.col("diag_increment")).otherwise(0.0)
    out = csd.join(increments, [*keys, "freq"]).join(shape, ["ch_i", "ch_j"]).select(
        *keys, "freq", "ch_i", "ch_j", (F.col("re") + extra).alias("re"), "im")
    return out, increments


def mechanistic_summary(psd: DataFrame, lo: float, hi: float, alpha: tuple[float, float], background: Column,
                        shoulders: list[tuple[float, float]], side_bands: dict[str, tuple[float, float]],
                        spacing: float) -> DataFrame:
    """Eight numbers per recording: peak, band fraction, entropy, 1/f exponent, two side-band fractions of the
    exponentiated shape, peak prominence and width."""
    keys = rec_keys(psd)
    shape = psd_shape(psd, lo, hi)
    relative = shape.withColumn("p", F.exp("value")).drop("value")
    exponent, _ = aperiodic_fit(shape.where(background), F.lit(True), "10")
    sides = band_fraction(relative, side_bands, lo, hi).groupBy(*keys).pivot("band", list(side_bands)).agg(F.first("fraction"))
    sides = sides.select(*keys, *[F.col(n).alias(f"fraction_{n}") for n in side_bands])
    whole = band_fraction(mean_psd(psd), {"a": alpha}, lo, hi).select(*keys, F.col("fraction").alias("fraction_alpha"))
    out = peak_frequency(psd, *alpha)
    for part in (whole, spectral_entropy(psd, lo, hi), exponent.select(*keys, "exponent"), sides,
                 peak_prominence_width(shape, alpha, shoulders, spacing)):
        out = out.join(part, keys)
    return out


def qc_report(samples: DataFrame, psd: DataFrame, bands: dict[str, tuple[float, float]], alpha: tuple[float, float],
              lo: float, hi: float, orders: list[int], tolerance: float, first: list[str], second: list[str]) -> DataFrame:
    """One row of quality numbers per recording."""
    keys = rec_keys(psd)
    powers = band_power(mean_psd(psd), bands).groupBy(*keys).pivot("band", list(bands)).agg(F.first("power"))
    powers = powers.select(*keys, *[F.col(n).alias(f"power_{n}") for n in bands])
    harmonics = harmonic_ratio(psd, orders, tolerance, lo, hi).groupBy(*keys).pivot("order", orders).agg(F.first("ratio"))
    harmonics = harmonics.select(*keys, *[F.col(str(o)).alias(f"harmonic_{o}x") for o in orders])
    out = peak_frequency(psd, lo, hi + 1e-9)
    for part in (powers, spectral_entropy(psd, lo, hi), half_max_width(psd, alpha).withColumnRenamed("width", "half_max_width"),
                 harmonics, region_ratio(band_power(psd, {"a": alpha}), first, second).withColumnRenamed("ratio", "region_ratio"),
                 correlation_summary(samples)):
        out = out.join(part, keys)
    return out
