"""Recordings -> epochs -> Fourier coefficients -> cross-spectra and power spectra.

Input tables are long: samples(recording_id[, segment], channel, t, value). ``t`` is the sample index.
Every operator is linear in the number of samples, and no group is larger than one block of epochs.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import beside, dealt
from ..functions.expr import taper, window_weights


def rec_keys(df: DataFrame) -> list[str]:
    return [c for c in ("recording_id", "segment") if c in df.columns]


def rereference(samples: DataFrame, reference: str = "average") -> DataFrame:
    """Subtract the channel mean (or one channel) at every sample; an absent reference channel is an error.

    The window spans one time point, so its size is the channel count.
    """
    point = Window.partitionBy(*rec_keys(samples), "t")
    if reference == "average":
        base = F.avg("value").over(point)
    else:
        named = F.max(F.when(F.col("channel") == reference, F.col("value"))).over(point)
        base = F.coalesce(named, F.raise_error(F.lit(f"unknown reference channel {reference}")).cast("double"))
    return samples.withColumn("value", F.col("value") - base)


def demean(samples: DataFrame) -> DataFrame:
    """Subtract each channel's mean over time.

    The means are partial aggregates set beside the samples (one row per recording and channel), so a long
    recording is never gathered into one window.
    """
    keys = [*rec_keys(samples), "channel"]
    means = samples.groupBy(*keys).agg(F.avg("value").alias("_mean"))
    return beside(samples, means, keys, "t").withColumn("value", F.col("value") - F.col("_mean")).drop("_mean").select(*samples.columns)


def recording_lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*rec_keys(samples)).agg((F.max("t") + 1).alias("n_samples"))


def crop_duration(samples: DataFrame, recordings: DataFrame, max_s: float) -> DataFrame:
    """Keep the first round(max_s * sampling rate) samples (half-even rounding) of each recording."""
    limits = recordings.select("recording_id", F.bround(F.lit(float(max_s)) * F.col("sfreq_hz")).cast("bigint").alias("_limit"))
    return samples.join(limits, "recording_id").where(F.col("t") < F.col("_limit")).drop("_limit")


def require_channels(samples: DataFrame, channels: list[str]) -> DataFrame:
    """Keep the declared channels with their declared position; a recording that lacks one is an error."""
    wanted = F.array(*[F.lit(c) for c in channels])
    kept = samples.where(F.col("channel").isin(channels))
    present = samples.groupBy("recording_id").agg(F.collect_set(
        F.when(F.col("channel").isin(channels), F.col("channel"))).alias("_seen"))
    checked = present.select("recording_id", F.when(F.size("_seen") == len(channels), True).otherwise(
        F.raise_error(F.concat(F.lit("recording "), F.col("recording_id").cast("string"), F.lit(" misses channels "),
                               F.concat_ws(",", F.array_except(wanted, F.col("_seen"))))).cast("boolean")).alias("_ok"))
    position = F.array_position(wanted, F.col("channel")).cast("bigint") - 1
    # The join reads every recording, also one that has none of the channels, so the check always runs.
    return (checked.where(F.col("_ok")).join(kept, "recording_id").drop("_ok")
            .withColumn("channel_pos", position).select(*samples.columns, "channel_pos"))


def temporal_segments(samples: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Halves ``fit``/``validation`` and, inside the first half, ``rel_a``/``rel_b``; ``t`` restarts at 0 in each.

    An odd trailing sample belongs to the second part of its split. ``lengths``: the ``recording_lengths``, where they are known already.
    """
    lengths = recording_lengths(samples) if lengths is None else lengths
    half = F.floor(F.col("n_samples") / 2)
    quarter = F.floor(half / 2)
    inside = F.col("t") < half

    def part(name: str, keep: Column, start: Column) -> Column:
        return F.when(keep, F.struct(F.lit(name).alias("segment"), (F.col("t") - start).cast("bigint").alias("t")))

    parts = F.array_compact(F.array(
        part("fit", inside, F.lit(0)), part("validation", ~inside, half),
        part("rel_a", F.col("t") < quarter, F.lit(0)), part("rel_b", inside & (F.col("t") >= quarter), quarter)))
    others = [c for c in samples.columns if c != "t"]
    return beside(samples, lengths, rec_keys(samples), "t").select(*others, F.explode(parts).alias("_p")).select(*others, "_p.segment", "_p.t")


def segment_lengths(lengths: DataFrame) -> DataFrame:
    """(recording_id, segment, n_samples) of the ``temporal_segments`` of recordings without gaps, from their lengths."""
    n = F.col("n_samples")
    half = F.floor(n / 2)
    quarter = F.floor(half / 2)
    parts = {"fit": half, "validation": n - half, "rel_a": quarter, "rel_b": half - quarter}
    each = F.array(*[F.struct(F.lit(name).alias("segment"), size.cast("bigint").alias("n_samples")) for name, size in parts.items()])
    return lengths.select("recording_id", F.explode(each).alias("_p")).select("recording_id", "_p.segment", "_p.n_samples").where("n_samples > 0")


def _with_last_epoch(samples: DataFrame, n: int, lengths: DataFrame | None = None) -> DataFrame:
    """samples with ``_last``, the number of their recording's last half-overlapping epoch of n samples."""
    last = F.when(F.col("n_samples") >= 2 * n, F.floor((F.col("n_samples") - n) / (n // 2))).otherwise(
        F.raise_error(F.lit("recording is too short for stable spectra")).cast("bigint"))
    return beside(samples, recording_lengths(samples) if lengths is None else lengths, rec_keys(samples), "t").withColumn("_last", last).drop("n_samples")


def epochs_overlap(samples: DataFrame, n: int, lengths: DataFrame | None = None) -> DataFrame:
    """Half-overlapping epochs of n samples; recordings shorter than 2n are an error."""
    hop = n // 2
    timed = _with_last_epoch(samples, n, lengths)
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("t") - n + 1) / hop).cast("bigint"))
    last = F.least(F.floor(F.col("t") / hop).cast("bigint"), F.col("_last"))
    return (
        timed.withColumn("epoch", F.explode(F.when(first <= last, F.sequence(first, last)))).drop("_last")
        .withColumn("pos", (F.col("t") - F.col("epoch") * hop).cast("bigint"))
    )


def epochs_tiled(samples: DataFrame, n: int) -> DataFrame:
    """Non-overlapping epochs of n samples; the incomplete tail is dropped."""
    lengths = recording_lengths(samples)
    return (
        beside(samples, lengths, rec_keys(samples), "t")
        .withColumn("epoch", F.floor(F.col("t") / n).cast("bigint"))
        .where(F.col("epoch") < F.floor(F.col("n_samples") / n)).drop("n_samples")
        .withColumn("pos", F.col("t") % n)
    )


def _epoch_constants(n: int, bins: list[int], window: str) -> tuple[dict[int, float], dict[int, float]]:
    weights = window_weights(n, window)
    cosine = {k: sum(w * math.cos(2 * math.pi * k * i / n) for i, w in enumerate(weights)) for k in bins}
    sine = {k: sum(w * math.sin(2 * math.pi * k * i / n) for i, w in enumerate(weights)) for k in bins}
    return cosine, sine


def epoch_dft(epochs: DataFrame, n: int, bins: list[int], window: str = "hann_sym", method: str = "native") -> DataFrame:
    """Fourier coefficients of every demeaned, tapered epoch at the given bins.

    ``native`` computes all bins as one map-side-combined aggregate per (recording, epoch, channel): rows are
    not multiplied by bins, and demeaning is folded in because sum((x-m)wc) = sum(xwc) - m*sum(wc). Its cost
    per row grows with the number of bins; ``arrow`` frames each epoch and runs batched real FFTs instead.
    """
    keys = [*rec_keys(epochs), "channel", "epoch"]
    if method == "arrow":
        framed = epochs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_f"))
        framed = framed.select(*keys, F.col("_f.value").alias("frame")).where(F.size("frame") == n)
        return _framed_fft(framed, keys, n, bins, window)
    cosine, sine = _epoch_constants(n, bins, window)
    tapered = F.col("value") * taper(F.col("pos"), n, window)
    sums = [F.sum("value").alias("_x"), F.count(F.lit(1)).alias("_n")]
    for k in bins:
        angle = F.lit(2.0 * math.pi * k / n) * F.col("pos")
        sums += [F.sum(tapered * F.cos(angle)).alias(f"_c{k}"), F.sum(tapered * F.sin(angle)).alias(f"_s{k}")]
    wide = epochs.groupBy(*keys).agg(*sums).where(F.col("_n") == n)
    mean = F.col("_x") / n
    spectrum = F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("bin"), (F.col(f"_c{k}") - mean * cosine[k]).alias("re"),
                 (mean * sine[k] - F.col(f"_s{k}")).alias("im")) for k in bins])
    return wide.select(*keys, F.explode(spectrum).alias("_z")).select(*keys, "_z.bin", "_z.re", "_z.im")


def _framed_fft(framed: DataFrame, keys: list[str], n: int, bins: list[int], window: str) -> DataFrame:
    import numpy as np

    weights, picked = window_weights(n, window), list(bins)

    @F.pandas_udf("array<struct<bin:bigint,re:double,im:double>>")
    def spectrum(frames: pd.Series) -> pd.Series:
        block = np.stack(frames.to_numpy())
        block = (block - block.mean(axis=1, keepdims=True)) * np.asarray(weights)
        z = np.fft.rfft(block, axis=1)[:, picked]
        return pd.Series([[{"bin": k, "re": float(v.real), "im": float(v.imag)} for k, v in zip(picked, row)] for row in z])

    return framed.select(*keys, F.explode(spectrum("frame")).alias("_z")).select(*keys, "_z.bin", "_z.re", "_z.im")


def reference_spectra(dft: DataFrame) -> DataFrame:
    """Average reference applied to Fourier coefficients.

    Referencing is linear, so it commutes with the transform; here it touches only the kept bins
    and not every sample.
    """
    cell = Window.partitionBy(*rec_keys(dft), "epoch", "bin")
    return dft.withColumn("re", F.col("re") - F.avg("re").over(cell)).withColumn("im", F.col("im") - F.avg("im").over(cell))


def bin_centers(fmin: float, fmax: float, width: float) -> list[float]:
    first = math.ceil(fmin / width) * width
    out, center = [], first
    while center < fmax + width * 0.25:
        out.append(center)
        center = first + len(out) * width
    return out


def frequency_map(n: int, fs: float, fmin: float, fmax: float, width: float) -> dict[int, float]:
    """FFT bin -> centre, by half-open ranges; a centre without any bin is an error."""
    mapping: dict[int, float] = {}
    for center in bin_centers(fmin, fmax, width):
        inside = [k for k in range(n // 2 + 1) if center - width / 2 <= k * fs / n < center + width / 2]
        if not inside:
            raise ValueError(f"no FFT values fall in the bin around {center}")
        mapping.update({k: center for k in inside})
    return mapping


def cross_spectrum(samples: DataFrame, fs: float, epoch_s: float, fmin: float, fmax: float, width: float,
                   method: str = "native", lengths: DataFrame | None = None) -> DataFrame:
    """csd(recording_id[, segment], freq, ch_i, ch_j, re, im, epoch_count), upper triangle with diagonal.

    Mean over epochs and FFT bins of conj(X_i) X_j * 2 / (fs * sum(w^2)). ``lengths``: n_samples per recording (and segment), where they are
    known already; else the samples are made once more to find them.
    """
    n = round(epoch_s * fs)
    mapping = frequency_map(n, fs, fmin, fmax, width)
    if method == "arrow":
        return _cross_spectrum_arrow(samples, fs, n, mapping, lengths)
    scale = 2.0 / (fs * sum(w * w for w in window_weights(n, "hann_sym")))
    keys = rec_keys(samples)
    dft = epoch_dft(epochs_overlap(samples, n, lengths), n, sorted(mapping), "hann_sym")
    center = F.element_at(F.create_map(*[F.lit(x) for k, c in mapping.items() for x in (k, float(c))]), F.col("bin").cast("int"))
    width_in_bins = F.element_at(F.create_map(*[F.lit(x) for c in set(mapping.values()) for x in (
        float(c), sum(1 for v in mapping.values() if v == c))]), F.col("freq"))
    # One row per (epoch, bin) holds all channels, an array as long as the channel list: the average
    # reference and every channel pair come from this single shuffle.
    cells = dft.groupBy(*keys, "epoch", "bin").agg(
        F.array_sort(F.collect_list(F.struct("channel", "re", "im"))).alias("z"),
        F.avg("re").alias("mre"), F.avg("im").alias("mim"))
    i, j = F.col("i"), F.col("j")
    ar, ai = i["re"] - F.col("mre"), i["im"] - F.col("mim")
    br, bi = j["re"] - F.col("mre"), j["im"] - F.col("mim")
    pairs = (
        cells.select(*keys, center.alias("freq"), "mre", "mim", "z", F.posexplode("z").alias("pi", "i"))
        .select(*keys, "freq", "mre", "mim", "i",
                F.explode(F.slice("z", F.col("pi") + 1, F.size("z") - F.col("pi"))).alias("j"))
        .select(*keys, "freq", i["channel"].alias("ch_i"), j["channel"].alias("ch_j"),
                (ar * br + ai * bi).alias("re"), (ar * bi - ai * br).alias("im"))
    )
    csd = pairs.groupBy(*keys, "freq", "ch_i", "ch_j").agg(
        (F.avg("re") * scale).alias("re"), (F.avg("im") * scale).alias("im"), F.count(F.lit(1)).alias("_n"))
    return csd.select(
        *keys, "freq", "ch_i", "ch_j", "re", F.when(F.col("ch_i") == F.col("ch_j"), 0.0).otherwise(F.col("im")).alias("im"),
        (F.col("_n") / width_in_bins).cast("bigint").alias("epoch_count"))


EPOCHS_PER_BLOCK = 32


def _cross_spectrum_arrow(samples: DataFrame, fs: float, n: int, mapping: dict[int, float], lengths: DataFrame | None = None) -> DataFrame:
    """Blocks of epochs as dense arrays: one shuffle of the samples, channel pairs stay inside NumPy.

    A block holds EPOCHS_PER_BLOCK epochs of one recording whatever its duration; blocks emit
    partial sums over epochs, which a map-side-combined aggregate adds up.
    """
    import numpy as np

    hop = n // 2
    keys = rec_keys(samples)
    weights = window_weights(n, "hann_sym")
    scale = 2.0 / (fs * sum(w * w for w in weights))
    bins = sorted(mapping)
    centers = sorted(set(mapping.values()))
    span = EPOCHS_PER_BLOCK * hop
    last_block = F.floor(F.col("_last") / EPOCHS_PER_BLOCK)
    low = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("t") - span - n + hop + 1) / span).cast("bigint"))
    high = F.least(F.floor(F.col("t") / span).cast("bigint"), last_block)
    blocked = _with_last_epoch(samples, n, lengths).withColumn(
        "block", F.explode(F.when(low <= high, F.sequence(low, high)))).select(*keys, "block", "_last", "channel", "t", "value")
    types = dict(samples.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", freq double, ch_i string, ch_j string, re double, im double, n bigint"

    members = [[i for i, k in enumerate(bins) if mapping[k] == center] for center in centers]

    def partial(key: tuple, rows: pa.Table) -> pa.Table:
        block, last = rows["block"][0].as_py(), rows["_last"][0].as_py()
        first = block * EPOCHS_PER_BLOCK
        count = min(EPOCHS_PER_BLOCK, last - first + 1)
        names = sorted(rows["channel"].unique().to_pylist())
        place = pc.index_in(rows["channel"], value_set=pa.array(names)).to_numpy()
        t, value = rows["t"].to_numpy() - first * hop, rows["value"].cast(pa.float64()).to_numpy()
        if len(np.unique(t * len(names) + place)) != len(t):
            raise ValueError("a sample is there twice")
        wide = np.full(((count - 1) * hop + n, len(names)), np.nan)
        inside = (t >= 0) & (t < len(wide))
        wide[t[inside], place[inside]] = value[inside]
        if not np.isfinite(wide).all():
            raise ValueError("samples must be complete and finite")
        wide = wide - wide.mean(axis=1, keepdims=True)
        frames = np.stack([wide[e * hop:e * hop + n] for e in range(count)])
        frames = (frames - frames.mean(axis=1, keepdims=True)) * np.asarray(weights)[None, :, None]
        z = np.fft.rfft(frames, axis=1)[:, bins, :]
        raw = np.einsum("efc,efd->fcd", np.conjugate(z), z) * scale
        upper = np.triu_indices(len(names))
        cells = np.stack([raw[member].mean(axis=0)[upper] for member in members])
        size, each = cells.size, cells.shape[1]
        labels = pa.array(names)
        pairs = [labels.take(pa.array(np.tile(side, len(centers)))) for side in upper]
        constant = [pa.array([k.as_py()], k.type).take(pa.array(np.zeros(size, dtype=np.int64))) for k in key[:-1]]
        im = np.where(upper[0] == upper[1], 0.0, cells.imag)
        return pa.Table.from_arrays([*constant, pa.array(np.repeat(np.array(centers, dtype=float), each)), *pairs, pa.array(cells.real.ravel()), pa.array(im.ravel()), pa.array(np.full(size, count))],
                                    names=[*keys, "freq", "ch_i", "ch_j", "re", "im", "n"])

    partials = dealt(blocked, *keys, "block").groupBy(*keys, "block").applyInArrow(partial, schema)
    total = F.sum("n")
    return partials.groupBy(*keys, "freq", "ch_i", "ch_j").agg(
        (F.sum("re") / total).alias("re"), (F.sum("im") / total).alias("im"), total.alias("epoch_count"))


def welch_psd(samples: DataFrame, fs: float, n: int) -> DataFrame:
    """psd(recording_id[, segment], channel, freq, p): half-overlapping periodic-Hann epochs, density scaling."""
    bins = list(range(n // 2 + 1))
    power = sum(w * w for w in window_weights(n, "hann_periodic"))
    keys = rec_keys(samples)
    dft = epoch_dft(epochs_overlap(samples, n), n, bins, "hann_periodic")
    edge = (F.col("bin") == 0) | ((F.col("bin") == n // 2) if n % 2 == 0 else F.lit(False))
    return dft.groupBy(*keys, "channel", "bin").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_p")).select(
        *keys, "channel", (F.col("bin") * (fs / n)).alias("freq"),
        (F.col("_p") / (fs * power) * F.when(edge, 1.0).otherwise(2.0)).alias("p"))


def band_coherence(dft: DataFrame, n: int, fs: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """|sum S_ij|^2 / (S_ii S_jj) per band and channel pair over all epochs and the band's bins, clipped to [0, 1]."""
    keys = rec_keys(dft)
    freq = F.col("bin") * (fs / n)
    labels = F.array_compact(F.array(*[F.when((freq >= lo) & (freq < hi), F.lit(name)) for name, (lo, hi) in bands.items()]))
    cells = dft.withColumn("band", F.explode(labels)).groupBy(*keys, "epoch", "bin", "band").agg(
        F.array_sort(F.collect_list(F.struct("channel", "re", "im"))).alias("z"))
    i, j = F.col("i"), F.col("j")
    sums = (
        cells.select(*keys, "band", "z", F.posexplode("z").alias("pi", "i"))
        .select(*keys, "band", "i", F.explode(F.slice("z", F.col("pi") + 1, F.size("z") - F.col("pi"))).alias("j"))
        .groupBy(*keys, "band", i["channel"].alias("ch_i"), j["channel"].alias("ch_j"))
        .agg(F.sum(i["re"] * j["re"] + i["im"] * j["im"]).alias("re"), F.sum(i["re"] * j["im"] - i["im"] * j["re"]).alias("im"))
    )
    auto = sums.where(F.col("ch_i") == F.col("ch_j"))
    first = auto.select(*keys, "band", "ch_i", F.col("re").alias("s_ii"))
    second = auto.select(*keys, "band", F.col("ch_i").alias("ch_j"), F.col("re").alias("s_jj"))
    value = F.try_divide(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.greatest(F.col("s_ii") * F.col("s_jj"), F.lit(1e-300)))
    return (
        sums.where(F.col("ch_i") != F.col("ch_j")).join(first, [*keys, "band", "ch_i"]).join(second, [*keys, "band", "ch_j"])
        .select(*keys, "band", "ch_i", "ch_j", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("value"))
    )
