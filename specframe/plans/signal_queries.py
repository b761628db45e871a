"""Queries over recordings: referencing, epochs, Fourier coefficients, cross-spectra, power spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import signal
from ..sources import views
from ..sources.views import BANDS, EPOCH, EPOCH_DAYS, FS
from .registry import query


@query("rereference", """
SELECT recording_id, channel, t, round(value - avg(value) OVER (PARTITION BY recording_id, t), 6) + 0.0 AS value FROM fx_samples
""", ("fx_samples",))
def rereference(spark, sf):
    return signal.rereference(views.samples(spark, sf)).select("recording_id", "channel", "t", rnd("value").alias("value"))


@query("demean", """
SELECT recording_id, channel, t, round(value - avg(value) OVER (PARTITION BY recording_id, channel), 8) + 0.0 AS value FROM fx_samples
""", ("fx_samples",))
def demean(spark, sf):
    return signal.demean(views.samples(spark, sf)).select("recording_id", "channel", "t", rnd("value", 8).alias("value"))


@query("crop_duration", """
SELECT recording_id, channel, t, round(value, 6) AS value FROM fx_samples WHERE t < round_even(10.27 * 24.0, 0)
""", ("fx_samples",))
def crop_duration(spark, sf):
    data = views.samples(spark, sf)
    recordings = data.select("recording_id").distinct().withColumn("sfreq_hz", F.lit(FS))
    return signal.crop_duration(data, recordings, 10.27).select("recording_id", "channel", "t", rnd("value").alias("value"))


@query("require_channels", """
SELECT recording_id, channel, t, round(value, 6) AS value,
       CAST(CASE channel WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS BIGINT) AS channel_pos
FROM fx_samples WHERE channel IN ('view', 'click', 'error')
""", ("fx_samples",))
def require_channels(spark, sf):
    return signal.require_channels(views.samples(spark, sf), ["view", "click", "error"]).select(
        "recording_id", "channel", "t", rnd("value").alias("value"), "channel_pos")


@query("temporal_segments", """
b AS (SELECT *, (max(t) OVER (PARTITION BY recording_id) + 1) // 2 AS h FROM fx_samples)
SELECT recording_id, channel, 'fit' AS segment, t, round(value, 6) AS value FROM b WHERE t < h
UNION ALL SELECT recording_id, channel, 'validation', t - h, round(value, 6) FROM b WHERE t >= h
UNION ALL SELECT recording_id, channel, 'rel_a', t, round(value, 6) FROM b WHERE t < h // 2
UNION ALL SELECT recording_id, channel, 'rel_b', t - h // 2, round(value, 6) FROM b WHERE t >= h // 2 AND t < h
""", ("fx_samples",))
def temporal_segments(spark, sf):
    return signal.temporal_segments(views.samples(spark, sf)).select(
        "recording_id", "channel", "segment", "t", rnd("value").alias("value"))


@query("epochs_overlap", "SELECT recording_id, channel, epoch, pos, round(value, 6) AS value FROM fx_epochs", ("fx_epochs",))
def epochs_overlap(spark, sf):
    return signal.epochs_overlap(views.samples(spark, sf), EPOCH).select(
        "recording_id", "channel", "epoch", "pos", rnd("value").alias("value"))


@query("epochs_tiled", """
SELECT recording_id, channel, t // 50 AS epoch, t % 50 AS pos, round(value, 6) AS value FROM fx_samples
WHERE t // 50 < (SELECT (max(t) + 1) // 50 FROM fx_samples)
""", ("fx_samples",))
def epochs_tiled(spark, sf):
    return signal.epochs_tiled(views.samples(spark, sf), 50).select(
        "recording_id", "channel", "epoch", "pos", rnd("value").alias("value"))


def _dft(spark, sf, window="hann_sym", method="native"):
    return signal.epoch_dft(signal.epochs_overlap(views.samples(spark, sf), EPOCH), EPOCH, list(range(EPOCH // 2 + 1)), window, method)


_DFT_SQL = "SELECT recording_id, channel, epoch, bin, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM fx_dft"


@query("epoch_dft", _DFT_SQL, ("fx_dft",))
def epoch_dft(spark, sf):
    return _dft(spark, sf).select("recording_id", "channel", "epoch", "bin", rnd("re", 5).alias("re"), rnd("im", 5).alias("im"))


@query("epoch_dft_arrow", _DFT_SQL, ("fx_dft",))
def epoch_dft_arrow(spark, sf):
    return _dft(spark, sf, method="arrow").select(
        "recording_id", "channel", "epoch", "bin", rnd("re", 5).alias("re"), rnd("im", 5).alias("im"))


_CSD_SQL = """
SELECT recording_id, freq, ch_i, ch_j, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, epoch_count FROM fx_csd
"""


def csd(spark, sf, method="arrow", samples=None, lengths=None):
    return signal.cross_spectrum(samples if samples is not None else views.samples(spark, sf), FS, EPOCH_DAYS, 1.0, 11.0, 1.0, method, lengths)


def _csd_report(df):
    return df.select("recording_id", "freq", "ch_i", "ch_j", rnd("re").alias("re"), rnd("im").alias("im"), "epoch_count")


@query("cross_spectrum", _CSD_SQL, ("fx_csd",))
def cross_spectrum(spark, sf):
    return _csd_report(csd(spark, sf, "native"))


@query("cross_spectrum_arrow", _CSD_SQL, ("fx_csd",))
def cross_spectrum_arrow(spark, sf):
    return _csd_report(csd(spark, sf, "arrow"))


def psd(spark, sf):
    return signal.welch_psd(views.samples(spark, sf), FS, EPOCH)


@query("welch_psd", "SELECT recording_id, channel, freq, round(p, 6) + 0.0 AS p FROM fx_psd", ("fx_psd",))
def welch_psd(spark, sf):
    return psd(spark, sf).select("recording_id", "channel", "freq", rnd("p").alias("p"))


_BAND_ROWS = ", ".join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, (lo, hi) in BANDS.items())


@query("band_coherence", f"""
tiled AS (SELECT recording_id, channel, t // 48 AS epoch, t % 48 AS pos, value FROM fx_samples),
c AS (SELECT *, value - avg(value) OVER (PARTITION BY recording_id, channel, epoch) AS x FROM tiled),
r AS (SELECT *, x - avg(x) OVER (PARTITION BY recording_id, epoch, pos) AS y FROM c),
z AS (SELECT recording_id, channel, epoch, b.band, k.bin,
        sum(y * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * pos / 47)) * cos(2 * pi() * k.bin * pos / 48)) AS re,
        -sum(y * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * pos / 47)) * sin(2 * pi() * k.bin * pos / 48)) AS im
      FROM r CROSS JOIN (SELECT unnest(range(25)) AS bin) k
      JOIN (VALUES {_BAND_ROWS}) b(band, lo, hi) ON k.bin * 0.5 >= lo AND k.bin * 0.5 < hi GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT a.recording_id, a.band, a.channel AS ch_i, b.channel AS ch_j,
        sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im
      FROM z a JOIN z b ON a.recording_id = b.recording_id AND a.epoch = b.epoch AND a.band = b.band AND a.bin = b.bin
        AND a.channel <= b.channel GROUP BY 1, 2, 3, 4)
SELECT s.recording_id, s.band, s.ch_i, s.ch_j,
       round(least(1.0, (s.re * s.re + s.im * s.im) / (i.re * j.re)), 6) + 0.0 AS value
FROM s JOIN s i ON i.recording_id = s.recording_id AND i.band = s.band AND i.ch_i = s.ch_i AND i.ch_j = s.ch_i
JOIN s j ON j.recording_id = s.recording_id AND j.band = s.band AND j.ch_i = s.ch_j AND j.ch_j = s.ch_j
WHERE s.ch_i < s.ch_j
""", ("fx_samples",))
def band_coherence(spark, sf):
    tiled = signal.epochs_tiled(views.samples(spark, sf), EPOCH)
    # The band edges need bins 2..23 only, so the others are never computed.
    dft = signal.reference_spectra(signal.epoch_dft(tiled, EPOCH, list(range(2, 24)), "hann_sym"))
    return signal.band_coherence(dft, EPOCH, FS, BANDS).select("recording_id", "band", "ch_i", "ch_j", rnd("value").alias("value"))
