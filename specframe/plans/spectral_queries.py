"""Queries over power spectra and cross-spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import signal, spectral
from ..sources import views
from ..sources.views import ALPHA, BANDS, FS
from .registry import query
from .signal_queries import _BAND_ROWS, csd, psd

LO, HI = 0.5, 11.0
SHOULDERS = [(2.0, 3.0), (6.0, 7.5)]
SIDE_BANDS = {"theta": (1.0, 3.0), "beta": (6.0, 9.0)}
FIRST, SECOND = ["click", "view"], ["purchase", "signup"]


def _channel_block():
    return F.when(F.col("channel").isin("click", "view"), "browse").when(
        F.col("channel").isin("purchase", "signup"), "convert").otherwise("fault")


def _trapz(source: str, keys: str, value: str = "p", name: str = "power") -> str:
    """SQL text: trapezoid of ``value`` over freq per ``keys``."""
    return f"""SELECT {keys}, coalesce(sum(a), 0.0) AS {name} FROM (SELECT {keys}, ({value} + lead({value}) OVER w) / 2.0 * (lead(freq) OVER w - freq) AS a
      FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY freq)) GROUP BY {keys}"""


_IN_BAND = f"(SELECT x.*, b.band FROM fx_psd x JOIN (VALUES {_BAND_ROWS}) b(band, lo, hi) ON x.freq >= b.lo AND x.freq < b.hi)"
_MEAN_IN_BAND = _IN_BAND.replace("fx_psd", "fx_mpsd")
_ALPHA_PSD = f"(SELECT * FROM fx_psd WHERE freq >= {ALPHA[0]} AND freq < {ALPHA[1]})"
_RANGE_MEAN = f"(SELECT * FROM fx_mpsd WHERE freq BETWEEN {LO} AND {HI})"
_SHAPE = f"SELECT recording_id, freq, ln(p + 2.2250738585072014e-308) - avg(ln(p + 2.2250738585072014e-308)) OVER (PARTITION BY recording_id) AS value FROM fx_mpsd WHERE freq BETWEEN {LO} AND {HI}"


@query("band_power", f"SELECT recording_id, channel, band, round(power, 6) + 0.0 AS power FROM ({_trapz(_IN_BAND, 'recording_id, channel, band')})", ("fx_psd",))
def band_power(spark, sf):
    return spectral.band_power(psd(spark, sf), BANDS).select("recording_id", "channel", "band", rnd("power").alias("power"))


@query("band_fraction", f"""
b AS ({_trapz(_MEAN_IN_BAND.replace('fx_mpsd', _RANGE_MEAN), 'recording_id, band')}),
t AS ({_trapz(_RANGE_MEAN, 'recording_id', name='total')})
SELECT recording_id, band, round(power / total, 6) + 0.0 AS fraction FROM b JOIN t USING (recording_id)
""", ("fx_mpsd",))
def band_fraction(spark, sf):
    return spectral.band_fraction(spectral.mean_psd(psd(spark, sf)), BANDS, LO, HI).select(
        "recording_id", "band", rnd("fraction").alias("fraction"))


@query("psd_shape", f"SELECT recording_id, freq, round(value, 6) + 0.0 AS value FROM ({_SHAPE})", ("fx_mpsd",))
def psd_shape(spark, sf):
    return spectral.psd_shape(psd(spark, sf), LO, HI).select("recording_id", "freq", rnd("value").alias("value"))


@query("peak_frequency", """
SELECT recording_id, arg_max(freq, struct_pack(p := p, f := -freq)) AS peak_hz FROM fx_mpsd WHERE freq >= 0.5 AND freq < 11.5 GROUP BY 1
""", ("fx_mpsd",))
def peak_frequency(spark, sf):
    return spectral.peak_frequency(psd(spark, sf), 0.5, 11.5)


@query("spectral_entropy", f"""
SELECT recording_id, round(-sum(q * ln(q)) / ln(count(*)), 6) AS entropy
FROM (SELECT recording_id, p / sum(p) OVER (PARTITION BY recording_id) AS q FROM {_RANGE_MEAN}) GROUP BY 1
""", ("fx_mpsd",))
def spectral_entropy(spark, sf):
    return spectral.spectral_entropy(psd(spark, sf), LO, HI).select("recording_id", rnd("entropy").alias("entropy"))


@query("total_log_power", f"SELECT recording_id, round(ln(power), 6) + 0.0 AS value FROM ({_trapz(_RANGE_MEAN, 'recording_id')})", ("fx_mpsd",))
def total_log_power(spark, sf):
    return spectral.total_log_power(psd(spark, sf), LO, HI).select("recording_id", rnd("value").alias("value"))


@query("alpha_topography", f"""
SELECT recording_id, channel, round(ln(power) - avg(ln(power)) OVER (PARTITION BY recording_id), 6) + 0.0 AS value
FROM ({_trapz(_ALPHA_PSD, 'recording_id, channel')})
""", ("fx_psd",))
def alpha_topography(spark, sf):
    return spectral.alpha_topography(psd(spark, sf), *ALPHA).select("recording_id", "channel", rnd("value").alias("value"))


@query("alpha_topography_csd", """
SELECT recording_id, channel, round(v - avg(v) OVER (PARTITION BY recording_id), 6) + 0.0 AS value
FROM (SELECT recording_id, ch_i AS channel, ln(avg(re)) AS v FROM fx_csd WHERE ch_i = ch_j AND freq >= 3 AND freq < 6 GROUP BY 1, 2)
""", ("fx_csd",))
def alpha_topography_csd(spark, sf):
    return spectral.csd_topography(csd(spark, sf), *ALPHA).select("recording_id", "channel", rnd("value").alias("value"))


@query("alpha_profile", """
SELECT recording_id, channel, round(v / avg(v) OVER (PARTITION BY recording_id), 6) + 0.0 AS value
FROM (SELECT recording_id, ch_i AS channel, avg(re) AS v FROM fx_csd WHERE ch_i = ch_j AND freq >= 3 AND freq < 6 GROUP BY 1, 2)
""", ("fx_csd",))
def alpha_profile(spark, sf):
    return spectral.alpha_profile(csd(spark, sf), *ALPHA).select("recording_id", "channel", rnd("value").alias("value"))


_COH = """
n AS (SELECT c.recording_id, c.freq, c.ch_i, c.ch_j, c.re / sqrt(a.re * b.re) AS re, c.im / sqrt(a.re * b.re) AS im
      FROM fx_csd c JOIN fx_csd a ON a.recording_id = c.recording_id AND a.freq = c.freq AND a.ch_i = c.ch_i AND a.ch_j = c.ch_i
      JOIN fx_csd b ON b.recording_id = c.recording_id AND b.freq = c.freq AND b.ch_i = c.ch_j AND b.ch_j = c.ch_j
      WHERE c.ch_i < c.ch_j)
"""


@query("coherency", _COH + """
SELECT recording_id, freq, ch_i, ch_j, 're' AS part, round(re, 6) + 0.0 AS value FROM n
UNION ALL SELECT recording_id, freq, ch_i, ch_j, 'im', round(im, 6) + 0.0 FROM n
UNION ALL SELECT recording_id, freq, ch_i, ch_j, 'lagged', round(im / sqrt(greatest(1 - re * re, 1e-8)), 6) + 0.0 FROM n
UNION ALL SELECT recording_id, freq, ch_i, ch_j, 'imaginary', round(im, 6) + 0.0 FROM n
""", ("fx_csd",))
def coherency(spark, sf):
    source = csd(spark, sf)
    out = spectral.coherency(source, "complex").unionByName(spectral.coherency(source, "lagged")).unionByName(
        spectral.coherency(source, "imaginary"))
    return out.withColumn("value", rnd("value"))


@query("channel_log_power", """
SELECT recording_id, freq, ch_i AS channel, round(ln(re) - avg(ln(re)) OVER (PARTITION BY recording_id), 6) + 0.0 AS value
FROM fx_csd WHERE ch_i = ch_j
""", ("fx_csd",))
def channel_log_power(spark, sf):
    return spectral.channel_log_power(csd(spark, sf)).select("recording_id", "freq", "channel", rnd("value").alias("value"))


@query("aperiodic_fit", """
l AS (SELECT recording_id, freq, ch_i AS channel, ln(re) AS v FROM fx_csd WHERE ch_i = ch_j),
f AS (SELECT recording_id, channel, regr_slope(v, ln(freq)) AS s, regr_intercept(v, ln(freq)) AS i FROM l
      WHERE freq <= 2 OR freq >= 8 GROUP BY 1, 2)
SELECT recording_id, channel, freq, round(-s, 6) + 0.0 AS exponent, round(v - (i + s * ln(freq)), 6) + 0.0 AS value
FROM l JOIN f USING (recording_id, channel)
""", ("fx_csd",))
def aperiodic_fit(spark, sf):
    logp = spectral.diagonal(csd(spark, sf)).withColumn("value", F.ln("p")).drop("p")
    fits, residuals = spectral.aperiodic_fit(logp, (F.col("freq") <= 2.0) | (F.col("freq") >= 8.0))
    return residuals.join(fits, ["recording_id", "channel"]).select(
        "recording_id", "channel", "freq", rnd("exponent").alias("exponent"), rnd("value").alias("value"))


_PROMINENCE = f"""
sh AS ({_SHAPE}),
pk AS (SELECT recording_id, avg(value) FILTER ((freq >= 2 AND freq < 3) OR (freq >= 6 AND freq < 7.5)) AS s,
         max(value) FILTER (freq >= 3 AND freq < 6) AS v,
         arg_max(freq, struct_pack(p := value, f := -freq)) FILTER (freq >= 3 AND freq < 6) AS f FROM sh GROUP BY 1),
mk AS (SELECT sh.recording_id, freq, s, v, f, value >= s + 0.5 * (v - s) AS above FROM sh JOIN pk USING (recording_id)
       WHERE freq >= 3 AND freq < 6),
br AS (SELECT recording_id, coalesce(max(freq) FILTER (NOT above AND freq < f), -1) AS lo,
         coalesce(min(freq) FILTER (NOT above AND freq > f), 1e9) AS hi FROM mk GROUP BY 1),
pw AS (SELECT recording_id, max(v) - max(s) AS prominence, 0.5 * count(*) FILTER (freq > lo AND freq < hi) AS width
       FROM mk JOIN br USING (recording_id) GROUP BY 1)
"""


@query("peak_prominence_width", _PROMINENCE + """
SELECT recording_id, round(prominence, 6) + 0.0 AS prominence, CAST(width AS DOUBLE) AS width FROM pw
""", ("fx_mpsd",))
def peak_prominence_width(spark, sf):
    return spectral.peak_prominence_width(spectral.psd_shape(psd(spark, sf), LO, HI), ALPHA, SHOULDERS, 0.5).select(
        "recording_id", rnd("prominence").alias("prominence"), "width")


@query("half_max_width", """
SELECT recording_id, max(freq) - min(freq) AS width FROM (
  SELECT *, max(p) OVER (PARTITION BY recording_id) AS m FROM fx_mpsd WHERE freq >= 3 AND freq < 6) WHERE p >= m / 2.0 GROUP BY 1
""", ("fx_mpsd",))
def half_max_width(spark, sf):
    return spectral.half_max_width(psd(spark, sf), ALPHA)


_HARMONIC = f"""
h0 AS (SELECT recording_id, arg_max(freq, struct_pack(p := p, f := -freq)) AS f, max(p) AS m FROM {_RANGE_MEAN} GROUP BY 1),
hr AS (SELECT h0.recording_id, o.o AS "order", max(x.p) FILTER (abs(x.freq - h0.f * o.o) <= 0.75 AND h0.f * o.o <= {HI}) / max(h0.m) AS ratio
       FROM h0 CROSS JOIN (VALUES (2), (3), (4)) o(o) JOIN fx_mpsd x ON x.recording_id = h0.recording_id GROUP BY 1, 2)
"""


@query("harmonic_ratio", _HARMONIC + 'SELECT recording_id, "order", round(ratio, 6) + 0.0 AS ratio FROM hr', ("fx_mpsd",))
def harmonic_ratio(spark, sf):
    return spectral.harmonic_ratio(psd(spark, sf), [2, 3, 4], 0.75, LO, HI).select("recording_id", "order", rnd("ratio").alias("ratio"))


_REGION = f"""
SELECT recording_id, avg(power) FILTER (channel IN ('click', 'view')) / avg(power) FILTER (channel IN ('purchase', 'signup')) AS ratio
FROM ({_trapz(_ALPHA_PSD, 'recording_id, channel')}) GROUP BY 1
"""


@query("region_ratio", f"SELECT recording_id, round(ratio, 6) + 0.0 AS ratio FROM ({_REGION})", ("fx_psd",))
def region_ratio(spark, sf):
    power = spectral.band_power(psd(spark, sf), {"a": ALPHA})
    return spectral.region_ratio(power, FIRST, SECOND).select("recording_id", rnd("ratio").alias("ratio"))


_CORR = """
SELECT recording_id, quantile_cont(abs(r), 0.5) AS median_abs, quantile_cont(abs(r), 0.95) AS p95_abs
FROM (SELECT a.recording_id, corr(a.value, b.value) AS r FROM fx_samples a JOIN fx_samples b
      ON a.recording_id = b.recording_id AND a.t = b.t AND a.channel < b.channel GROUP BY a.recording_id, a.channel, b.channel) GROUP BY 1
"""


@query("correlation_summary", f"SELECT recording_id, round(median_abs, 6) + 0.0 AS median_abs, round(p95_abs, 6) + 0.0 AS p95_abs FROM ({_CORR})", ("fx_samples",))
def correlation_summary(spark, sf):
    return spectral.correlation_summary(views.samples(spark, sf)).select(
        "recording_id", rnd("median_abs").alias("median_abs"), rnd("p95_abs").alias("p95_abs"))


@query("pc_variance")
def pc_variance(spark, sf):
    return spectral.pc_variance(views.samples(spark, sf), [1, 3, 5]).withColumn("share", rnd("share"))


@query("block_band_power", f"""
SELECT recording_id, CASE WHEN channel IN ('click', 'view') THEN 'browse' WHEN channel = 'error' THEN 'fault' ELSE 'convert' END AS block,
       round(avg(power), 6) + 0.0 AS power
FROM ({_trapz(_ALPHA_PSD, 'recording_id, channel')}) GROUP BY 1, 2
""", ("fx_psd",))
def block_band_power(spark, sf):
    nodes = views.table(spark, sf, "events").select(F.col("event_type").alias("channel")).distinct().withColumn("block", _channel_block())
    return spectral.block_band_power(psd(spark, sf), nodes, ALPHA).withColumn("power", rnd("power"))


@query("qc_report", _HARMONIC + f""",
bp AS ({_trapz(_MEAN_IN_BAND, 'recording_id, band')}),
en AS (SELECT recording_id, -sum(q * ln(q)) / ln(count(*)) AS entropy
       FROM (SELECT recording_id, p / sum(p) OVER (PARTITION BY recording_id) AS q FROM {_RANGE_MEAN}) GROUP BY 1),
hw AS (SELECT recording_id, max(freq) - min(freq) AS w FROM (
         SELECT *, max(p) OVER (PARTITION BY recording_id) AS m FROM fx_mpsd WHERE freq >= 3 AND freq < 6) WHERE p >= m / 2.0 GROUP BY 1),
rr AS ({_REGION}), cs AS ({_CORR})
SELECT h0.recording_id, h0.f AS peak_hz,
  (SELECT round(power, 6) FROM bp WHERE bp.recording_id = h0.recording_id AND band = 'slow') AS power_slow,
  (SELECT round(power, 6) FROM bp WHERE bp.recording_id = h0.recording_id AND band = 'mid') AS power_mid,
  (SELECT round(power, 6) FROM bp WHERE bp.recording_id = h0.recording_id AND band = 'fast') AS power_fast,
  (SELECT round(power, 6) FROM bp WHERE bp.recording_id = h0.recording_id AND band = 'high') AS power_high,
  round(entropy, 6) AS entropy, hw.w AS half_max_width,
  (SELECT round(ratio, 6) FROM hr WHERE hr.recording_id = h0.recording_id AND "order" = 2) AS harmonic_2x,
  (SELECT round(ratio, 6) FROM hr WHERE hr.recording_id = h0.recording_id AND "order" = 3) AS harmonic_3x,
  round(rr.ratio, 6) AS region_ratio, round(median_abs, 6) AS median_abs, round(p95_abs, 6) AS p95_abs
FROM h0 JOIN en USING (recording_id) JOIN hw USING (recording_id) JOIN rr USING (recording_id) JOIN cs USING (recording_id)
""", ("fx_psd", "fx_mpsd"))
def qc_report(spark, sf):
    data = views.samples(spark, sf)
    report = spectral.qc_report(data, psd(spark, sf), BANDS, ALPHA, LO, HI, [2, 3], 0.75, FIRST, SECOND)
    exact = ("recording_id", "peak_hz", "half_max_width")
    return report.select(*[F.col(c) if c in exact else rnd(c).alias(c) for c in report.columns])


def channel_gain(spark, sf):
    """gain(sensor, node_id, g): event value per channel and user."""
    return views.table(spark, sf, "events").groupBy(F.col("event_type").alias("sensor"), F.col("user_id").alias("node_id")).agg(
        (F.sum("value") / 1000.0).alias("g"))


_COV = """
gn AS (SELECT event_type AS sensor, user_id AS node_id, sum(value) / 1000.0 AS g FROM events GROUP BY 1, 2),
gr AS (SELECT sensor, node_id, g - avg(g) OVER (PARTITION BY node_id) AS g FROM gn),
rc AS (SELECT a.sensor AS s_i, b.sensor AS s_j, sum(a.g * b.g) AS c FROM gr a JOIN gr b ON a.node_id = b.node_id AND a.sensor <= b.sensor GROUP BY 1, 2),
cv AS (SELECT s_i, s_j, c / (SELECT avg(c) FROM rc WHERE s_i = s_j) AS cov FROM rc)
"""


@query("gain_covariance", _COV + "SELECT s_i, s_j, round(cov, 6) + 0.0 AS cov FROM cv")
def gain_covariance(spark, sf):
    return spectral.gain_covariance(channel_gain(spark, sf)).withColumn("cov", rnd("cov"))


@query("add_background", _COV + """,
ms AS (SELECT recording_id, avg(re) AS m FROM fx_csd WHERE ch_i = ch_j GROUP BY 1),
sp AS (SELECT CAST(f AS DOUBLE) AS freq, power(f, -1.0) / avg(power(f, -1.0)) OVER () AS s1, power(f, -0.5) / avg(power(f, -0.5)) OVER () AS s2
       FROM (SELECT CAST(unnest(range(1, 12)) AS DOUBLE) AS f))
SELECT c.recording_id, c.freq, c.ch_i, c.ch_j,
       round(re + m * (0.2::DOUBLE / 0.8::DOUBLE) * s2 * cov + CASE WHEN ch_i = ch_j THEN m * (0.3::DOUBLE / 0.7::DOUBLE) * s1 ELSE 0 END, 6) + 0.0 AS re,
       round(im, 6) + 0.0 AS im
FROM fx_csd c JOIN ms USING (recording_id) JOIN sp USING (freq) JOIN cv ON s_i = ch_i AND s_j = ch_j
""", ("fx_csd",))
def add_background(spark, sf):
    covariance = spectral.gain_covariance(channel_gain(spark, sf))
    out, _ = spectral.add_background(csd(spark, sf), 0.3, 1.0, 0.2, 0.5, covariance)
    return out.select("recording_id", "freq", "ch_i", "ch_j", rnd("re").alias("re"), rnd("im").alias("im"))


@query("mechanistic_summary", _PROMINENCE + f""",
rl AS (SELECT recording_id, freq, exp(value) AS p FROM sh),
rt AS ({_trapz('rl', 'recording_id', name='total')}),
th AS ({_trapz('(SELECT * FROM rl WHERE freq >= 1 AND freq < 3)', 'recording_id')}),
be AS ({_trapz('(SELECT * FROM rl WHERE freq >= 6 AND freq < 9)', 'recording_id')}),
al AS ({_trapz('(SELECT * FROM fx_mpsd WHERE freq >= 3 AND freq < 6)', 'recording_id')}),
tt AS ({_trapz(_RANGE_MEAN, 'recording_id', name='total')}),
ex AS (SELECT recording_id, -regr_slope(value, log10(freq)) AS exponent FROM sh WHERE freq < 2 OR freq > 8 GROUP BY 1),
en AS (SELECT recording_id, -sum(q * ln(q)) / ln(count(*)) AS entropy
       FROM (SELECT recording_id, p / sum(p) OVER (PARTITION BY recording_id) AS q FROM {_RANGE_MEAN}) GROUP BY 1)
SELECT pk.recording_id, pk.f AS peak_hz, round(al.power / tt.total, 6) AS fraction_alpha, round(entropy, 6) AS entropy,
       round(exponent, 6) + 0.0 AS exponent, round(th.power / rt.total, 6) AS fraction_theta, round(be.power / rt.total, 6) AS fraction_beta,
       round(prominence, 6) + 0.0 AS prominence, CAST(width AS DOUBLE) AS width
FROM pk JOIN pw USING (recording_id) JOIN rt USING (recording_id) JOIN th USING (recording_id) JOIN be USING (recording_id)
JOIN al USING (recording_id) JOIN tt USING (recording_id) JOIN ex USING (recording_id) JOIN en USING (recording_id)
""", ("fx_mpsd",))
def mechanistic_summary(spark, sf):
    out = spectral.mechanistic_summary(psd(spark, sf), LO, HI, ALPHA, (F.col("freq") < 2.0) | (F.col("freq") > 8.0),
                                       SHOULDERS, SIDE_BANDS, 0.5)
    exact = ("recording_id", "peak_hz", "width")
    return out.select(*[F.col(c) if c in exact else rnd(c).alias(c) for c in out.columns])


@query("extract_collection", """
d AS (SELECT recording_id, max(grp) AS grp, (max(t) + 1) / 24.0::DOUBLE AS duration_days FROM fx_samples GROUP BY 1),
c AS (SELECT recording_id // 2 AS recording_id, CASE recording_id % 2 WHEN 0 THEN 'fit' ELSE 'validation' END AS segment, freq, ch_i, ch_j, re, im, epoch_count FROM h2_csd
      UNION ALL SELECT recording_id // 2, CASE recording_id % 2 WHEN 0 THEN 'rel_a' ELSE 'rel_b' END, freq, ch_i, ch_j, re, im, epoch_count FROM q4_csd)
SELECT recording_id, grp, duration_days, segment, freq, ch_i, ch_j, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, epoch_count FROM c JOIN d USING (recording_id)
""", ("fx_samples", "h2_csd", "q4_csd"))
def extract_collection(spark, sf):
    """All recordings to four segment collections, with the subject columns attached."""
    data = views.samples(spark, sf)
    subjects = data.groupBy("recording_id").agg(F.first("grp").alias("grp"), ((F.max("t") + 1) / FS).alias("duration_days"))
    collection = csd(spark, sf, "arrow", signal.temporal_segments(data.drop("grp")))
    return collection.join(subjects, "recording_id").select(
        "recording_id", "grp", "duration_days", "segment", "freq", "ch_i", "ch_j", rnd("re").alias("re"), rnd("im").alias("im"), "epoch_count")
