"""Queries over feature tables: scaling, reliability, selection, contrasts, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import checks, features, signal, spectral, stats
from ..sources import views
from ..sources.views import BANDS, EPOCH, FS, SQL_VIEWS
from .registry import query
from .signal_queries import _BAND_ROWS, csd, psd

_VOWELS = (0, 4, 8, 14, 20)


def blocks(df):
    """Letter coordinates in two blocks."""
    return df.withColumn("block", F.when(F.col("coord").isin(*_VOWELS), "vowel").otherwise("consonant"))


def letters(spark, sf):
    return blocks(views.letters(spark, sf))


def train_stats(data):
    return features.robust_standardize(data.where("segment = 'fit' AND split = 'train'"))


_BLOCK = "CASE WHEN coord IN (0, 4, 8, 14, 20) THEN 'vowel' ELSE 'consonant' END AS block"
SQL_VIEWS["fx_blocks"] = (("fx_letters",), f"SELECT *, {_BLOCK} FROM fx_letters")
SQL_VIEWS["fx_stats"] = (("fx_blocks",), """
SELECT block, coord, mean, CASE WHEN sd > f THEN sd ELSE f END AS scale FROM (
  SELECT *, coalesce(quantile_cont(CASE WHEN sd > 0 THEN sd END, 0.1) OVER (PARTITION BY block) * 0.1, 1.0) AS f
  FROM (SELECT block, coord, avg(value) AS mean, stddev_samp(value) AS sd FROM fx_blocks WHERE segment = 'fit' AND split = 'train' GROUP BY 1, 2))
""")
SQL_VIEWS["fx_z"] = (("fx_blocks", "fx_stats"), """
SELECT b.entity_id, b.grp, b.split, b.segment, b.block, b.coord, (b.value - s.mean) / s.scale AS value
FROM fx_blocks b JOIN fx_stats s ON s.block = b.block AND s.coord = b.coord
""")
SQL_VIEWS["fx_rel"] = (("fx_blocks",), """
SELECT a.block, a.coord, CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN corr(a.value, b.value) ELSE -1e999 END AS r
FROM fx_blocks a JOIN fx_blocks b ON a.entity_id = b.entity_id AND a.coord = b.coord AND a.segment = 'rel_a' AND b.segment = 'rel_b'
WHERE a.split = 'train' GROUP BY 1, 2
""")


@query("robust_standardize", """
SELECT entity_id, segment, block, coord, round(value, 6) + 0.0 AS value FROM fx_z
""", ("fx_z",))
def robust_standardize(spark, sf):
    data = letters(spark, sf)
    return features.apply_standardize(data, train_stats(data)).select("entity_id", "segment", "block", "coord", rnd("value").alias("value"))


def reliability(data):
    return features.split_half_reliability(data.where("split = 'train'"), "rel_a", "rel_b")


@query("split_half_reliability", """
p AS (SELECT a.entity_id, a.block, CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN corr(a.value, b.value) END AS r
      FROM fx_blocks a JOIN fx_blocks b ON a.entity_id = b.entity_id AND a.coord = b.coord AND a.segment = 'fit' AND b.segment = 'validation' GROUP BY 1, 2)
SELECT 'coord' AS axis, block, coord AS id, round(r, 6) + 0.0 AS r FROM fx_rel UNION ALL SELECT 'entity', block, entity_id, round(r, 6) + 0.0 FROM p
""", ("fx_rel", "fx_blocks"))
def split_half_reliability(spark, sf):
    data = letters(spark, sf)
    by_entity = features.split_half_reliability(data, "fit", "validation", "entity", None)
    return reliability(data).select(F.lit("coord").alias("axis"), "block", F.col("coord").alias("id"), rnd("r").alias("r")).unionByName(
        by_entity.select(F.lit("entity").alias("axis"), "block", F.col("entity_id").alias("id"), rnd("r").alias("r")))


@query("select_reliable", """
k AS (SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY block) AS d, count(*) FILTER (r >= 0.6) OVER (PARTITION BY block) AS p FROM fx_rel WINDOW w AS (PARTITION BY block ORDER BY r DESC, coord))
SELECT block, coord, round(r, 6) AS r, rk - 1 AS out_coord FROM k
WHERE rk <= CASE WHEN least(p, 8) >= least(4, d) THEN least(p, 8) ELSE least(4, 8, d) END
""", ("fx_rel",))
def select_reliable(spark, sf):
    return features.select_reliable(reliability(letters(spark, sf)), 0.6, 8, 4).withColumn("r", rnd("r"))


@query("select_balanced", """
h AS (SELECT *, CASE WHEN coord < 13 THEN 're' ELSE 'im' END AS part FROM (SELECT 'all' AS block, coord, r FROM fx_rel)),
k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY r DESC, coord) AS rk, count(*) FILTER (r >= 0.5) OVER (PARTITION BY part) AS p FROM h)
SELECT part, coord, round(r, 6) AS r, rk - 1 AS out_coord FROM k WHERE rk <= CASE WHEN least(p, 5) >= 3 THEN least(p, 5) ELSE 3 END
""", ("fx_rel",))
def select_balanced(spark, sf):
    rel = reliability(letters(spark, sf)).select(F.lit("all").alias("block"), "coord", "r", F.when(F.col("coord") < 13, "re").otherwise("im").alias("part"))
    return features.select_balanced(rel, 0.5, 10, 6).select("part", "coord", rnd("r").alias("r"), "out_coord")


@query("select_edges_by_band", """
SELECT band, coord, round(r, 6) AS r, row_number() OVER (ORDER BY r DESC, band, coord) - 1 AS out_coord
FROM (SELECT CASE WHEN coord < 9 THEN 'theta' WHEN coord < 18 THEN 'alpha' ELSE 'beta' END AS band, coord, r FROM fx_rel) WHERE band IN ('theta', 'beta') AND r >= 0.4
ORDER BY r DESC, band, coord LIMIT 7
""", ("fx_rel",))
def select_edges_by_band(spark, sf):
    band = F.when(F.col("coord") < 9, "theta").when(F.col("coord") < 18, "alpha").otherwise("beta")
    rel = reliability(letters(spark, sf)).select(band.alias("band"), "coord", "r")
    return features.select_edges_by_band(rel, ["theta", "beta"], 0.4, 7).withColumn("r", rnd("r"))


@query("pca_scores")
def pca_scores(spark, sf):
    data = letters(spark, sf).where("segment = 'fit'")
    standard = features.apply_standardize(data, train_stats(letters(spark, sf))).where("split = 'train'")
    _, scores = features.pca_scores(standard, 4)
    scaled = scores.join(features.score_scales(scores), "coord")
    return scaled.select("entity_id", "coord", (F.col("value") / F.col("score_scale")).alias("value"))


@query("spatial_basis")
def spatial_basis(spark, sf):
    return features.spatial_basis(csd(spark, sf), 3).withColumn("loading", rnd("loading"))


_CHANNELS = ["click", "error", "purchase", "signup", "view"]


def cosine_basis(df):
    """Two orthonormal cosine modes over the sorted channels."""
    position = F.array_position(F.array(*[F.lit(c) for c in _CHANNELS]), F.col("channel")) - 1
    return df.select(F.col("ch_i").alias("channel")).distinct().withColumn("mode", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "loading", F.cos((position + 0.5) * (F.col("mode") + 1) * 3.141592653589793 / 5.0) * (0.4 ** 0.5))


@query("project_basis", """
b AS (SELECT c.c AS channel, m.m AS mode, cos((c.i + 0.5::DOUBLE) * (m.m + 1) * pi() / 5.0) * sqrt(0.4::DOUBLE) AS l
      FROM (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)) c(c, i) CROSS JOIN (VALUES (0), (1)) m(m)),
f AS (SELECT recording_id, freq, ch_i, ch_j, re, im FROM fx_csd UNION ALL SELECT recording_id, freq, ch_j, ch_i, re, -im FROM fx_csd WHERE ch_i < ch_j),
p AS (SELECT recording_id, freq, x.mode AS m_i, y.mode AS m_j, sum(x.l * re * y.l) AS re, sum(x.l * im * y.l) AS im
      FROM f JOIN b x ON x.channel = ch_i JOIN b y ON y.channel = ch_j WHERE x.mode <= y.mode GROUP BY 1, 2, 3, 4)
SELECT recording_id, freq, m_i, m_j, round(re * CASE WHEN m_i = m_j THEN 1 ELSE 0.95::DOUBLE END, 6) + 0.0 AS re,
       round(CASE WHEN m_i = m_j THEN 0 ELSE im * 0.95::DOUBLE END, 6) + 0.0 AS im FROM p
""", ("fx_csd",))
def project_basis(spark, sf):
    source = csd(spark, sf)
    out = features.project_basis(source, cosine_basis(source), 0.05)
    im = F.when(F.col("m_i") == F.col("m_j"), 0.0).otherwise(F.col("im"))
    return out.select("recording_id", "freq", "m_i", "m_j", rnd("re").alias("re"), rnd(im).alias("im"))


@query("weighted_features", """
SELECT entity_id, segment, block, coord, round(value * sqrt(CASE block WHEN 'vowel' THEN 0.6::DOUBLE / 5 ELSE 0.4::DOUBLE / 21 END), 6) + 0.0 AS value FROM fx_z
""", ("fx_z",))
def weighted_features(spark, sf):
    data = letters(spark, sf)
    standard = features.apply_standardize(data, train_stats(data))
    return features.weighted_features(standard, {"vowel": 0.6, "consonant": 0.4}).select("entity_id", "segment", "block", "coord", rnd("value").alias("value"))


@query("feature_blocks", f"""
s AS (SELECT recording_id AS entity_id, 'shape' AS block, CAST(freq AS VARCHAR) AS coord, ln(p) - avg(ln(p)) OVER (PARTITION BY recording_id) AS value FROM fx_mpsd WHERE freq BETWEEN 0.5 AND 11),
t AS (SELECT recording_id AS entity_id, 'topography' AS block, channel AS coord, ln(power) - avg(ln(power)) OVER (PARTITION BY recording_id) AS value FROM (
        SELECT recording_id, channel, sum(a) AS power FROM (SELECT recording_id, channel, (p + lead(p) OVER w) / 2 * (lead(freq) OVER w - freq) AS a
          FROM fx_psd WHERE freq >= 3 AND freq < 6 WINDOW w AS (PARTITION BY recording_id, channel ORDER BY freq)) GROUP BY 1, 2)),
u AS (SELECT * FROM s UNION ALL SELECT * FROM t)
SELECT entity_id, block, coord, round(value, 6) + 0.0 AS value FROM u UNION ALL SELECT entity_id, 'all', block || ':' || coord, round(value, 6) + 0.0 FROM u
""", ("fx_mpsd", "fx_psd"))
def feature_blocks(spark, sf):
    power = psd(spark, sf)
    return features.feature_blocks({
        "shape": spectral.psd_shape(power, 0.5, 11.0).select(F.col("recording_id").alias("entity_id"), F.col("freq").alias("coord"), "value"),
        "topography": spectral.alpha_topography(power, *BANDS["mid"]).select(F.col("recording_id").alias("entity_id"), F.col("channel").alias("coord"), "value"),
    }).withColumn("value", rnd("value"))


@query("residualize", """
c AS (SELECT l.doc_id AS entity_id, ln(n_chars) AS age, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sex, l.toxic = 0 AS train FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
p AS (SELECT entity_id, train, (age - (SELECT avg(age) FROM c WHERE train)) / (SELECT stddev_samp(age) FROM c WHERE train) AS a, sex AS x FROM c),
r AS (SELECT f.entity_id, f.coord, f.value, a, x, train FROM fx_blocks f JOIN p ON p.entity_id = f.entity_id WHERE f.segment = 'fit'),
m AS (SELECT coord, covar_pop(a, a) AS aa, covar_pop(x, x) AS xx, covar_pop(a, x) AS ax, covar_pop(a, value) AS ay, covar_pop(x, value) AS xy FROM r WHERE train GROUP BY 1)
SELECT r.entity_id, r.coord, round(value - a * (ay * xx - xy * ax) / (aa * xx - ax * ax) - x * (xy * aa - ay * ax) / (aa * xx - ax * ax), 6) + 0.0 AS value
FROM r JOIN m ON m.coord = r.coord
""", ("fx_blocks",))
def residualize(spark, sf):
    people = views.table(spark, sf, "labels").join(views.table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("entity_id"), F.ln("n_chars").alias("age"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("sex"), "toxic")
    data = letters(spark, sf).where("segment = 'fit'").select("entity_id", "coord", "value")
    return features.residualize(data, people, F.col("toxic") == 0).withColumn("value", rnd("value"))


@query("anova_select", """
g AS (SELECT coord, grp, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM fx_blocks WHERE segment = 'fit' GROUP BY 1, 2),
f AS (SELECT coord, ((sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM g GROUP BY 1)
SELECT coord, round(f, 4) AS f, row_number() OVER (ORDER BY f DESC, coord) AS rank FROM f ORDER BY f DESC, coord LIMIT 6
""", ("fx_blocks",))
def anova_select(spark, sf):
    return features.anova_select(letters(spark, sf).where("segment = 'fit'"), "grp", 6).withColumn("f", rnd("f", 4))


# --- aggregates ----------------------------------------------------------------------------------


@query("replicate_mean", "SELECT candidate_id, coord, round(avg(value), 6) AS value FROM fx_bank GROUP BY 1, 2", ("fx_bank",))
def replicate_mean(spark, sf):
    return stats.replicate_mean(views.bank(spark, sf), 2).withColumn("value", rnd("value"))


@query("group_summary", """
u AS (SELECT grp, 'age' AS parameter, age AS v FROM fx_people UNION ALL SELECT grp, 'sex', sex FROM fx_people)
SELECT grp, parameter, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.5), 8) AS median, round(quantile_cont(v, 0.25), 8) AS q25, round(quantile_cont(v, 0.75), 8) AS q75
FROM u GROUP BY 1, 2
""", ("fx_people",))
def group_summary(spark, sf):
    out = stats.group_summary(views.people(spark, sf), "grp", ["age", "sex"])
    return out.select("grp", "parameter", *[rnd(c, 6 if c in ("mean", "sd") else 8).alias(c) for c in ("mean", "sd", "median", "q25", "q75")])


_FITS = """
f AS (SELECT o_orderkey AS entity_id, o_orderpriority AS split, o_totalprice / 200000.0 AS fit_ratio, o_totalprice / 300000.0 AS unseen_ratio,
        o_custkey AS chosen, c_nationkey AS group_choice FROM orders JOIN customer ON c_custkey = o_custkey)
"""


def order_fits(spark, sf):
    """A large result table: one row per order."""
    return views.table(spark, sf, "orders").join(views.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("entity_id"), F.col("o_orderpriority").alias("split"), (F.col("o_totalprice") / 200000.0).alias("fit_ratio"),
        (F.col("o_totalprice") / 300000.0).alias("unseen_ratio"), F.col("o_custkey").alias("chosen"), F.col("c_nationkey").alias("group_choice"))


@query("split_summary", _FITS + """
SELECT split, count(*) AS n, round(median(fit_ratio), 6) AS median_fit_ratio, round(median(unseen_ratio), 6) AS median_unseen_ratio,
  round(avg(CASE WHEN fit_ratio < 1 THEN 1.0 ELSE 0.0 END), 6) AS share_fit_ratio_below_1, round(avg(CASE WHEN unseen_ratio < 1 THEN 1.0 ELSE 0.0 END), 6) AS share_unseen_ratio_below_1,
  count(DISTINCT chosen) AS unique_selected, round(avg(CASE WHEN chosen = group_choice THEN 1.0 ELSE 0.0 END), 6) AS share_group_choice FROM f GROUP BY 1
""")
def split_summary(spark, sf):
    out = stats.split_summary(order_fits(spark, sf), ["split"], ["fit_ratio", "unseen_ratio"], "chosen", "group_choice")
    return out.select(*[rnd(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("coverage_ranges", """
SELECT 'length' AS parameter, (SELECT min(p_size) FROM part)::DOUBLE AS bank_min, (SELECT max(p_size) FROM part)::DOUBLE AS bank_max, round(quantile_cont(l_quantity, 0.05), 6) AS p05,
  round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.95), 6) AS p95 FROM lineitem
UNION ALL SELECT 'price', (SELECT min(p_retailprice) FROM part), (SELECT max(p_retailprice) FROM part), round(quantile_cont(l_extendedprice, 0.05), 6),
  round(quantile_cont(l_extendedprice, 0.5), 6), round(quantile_cont(l_extendedprice, 0.95), 6) FROM lineitem
""")
def coverage_ranges(spark, sf):
    bank = views.table(spark, sf, "part").select(F.col("p_size").alias("length"), F.col("p_retailprice").alias("price"))
    observed = views.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("length"), F.col("l_extendedprice").alias("price"))
    out = stats.coverage_ranges(bank, observed, ["length", "price"])
    return out.select("parameter", *[rnd(c).alias(c) for c in out.columns[1:]])


@query("group_contrast", """
SELECT block, coord, round(avg(value) FILTER (grp = 'q1') - avg(value) FILTER (grp = 'q0'), 6) + 0.0 AS diff FROM fx_blocks WHERE segment = 'fit' GROUP BY 1, 2
""", ("fx_blocks",))
def group_contrast(spark, sf):
    return stats.group_contrast(letters(spark, sf).where("segment = 'fit'"), "q0", "q1").withColumn("diff", rnd("diff"))


_HEDGES = """
hp AS (SELECT segment, block, coord, count(*) FILTER (grp = 'q0') AS n0, count(*) FILTER (grp = 'q1') AS n1, avg(value) FILTER (grp = 'q0') AS m0, avg(value) FILTER (grp = 'q1') AS m1,
         var_samp(value) FILTER (grp = 'q0') AS v0, var_samp(value) FILTER (grp = 'q1') AS v1 FROM fx_blocks GROUP BY 1, 2, 3),
hg AS (SELECT segment, block, coord, (1 - 3.0::DOUBLE / (4 * (n0 + n1) - 9)) * (m1 - m0) / sqrt(greatest(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2), 2.220446049250313e-16)) AS g FROM hp)
"""


@query("hedges_g", _HEDGES + "SELECT block, coord, round(g, 6) + 0.0 AS g FROM hg WHERE segment = 'fit'", ("fx_blocks",))
def hedges_g(spark, sf):
    return stats.hedges_g(letters(spark, sf).where("segment = 'fit'"), "q0", "q1").withColumn("g", rnd("g"))


@query("effect_replication", _HEDGES + """
SELECT a.block, round(corr(a.g, b.g), 6) AS r, round(median(abs(a.g)), 6) AS median_abs, round(max(abs(a.g)), 6) AS max_abs, count(*) FILTER (abs(a.g) >= 0.2) AS strong,
       round(avg(CASE WHEN sign(a.g) = sign(b.g) THEN 1.0 ELSE 0.0 END) FILTER (abs(a.g) >= 0.2), 6) AS sign_agreement
FROM hg a JOIN hg b ON a.segment = 'fit' AND b.segment = 'validation' AND a.coord = b.coord GROUP BY 1
""", ("fx_blocks",))
def effect_replication(spark, sf):
    data = letters(spark, sf)
    out = stats.effect_replication(*[stats.hedges_g(data.where(F.col("segment") == s), "q0", "q1") for s in ("fit", "validation")])
    return out.select("block", rnd("r").alias("r"), rnd("median_abs").alias("median_abs"), rnd("max_abs").alias("max_abs"), "strong", rnd("sign_agreement").alias("sign_agreement"))


@query("reliability_summary", """
c AS (SELECT a.block, a.coord, CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN corr(a.value, b.value) END AS r
      FROM fx_blocks a JOIN fx_blocks b ON a.entity_id = b.entity_id AND a.coord = b.coord AND a.segment = 'fit' AND b.segment = 'validation' GROUP BY 1, 2),
p AS (SELECT a.entity_id, a.block, CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN corr(a.value, b.value) END AS r
      FROM fx_blocks a JOIN fx_blocks b ON a.entity_id = b.entity_id AND a.coord = b.coord AND a.segment = 'fit' AND b.segment = 'validation' GROUP BY 1, 2)
SELECT block, count(*) AS dimensions, round(median(r), 6) AS median_r, round(avg(CASE WHEN r >= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS share_r_060,
       (SELECT round(median(r), 6) FROM p WHERE p.block = c.block) AS median_profile_r FROM c GROUP BY block
""", ("fx_blocks",))
def reliability_summary(spark, sf):
    data = letters(spark, sf)
    out = stats.reliability_summary(features.split_half_reliability(data, "fit", "validation", "coord", None),
                                    features.split_half_reliability(data, "fit", "validation", "entity", None))
    return out.select("block", "dimensions", *[rnd(c).alias(c) for c in ("median_r", "share_r_060", "median_profile_r")])


@query("effect_preservation", """
d AS (SELECT segment, block, coord, avg(value) FILTER (grp = 'q1') - avg(value) FILTER (grp = 'q0') AS d FROM fx_blocks GROUP BY 1, 2, 3)
SELECT o.block, round(corr(o.d, p.d), 6) AS correlation, round(sqrt(sum(o.d * o.d)), 6) AS observed_norm, round(sqrt(sum(p.d * p.d)), 6) AS predicted_norm,
       round(sqrt(sum(p.d * p.d)) / sqrt(sum(o.d * o.d)), 6) AS norm_retained
FROM d o JOIN d p ON o.segment = 'validation' AND p.segment = 'fit' AND o.coord = p.coord GROUP BY 1
""", ("fx_blocks",))
def effect_preservation(spark, sf):
    data = letters(spark, sf)
    out = stats.effect_preservation(data.where("segment = 'validation'"), data.where("segment = 'fit'"), "q0", "q1")
    return out.select("block", *[rnd(c).alias(c) for c in ("correlation", "observed_norm", "predicted_norm", "norm_retained")])


@query("axis_coverage", f"""
bm AS (SELECT candidate_id, coord, {_BLOCK}, avg(value) AS value FROM fx_bank GROUP BY 1, 2),
c AS (SELECT block, coord, avg(value) FILTER (grp = 'q0') AS a, avg(value) FILTER (grp = 'q1') AS b FROM fx_blocks WHERE segment = 'fit' GROUP BY 1, 2),
n AS (SELECT block, sqrt(sum((b - a) ** 2)) AS s FROM c GROUP BY 1),
x AS (SELECT c.*, s, (b - a) / s AS d FROM c JOIN n ON n.block = c.block),
e AS (SELECT block, max(s) AS s, sum(a * d) AS pa, sum(b * d) AS pb FROM x GROUP BY 1),
p AS (SELECT x.block, candidate_id, sum(value * d) AS p, avg((value - a) ** 2) AS da, avg((value - b) ** 2) AS db FROM bm JOIN x ON x.coord = bm.coord GROUP BY 1, 2),
q AS (SELECT block, min(p) AS lo, max(p) AS hi, arg_min(candidate_id, struct_pack(d := da, c := candidate_id)) AS na, arg_min(candidate_id, struct_pack(d := db, c := candidate_id)) AS nb FROM p GROUP BY 1)
SELECT e.block, round(s, 6) AS separation, round(pa, 6) + 0.0 AS first_projection, round(pb, 6) + 0.0 AS second_projection, round(lo, 6) + 0.0 AS bank_min, round(hi, 6) + 0.0 AS bank_max,
       na AS nearest_first, nb AS nearest_second, pa BETWEEN lo AND hi AS covers_first, pb BETWEEN lo AND hi AS covers_second
FROM e JOIN q ON q.block = e.block
""", ("fx_bank", "fx_blocks"))
def axis_coverage(spark, sf):
    bank = blocks(stats.replicate_mean(views.bank(spark, sf), 2))
    out = stats.axis_coverage(letters(spark, sf).where("segment = 'fit'"), bank, "q0", "q1")
    return out.select(*[rnd(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# --- splits --------------------------------------------------------------------------------------


@query("stratified_holdout", """
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('7:' || entity_id), entity_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM fx_people)
SELECT entity_id, grp, CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'holdout' ELSE 'train' END AS split FROM k
""", ("fx_people",))
def stratified_holdout(spark, sf):
    return stats.stratified_holdout(views.people(spark, sf).select("entity_id", "grp"), "grp", 0.2, 7)


@query("stratified_folds", """
SELECT entity_id, grp, (row_number() OVER (PARTITION BY grp ORDER BY md5('11:' || entity_id), entity_id) - 1) % 5 AS fold FROM fx_people
""", ("fx_people",))
def stratified_folds(spark, sf):
    return stats.stratified_folds(views.people(spark, sf).select("entity_id", "grp"), "grp", 5, 11)


_NESTED = """
o AS (SELECT entity_id, grp, (row_number() OVER (PARTITION BY grp ORDER BY md5('11:' || entity_id), entity_id) - 1) % 5 AS fold FROM fx_people),
t AS (SELECT o.*, f.f AS outer_fold, fold = f.f AS held FROM o CROSS JOIN (SELECT unnest(range(5)) AS f) f),
i AS (SELECT entity_id, outer_fold, (row_number() OVER (PARTITION BY outer_fold, grp ORDER BY md5((1011 + outer_fold) || ':' || entity_id), entity_id) - 1) % 3 AS inner_fold FROM t WHERE NOT held),
ns AS (SELECT t.entity_id, grp, t.outer_fold, CASE WHEN held THEN 'validation' ELSE 'training' END AS outer_role, inner_fold FROM t LEFT JOIN i ON i.entity_id = t.entity_id AND i.outer_fold = t.outer_fold)
"""


@query("nested_splits", _NESTED + "SELECT * FROM ns", ("fx_people",))
def nested_splits(spark, sf):
    return stats.nested_splits(views.people(spark, sf), "grp", 5, 3, 11)


@query("nested_split_counts", _NESTED + "SELECT outer_fold, outer_role, grp, count(*) AS n FROM ns GROUP BY 1, 2, 3", ("fx_people",))
def nested_split_counts(spark, sf):
    return stats.fold_counts(stats.nested_splits(views.people(spark, sf), "grp", 5, 3, 11), "grp")


@query("concat_folds", """
SELECT entity_id, fold, round(age * (fold + 1), 6) + 0.0 AS prediction FROM (
  SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY md5('11:' || entity_id), entity_id) - 1) % 5 AS fold FROM fx_people)
""", ("fx_people",))
def concat_folds(spark, sf):
    people = views.people(spark, sf)
    folded = stats.stratified_folds(people, "grp", 5, 11)
    parts = [folded.where(F.col("fold") == i).select("entity_id", "fold", rnd(F.col("age") * (i + 1)).alias("prediction")) for i in range(5)]
    return checks.concat_folds(parts, people, "entity_id")


@query("attach_oof", _NESTED + """
SELECT ns.entity_id, ns.outer_fold, grp, round(age * (ns.outer_fold + 1), 6) + 0.0 AS prediction FROM ns JOIN fx_people USING (entity_id, grp) WHERE outer_role = 'validation'
""", ("fx_people",))
def attach_oof(spark, sf):
    people = views.people(spark, sf)
    splits = stats.nested_splits(people, "grp", 5, 3, 11).where("outer_role = 'validation'")
    table = splits.select("entity_id", "outer_fold", "grp")
    predictions = splits.join(people.select("entity_id", "age"), "entity_id").select("entity_id", "outer_fold", rnd(F.col("age") * (F.col("outer_fold") + 1)).alias("prediction"))
    return checks.attach_oof(table, predictions, ["entity_id", "outer_fold"])


@query("representative_entity", _FITS + """,
m AS (SELECT split, median(fit_ratio) AS median FROM f GROUP BY 1)
SELECT f.split, round(max(m.median), 6) AS median, arg_min(entity_id, struct_pack(d := abs(fit_ratio - m.median), k := entity_id)) AS entity_id,
       round(arg_min(fit_ratio, struct_pack(d := abs(fit_ratio - m.median), k := entity_id)), 6) AS fit_ratio FROM f JOIN m ON m.split = f.split GROUP BY 1
""")
def representative_entity(spark, sf):
    out = stats.representative_entity(order_fits(spark, sf), "split", "fit_ratio")
    return out.select("split", rnd("median").alias("median"), "entity_id", rnd("fit_ratio").alias("fit_ratio"))


@query("sweep_ranking", """
r AS (SELECT o_orderpriority AS variant, round(avg(o_totalprice) / 100000.0, 6) AS total, round(stddev_pop(o_totalprice) / 100000.0, 6) AS spatial FROM orders GROUP BY 1)
SELECT variant, total, spatial, row_number() OVER (ORDER BY total, spatial, variant) AS rank FROM r
""")
def sweep_ranking(spark, sf):
    orders = views.table(spark, sf, "orders")
    price = F.col("o_totalprice")
    runs = {p: orders.where(F.col("o_orderpriority") == p).agg(rnd(F.avg(price) / 100000.0).alias("total"), rnd(F.stddev_pop(price) / 100000.0).alias("spatial"))
            for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
    return stats.sweep_ranking(runs, ["total", "spatial"])
