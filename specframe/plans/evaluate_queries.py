"""Queries for model comparison, gates, classification metrics, audits, and file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import checks, evaluate, features, graph, group_signal, scoring, signal, stats, tree_ensemble
from ..session import durable, stage_path
from ..sources import files, views
from ..sources.views import ALPHA
from . import jobs
from .feature_queries import letters, train_stats
from .registry import query
from .scoring_queries import FRACTIONS, LEAST_TEMPERATURE, MULTIPLIERS, TERMS, THETA, state_features
from .signal_queries import csd


def both_models(spark, sf):
    """Customers scored by both models, one column per metric and model.

    Model F is a customer's finished orders, model O the others. Where a customer has no order of a kind, the mean of the model
    stands in, and where the model has none, the mean of all its orders: every customer with an order is compared.
    """
    orders = views.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("model"),
        (F.col("o_orderpriority") < "3").alias("urgent"), (F.col("o_totalprice") / 100000.0).alias("v"))
    own = lambda m, kind=None: F.avg(F.when((F.col("model") == m) & (F.lit(True) if kind is None else F.col("urgent") == kind), F.col("v")))
    means = orders.groupBy("entity_id").agg(F.avg("v").alias("all"), *[f.alias(f"{m}_{n}") for m in "FO" for n, f in (("total", own(m)), ("spatial", own(m, True)), ("spectral", own(m, False)))])
    people = views.people(spark, sf).select("entity_id", "grp")

    def side(m):
        total = F.coalesce(f"{m}_total", "all")
        return means.join(people, "entity_id").select("entity_id", "grp", total.alias("total"), *[F.coalesce(F.col(f"{m}_{n}"), total).alias(n) for n in ("spatial", "spectral")])

    return side("F"), side("O")


_PAIRED = """
cs AS (SELECT o_custkey AS entity_id, avg(o_totalprice / 100000.0) AS al, avg(o_totalprice / 100000.0) FILTER (o_orderstatus = 'F') AS ft, avg(o_totalprice / 100000.0) FILTER (o_orderstatus <> 'F') AS ot,
         avg(o_totalprice / 100000.0) FILTER (o_orderstatus = 'F' AND o_orderpriority < '3') AS fs, avg(o_totalprice / 100000.0) FILTER (o_orderstatus <> 'F' AND o_orderpriority < '3') AS os FROM orders GROUP BY 1),
pr AS (SELECT entity_id, grp, coalesce(ft, al) AS rt, coalesce(ot, al) AS ct, coalesce(fs, ft, al) AS rs, coalesce(os, ot, al) AS cs FROM cs JOIN fx_people USING (entity_id))
"""


@query("align_models", _PAIRED + """
SELECT entity_id, grp, round(rt, 11) AS reference_total, round(ct, 11) AS candidate_total, round(rs, 11) AS reference_spatial, round(cs, 11) AS candidate_spatial FROM pr
""", ("fx_people",))
def align_models(spark, sf):
    out = checks.align_models(*both_models(spark, sf), "entity_id", "grp", ["total", "spatial"])
    return out.select(*[rnd(c, 11).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("paired_bootstrap", _PAIRED + """,
d AS (SELECT entity_id, ct - rt AS total, cs - rs AS spatial, row_number() OVER (ORDER BY md5('5:' || entity_id), entity_id) - 1 AS j, count(*) OVER () AS n FROM pr),
s AS (SELECT b.b, CAST(('0x' || substr(md5('5:' || b.b || ':all:' || j), 1, 15)) AS BIGINT) % n AS j FROM d CROSS JOIN (SELECT unnest(range(1000)) AS b) b),
m AS (SELECT b, median(total) AS total, median(spatial) AS spatial FROM s JOIN d ON d.j = s.j GROUP BY 1)
SELECT 'total' AS metric, (SELECT round(median(total), 6) FROM d) AS median_difference, round(quantile_cont(total, 0.025), 6) AS low, round(quantile_cont(total, 0.975), 6) AS high, (SELECT round(avg(CASE WHEN total < 0 THEN 1.0 ELSE 0.0 END), 6) FROM d) AS share_improved FROM m
UNION ALL SELECT 'spatial', (SELECT round(median(spatial), 6) FROM d), round(quantile_cont(spatial, 0.025), 6), round(quantile_cont(spatial, 0.975), 6), (SELECT round(avg(CASE WHEN spatial < 0 THEN 1.0 ELSE 0.0 END), 6) FROM d) FROM m
""", ("fx_people",))
def paired_bootstrap(spark, sf):
    paired = checks.align_models(*both_models(spark, sf), "entity_id", "grp", ["total", "spatial"])
    out = evaluate.paired_bootstrap(paired, ["total", "spatial"], 1000, 5)
    return out.select("metric", *[rnd(c).alias(c) for c in out.columns[1:]])


_DRAWS = """
en AS (SELECT DISTINCT entity_id, grp FROM {source}),
ix AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('{seed}:' || entity_id), entity_id) - 1 AS j, count(*) OVER (PARTITION BY grp) AS n FROM en),
sl AS (SELECT b.b, grp, CAST(('0x' || substr(md5('{seed}:' || b.b || ':' || grp || ':' || j), 1, 15)) AS BIGINT) % n AS j FROM ix CROSS JOIN (SELECT unnest(range({samples})) AS b) b),
ht AS (SELECT s.b, x.entity_id, x.grp, x.n, count(*) AS hits FROM sl s JOIN ix x ON x.grp = s.grp AND x.j = s.j GROUP BY 1, 2, 3, 4)
"""


@query("effect_bootstrap", _DRAWS.format(source="fx_blocks", seed=9, samples=1000) + """,
v AS (SELECT entity_id, block, coord, max(value) FILTER (segment = 'validation') AS o, max(value) FILTER (segment = 'fit') AS r, max(value) FILTER (segment = 'rel_a') AS c FROM fx_blocks GROUP BY 1, 2, 3),
wt AS (SELECT b, entity_id, hits * CASE WHEN grp = 'q1' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / n AS w FROM ht UNION ALL SELECT 1000, entity_id, CASE WHEN grp = 'q1' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / n FROM ix),
ef AS (SELECT b, block, coord, sum(w * o) AS o, sum(w * r) AS r, sum(w * c) AS c FROM wt JOIN v ON v.entity_id = wt.entity_id GROUP BY 1, 2, 3),
st AS (SELECT b, block, corr(o, r) AS rr, corr(o, c) AS rc, sqrt(sum(r * r)) / sqrt(sum(o * o)) AS nr, sqrt(sum(c * c)) / sqrt(sum(o * o)) AS nc FROM ef GROUP BY 1, 2)
SELECT block, round(max(rr) FILTER (b = 1000), 6) AS reference_correlation, round(max(rc) FILTER (b = 1000), 6) AS candidate_correlation, round(max(nr) FILTER (b = 1000), 6) AS reference_norm, round(max(nc) FILTER (b = 1000), 6) AS candidate_norm,
  round(max(rc - rr) FILTER (b = 1000), 6) AS correlation_difference, round(quantile_cont(rc - rr, 0.025) FILTER (b < 1000), 6) AS correlation_low, round(quantile_cont(rc - rr, 0.975) FILTER (b < 1000), 6) AS correlation_high,
  round(max(nc - nr) FILTER (b = 1000), 6) AS norm_difference, round(quantile_cont(nc - nr, 0.025) FILTER (b < 1000), 6) AS norm_low, round(quantile_cont(nc - nr, 0.975) FILTER (b < 1000), 6) AS norm_high FROM st GROUP BY 1
""", ("fx_blocks",))
def effect_bootstrap(spark, sf):
    data = letters(spark, sf)
    tables = {n: data.where(F.col("segment") == s) for n, s in (("observed", "validation"), ("reference", "fit"), ("candidate", "rel_a"))}
    out = evaluate.effect_bootstrap(tables, "q0", "q1", 1000, 9)
    return out.select("block", *[rnd(c).alias(c) for c in out.columns[1:]])


@query("parameter_effects", """
pp AS (SELECT entity_id, grp, age, sex FROM fx_people WHERE grp IN ('BUILDING', 'MACHINERY')), """ + _DRAWS.format(source="pp", seed=3, samples=1000) + """,
u AS (SELECT entity_id, grp, 'age' AS parameter, age AS v FROM pp UNION ALL SELECT entity_id, grp, 'sex', sex FROM pp),
p AS (SELECT parameter, avg(v) FILTER (grp = 'MACHINERY') - avg(v) FILTER (grp = 'BUILDING') AS d, var_samp(v) FILTER (grp = 'BUILDING') AS v0, var_samp(v) FILTER (grp = 'MACHINERY') AS v1, count(*) FILTER (grp = 'BUILDING') AS n0, count(*) FILTER (grp = 'MACHINERY') AS n1 FROM u GROUP BY 1),
x AS (SELECT h.b, u.parameter, u.grp, u.v FROM ht h JOIN u ON u.entity_id = h.entity_id CROSS JOIN LATERAL (SELECT unnest(range(h.hits)) AS i) r),
q AS (SELECT b, parameter, avg(v) FILTER (grp = 'MACHINERY') - avg(v) FILTER (grp = 'BUILDING') AS d, var_samp(v) FILTER (grp = 'BUILDING') AS v0, var_samp(v) FILTER (grp = 'MACHINERY') AS v1, count(*) FILTER (grp = 'BUILDING') AS n0, count(*) FILTER (grp = 'MACHINERY') AS n1 FROM x GROUP BY 1, 2),
c AS (SELECT parameter, quantile_cont(d / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 0.025) AS lo, quantile_cont(d / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 0.975) AS hi FROM q GROUP BY 1)
SELECT parameter, n0 AS n_first, n1 AS n_second, round(d, 6) AS difference, round(d / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) AS standardized, round(lo, 6) AS low, round(hi, 6) AS high,
  CASE parameter WHEN 'age' THEN 0.62 ELSE 0.41 END::DOUBLE AS recovery, 0.5::DOUBLE AS recovery_threshold, parameter = 'age' AS passes_recovery FROM p JOIN c USING (parameter)
""", ("fx_people",))
def parameter_effects(spark, sf):
    out = evaluate.parameter_effects(views.people(spark, sf), ["age", "sex"], "BUILDING", "MACHINERY", {"age": 0.62, "sex": 0.41}, {"age": 0.5, "sex": 0.5}, 1000, 3)
    exact = ("recovery", "recovery_threshold")
    return out.select(*[rnd(c).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in out.dtypes])


_GATES = [("total_below_null", "total", "<", 1.0), ("majority_beat_null", "share", ">", 0.5), ("spatial_below_null", "spatial", "<", 1.0),
          ("effect_preserved", "correlation", ">=", 0.3), ("parameters_recoverable", "absent", ">=", 3.0)]


@query("acceptance_gates", _PAIRED + """,
m AS (SELECT round(median(ct / rt), 6) AS total, round(avg(CASE WHEN ct < rt THEN 1.0 ELSE 0.0 END), 6) AS share, round(median(cs / rs), 6) AS spatial, round(corr(ct, rt), 6) AS correlation FROM pr),
g AS (SELECT 'total_below_null' AS "check", total AS observed, 1.0::DOUBLE AS threshold, total < 1.0 AS passed FROM m UNION ALL SELECT 'majority_beat_null', share, 0.5, share > 0.5 FROM m
  UNION ALL SELECT 'spatial_below_null', spatial, 1.0, spatial < 1.0 FROM m UNION ALL SELECT 'effect_preserved', correlation, 0.3, correlation >= 0.3 FROM m UNION ALL SELECT 'parameters_recoverable', NULL, 3.0, false)
SELECT "check", observed, threshold, passed, CASE WHEN bool_and(passed) OVER () THEN 'accepted' ELSE 'not_accepted' END AS status FROM g
""", ("fx_people",))
def acceptance_gates(spark, sf):
    from ..functions.expr import correlation
    from ..functions.quantiles import exact_quantiles

    paired = checks.align_models(*both_models(spark, sf), "entity_id", "grp", ["total", "spatial"]).withColumn("k", F.lit(0))
    paired = paired.withColumn("t", F.col("candidate_total") / F.col("reference_total")).withColumn("s", F.col("candidate_spatial") / F.col("reference_spatial"))
    medians = exact_quantiles(paired, ["k"], {"t": [(0.5, "total")], "s": [(0.5, "spatial")]})
    others = paired.groupBy("k").agg(F.avg((F.col("candidate_total") < F.col("reference_total")).cast("double")).alias("share"),
                                     correlation(F.col("candidate_total"), F.col("reference_total")).alias("correlation"))
    row = medians.join(others, "k")
    metrics = stats.unpivot(row.select(*[rnd(c).alias(c) for c in ("total", "share", "spatial", "correlation")]), [], ["total", "share", "spatial", "correlation"], "name")
    return evaluate.acceptance_gates(metrics, _GATES)


@query("lexicographic_select", """
m AS (SELECT p_brand AS model, avg(p_size) > 24 AS eligible, round(avg(p_retailprice) / 1500.0, 8) AS total, round(avg(p_size) / 25.0, 8) AS topography, round(stddev_pop(p_size) / 14.5, 8) AS connectivity, count(*) AS complexity FROM part GROUP BY 1)
SELECT model, total, topography, connectivity, complexity FROM m WHERE eligible AND total < 1
ORDER BY (topography < 1 AND connectivity < 1) DESC, greatest(topography, connectivity), total, complexity, model LIMIT 1
""")
def lexicographic_select(spark, sf):
    part = views.table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(
        (F.avg("p_size") > 24).alias("eligible"), rnd(F.avg("p_retailprice") / 1500.0, 8).alias("total"), rnd(F.avg("p_size") / 25.0, 8).alias("topography"),
        rnd(F.stddev_pop("p_size") / 14.5, 8).alias("connectivity"), F.count(F.lit(1)).alias("complexity"))
    return evaluate.lexicographic_select(part).select("model", "total", "topography", "connectivity", "complexity")


@query("binary_metrics", """
s AS (SELECT round(1 / (1 + exp(-(l_quantity - 25) / 10.0)), 8) AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
c AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cn FROM c)
SELECT round((SELECT CAST(sum(p * (cn - n * 0.5)) AS DOUBLE) / CAST(sum(p) * sum(n) AS DOUBLE) FROM r), 6) AS roc_auc,
  round((avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (label = 1) + avg(CASE WHEN score >= 0.5 THEN 0.0 ELSE 1.0 END) FILTER (label = 0)) / 2, 6) AS balanced_accuracy, round(avg((score - label) ** 2), 6) AS brier FROM s
""")
def binary_metrics(spark, sf):
    line = views.table(spark, sf, "lineitem")
    scores = line.select(rnd(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("l_quantity") - 25) / 10.0)), 8).alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    out = evaluate.binary_metrics(scores)
    return out.select(*[rnd(c).alias(c) for c in out.columns])


def _labelled_arrays(spark, sf, segment):
    """Letter rates of one half, the quality label, and two covariates: log length and whether the text is English."""
    data = letters(spark, sf).where(F.col("segment") == segment)
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"), F.array(F.ln(F.length("text") + 1.0), (F.col("lang") == "en").cast("double")).alias("z"))
    packed = features.pack(data.drop("block"), ["entity_id", "grp"], "x").join(docs, "entity_id")
    return packed.select("entity_id", F.when(F.col("grp") == "q1", 1).otherwise(0).alias("label"), "x", "z")


# Numbers of selected features and regularisation strengths that are tried.
TOP_K, STRENGTHS = [30, 120, group_signal.ALL], [0.03, 0.3, 3.0]


def _group_signal(spark, sf):
    """Three repeats of five outer and three inner folds over the whole grid, as they are and with covariates removed."""
    fit, unseen = durable(_labelled_arrays(spark, sf, "fit")), durable(_labelled_arrays(spark, sf, "validation"))
    return {name: group_signal.cv_group_signal(fit, unseen, 3, 5, 3, TOP_K, STRENGTHS, 1, adjust=adjust) for name, adjust in (("none", False), ("covariates", True))}


@query("cv_group_signal")
def cv_group_signal(spark, sf):
    parts = [df.select(F.lit(name).alias("adjustment"), "repeat", *[rnd(c, 4).alias(c) for c in ("roc_auc", "balanced_accuracy", "brier")]) for name, df in _group_signal(spark, sf).items()]
    return parts[0].unionByName(parts[1])


def _learnability(spark, sf):
    """Every parameter of the bank from its profiles: five folds of 300 trees."""
    packed = features.pack(stats.replicate_mean(views.bank(spark, sf), 2), ["candidate_id"], "x")
    return tree_ensemble.learnability(packed, views.bank_params(spark, sf), THETA, 5, 1, 300)


@query("learnability")
def learnability(spark, sf):
    return _learnability(spark, sf).select("parameter", rnd("r2", 4).alias("r2"), rnd("nrmse", 4).alias("nrmse"))


def _nations(spark, sf):
    """Keys of the nation dimension, in order."""
    return sorted(r["n_nationkey"] for r in views.table(spark, sf, "nation").select("n_nationkey").collect())


def _profiles(spark, sf):
    """profiles(entity_id, grp, segment, sensor, value): share of a customer's spending by nation of the supplier, early and late.

    Every customer with an order has both segments; one without spending in a segment is level over the nations there.
    """
    keys = _nations(spark, sf)
    orders, line, supplier = (views.table(spark, sf, t) for t in ("orders", "lineitem", "supplier"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("o_custkey").alias("entity_id"), "s_nationkey", (F.year("o_orderdate") < 1998).alias("early"), "l_extendedprice")

    def spent(early, key):
        return F.sum(F.when((F.col("early") == early) & (F.col("s_nationkey") == key), F.col("l_extendedprice")).otherwise(0.0)) / 100000.0 + 0.1

    sides = (("fit", True), ("validation", False))
    sums = rows.groupBy("entity_id").agg(*[spent(early, k).alias(f"{name}{k}") for name, early in sides for k in keys])
    cells = [F.struct(F.lit(name).alias("segment"), F.lit(f"NATION_{k}").alias("sensor"),
                      (F.col(f"{name}{k}") / (sum((F.col(f"{name}{j}") for j in keys), F.lit(0.0)) / float(len(keys)))).alias("value")) for name, _ in sides for k in keys]
    tall = sums.select("entity_id", F.explode(F.array(*cells)).alias("c")).select("entity_id", "c.*")
    return tall.join(views.people(spark, sf).select("entity_id", "grp"), "entity_id")


@query("nonneg_profile_fit")
def nonneg_profile_fit(spark, sf):
    profiles = _profiles(spark, sf)
    basis = graph.power_basis(views.sensor_gain(spark, sf), views.block_nodes(spark, sf))
    pooled = {r["sensor"]: r["v"] for r in profiles.where("segment = 'fit'").groupBy("sensor").agg(F.avg("value").alias("v")).collect()}
    out = evaluate.nonneg_profile_fit(basis, profiles, pooled)
    return out.select("entity_id", *[rnd(c).alias(c) for c in ("rmse", "null_rmse", "ratio")])


@query("network_topography")
def network_topography(spark, sf):
    topography = _profiles(spark, sf).where("segment = 'fit'").withColumn("value", F.ln("value"))
    out = evaluate.network_topography(views.sensor_gain(spark, sf), views.block_nodes(spark, sf), topography, "BUILDING", "MACHINERY")
    return out.withColumn("value", rnd("value"))


# --- multi-stage jobs ------------------------------------------------------------------------------


def _segment_csd(spark, sf):
    samples = views.samples(spark, sf).drop("grp")
    lengths = durable(signal.recording_lengths(samples))
    return csd(spark, sf, "arrow", signal.temporal_segments(samples, lengths), signal.segment_lengths(lengths))


@query("fit_transform")
def fit_transform(spark, sf):
    source = durable(_segment_csd(spark, sf))
    train = source.select("recording_id").distinct()
    _, transform = jobs.fit_transform(source, train, 3, "lagged", 0.05, (F.col("freq") <= 2.0) | (F.col("freq") >= 8.0), ALPHA, 0.2,
                                      {"auto": 8, "cross": 8, "topography": 4}, 4)
    return transform.select("block", "coord", *[rnd(c).alias(c) for c in ("mean", "scale", "r")], "out_coord")


# Reliability threshold, most coordinates per block, and fewest: refitted in every fold.
_SELECTION = (0.2, {"vowel": 4, "consonant": 14}, 3)


@query("nested_evaluation", f"""
fo AS (SELECT entity_id, grp, (row_number() OVER (PARTITION BY grp ORDER BY md5('17:' || entity_id), entity_id) - 1) % 5 AS fold FROM fx_entities),
b AS (SELECT x.*, fold, outer_fold FROM fx_blocks x JOIN fo USING (entity_id) CROSS JOIN (SELECT unnest(range(5)) AS outer_fold)),
st AS (SELECT outer_fold, block, coord, avg(value) AS mean, stddev_samp(value) AS sd FROM b WHERE segment = 'fit' AND fold <> outer_fold GROUP BY 1, 2, 3),
sc AS (SELECT outer_fold, block, coord, mean, CASE WHEN sd > f THEN sd ELSE f END AS scale FROM (SELECT *, coalesce(quantile_cont(CASE WHEN sd > 0 THEN sd END, 0.1) OVER (PARTITION BY outer_fold, block) * 0.1, 1.0) AS f FROM st)),
re AS (SELECT x.outer_fold, x.block, x.coord, CASE WHEN stddev_pop(x.value) > 0 AND stddev_pop(y.value) > 0 THEN corr(x.value, y.value) ELSE -1e999 END AS r
  FROM b x JOIN b y ON x.entity_id = y.entity_id AND x.coord = y.coord AND x.outer_fold = y.outer_fold AND x.segment = 'rel_a' AND y.segment = 'rel_b' WHERE x.fold <> x.outer_fold GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY outer_fold, block ORDER BY r DESC, coord) AS rank, count(*) FILTER (r >= {_SELECTION[0]}) OVER (PARTITION BY outer_fold, block) AS ok,
  CASE block WHEN 'vowel' THEN {_SELECTION[1]["vowel"]} ELSE {_SELECTION[1]["consonant"]} END AS most FROM re),
ke AS (SELECT outer_fold, block, coord, count(*) OVER (PARTITION BY outer_fold, block) AS d FROM rk WHERE rank <= CASE WHEN least(ok, most) >= {_SELECTION[2]} THEN least(ok, most) ELSE {_SELECTION[2]} END),
w AS (SELECT outer_fold, coord, mean, CASE block WHEN 'vowel' THEN 5.0 / 26.0 ELSE 21.0 / 26.0 END / d / (scale * scale) AS w FROM sc JOIN ke USING (outer_fold, block, coord)),
u AS (SELECT entity_id, grp, fold, coord, max(value) FILTER (segment = 'fit') AS fit, max(value) FILTER (segment = 'validation') AS unseen FROM b WHERE outer_fold = 0 GROUP BY ALL),
bm AS (SELECT candidate_id, coord, avg(value) AS f, var_pop(value) AS v FROM fx_bank GROUP BY 1, 2),
ds AS (SELECT outer_fold, entity_id, sum(w * (fit - unseen) ** 2) AS d FROM u JOIN w USING (coord) WHERE fold <> outer_fold GROUP BY 1, 2),
tr AS (SELECT outer_fold, greatest({LEAST_TEMPERATURE}, median(d) * m) AS t FROM ds CROSS JOIN (VALUES {", ".join(f"({m}::DOUBLE)" for m in MULTIPLIERS)}) m(m) GROUP BY outer_fold, m),
pc AS (SELECT outer_fold, entity_id, fold, candidate_id, sum(w * ((fit - f) ** 2 + v)) + any_value(prior) AS c FROM u JOIN w USING (coord) JOIN bm USING (coord) JOIN fx_prior USING (candidate_id) GROUP BY 1, 2, 3, 4),
ps AS (SELECT outer_fold, entity_id, fold, candidate_id, t, exp(l - max(l) OVER (PARTITION BY outer_fold, entity_id, t)) AS e FROM (SELECT pc.*, t, -0.5 * c / t AS l FROM pc JOIN tr USING (outer_fold))),
pr AS (SELECT outer_fold, entity_id, fold, t, coord, sum(e * f) / sum(e) AS p FROM ps JOIN bm USING (candidate_id) GROUP BY 1, 2, 3, 4, 5),
co AS (SELECT outer_fold, entity_id, grp, pr.fold, t, sum(w * (p - unseen) ** 2) AS uc, sum(w * (mean - unseen) ** 2) AS nc FROM pr JOIN w USING (outer_fold, coord) JOIN u USING (entity_id, coord) GROUP BY 1, 2, 3, 4, 5),
md AS (SELECT outer_fold, t, median(uc / nc) AS md, avg(uc / nc) AS mn FROM co WHERE fold <> outer_fold GROUP BY 1, 2),
ch AS (SELECT outer_fold, arg_min(t, struct_pack(md := md, mn := mn, t := t)) AS t FROM md GROUP BY 1)
SELECT entity_id, grp, CAST(outer_fold AS INTEGER) AS outer_fold, round(uc, 6) AS unseen_cost, round(nc, 6) AS pooled_unseen_cost, round(uc / nc, 6) AS unseen_ratio, round(t, 6) AS temperature
FROM co JOIN ch USING (outer_fold, t) WHERE fold = outer_fold""", ("fx_blocks", "fx_entities", "fx_bank", "fx_prior"))
def nested_evaluation(spark, sf):
    """Five outer folds and eight temperatures; scaling, selection, temperature and pooled mean are refitted without each fold."""
    raw = letters(spark, sf).drop("split")
    folds = stats.stratified_folds(views.entities(spark, sf).select("entity_id", "grp"), "grp", 5, 17)
    from .feature_queries import blocks

    bank = blocks(views.bank(spark, sf)).withColumn("state_id", F.col("candidate_id"))
    params = durable(views.bank_params(spark, sf))
    out = jobs.nested_evaluation(raw, bank, params, THETA, scoring.prior_cost(params, TERMS), folds, 5, MULTIPLIERS, {"vowel": 5.0 / 26.0, "consonant": 21.0 / 26.0}, _SELECTION, LEAST_TEMPERATURE)
    return out.select("entity_id", "grp", "outer_fold", *[rnd(c).alias(c) for c in ("unseen_cost", "pooled_unseen_cost", "unseen_ratio", "temperature")])


@query("feature_audit")
def feature_audit(spark, sf):
    data = letters(spark, sf)
    stat = train_stats(data)
    scaled = features.apply_standardize(data, stat)
    bank = stats.replicate_mean(state_features(spark, sf, stat).where(F.col("fraction") == FRACTIONS[0]).drop("fraction", "state_id"), 2)
    out = jobs.feature_audit(*[scaled.where(F.col("segment") == s).drop("segment", "split") for s in ("fit", "validation")], bank,
                             scaled.where("segment = 'rel_a'").drop("segment", "split"), "q0", "q1", {"vowel": 0.3, "consonant": 0.4}, _group_signal(spark, sf), _learnability(spark, sf))
    return out.withColumn("value", rnd("value"))


# --- files -------------------------------------------------------------------------------------------


_LISTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("discover_files", "\nUNION ALL ".join(f"SELECT '{t}' AS entity_id, count(*) AS n FROM {t}" for t in _LISTED))
def discover_files(spark, sf):
    """Every table of the folder is discovered, and its rows are read and counted."""
    root, group = sf.rstrip("/").rsplit("/", 1)
    found = files.discover_files(spark, root, [group], "*.parquet")
    counted = [views.table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("entity_id"), "n") for t in _LISTED]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    known = found.select(F.regexp_extract("path", r"/(\w+)\.parquet", 1).alias("entity_id")).distinct()
    return out.join(known, "entity_id", "left_semi")


@query("artifact_manifest")
def artifact_manifest(spark, sf):
    return files.artifact_manifest(spark, sf.rstrip("/"))


@query("read_dense_matrix", """
m AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(v AS DOUBLE) AS value FROM m
""")
def read_dense_matrix(spark, sf):
    """Nation trade counts written as matrix text, then read back as edges."""
    line, orders, customer, supplier = (views.table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    counts = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    keys = _nations(spark, sf)
    rows = counts.groupBy("c_nationkey").agg(*[F.count_if(F.col("s_nationkey") == i).cast("string").alias(f"n{i}") for i in keys])
    path = stage_path(spark, "matrix")
    rows.orderBy("c_nationkey").select(F.concat_ws(" ", *[f"n{i}" for i in keys]).alias("value")).write.text(path)
    return files.read_dense_matrix(spark, path, len(keys))


@query("collection_store", """
SELECT entity_id, segment, coord, round(value, 12) AS value, 'none' AS reference FROM fx_letter_segments
""", ("fx_letter_segments",))
def collection_store(spark, sf):
    path = stage_path(spark, "collection")
    files.write_collection(views.letter_segments(spark, sf), path)
    return files.read_collection(spark, path, {"reference": "none"}).select("entity_id", "segment", "coord", rnd("value", 12).alias("value"), "reference")


@query("write_reports", """
SELECT o_orderpriority AS split, count(*) AS n, round(avg(o_totalprice) / 1000.0, 6) AS mean FROM orders GROUP BY 1
""")
def write_reports(spark, sf):
    table = views.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("split")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice") / 1000.0).alias("mean"))
    csv, document = stage_path(spark, "report"), stage_path(spark, "summary")
    files.write_table(table, csv)
    files.write_json(table.agg(F.sum("n").alias("rows"), F.collect_set("split").alias("splits")), document)
    return spark.read.csv(csv, header=True, schema="split string, n bigint, mean double")
