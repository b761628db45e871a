"""Scoring against dense NumPy computations; chunked banks give the same answers as one chunk."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specframe.functions.expr import correlation
from specframe.operators import evaluate, features, group_signal, scoring, stats, tiled

RNG = np.random.default_rng(31)
N, S, R, D, P = 17, 24, 2, 5, 3
Y, U = RNG.normal(size=(N, D)), RNG.normal(size=(N, D))
STATES = RNG.normal(size=(S, R, D))
THETA = RNG.normal(size=(S // 2, P))
PRIOR = 0.1 * np.abs(RNG.normal(size=S // 2))
T = 0.7


def data(spark):
    rows = [(i, s, d, float(v[i, d])) for i in range(N) for s, v in (("fit", Y), ("validation", U)) for d in range(D)]
    entities = spark.createDataFrame(rows, "entity_id bigint, segment string, coord bigint, value double")
    cells = [(f"s{k:03d}", f"c{k // 2:02d}", r, d, float(STATES[k, r, d])) for k in range(S) for r in range(R) for d in range(D)]
    states = spark.createDataFrame(cells, "state_id string, candidate_id string, replicate bigint, coord bigint, value double")
    params = spark.createDataFrame([(f"c{c:02d}", *[float(x) for x in THETA[c]], float(PRIOR[c])) for c in range(S // 2)], "candidate_id string, a double, b double, c double, prior double")
    return entities, states, params


def dense():
    cost = ((STATES[None] - Y[:, None, None, :]) ** 2).sum(axis=3).mean(axis=2)
    logit = -0.5 * (cost + PRIOR[np.arange(S) // 2]) / T
    w = np.exp(logit - logit.max(axis=1, keepdims=True))
    return cost, w / w.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("method,limit", [("long", None), ("arrow", None), ("arrow", 400)])
def test_pairwise_cost(spark, method, limit):
    entities, states, _ = data(spark)
    got = scoring.pairwise_cost(entities.where("segment = 'fit'").drop("segment"), states, method, limit).toPandas()
    assert len(got) == N * S
    assert got.pivot(index="entity_id", columns="state_id", values="cost").to_numpy() == pytest.approx(dense()[0])


@pytest.mark.parametrize("limit", [None, 500])
def test_posterior_pass(spark, limit):
    """A limit of 500 bytes splits the bank into several chunks, whose partial sums must merge exactly."""
    entities, states, params = data(spark)
    packed = scoring.pack_entities(entities, {"fit": "fit", "validation": "unseen"})
    bank = scoring.pack_states(states, params, ["a", "b", "c"]).join(params.select("candidate_id", "prior"), "candidate_id")
    if limit:
        assert tiled.bank_side(bank, ["prior"], limit).count > 2
    passed = scoring.posterior_pass(packed, bank, [("v", T, "prior")], 4, limit)
    cost, w = dense()
    mean, theta = STATES.mean(axis=1), THETA[np.arange(S) // 2]
    got = scoring.posterior_summary(passed, ["a", "b", "c"]).toPandas().sort_values("entity_id")
    assert got[["a_mean", "b_mean", "c_mean"]].to_numpy() == pytest.approx(w @ theta)
    assert got.map_probability.to_numpy() == pytest.approx(w.max(axis=1))
    assert list(got.map_state) == [f"s{k:03d}" for k in w.argmax(axis=1)]
    assert got.ess_states.to_numpy() == pytest.approx(1 / (w ** 2).sum(axis=1))
    by_candidate = w.reshape(N, S // 2, 2).sum(axis=2)
    assert got.ess_candidates.to_numpy() == pytest.approx(1 / (by_candidate ** 2).sum(axis=1))
    top = scoring.posterior_top(passed).toPandas()
    for i, part in top.groupby("entity_id"):
        assert list(part.sort_values("rank").weight) == pytest.approx(sorted(w[i], reverse=True)[:4])
    costs = scoring.predictive_costs(passed, packed, [0.1] * D).toPandas().sort_values("entity_id")
    assert costs.unseen_cost.to_numpy() == pytest.approx(((w @ mean - U) ** 2).sum(axis=1))
    assert costs.map_unseen_cost.to_numpy() == pytest.approx(((mean[w.argmax(axis=1)] - U) ** 2).sum(axis=1))
    assert costs.oracle_unseen_cost.to_numpy() == pytest.approx(((mean[None] - U[:, None]) ** 2).sum(axis=2).min(axis=1))
    for column, name in enumerate("abc"):  # the same quantiles whatever the number of chunks
        order = np.argsort(theta[:, column], kind="stable")
        for share, suffix in ((0.05, "q05"), (0.95, "q95")):
            want = [np.interp(share, np.cumsum(w[i][order]), theta[order, column]) for i in range(N)]
            assert got[f"{name}_{suffix}"].to_numpy() == pytest.approx(np.array(want))


def test_nearest_pass_in_chunks_and_prior(spark):
    _, states, params = data(spark)
    first = states.where("state_id LIKE '%0' OR state_id LIKE '%2' OR state_id LIKE '%4' OR state_id LIKE '%6' OR state_id LIKE '%8'")
    bank = scoring.pack_states(first, params, ["a", "b", "c"])
    mean = STATES[::2].mean(axis=1)
    d = ((mean[:, None] - mean[None]) ** 2).sum(axis=2) + np.where(np.eye(S // 2), np.inf, 0)
    got = scoring.nearest_other(bank).toPandas().sort_values("id")
    assert list(got.nn_id) == [f"c{k:02d}" for k in d.argmin(axis=1)]
    assert got.rmse.to_numpy() == pytest.approx(np.sqrt(((THETA[d.argmin(axis=1)] - THETA) ** 2).mean(axis=1)))
    entities = spark.createDataFrame([(i, [float(v) for v in Y[i]]) for i in range(N)], "entity_id bigint, fit array<double>")
    spread = STATES[::2].var(axis=1).sum(axis=1)
    total = ((mean[None] - Y[:, None]) ** 2).sum(axis=2) + spread + 0.5 * ((THETA - THETA[2]) ** 2).mean(axis=1)
    center = [float(v) for v in THETA[2]]
    for limit in (None, 300):
        placed = entities.withColumn("center", F.array(*[F.lit(v) for v in center]))
        out = scoring.nearest_pass(placed, bank, 0.5, limit=limit).toPandas().sort_values("entity_id")
        assert list(out.candidate_id) == [f"c{k:02d}" for k in total.argmin(axis=1)] and out.total.to_numpy() == pytest.approx(total.min(axis=1))


def test_compact_mixture_equals_dense_mixture(spark):
    """Posterior cross-spectra from three weighted sums equal the average of explicitly built states."""
    w = RNG.random(6)
    w /= w.sum()
    base, diag, power = RNG.normal(size=(3, 4, 3)), RNG.random((6, 4)), RNG.random((6, 4))
    pairs, cov = [("a", "a"), ("a", "b"), ("b", "b")], np.array([1.2, 0.3, 0.8])
    posterior = spark.createDataFrame([(1, f"s{s}", float(w[s])) for s in range(6)], "entity_id int, state_id string, weight double")
    states = spark.createDataFrame([(f"s{s}", f"c{s // 2}") for s in range(6)], "state_id string, candidate_id string")
    bank = spark.createDataFrame([(f"c{c}", float(f), i, j, float(base[c, f, k]), 0.5) for c in range(3) for f in range(4) for k, (i, j) in enumerate(pairs)],
                                 "candidate_id string, freq double, ch_i string, ch_j string, re double, im double")
    increments = spark.createDataFrame([(f"s{s}", float(f), float(diag[s, f]), float(power[s, f])) for s in range(6) for f in range(4)], "state_id string, freq double, diag_increment double, source_power double")
    covariance = spark.createDataFrame([(i, j, float(cov[k])) for k, (i, j) in enumerate(pairs)], "ch_i string, ch_j string, cov double")
    got = {(r["freq"], r["ch_i"], r["ch_j"]): r["re"] for r in scoring.predictive_csd(posterior, states, bank, increments, covariance).collect()}
    for f in range(4):
        for k, (i, j) in enumerate(pairs):
            want = sum(w[s] * (base[s // 2, f, k] + power[s, f] * cov[k] + (diag[s, f] if i == j else 0)) for s in range(6))
            assert got[(float(f), i, j)] == pytest.approx(want)


def test_correlation_on_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    row = df.agg(correlation(F.col("x"), F.col("y")).alias("a"), correlation(F.col("x"), F.col("y"), 0.0).alias("b"), correlation(F.col("x"), F.col("y"), float("-inf")).alias("c")).first()
    assert row["a"] is None and row["b"] == 0.0 and row["c"] == float("-inf")


def test_fitted_scaling_ignores_labels(spark):
    rows = [(e, "x" if e % 2 else "y", "b", c, float(RNG.normal())) for e in range(30) for c in range(4)]
    df = spark.createDataFrame(rows, "entity_id int, grp string, block string, coord int, value double")
    a, b = (features.robust_standardize(d).toPandas().sort_values("coord").reset_index(drop=True) for d in (df, df.withColumn("grp", F.lit("z"))))
    assert a.equals(b)


def test_pca_matches_svd(spark):
    x = RNG.normal(size=(40, 6)) @ RNG.normal(size=(6, 6))
    x = x - x.mean(axis=0)
    df = spark.createDataFrame([(e, "b", c, float(x[e, c])) for e in range(40) for c in range(6)], "entity_id int, block string, coord int, value double")
    _, scores = features.pca_scores(df, 3)
    got = scores.toPandas().pivot(index="entity_id", columns="coord", values="value").to_numpy()
    right = np.linalg.svd(x, full_matrices=False)[2][:3]
    assert np.abs(got) == pytest.approx(np.abs(x @ right.T), abs=1e-8)


def test_nonnegative_fit_is_exact(spark):
    """A profile proportional to a basis column gives error 0; a mixed one matches a direct search."""
    basis = np.array([[2.0, 0.2], [0.5, 1.0], [0.5, 1.8]])
    table = spark.createDataFrame([(f"s{i}", f"b{j}", float(basis[i, j])) for i in range(3) for j in range(2)], "sensor string, block string, value double")
    exact, other = basis[:, 0] / basis[:, 0].mean(), np.array([0.3, 2.4, 0.3])
    rows = [(e, seg, f"s{i}", float(v[i])) for e, v in ((1, exact), (2, other)) for seg in ("fit", "validation") for i in range(3)]
    got = {r["entity_id"]: r for r in evaluate.nonneg_profile_fit(table, spark.createDataFrame(rows, "entity_id int, segment string, sensor string, value double"), {f"s{i}": 1.0 for i in range(3)}).collect()}
    assert got[1]["rmse"] == pytest.approx(0.0, abs=1e-9) and got[2]["rmse"] > 0.5
    design = np.column_stack([basis, np.ones(3)])
    grid = np.stack(np.meshgrid(*[np.linspace(0, 2, 41)] * 3), -1).reshape(-1, 3)
    best = grid[((grid @ design.T - other) ** 2).sum(axis=1).argmin()]
    fitted = design @ best
    assert got[2]["rmse"] == pytest.approx(np.sqrt(((fitted / fitted.mean() - other) ** 2).mean()), abs=0.03)


def test_effect_bootstrap_point_values(spark):
    rows = [(e, "p" if e < 10 else "q", "b", c, float(RNG.normal() + (e >= 10) * c)) for e in range(25) for c in range(6)]
    obs = spark.createDataFrame(rows, "entity_id int, grp string, block string, coord int, value double")
    same, half = obs, obs.withColumn("value", F.col("value") * 0.5)
    row = evaluate.effect_bootstrap({"observed": obs, "reference": half, "candidate": same}, "p", "q", 12, 3).first()
    assert row["reference_correlation"] == pytest.approx(1.0) and row["reference_norm"] == pytest.approx(0.5) and row["candidate_norm"] == pytest.approx(1.0)
    assert row["norm_low"] == pytest.approx(0.5) and row["norm_high"] == pytest.approx(0.5)


def test_hedges_g_value(spark):
    a, b = np.array([1.0, 2.0, 4.0]), np.array([3.0, 5.0, 6.0, 8.0])
    rows = [(i, "p", "b", 0, float(v)) for i, v in enumerate(a)] + [(9 + i, "q", "b", 0, float(v)) for i, v in enumerate(b)]
    got = stats.hedges_g(spark.createDataFrame(rows, "entity_id int, grp string, block string, coord int, value double"), "p", "q").first()["g"]
    pooled = np.sqrt((2 * a.var(ddof=1) + 3 * b.var(ddof=1)) / 5)
    assert got == pytest.approx((b.mean() - a.mean()) / pooled * (1 - 3 / (4 * 7 - 9)))


def test_parameter_sensitivity_matches_ridge(spark):
    _, states, params = data(spark)
    first = states.where("state_id LIKE '%0' OR state_id LIKE '%2' OR state_id LIKE '%4' OR state_id LIKE '%6' OR state_id LIKE '%8'").withColumn("block", F.lit("b"))
    got = scoring.parameter_sensitivity(params, first, ["a", "b", "c"]).toPandas().sort_values("parameter")
    mean = STATES[::2].mean(axis=1)
    x, y = THETA - THETA.mean(axis=0), mean - mean.mean(axis=0)
    beta = np.linalg.solve(x.T @ x + 1e-6 * np.eye(P), x.T @ y)
    noise = np.sqrt(((STATES[::2] - mean[:, None]) ** 2).mean())
    assert got.effect_rms.to_numpy() == pytest.approx(np.sqrt((beta ** 2).mean(axis=1)))
    assert got.noise_rms.to_numpy() == pytest.approx(noise)
    r = [max(abs(np.corrcoef(THETA[:, i], mean[:, d])[0, 1]) for d in range(D)) for i in range(P)]
    assert got.max_marginal_r.to_numpy() == pytest.approx(np.array(r))


def test_network_topography_recovers_a_planted_block(spark):
    """Sensor maps made from one block's share give an effect correlation of 1 for that block."""
    g = RNG.normal(size=(6, 9))
    block = np.array(["A", "B", "C"] * 3)
    gain = spark.createDataFrame([(f"s{i}", j, float(g[i, j])) for i in range(6) for j in range(9)], "sensor string, node_id int, g double")
    nodes = spark.createDataFrame([(j, str(block[j])) for j in range(9)], "node_id int, block string")
    power = np.stack([(g[:, block == b] ** 2).sum(axis=1) for b in "ABC"], axis=1)
    share = power / power.sum(axis=1, keepdims=True)
    share -= share.mean(axis=0)
    rows = [(e, "p" if e < 8 else "q", f"s{i}", float(0.01 * RNG.normal() * 0 + (e >= 8) * share[i, 1] + 0.1 * (e % 3) * share[i, 0])) for e in range(16) for i in range(6)]
    out = evaluate.network_topography(gain, nodes, spark.createDataFrame([(e, grp, s, v if e not in (7, 15) else v) for e, grp, s, v in rows], "entity_id int, grp string, sensor string, value double").where("entity_id % 8 < 6"), "p", "q")
    got = {(r["kind"], r["block"]): r["value"] for r in out.collect()}
    assert got[("multivariate_correlation", None)] == pytest.approx(1.0)
    for m in (1, 2):
        assert max(abs(got[(f"mode_{m}", b)]) for b in "ABC") == pytest.approx(1.0)
    assert sum(3 * got[("mode_1", b)] for b in "ABC") == pytest.approx(0.0, abs=1e-9)


def test_group_signal_finds_a_separable_label(spark):
    rows = [(e, e % 2, [float(RNG.normal() + 3 * (e % 2)), float(RNG.normal())]) for e in range(60)]
    df = spark.createDataFrame(rows, "entity_id int, label int, x array<double>")
    row = group_signal.cv_group_signal(df, df, 1, 2, 2, [1], [0.01], 5, 5).first()
    assert row["roc_auc"] > 0.9 and row["brier"] < 0.25


def test_ragged_entities_are_an_error(spark):
    """An entity with other coordinates than the states must not be matched column by column."""
    states = spark.createDataFrame([("s", "c", 0, k, float(k)) for k in (0, 1)], "state_id string, candidate_id string, replicate int, coord bigint, value double")
    for coords in ((1, 2), (0,), (0, 0, 1)):
        entities = spark.createDataFrame([(2, k, 1.0) for k in coords], "entity_id bigint, coord bigint, value double")
        with pytest.raises(Exception, match="unknown for 2"):
            scoring.pairwise_cost(entities, states, "arrow").collect()
    with pytest.raises(Exception, match="unknown for 7"):
        features.pack(spark.createDataFrame([(7, 0, 1.0), (8, 0, 1.0), (8, 1, 2.0)], "entity_id bigint, coord bigint, value double"), ["entity_id"]).collect()


def test_nonnegative_weights_meet_the_optimality_conditions():
    for columns in (3, 20):
        design, target = np.abs(RNG.normal(size=(30, columns))), RNG.normal(size=30)
        weights = evaluate.nonnegative_weights(design, target)
        gradient = design.T @ (target - design @ weights)
        assert (weights >= 0).all() and gradient.max() < 1e-7 and np.abs(gradient[weights > 0]).max(initial=0) < 1e-7


def test_pivots_skip_distances_and_keep_the_nearest():
    """Clustered states: bounds leave most pairs out, and what is left holds the exact nearest, ties included."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 12)) * 10
    f = np.repeat(centers, 50, axis=0) + rng.normal(size=(2000, 12)) * 0.1
    f[77] = f[33]
    rows = np.r_[f[33:34], centers[rng.integers(0, 40, 299)] + rng.normal(size=(299, 12)) * 0.1]
    spread = np.where(np.arange(2000) % 2, 0.0, 0.01)
    spread[[33, 77]] = 0.0
    best, total, _, computed = tiled.nearest(rows, f, spread)
    dense = ((rows[:, None] - f[None]) ** 2).sum(axis=2) + spread
    assert (best == dense.argmin(axis=1)).all() and best[0] == 33 and total == pytest.approx(dense.min(axis=1))
    assert computed < 0.1 * dense.size  # more than nine in ten distances skipped


def test_heaviest_and_quantiles_on_ties():
    logit = np.array([[1.0, 3.0, 3.0, 3.0, 0.0], [2.0, 2.0, 2.0, 2.0, 2.0]])
    assert tiled.heaviest(logit, 2).tolist() == [[1, 2], [0, 1]] and tiled.heaviest(logit, 9).shape == (2, 5)
    owner, value, weight = np.array([0, 0, 0, 1, 1]), np.array([3.0, 1.0, 2.0, 5.0, 5.0]), np.array([0.2, 0.5, 0.3, 0.5, 0.5])
    got = tiled.solve_quantile(owner, value, weight, np.zeros(2), np.full(2, np.nan), np.array([0.65, 0.95]))
    assert got == pytest.approx([1.5, 5.0])
    assert tiled.solve_quantile(np.array([0]), np.array([4.0]), np.array([0.4]), np.array([0.5]), np.array([2.0]), np.array([0.7])) == pytest.approx([3.0])
