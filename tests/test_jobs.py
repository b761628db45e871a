"""Multi-stage jobs against a plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specframe.operators import features
from specframe.plans import jobs


def test_nested_evaluation_refits_on_each_training_set(spark):
    rng = np.random.default_rng(12)
    n, d, k = 18, 4, 6
    fit, unseen, bank = rng.normal(size=(n, d)), rng.normal(size=(n, d)), rng.normal(size=(k, 2, d))
    theta, fold = rng.normal(size=k), np.arange(n) % 3
    raw = spark.createDataFrame([(e, "g", s, "b", c, float(v[e, c])) for e in range(n) for s, v in (("fit", fit), ("validation", unseen)) for c in range(d)],
                                "entity_id bigint, grp string, segment string, block string, coord bigint, value double")
    states = spark.createDataFrame([(f"c{i}", f"c{i}", r, "b", c, float(bank[i, r, c])) for i in range(k) for r in range(2) for c in range(d)],
                                   "candidate_id string, state_id string, replicate bigint, block string, coord bigint, value double")
    params = spark.createDataFrame([(f"c{i}", float(theta[i])) for i in range(k)], "candidate_id string, p double")
    folds = spark.createDataFrame([(e, int(fold[e])) for e in range(n)], "entity_id bigint, fold bigint")
    prior = params.select("candidate_id", F.lit(0.0).alias("prior"))
    got = jobs.nested_evaluation(raw, states, params, ["p"], prior, folds, 3, [0.5], {"b": 1.0}).toPandas().set_index("entity_id")
    assert sorted(got.index) == list(range(n))
    for f in range(3):
        train, held = fold != f, fold == f
        mean, sd = fit[train].mean(axis=0), fit[train].std(axis=0, ddof=1)
        scale = lambda x: (x - mean) / sd / np.sqrt(d)
        y, u, b = scale(fit), scale(unseen), scale(bank)
        base = np.median(((y - u)[train] ** 2).sum(axis=1))
        cost = ((b[None] - y[:, None, None]) ** 2).sum(axis=3).mean(axis=2)
        w = np.exp(-0.5 * cost / (0.5 * base))
        w /= w.sum(axis=1, keepdims=True)
        want = ((w @ b.mean(axis=1) - u) ** 2).sum(axis=1)
        null = ((y[train].mean(axis=0) - u) ** 2).sum(axis=1)
        assert got.loc[np.flatnonzero(held), "temperature"].to_numpy() == pytest.approx(0.5 * base)
        assert got.loc[np.flatnonzero(held), "unseen_cost"].to_numpy() == pytest.approx(want[held])
        assert got.loc[np.flatnonzero(held), "unseen_ratio"].to_numpy() == pytest.approx((want / null)[held])


def test_fit_transform_selects_reliable_coordinates_and_applies(spark):
    """Two recordings groups with a stable tone: the transform is fitted, stored as tables and applied by a join."""
    rng = np.random.default_rng(3)
    rows = []
    for rec in range(6):
        for seg in ("fit", "rel_a", "rel_b"):
            for f in range(2, 11):
                for i, a in enumerate("abc"):
                    for j, b in enumerate("abc"):
                        if i <= j:
                            power = (1.0 + rec) / f * (1.5 if f == 6 and rec % 2 else 1.0)
                            rows.append((rec, seg, float(f), a, b, power * (1.0 if i == j else 0.3) * (1 + 0.01 * rng.random()), 0.0 if i == j else 0.1 * power * (rec + 1) / 6))
    csd = spark.createDataFrame(rows, "recording_id bigint, segment string, freq double, ch_i string, ch_j string, re double, im double")
    background = (F.col("freq") <= 3) | (F.col("freq") >= 9)
    basis, transform = jobs.fit_transform(csd, csd.select("recording_id").distinct(), 2, "lagged", 0.05, background, (4.0, 8.0), 0.5, {"auto": 5, "cross": 4, "topography": 2}, 2)
    sizes = {r["block"]: r["count"] for r in transform.groupBy("block").count().collect()}
    assert sizes["auto"] <= 5 and sizes["cross"] <= 4 and sizes["topography"] == 2
    raw = jobs.raw_blocks(csd.where("segment = 'fit'"), basis, "lagged", 0.05, background, (4.0, 8.0)).withColumnRenamed("recording_id", "entity_id")
    out = jobs.apply_transform(raw, transform, {"auto": 0.5, "cross": 0.3, "topography": 0.2})
    checks = out.groupBy("block", "coord").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert len(checks) == sum(sizes.values()) and all(abs(r["m"]) < 1e-8 and r["n"] == 6 for r in checks)
    assert features.pack(out, ["entity_id"]).where(F.size("f") == sum(sizes.values())).count() == 6


def test_fit_transform_makes_the_cross_spectra_once(spark):
    """The basis, the projection and the three blocks read stored cross-spectra; counted where they are made."""
    made = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(4)
    rows = [(rec, seg, float(f), a, b, (1.0 + rec + rng.random()) / f * (1.0 if a == b else 0.3), 0.0 if a == b else 0.1 * rng.random())
            for rec in range(5) for seg in ("fit", "rel_a", "rel_b") for f in range(2, 11) for a in "abc" for b in "abc" if a <= b]
    schema = "recording_id bigint, segment string, freq double, ch_i string, ch_j string, re double, im double"

    def making(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    csd = spark.createDataFrame(rows, schema).mapInArrow(making, schema)
    train = spark.createDataFrame([(rec,) for rec in range(5)], "recording_id bigint")
    background = (F.col("freq") <= 3) | (F.col("freq") >= 9)
    _, transform = jobs.fit_transform(csd, train, 2, "lagged", 0.05, background, (4.0, 8.0), 0.5, {"auto": 5, "cross": 4, "topography": 2}, 2)
    assert transform.count() > 0 and made.value == len(rows)


def test_feature_audit_holds_every_report(spark):
    rng = np.random.default_rng(1)
    frame = lambda key, n, extra=(): spark.createDataFrame([(i, *extra, "ab"[i % 2], b, c, float(rng.normal() + i % 2)) for i in range(n) for b in ("x", "y") for c in range(4)], f"{key} long, grp string, block string, coord long, value double")
    fit, unseen = frame("entity_id", 20), frame("entity_id", 20)
    bank = frame("candidate_id", 6).drop("grp")
    signal = spark.createDataFrame([(0, 0.6, 0.5, 0.2), (1, 0.8, 0.7, 0.4)], "repeat int, roc_auc double, balanced_accuracy double, brier double")
    learned = spark.createDataFrame([("p", 0.5, 0.1), ("q", -0.1, 0.3)], "parameter string, r2 double, nrmse double")
    rows = jobs.feature_audit(fit, unseen, bank, fit, "a", "b", {"x": 0.3, "y": 0.4}, {"none": signal}, learned).collect()
    found = {(r["report"], r["block"], r["metric"]): r["value"] for r in rows}
    assert {k[0] for k in found} == {"reliability", "replication", "coverage", "preservation", "group_signal", "learnability"}
    assert found["group_signal", "none", "mean_roc_auc"] == pytest.approx(0.7) and found["group_signal", "none", "largest_brier"] == 0.4 and found["group_signal", "none", "repeats"] == 2
    assert found["learnability", "q", "r2"] == -0.1 and found["learnability", "all", "positive"] == 1 and found["learnability", "all", "median_r2"] == pytest.approx(0.2)
