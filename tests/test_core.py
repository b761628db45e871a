"""Distributed building blocks against plain computations, including hot groups."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specframe.functions.quantiles import exact_quantiles
from specframe.functions.ranking import global_running, hash_rank
from specframe.operators import evaluate, stats


def test_exact_quantiles_in_large_skewed_groups(spark):
    """One group far above the sketch's exact size, with heavy ties, and small ones beside it."""
    rng = np.random.default_rng(3)
    hot = np.r_[rng.normal(0, 1, 30000), np.full(9000, 0.25)]
    pdf = pd.DataFrame({"g": ["hot"] * len(hot) + ["two"] * 2 + ["one"], "x": np.r_[hot, [1.0, 2.0], [5.0]]})
    ps = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(pdf).repartition(6), ["g"], {"x": [(p, f"q{i}") for i, p in enumerate(ps)]}).collect()}
    for g, part in pdf.groupby("g"):
        for i, p in enumerate(ps):
            assert got[g][f"q{i}"] == pytest.approx(np.percentile(part["x"], 100 * p), abs=1e-12), (g, p)


def test_exact_quantiles_skip_nulls_and_handle_two_columns(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 2.0), ("a", None, 4.0)], "g string, x double, y double")
    row = exact_quantiles(df, ["g"], {"x": [(0.5, "mx")], "y": [(0.25, "qy")]}).first()
    assert row["mx"] == 2.0 and row["qy"] == 2.5


def test_hash_rank_equals_a_plain_sort(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("string").alias("g"))
    got = hash_rank(df, ["g"], 5, "id").toPandas()
    for g, part in got.groupby("g"):
        want = sorted(part["id"], key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
        assert list(part.sort_values("shuffled_rank")["id"]) == want
        assert sorted(part["shuffled_rank"]) == list(range(1, len(part) + 1))


def test_global_running_over_partitions(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(np.arange(3000) % 4 == 0, "b", "a"), "i": range(3000), "x": rng.integers(0, 50, 3000).astype(float), "w": 1.0})
    got = global_running(spark.createDataFrame(pdf), [F.col("x").asc(), F.col("i").asc()], {"c": "w"}, ["g"]).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values(["x", "i"])
        assert list(part["rank"]) == list(range(1, len(part) + 1)) and list(part["c"]) == list(range(1, len(part) + 1))
    whole = global_running(spark.createDataFrame(pdf), [F.col("x").asc(), F.col("i").asc()], {}).toPandas().sort_values(["x", "i"])
    assert list(whole["rank"]) == list(range(1, 3001))


def test_weighted_quantile_matches_interp(spark):
    rng = np.random.default_rng(8)
    v, w = rng.normal(size=200), rng.random(200)
    w /= w.sum()
    df = spark.createDataFrame(pd.DataFrame({"e": 1, "s": range(200), "v": v, "w": w}))
    row = stats.weighted_quantile(df, "v", "w", ["e"], "s", {"a": 0.05, "b": 0.5, "c": 0.95, "d": 1e-9}).first()
    order = np.argsort(v)
    for name, p in (("a", 0.05), ("b", 0.5), ("c", 0.95), ("d", 1e-9)):
        assert row[name] == pytest.approx(np.interp(p, np.cumsum(w[order]), v[order]))


def test_nested_splits_are_balanced_and_complete(spark):
    people = spark.range(523).select(F.col("id").alias("entity_id"), F.when(F.col("id") % 5 < 2, "x").otherwise("y").alias("grp"))
    splits = stats.nested_splits(people, "grp", 5, 3, 20).toPandas()
    held = splits[splits.outer_role == "validation"]
    assert sorted(held.entity_id) == list(range(523))
    for (_, role, _), part in splits.groupby(["outer_fold", "outer_role", "grp"]):
        assert part.inner_fold.isna().all() if role == "validation" else part.inner_fold.notna().all()
    counts = held.groupby(["grp", "outer_fold"]).size().unstack()
    assert (counts.max(axis=1) - counts.min(axis=1) <= 1).all()
    inner = splits[splits.outer_role == "training"].groupby(["outer_fold", "grp", "inner_fold"]).size().unstack()
    assert (inner.max(axis=1) - inner.min(axis=1) <= 1).all()
    again = stats.nested_splits(people, "grp", 5, 3, 20).toPandas()
    key = ["entity_id", "outer_fold"]
    assert splits.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_holdout_takes_at_least_one_and_rounds_half_even(spark):
    people = spark.createDataFrame([(i, "a") for i in range(5)] + [(9, "b")], "entity_id bigint, grp string")
    got = stats.stratified_holdout(people, "grp", 0.5, 1).groupBy("grp", "split").count().collect()
    assert {(r["grp"], r["split"]): r["count"] for r in got} == {("a", "holdout"): 2, ("a", "train"): 3, ("b", "holdout"): 1}


def test_auc_with_ties_matches_pair_counting(spark):
    rng = np.random.default_rng(2)
    label, score = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    row = evaluate.binary_metrics(spark.createDataFrame(pd.DataFrame({"score": score, "label": label}))).first()
    pos, neg = score[label == 1], score[label == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert row["roc_auc"] == pytest.approx(want)
    assert row["brier"] == pytest.approx(np.mean((score - label) ** 2))


def test_gates_fail_on_missing_metrics(spark):
    metrics = spark.createDataFrame([("total", 0.8), ("share", 0.7)], "name string, value double")
    rows = evaluate.acceptance_gates(metrics, [("a", "total", "<", 1.0), ("b", "share", ">", 0.5)]).collect()
    assert all(r["passed"] and r["status"] == "accepted" for r in rows)
    rows = {r["check"]: r for r in evaluate.acceptance_gates(metrics, [("a", "total", "<", 1.0), ("c", "none", ">", 0.5)]).collect()}
    assert rows["a"]["passed"] and not rows["c"]["passed"] and rows["a"]["status"] == "not_accepted"


def test_small_side_gives_equal_rows_on_both_sides_of_its_limit(spark):
    from specframe.session import small_side

    rows = spark.range(1000).selectExpr("id", "id % 7 AS k")
    side = spark.range(7).selectExpr("id AS k", "id * 10 AS v")
    plans = [rows.join(small_side(side, limit), "k") for limit in (7, 6)]
    got = [sorted(map(tuple, p.collect())) for p in plans]
    assert got[0] == got[1] and len(got[0]) == 1000
