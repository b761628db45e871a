"""Draws inside tasks: totals, distribution, and statistics against the weights written out."""

import numpy as np
import pytest

from specframe.operators import evaluate, resampling


def test_blocks_of_a_sample_add_up_and_are_multinomial():
    n, size, samples = 1000, 64, 400
    weights = [resampling.block_weights(n, k, samples, 7, "g", size) for k in range(-(-n // size))]
    whole = np.concatenate(weights, axis=1)
    assert whole.shape == (samples, n) and (whole.sum(axis=1) == n).all()
    assert abs(whole.mean() - 1) < 1e-12 and abs(whole.var() - (1 - 1 / n)) < 0.02
    # Counts of a block vary as a binomial does, and counts of two blocks are negatively correlated.
    first = whole[:, :size].sum(axis=1)
    assert abs(first.var() / (size * (1 - size / n)) - 1) < 0.3 and np.corrcoef(first, whole[:, size:].sum(axis=1))[0, 1] == pytest.approx(-1)
    assert (resampling.block_weights(n, 3, samples, 7, "g", size) == weights[3]).all()


def _order(spark, ids, seed):
    import hashlib

    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("block", [4096, 16])
def test_paired_bootstrap_equals_written_out_samples(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    monkeypatch.setattr(resampling, "SAMPLE_CHUNK", 7)
    rng = np.random.default_rng(2)
    n, samples, seed = 150, 40, 5
    d = np.round(rng.normal(size=(n, 2)), 1)
    rows = [(i, float(d[i, 0]), 0.0, None if i % 10 == 0 else float(d[i, 1]), 0.0) for i in range(n)]
    paired = spark.createDataFrame(rows, "entity_id long, candidate_a double, reference_a double, candidate_b double, reference_b double")
    got = {r["metric"]: r for r in evaluate.paired_bootstrap(paired, ["a", "b"], samples, seed).collect()}
    order = _order(spark, range(n), seed)
    weights = np.concatenate([resampling.block_weights(n, k, samples, seed, "all", block) for k in range(-(-n // block))], axis=1)
    for m, column in (("a", 0), ("b", 1)):
        values = d[order, column]
        values[[i for i, e in enumerate(order) if m == "b" and e % 10 == 0]] = np.nan
        medians = [np.nanmedian(np.repeat(values, w)) for w in weights]
        assert got[m]["low"] == pytest.approx(np.quantile(medians, 0.025)) and got[m]["high"] == pytest.approx(np.quantile(medians, 0.975))
        assert got[m]["median_difference"] == pytest.approx(np.nanmedian(values))


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """Half of the values on either side of a gap: medians jump across it, far outside the first bracket's values."""
    n, samples = 400, 30
    rows = [(i, float(i % 2) * 100 + i / 1000, 0.0) for i in range(n)]
    paired = spark.createDataFrame(rows, "entity_id long, candidate_a double, reference_a double")
    row = evaluate.paired_bootstrap(paired, ["a"], samples, 3).first()
    values = np.array([rows[i][1] for i in _order(spark, range(n), 3)])
    medians = [np.median(np.repeat(values, w)) for w in resampling.block_weights(n, 0, samples, 3, "all")]
    assert row["low"] == pytest.approx(np.quantile(medians, 0.025)) and row["high"] == pytest.approx(np.quantile(medians, 0.975))


def test_parameter_effects_on_missing_values(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "a" if i % 3 else "b", float(rng.normal() + (i % 3 == 0)), None if i % 7 == 0 else float(i)) for i in range(90)]
    fits = spark.createDataFrame(rows, "entity_id long, grp string, p double, q double")
    got = {r["parameter"]: r for r in evaluate.parameter_effects(fits, ["p", "q"], "a", "b", {"p": 0.9, "q": 0.1}, {"p": 0.5, "q": 0.5}, 50, 1).collect()}
    for k, name in ((2, "p"), (3, "q")):
        a, b = ([r[k] for r in rows if r[1] == g and r[k] is not None] for g in "ab")
        pooled = np.sqrt(((len(a) - 1) * np.var(a, ddof=1) + (len(b) - 1) * np.var(b, ddof=1)) / (len(a) + len(b) - 2))
        assert got[name]["standardized"] == pytest.approx((np.mean(b) - np.mean(a)) / pooled) and got[name]["n_first"] == len(a)
        assert got[name]["low"] < got[name]["standardized"] < got[name]["high"] and got[name]["passes_recovery"] == (name == "p")
