"""Pair moments against NumPy, on missing points, uneven channels, hot recordings and small portions."""

import numpy as np
import pytest

from specframe.operators import comoments, spectral


@pytest.mark.parametrize("portion", [1 << 16, 20])
def test_pair_moments_equal_numpy(spark, monkeypatch, portion):
    monkeypatch.setattr(comoments, "PORTION", portion)
    rng = np.random.default_rng(3)
    rows = []
    for rec, points, channels in (("long", 300, "abcd"), ("short", 12, "bc"), ("one", 1, "ab")):
        shared = rng.normal(size=points)
        for k, c in enumerate(channels):
            for t in range(points):
                if rng.random() < 0.9:
                    rows.append((rec, "s", t, c, None if rng.random() < 0.05 else float(1e4 + shared[t] * k + rng.normal())))
    frame = spark.createDataFrame(rows, "recording_id string, session string, t long, channel string, value double").repartition(5)
    got = {(r["recording_id"], r["ch_i"], r["ch_j"]): r for r in comoments.pair_moments(frame, ["recording_id", "session"]).collect()}
    value = {(r, t, c): v for r, _, t, c, v in rows if v is not None}
    for (rec, i, j), row in got.items():
        both = [(value[rec, t, i], value[rec, t, j]) for t in range(300) if (rec, t, i) in value and (rec, t, j) in value]
        x, y = np.array(both).T
        assert row["n"] == len(both) and row["cov"] == pytest.approx(((x - x.mean()) * (y - y.mean())).mean(), abs=1e-7)
        if len(both) > 2:
            assert row["r"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-7)
        elif len(both) == 1:
            assert row["r"] is None
    assert {k for k in got if k[0] == "long"} == {("long", a, b) for a in "abcd" for b in "abcd" if a <= b}
    assert comoments.pair_moments(frame.limit(0), ["recording_id", "session"]).count() == 0


def test_repeated_sample_is_an_error(spark):
    frame = spark.createDataFrame([(1, 0, "a", 1.0), (1, 0, "a", 2.0)], "recording_id int, t long, channel string, value double")
    with pytest.raises(Exception, match="twice"):
        spectral.correlation_summary(frame).collect()
