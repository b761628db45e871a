"""Principal components from QR factors, and fitted transforms that are saved and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specframe.operators import features, tall_qr
from specframe.plans import transforms
from specframe.sources import transform_store as store


def long_rows(spark, x, segments=None):
    rows = [(e, "a" if c < 3 else "b", c, float(x[e, c])) for e in range(x.shape[0]) for c in range(x.shape[1])]
    df = spark.createDataFrame(rows, "entity_id long, block string, coord long, value double")
    return df if segments is None else df.withColumn("segment", F.explode(F.array(*[F.lit(s) for s in segments])))


def plain_components(x, k):
    _, _, right = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    right = right[:k]
    return right * np.sign(right[range(len(right)), np.abs(right).argmax(axis=1)])[:, None]


def test_components_equal_a_singular_value_decomposition(spark, monkeypatch):
    monkeypatch.setattr(tall_qr, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 1e-5]) @ rng.normal(size=(6, 6)) + 40.0
    for partitions in (1, 7, 70):  # one factor, one merge, two levels of merges
        fitted = tall_qr.fit(long_rows(spark, x), 6, partitions)
        got = np.zeros((6, 6))
        for r in fitted.collect():
            got[r["comp"], r["coord_index"]] = r["loading"]
            assert r["mean"] == pytest.approx(x[:, r["coord_index"]].mean()) and r["width"] == 6 and r["coord"] == r["coord_index"]
        assert np.allclose(got, plain_components(x, 6), atol=1e-6)
    scores = tall_qr.project(long_rows(spark, x), fitted, 6).toPandas().pivot(index="entity_id", columns="coord", values="value").to_numpy()
    assert np.allclose(scores, (x - x.mean(axis=0)) @ plain_components(x, 6).T, atol=1e-6)


def test_components_of_odd_tables(spark):
    x = np.array([[1.0, 2.0, 3.0, 4.0], [2.0, 1.0, 5.0, 4.0], [0.0, 2.0, 2.0, 4.0]])
    assert tall_qr.fit(long_rows(spark, x), 4).select("comp").distinct().count() == 2  # three rows span two directions
    assert tall_qr.fit(long_rows(spark, x).limit(0), 4).count() == 0
    assert tall_qr.fit(long_rows(spark, x[:1]), 4).count() == 0  # one row has no direction
    fitted = tall_qr.fit(long_rows(spark, x), 2)
    with pytest.raises(Exception, match="missing or repeated for 1"):
        tall_qr.project(long_rows(spark, x).where("NOT (entity_id = 1 AND coord = 2)"), fitted, 2).collect()
    with pytest.raises(Exception, match="finite"):
        tall_qr.fit(long_rows(spark, np.where(x == 5.0, np.nan, x)), 2).collect()


def test_features_pca_scores_uses_the_factors(spark):
    x = np.random.default_rng(5).normal(size=(50, 5))
    components, scores = features.pca_scores(long_rows(spark, x), 3)
    got = scores.toPandas().pivot(index="entity_id", columns="coord", values="value").to_numpy()
    assert np.allclose(got, (x - x.mean(axis=0)) @ plain_components(x, 3).T)
    assert components.count() == 15
    none, same = features.pca_scores(long_rows(spark, x), 0)
    assert none is None and same.count() == 250


def test_selection_is_saved_read_back_and_applied_to_unseen_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) * [1, 2, 3, 4, 5, 6]
    noise = {"fit": 0.1, "rel_a": 0.1, "rel_b": 0.1}
    train = None
    for segment, size in noise.items():
        y = x + size * rng.normal(size=x.shape)
        y[:, 5] = rng.normal(size=40)  # unreliable
        part = long_rows(spark, y, [segment])
        train = part if train is None else train.unionByName(part)
        if segment == "fit":
            fit = y
    root = str(tmp_path / "store")
    assert transforms.save_selection(spark, root, "t", train, 0.5, {"a": 3, "b": 3}, 1, {"a": 0.7, "b": 0.3}) == 1
    fitted = store.load(spark, root, "t", expected={"selection": transforms.SELECTION})
    assert fitted.version == 1 and fitted.parameters["maximum"] == {"a": 3, "b": 3}
    unseen = rng.normal(size=(7, 6))
    got = {(r["entity_id"], r["coord"]): r["value"] for r in transforms.apply_saved(fitted, long_rows(spark, unseen, ["new"])).collect()}
    assert set(got) == {(e, c) for e in range(7) for c in range(5)}
    mean, sd = fit.mean(axis=0), fit.std(axis=0, ddof=1)
    for (e, c), value in got.items():
        assert value == pytest.approx((unseen[e, c] - mean[c]) / sd[c] * np.sqrt(0.7 / 3 if c < 3 else 0.3 / 2))
    # Fewer coordinates in the new rows do not change the weights of the others.
    part = transforms.apply_saved(fitted, long_rows(spark, unseen, ["new"]).where("coord <> 0")).collect()
    assert {(r["entity_id"], r["coord"]): pytest.approx(r["value"]) for r in part} == {k: v for k, v in got.items() if k[1] != 0}


def test_components_are_saved_read_back_and_applied_to_unseen_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    x, unseen, root = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)), rng.normal(size=(8, 5)), str(tmp_path / "store")
    transforms.save_components(spark, root, "pca", long_rows(spark, x), 3)
    got = transforms.apply_saved(store.load(spark, root, "pca"), long_rows(spark, unseen)).toPandas().pivot(index="entity_id", columns="coord", values="value").to_numpy()
    z = lambda a: (a - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    loadings = plain_components(z(x), 3)
    assert np.allclose(got, z(unseen) @ loadings.T / (z(x) @ loadings.T).std(axis=0, ddof=1))
    transforms.save_components(spark, root, "few", long_rows(spark, x[:3]), 5)
    assert store.load(spark, root, "few").parameters["k"] <= 3


def test_versions_switch_whole_and_schemas_evolve(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(LookupError):
        store.load(spark, root, "x")
    one, two = spark.createDataFrame([(1, 2.0)], "a long, b double"), spark.createDataFrame([(1, 2.0, "n"), (3, None, None)], "a long, b double, c string")
    assert store.save(spark, root, "x", {"t": one}, {"p": [1, None, "q"]}) == 1
    assert store.save(spark, root, "x", {"t": two, "empty": two.limit(0)}) == 2
    assert [tuple(r) for r in store.load(spark, root, "x").tables["t"].orderBy("a").collect()] == [(1, 2.0, "n"), (3, None, None)]
    assert store.load(spark, root, "x").tables["empty"].schema == two.schema
    old = store.load(spark, root, "x", 1, {"t": "a bigint, c string"})
    assert [r.asDict() for r in old.tables["t"].collect()] == [{"a": 1, "c": None, "b": 2.0}] and old.parameters == {"p": [1, None, "q"]}
    with pytest.raises(ValueError, match="is bigint, not string"):
        store.load(spark, root, "x", 1, {"t": "a string"})
    with pytest.raises(ValueError, match="no table"):
        store.load(spark, root, "x", 1, {"u": "a string"})
    with pytest.raises(LookupError):
        store.load(spark, root, "x", 9)
    failing = one.select(F.raise_error(F.lit("stop")).cast("long").alias("a"))
    with pytest.raises(Exception, match="stop"):
        store.save(spark, root, "x", {"t": one, "u": failing})
    assert store.load(spark, root, "x").version == 2
    assert sorted(tuple(r) for r in store.versions(spark, root, "x").collect()) == [(1, "t", 1), (2, "empty", 0), (2, "t", 2)]
    with pytest.raises(ValueError):
        store.save(spark, root, "../x", {"t": one})
