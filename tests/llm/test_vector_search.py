import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from specframe.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k, modulus):
    usable = [(i, r[0], [math.floor(64 * float(x)) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, query, q in usable:
        if query is None or query % modulus:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), c is None, c if c is not None else 0) for j, c, v in usable if j != i)
        out += [(query, n + 1, None if missing else c, -s) for n, (s, missing, c) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(spark, rows, k=5, modulus=3):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = vector_search.exact_top(frame, F.col("vec_id") % modulus == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes)["rank"] == "int"
    return sorted([tuple(r) for r in got.collect()], key=repr)


@pytest.mark.parametrize("kind", ["normal", "ties", "sparse", "positive", "large"])
def test_equals_brute_force_over_several_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(vector_search, "INDEX_CELLS", 256 * 8)
    monkeypatch.setattr(vector_search, "QUERY_CELLS", 64 * 8)
    rng = np.random.default_rng(5)
    m = rng.normal(0, 0.15, (900, 8))
    if kind == "ties":
        m = np.round(m * 4) / 8
        m[100:400] = m[100]  # a third of all rows are one vector
    if kind == "sparse":
        m[rng.random(m.shape) < 0.8] = 0
    if kind == "large":
        m = m * 2e6
    if kind == "positive":
        m = np.abs(m)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]
    assert found(spark, rows, 7, 10) == brute(rows, 7, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (3, []), (6, [0.5, nan]), (9, [0.5, inf]), (12, [0.5, None]), (15, [0.5, -0.5]), (18, [0.25]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.01]), (21, [0.5, 0.5]), (21, [0.5, 0.5]), (-3, [0.5, 0.5])]
    assert found(spark, rows) == brute([(i, v if v is None else (v + [0.0, 0.0])[:2]) for i, v in rows], 5, 3)
    assert found(spark, []) == [] and found(spark, [(3, [1.0])]) == []
    with pytest.raises(Exception, match="too large"):
        found(spark, [(3, [1e30]), (4, [1.0])])


def test_stops_on_proof_before_all_postings(spark):
    """Few large components decide: most postings are never touched, and the members are still all there."""
    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (4000, 32))
    m[:, 0] = rng.integers(0, 400, 4000)
    q = np.r_[200, rng.integers(-2, 3, 31)]
    index = vector_search.BlockIndex(m.astype(np.int32), np.argsort(m, axis=0, kind="stable").T.astype(np.int32))
    members, scores, done = index.top(q, 10)
    exact = m @ q
    assert done < 0.1 * m.size and len(members) < 0.2 * len(m)
    assert sorted(scores)[-10:] == sorted(exact)[-10:] and set(np.flatnonzero(exact >= sorted(exact)[-10])) <= set(members.tolist())


def test_bound_follows_the_postings_left_and_additions_stay_small(spark):
    """What is missing is the largest impact left in each dimension, so fewer postings prove the same; memory is a portion."""
    rng = np.random.default_rng(3)
    m = np.floor(rng.normal(0, 8, (6000, 64))).astype(np.int32)
    postings = np.ascontiguousarray(np.argsort(m, axis=0, kind="stable").T.astype(np.int32))
    index = vector_search.BlockIndex(m, postings, 64)
    dims, q = np.arange(64), m[5].astype(np.float64)
    low, high = np.full(64, 1500), np.full(64, 4500)
    left = np.stack([q[j] * m[postings[j, 1500:4500], j] for j in dims])
    assert index._missing(q, dims, low, high) == np.maximum(left.max(axis=1), 0).sum() and index._missing(q, dims, high, high) == 0
    assert len(index.rows) < 0.2 * m.size
    for own in range(20):
        members, scores, done = index.top(m[own], 10, own)
        exact = np.delete(m @ m[own], own)
        assert sorted(scores)[-10:] == sorted(exact)[-10:] and own not in members and done < 0.75 * m.size


def test_copies_and_partitions_stay_bounded_on_large_tables(spark):
    """An index block is copied once per block of queries, so these grow with the table; a partition holds a few pairs, however many there are."""
    from specframe.functions import blocks

    for rows, tasks, largest_copies in ((50_000, 200, 40), (600_000, 200, 259), (6_000_000, 200, 13_579)):
        asked, index_blocks = rows // 20, blocks.block_count(rows, vector_search.INDEX_CELLS // 64)
        count = vector_search.query_block_count(asked, 64, index_blocks, tasks)
        assert -(-asked // count) * 64 <= vector_search.QUERY_MOST and count * index_blocks <= largest_copies  # 4,366 and 430,124 in small blocks
    assert vector_search.query_block_count(0, 64, 1, 200) == 1
    side = spark.range(60).select(F.col("id").alias("_block"), F.lit(1).alias("v"))
    pairs = blocks.tiles(side, side, 60, 60)
    assert pairs.count() == 3600 and max(len(p) for p in pairs.select("_tile").rdd.glom().collect()) < 4 * blocks.TILES_EACH
