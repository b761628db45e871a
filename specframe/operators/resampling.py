"""Bootstrap draws made where they are used: no row per entity and sample, in any shuffle.

A group of n entities stands in the order of its seeded shuffle, cut into blocks of BLOCK positions. Sample b draws n times with
replacement. How many of the n fall into a block comes from splitting n down a binary tree over the blocks by binomial draws, whose
generator is seeded by (seed, group, tree node), so every task that needs a node gets the same numbers; inside a block draw i takes
position hash(seed, b, group, i) mod the block's size. Together that is the multinomial distribution. A group of one block
needs no tree. A task holds one block and its samples x BLOCK weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.ranking import hash_rank
from ..session import durable, small_side

BLOCK = 4096
# Samples whose medians are found in one group.
SAMPLE_CHUNK = 50


def block_draws(n: int, blocks: int, block: int, samples: int, seed: int, group: str, size: int) -> np.ndarray:
    """Number of draws that fall into ``block``, for every sample."""
    low, high, node = 0, blocks, 1
    counts = np.full(samples, n, dtype=np.int64)
    held = lambda a, b: min(b * size, n) - a * size
    while high - low > 1:
        middle = (low + high) // 2
        key = int.from_bytes(hashlib.md5(f"{seed}:{group}:{node}".encode()).digest()[:8], "big")
        left = np.random.Generator(np.random.Philox(key)).binomial(counts, held(low, middle) / held(low, high))
        if block < middle:
            counts, high, node = left, middle, 2 * node
        else:
            counts, low, node = counts - left, middle, 2 * node + 1
    return counts


def block_weights(n: int, block: int, samples: int, seed: int, group: str, size: int | None = None) -> np.ndarray:
    """samples x positions of the block: how often each sample draws each position."""
    size = size or BLOCK
    blocks = -(-n // size)
    width = min((block + 1) * size, n) - block * size
    counts = block_draws(n, blocks, block, samples, seed, group, size)
    out = np.zeros((samples, width), dtype=np.int32)
    label = f"{block}/" if block else ""
    ends = [b"%d" % i for i in range(int(counts.max(initial=0)))]
    for b, count in enumerate(counts.tolist()):
        start = f"{seed}:{b}:{group}:{label}".encode()
        digests = b"".join([hashlib.md5(start + end).digest() for end in ends[:count]])
        # The first fifteen hexadecimal digits of each.
        picks = (np.frombuffer(digests, dtype=">u8")[::2].astype(np.int64) >> 4) & ((1 << 60) - 1)
        out[b] = np.bincount(picks % width, minlength=width)
    return out


def resampled(entities: DataFrame, samples: int, seed: int, function: Callable, schema: str, group: str = "grp", key: str = "entity_id") -> DataFrame:
    """``function(group, weights, table)`` yields record batches for each block; weights are samples x rows of the table.

    ``entities`` has one row per entity with its group and whatever columns the function needs.
    """
    ranked = hash_rank(entities, [group], seed, key, "_j").withColumn("_j", F.col("_j") - 1)
    sizes = entities.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranked.join(small_side(sizes), group).withColumn("_block", F.floor(F.col("_j") / BLOCK))
    size = BLOCK

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_j")
        name, n, block = table[group][0].as_py(), table["_n"][0].as_py(), table["_block"][0].as_py()
        return pa.Table.from_batches(function(name, block_weights(n, block, samples, seed, str(name), size), table))

    # A block is little data and much work: a fixed number of partitions keeps blocks from being put together.
    spark = entities.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return placed.repartition(parts, group, "_block").groupBy(group, "_block").applyInArrow(run, schema)


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A list column as a matrix."""
    return np.asarray(table[name].combine_chunks().flatten(), dtype=np.float64).reshape(len(table), -1)


def sample_medians(values: DataFrame, metrics: list[str], samples: int, seed: int, group: str, key: str) -> DataFrame:
    """(metric, b, median) of every bootstrap sample, exact.

    A sample's median stays within a few standard errors of the overall one, so blocks send weights only for the values between two
    exact quantiles, some sqrt(n) of them, and the sum of weights below. If a sample's median lies outside, the bracket is doubled.
    """
    n = values.count()
    reach = 4.0 / max(1.0, n) ** 0.5
    while True:
        wide = reach >= 0.5
        marks = {m: [(max(0.0, 0.5 - reach), f"{m}_low"), (min(1.0, 0.5 + reach), f"{m}_high")] for m in metrics}
        row = exact_quantiles(values, [group], marks).first() if not wide else None
        bounds = {m: (-np.inf, np.inf) if wide or row is None or row[f"{m}_low"] is None else (row[f"{m}_low"], row[f"{m}_high"]) for m in metrics}

        def send(_, weights: np.ndarray, table: pa.Table, bounds=bounds) -> Iterator[pa.RecordBatch]:
            for number, m in enumerate(metrics):
                v = np.array([np.nan if x is None else x for x in table[m].to_pylist()], dtype=np.float64)
                low, high = bounds[m]
                with np.errstate(invalid="ignore"):
                    inside, below = np.flatnonzero((v >= low) & (v <= high)), v < low
                for a in range(0, len(weights), SAMPLE_CHUNK):
                    w = weights[a : a + SAMPLE_CHUNK]
                    parts = (v[inside], w[:, inside].astype(np.int32), w[:, below].sum(axis=1).astype(np.int64), w[:, ~np.isnan(v)].sum(axis=1).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([a], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts]], names=["metric", "start", "v", "w", "below", "total"])

        def solve(table: pa.Table) -> pa.Table:
            get = lambda name, kind: [np.frombuffer(x.as_py(), dtype=kind) for x in table[name]]
            below, total = sum(get("below", np.int64)), sum(get("total", np.int64))
            v = np.concatenate(get("v", np.float64))
            w = np.concatenate([x.reshape(len(below), -1) for x in get("w", np.int32)], axis=1)
            order = np.argsort(v, kind="stable")
            v, upto = v[order], below[:, None] + np.cumsum(w[:, order], axis=1, dtype=np.int64)
            ranks = [(total - 1) // 2, total // 2]
            held = (total > 0) & (ranks[0] >= below) & (ranks[1] < (upto[:, -1] if len(v) else below))
            found = np.full(len(below), np.nan)
            for b in np.flatnonzero(held):
                found[b] = 0.5 * sum(v[np.searchsorted(upto[b], r[b], side="right")] for r in ranks)
            start = table["start"][0].as_py()
            return pa.table({"metric": pa.array([metrics[table["metric"][0].as_py()]] * len(below)), "b": pa.array(np.arange(start, start + len(below)), pa.int32()),
                             "median": pa.array(found, mask=np.isnan(found)), "missed": pa.array(~held & (total > 0))})

        sent = resampled(values, samples, seed, send, "metric int, start int, v binary, w binary, below binary, total binary", group, key)
        out = durable(sent.groupBy("metric", "start").applyInArrow(solve, "metric string, b int, median double, missed boolean"))
        if wide or out.where("missed").isEmpty():
            return out.drop("missed")
        reach *= 2
