"""Channel-pair moments of recordings from mergeable co-moment matrices.

Rows are shuffled once, so that all channels of a time point meet; a task turns portions of its points into matrices (counts, means,
and centred products of every channel pair) and sends one row per portion. Portions of a recording merge pairwise and exactly,
so no row per time point and pair is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a portion; a portion ends between time points.
PORTION = 1 << 16


def portion_moments(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """(5, channels, channels): n, mean of the row channel, of the column channel, scatter of the row channel, co-moment, over points that have both."""
    m = known.astype(float)
    shift = np.divide((x * m).sum(axis=0), m.sum(axis=0), out=np.zeros(x.shape[1]), where=m.sum(axis=0) > 0)
    z = np.where(known, x - shift, 0.0)
    n = m.T @ m
    safe = np.maximum(n, 1.0)
    mean = (z.T @ m) / safe
    scatter = np.maximum((z * z).T @ m - n * mean**2, 0.0)
    return np.stack([n, mean + shift[:, None], mean.T + shift[None, :], scatter, z.T @ z - n * mean * mean.T])


def merge_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    part = a[0] * b[0] / np.maximum(n, 1.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    share = b[0] / np.maximum(n, 1.0)
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * part, a[4] + b[4] + dx * dy * part])


def _expand(own: np.ndarray, names: list[str], whole: list[str]) -> np.ndarray:
    out = np.zeros((5, len(whole), len(whole)))
    at = [whole.index(n) for n in names]
    out[np.ix_(range(5), at, at)] = own
    return out


def pair_moments(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ch_i, ch_j, n, cov, r) for every channel pair i <= j of samples(keys, t, channel, value).

    Missing values leave a point out of the pairs they belong to; r is null where either channel does not vary. A channel that
    occurs twice at a time point is an error.
    """
    types = dict(samples.dtypes)
    slim = samples.select(*keys, "t", "channel", F.col("value").cast("double").alias("value"))
    placed = slim.repartition(*keys, "t").sortWithinPartitions(*keys, "t", "channel")
    kept = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def portion(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        codes = table["channel"].chunk(0).dictionary_encode()
        names = codes.dictionary.to_pylist()
        t = np.asarray(table["t"])
        point = np.cumsum(np.r_[0, t[1:] != t[:-1]])
        channel = np.asarray(codes.indices)
        x, known = np.zeros((point[-1] + 1, len(names))), np.zeros((point[-1] + 1, len(names)), dtype=bool)
        value = table["value"].chunk(0)
        if len(np.unique(point * len(names) + channel)) < len(point):
            raise ValueError("a channel occurs twice at one time point")
        x[point, channel] = value.fill_null(0.0).to_numpy(zero_copy_only=False)
        known[point, channel] = value.is_valid().to_numpy(zero_copy_only=False)
        own = [table[k].chunk(0).slice(0, 1) for k in keys]
        return pa.RecordBatch.from_arrays([*own, pa.array([names], pa.list_(pa.string())), pa.array([portion_moments(x, known).tobytes()], pa.binary())], names=[*keys, "names", "moments"])

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut a sorted partition where a recording ends, and between points once PORTION rows are together."""
        held: list[pa.Table] = []
        size, previous = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            names = [np.asarray(table[k].to_pylist(), dtype=object) for k in keys]
            times = np.asarray(table["t"])
            fresh = np.r_[True, np.any([n[1:] != n[:-1] for n in names], axis=0)] if len(times) > 1 else np.array([True])
            now = tuple(n[0] for n in names)
            fresh[0] = previous is not None and previous[0] != now
            moved = np.r_[previous is not None and (previous[1] != times[0] or fresh[0]), (times[1:] != times[:-1]) | fresh[1:]]
            start = 0
            for stop in np.flatnonzero(moved).tolist():
                if fresh[stop] or size + stop - start >= PORTION:
                    held.append(table.slice(start, stop - start))
                    whole = pa.concat_tables(held)
                    if len(whole):
                        yield portion(whole)
                    held, size, start = [], 0, stop
            held.append(table.slice(start))
            size += len(table) - start
            previous = tuple(n[-1] for n in names), times[-1]
        if held:
            yield portion(pa.concat_tables(held))

    def merge(table: pa.Table) -> pa.Table:
        lists = table["names"].to_pylist()
        whole = sorted({n for own in lists for n in own})
        total = None
        for own, cell in zip(lists, table["moments"]):
            part = _expand(np.frombuffer(cell.as_py()).reshape(5, len(own), len(own)), own, whole)
            total = part if total is None else merge_moments(total, part)
        i, j = np.triu_indices(len(whole))
        n, cov = total[0][i, j], total[4][i, j]
        vx, vy = total[3][i, j], total[3][j, i]
        some = n > 0
        r = np.divide(cov, np.sqrt(vx * vy), out=np.full(len(i), np.nan), where=(vx > 0) & (vy > 0))
        own = {k: pa.array([table[k][0].as_py()] * len(i), table[k].type) for k in keys}
        return pa.table({**own, "ch_i": pa.array([whole[k] for k in i]), "ch_j": pa.array([whole[k] for k in j]), "n": pa.array(n.astype(np.int64)),
                         "cov": pa.array(cov / np.maximum(n, 1.0), mask=~some), "r": pa.array(r, mask=np.isnan(r))}).filter(pa.array(some))

    sent = placed.mapInArrow(portions, f"{kept}, names array<string>, moments binary")
    return sent.groupBy(*keys).applyInArrow(merge, f"{kept}, ch_i string, ch_j string, n long, cov double, r double")
