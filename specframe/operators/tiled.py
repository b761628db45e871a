"""Entities against a bank of states in tiles: blocks of bounded bytes meet in a keyed join and leave partial sums.

Neither side passes through the driver, and a task holds one block of each side and matrices of at most CELLS numbers.
Every result is made of mergeable parts, so one block and a thousand take the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import BLOCK, block_count, numbered, pack_blocks, tiles
from ..session import durable

# Bytes of a packed block, and numbers of a matrix that a task holds at a time.
TILE_BYTES = 4 * 1024 * 1024
CELLS = 1 << 20
PROBABILITIES = (0.05, 0.95)


class Side:
    """One side of the join: packed blocks and their number."""

    def __init__(self, rows: DataFrame, ids: list[str], arrays: list[str], name: str, limit: int, by: Column | None = None, least: int = 1, cells: int = 1 << 62):
        stored = numbered(rows.select(*ids, *arrays), name)
        kinds = dict(stored.dtypes)
        sizes = [F.size(a) if kinds[a].startswith("array") else F.lit(1) for a in arrays]
        total, width = stored.agg(F.count(F.lit(1)), F.max(sum(sizes, F.lit(0)))).first()
        per_block = max(1, min(limit // (8 * max(1, width or 1)), cells))
        self.count = max(block_count(total, per_block), min(least, block_count(total, 64)))
        schema = ", ".join([f"{BLOCK} long", *[f"`{c}` array<{kinds[c]}>" for c in ids], *[f"`{a}` binary" for a in arrays], "rows long"])

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by([(c, "ascending") for c in ids]).combine_chunks()
            columns = [pa.array([table[BLOCK][0].as_py()])]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[c].chunk(0)) for c in ids]
            for a in arrays:
                chunk = table[a].chunk(0)
                flat = chunk.flatten() if isinstance(chunk, pa.ListArray) else chunk
                columns.append(pa.array([np.asarray(flat, dtype=np.float64).tobytes()], pa.binary()))
            return pa.Table.from_arrays([*columns, pa.array([len(table)])], names=[BLOCK, *ids, *arrays, "rows"])

        self.blocks = pack_blocks(stored, self.count, pack, schema, by)


def bank_side(states: DataFrame, priors: list[str], limit: int | None) -> Side:
    """States packed by candidate, so a candidate's states are never split; inside a block they are ordered by (candidate, state)."""
    return Side(states, ["candidate_id", "state_id"], ["f", "spread", "theta", *priors], "bank", limit or TILE_BYTES, F.col("candidate_id"), cells=CELLS // 16)


def entity_side(entities: DataFrame, ids: list[str], arrays: list[str], limit: int | None) -> Side:
    parallel = entities.sparkSession.sparkContext.defaultParallelism
    return Side(entities, ids, arrays, "entities", limit or TILE_BYTES, least=parallel)


def reduce_tiles(left: Side, bank: Side, function: Callable, schema: str) -> DataFrame:
    """``function(entities, states)`` yields record batches for each pair of blocks; both arguments map a name to a matrix or an id array."""

    def side(batch: pa.RecordBatch, i: int, prefix: str) -> dict:
        n = batch.column(prefix + "rows")[i].as_py()
        out: dict = {"n": n}
        for name in batch.schema.names:
            if name.startswith(prefix) and name[1:] not in (BLOCK, "rows"):
                cell = batch.column(name)[i]
                out[name[1:]] = cell.values if pa.types.is_list(batch.column(name).type) else np.frombuffer(cell.as_py(), dtype=np.float64).reshape(n, -1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from function(side(batch, i, "l"), side(batch, i, "r"))

    return tiles(left.blocks, bank.blocks, left.count, bank.count).mapInArrow(run, schema)


def parts(entities: dict, states: dict, cells: int = CELLS) -> Iterator[slice]:
    """Rows of the entity block in portions whose cost matrix keeps to ``cells`` numbers."""
    step = max(1, cells // max(1, states["n"]))
    for start in range(0, entities["n"], step):
        yield slice(start, min(start + step, entities["n"]))


def squared(rows: np.ndarray, f: np.ndarray) -> np.ndarray:
    return np.maximum((rows * rows).sum(axis=1)[:, None] + (f * f).sum(axis=1)[None, :] - 2.0 * rows @ f.T, 0.0)


def lists(matrix: np.ndarray) -> pa.ListArray:
    """A list column with the rows of a matrix."""
    matrix = np.ascontiguousarray(matrix, dtype=np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def heaviest(logit: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest entries of each row, largest first, equal ones by column."""
    k = min(k, logit.shape[1])
    picked = np.argpartition(-logit, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(logit, picked, axis=1).min(axis=1)
    for row in np.flatnonzero((logit >= edge[:, None]).sum(axis=1) > k):  # ties at the edge: the first columns count
        picked[row] = np.lexsort((np.arange(logit.shape[1]), -logit[row]))[:k]
    picked.sort(axis=1)
    order = np.argsort(-np.take_along_axis(logit, picked, axis=1), axis=1, kind="stable")
    return np.take_along_axis(picked, order, axis=1)


def parameter_grid(states: DataFrame, bins: int = 200) -> list[list[float]]:
    """Per parameter, values of states that cut them into about ``bins`` parts, for bins (previous cut, cut]."""
    width = states.agg(F.max(F.size("theta"))).first()[0] or 0
    shares = [(i + 1) / bins for i in range(bins - 1)]
    if width == 0:
        return []
    row = states.agg(*[F.percentile_approx(F.get("theta", F.lit(i)), shares, 10 * bins).alias(f"g{i}") for i in range(width)]).first()
    return [sorted(set(row[f"g{i}"] or [])) for i in range(width)]


def _histogram(theta: np.ndarray, weights: np.ndarray, grid: list[list[float]]) -> np.ndarray:
    """Weight per bin, for each row of weights and each parameter side by side."""
    out = [np.zeros((len(weights), 0))]
    for column, cuts in enumerate(grid):
        place = np.searchsorted(cuts, theta[:, column], side="left")
        order = np.argsort(place, kind="stable")
        present, starts = np.unique(place[order], return_index=True)
        part = np.zeros((len(weights), len(cuts) + 1))
        part[:, present] = np.add.reduceat(weights[:, order], starts, axis=1)
        out.append(part)
    return np.concatenate(out, axis=1)


def posterior_parts(left: Side, bank: Side, kinds: dict[str, str], variants: list[tuple[str, float, str]], top_k: int, grid: list[list[float]], unseen: bool) -> DataFrame:
    """Partial sums of every (entity, variant, bank block), relative to the block's largest log weight m."""
    top_type = f"array<struct<l:double,state_id:{kinds['state_id']},candidate_id:{kinds['candidate_id']}>>"
    schema = (f"entity_id {kinds['entity_id']}, variant string, m double, s double, s2 double, c2 double, best_state {kinds['state_id']}, "
              f"best_candidate {kinds['candidate_id']}, best_f array<double>, theta array<double>, pred array<double>, oracle double, top {top_type}, hist array<double>")
    names = [c.split(" ", 1)[0] for c in schema.replace(top_type, "x").split(", ")]

    def reduce(entities: dict, states: dict) -> Iterator[pa.RecordBatch]:
        candidates = states["candidate_id"].to_pylist()
        starts = [i for i in range(len(candidates)) if i == 0 or candidates[i] != candidates[i - 1]]
        for part in parts(entities, states):
            cost = squared(entities["fit"][part], states["f"]) + states["spread"].ravel()[None, :]
            n = len(cost)
            oracle = squared(entities["unseen"][part], states["f"]).min(axis=1) if unseen else np.full(n, np.nan)
            for variant, temperature, prior in variants:
                logit = -0.5 * (cost + states[prior].ravel()[None, :]) / temperature
                top = heaviest(logit, top_k)
                best, m = top[:, 0], logit.max(axis=1)
                e = np.exp(logit - m[:, None])
                flat = pa.array(top.ravel())
                cells = pa.StructArray.from_arrays([pa.array(np.take_along_axis(logit, top, axis=1).ravel()), states["state_id"].take(flat), states["candidate_id"].take(flat)], names=["l", "state_id", "candidate_id"])
                chosen = pa.array(best)
                columns = [entities["entity_id"].slice(part.start, n), pa.array([variant] * n), *map(pa.array, (m, e.sum(axis=1), (e * e).sum(axis=1), (np.add.reduceat(e, starts, axis=1) ** 2).sum(axis=1))),
                           states["state_id"].take(chosen), states["candidate_id"].take(chosen), lists(states["f"][best]), lists(e @ states["theta"]), lists(e @ states["f"]), pa.array(oracle),
                           pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * top.shape[1], pa.int32()), cells), lists(_histogram(states["theta"], e, grid))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return reduce_tiles(left, bank, reduce, schema)


def merge_parts(partial: DataFrame, top_k: int) -> DataFrame:
    """Add the partial sums of bank blocks: one small row per entity and block meets in one group."""
    grouped = partial.groupBy("entity_id", "variant").agg(F.collect_list(F.struct(*[c for c in partial.columns if c not in ("entity_id", "variant")])).alias("p"))
    grouped = grouped.withColumn("m", F.array_max(F.transform("p", lambda x: x["m"])))
    grouped = grouped.withColumn("p", F.transform("p", lambda x: x.withField("scale", F.exp(x["m"] - F.col("m")))))

    def scaled(name: str, power: int) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda a, x: a + x[name] * F.pow(x["scale"], F.lit(power)))

    def vector(name: str) -> Column:
        """Sum of the parts' arrays, each scaled: one pass over the parts, array by array."""
        first = F.transform(F.element_at("p", 1)[name], lambda v: v * F.element_at("p", 1)["scale"])
        return F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), first, lambda a, x: F.zip_with(a, x[name], lambda u, v: u + v * x["scale"]))

    best = F.array_min(F.transform("p", lambda x: F.struct((-x["m"]).alias("l"), x["best_state"].alias("best_state"), x["best_candidate"].alias("best_candidate"), x["best_f"].alias("best_f"))))
    ordered = F.array_sort(F.transform(F.flatten(F.transform("p", lambda x: x["top"])), lambda t: F.struct((-t["l"]).alias("l"), t["state_id"].alias("state_id"), t["candidate_id"].alias("candidate_id"))))
    top = F.transform(F.slice(ordered, 1, top_k), lambda t: F.struct((-t["l"]).alias("l"), t["state_id"].alias("state_id"), t["candidate_id"].alias("candidate_id")))
    return grouped.withColumn("b", best).select(
        "entity_id", "variant", "m", vector("hist").alias("hist"), scaled("s", 1).alias("s"), scaled("s2", 2).alias("s2"), scaled("c2", 2).alias("c2"), "b.best_state", "b.best_candidate", "b.best_f",
        vector("theta").alias("theta"), vector("pred").alias("pred"), F.array_min(F.transform("p", lambda x: x["oracle"])).alias("oracle"), top.alias("top"))


def _crossings(grid: list[list[float]], hist: np.ndarray, s: np.ndarray, slots: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Bin in which each quantile lies, and the share of weight below it, per row."""
    offsets = np.cumsum([0, *[len(cuts) + 1 for cuts in grid]])
    bins, below = np.zeros((len(hist), len(slots)), dtype=np.int64), np.zeros((len(hist), len(slots)))
    for j, (i, p) in enumerate(slots):
        share = np.cumsum(hist[:, offsets[i] : offsets[i + 1]], axis=1) / s[:, None]
        over = share > p
        bins[:, j] = np.where(over.any(axis=1), over.argmax(axis=1), len(grid[i]))
        rows = np.flatnonzero(bins[:, j] > 0)
        below[rows, j] = share[rows, bins[rows, j] - 1]
    return bins, below


def solve_quantile(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, below: np.ndarray, cut: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each group, interpolation of the values at cumulative weight p; a group starts at (cut, below), cut may be NaN.

    ``owner`` gives the group of every member; below, cut and p have one entry per group.
    """
    groups = len(below)
    starts = np.flatnonzero(~np.isnan(cut))
    owner, value, weight = np.r_[starts, owner], np.r_[cut[starts], value], np.r_[np.zeros(len(starts)), weight]
    first = np.r_[np.ones(len(starts), dtype=bool), np.zeros(len(owner) - len(starts), dtype=bool)]
    order = np.lexsort((value, ~first, owner))
    owner, value, weight = owner[order], value[order], weight[order]
    heads = np.searchsorted(owner, np.arange(groups))
    sizes = np.searchsorted(owner, np.arange(groups), side="right") - heads
    total = np.cumsum(weight)
    upto = total - np.repeat((total - weight)[np.minimum(heads, len(total) - 1)], sizes) + np.repeat(below, sizes)
    passed = np.bincount(owner, upto < np.repeat(p, sizes), groups).astype(np.int64)
    at = heads + np.minimum(passed, sizes - 1)
    before = np.maximum(at - 1, heads)
    gap = upto[at] - upto[before]
    inside = (passed > 0) & (passed < sizes) & (gap > 0)
    share = np.divide(p - upto[before], gap, out=np.zeros(groups), where=inside)
    return np.where(inside, value[before] + share * (value[at] - value[before]), value[at])


def with_quantiles(merged: DataFrame, entities: DataFrame, bank: Side, kinds: dict[str, str], variants: list[tuple[str, float, str]], grid: list[list[float]], limit: int | None) -> DataFrame:
    """Add q to merged rows: the merged histogram tells the bin of each quantile, and a second pass fetches that bin's states only."""
    slots = [(i, p) for i in range(len(grid)) for p in PROBABILITIES]
    if not slots:
        return merged.drop("hist").withColumn("q", F.lit(None).cast("array<double>"))
    located = merged.select("entity_id", "variant", "m", "s", "hist").join(entities.select("entity_id", "fit"), "entity_id")
    left = entity_side(located, ["entity_id", "variant"], ["fit", "m", "s", "hist"], limit)
    settings = {name: (t, prior) for name, t, prior in variants}

    def members(rows: dict, states: dict) -> Iterator[pa.RecordBatch]:
        bins, below = _crossings(grid, rows["hist"], rows["s"].ravel(), slots)
        places = [np.searchsorted(cuts, states["theta"][:, i], side="left") for i, cuts in enumerate(grid)]
        names = np.array(rows["variant"].to_pylist(), dtype=object)
        for part in parts(rows, states):
            cost = squared(rows["fit"][part], states["f"]) + states["spread"].ravel()[None, :]
            weight = np.empty_like(cost)
            for name, (t, prior) in settings.items():
                own = names[part] == name
                weight[own] = np.exp(-0.5 * (cost[own] + states[prior].ravel()[None, :]) / t - rows["m"][part][own]) / rows["s"][part][own]
            for j, (i, _) in enumerate(slots):
                row, state = np.nonzero(places[i][None, :] == bins[part, j][:, None])
                held, counts = np.unique(row, return_counts=True)
                offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
                at = pa.array(held + part.start)
                yield pa.RecordBatch.from_arrays([
                    rows["entity_id"].take(at), rows["variant"].take(at), pa.array(np.full(len(held), j), pa.int32()), pa.array(bins[part, j][held]), pa.array(below[part, j][held]),
                    pa.ListArray.from_arrays(offsets, pa.array(states["theta"][state, i])), pa.ListArray.from_arrays(offsets, pa.array(weight[row, state]))], names=["entity_id", "variant", "j", "bin", "below", "v", "w"])

    fetched = reduce_tiles(left, bank, members, f"entity_id {kinds['entity_id']}, variant string, j int, bin long, below double, v array<double>, w array<double>")
    gathered = fetched.groupBy("entity_id", "variant", "j").agg(F.first("bin").alias("bin"), F.first("below").alias("below"), F.flatten(F.collect_list("v")).alias("v"), F.flatten(F.collect_list("w")).alias("w"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j, place = np.asarray(batch.column("j")), np.asarray(batch.column("bin"))
            cut = np.array([grid[slots[a][0]][b - 1] if b > 0 else np.nan for a, b in zip(j, place)])
            share = np.array([slots[a][1] for a in j])
            v, w = batch.column("v"), batch.column("w")
            owner = np.repeat(np.arange(len(j)), np.asarray(v.value_lengths()))
            x = solve_quantile(owner, np.asarray(v.flatten()), np.asarray(w.flatten()), np.asarray(batch.column("below")), cut, share)
            yield pa.RecordBatch.from_arrays([batch.column("entity_id"), batch.column("variant"), batch.column("j"), pa.array(x)], names=["entity_id", "variant", "j", "x"])

    solved = gathered.mapInArrow(solve, f"entity_id {kinds['entity_id']}, variant string, j int, x double")
    q = solved.groupBy("entity_id", "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda r: r["x"]).alias("q"))
    return merged.drop("hist").join(q, ["entity_id", "variant"])


def posterior(entities: DataFrame, states: DataFrame, variants: list[tuple[str, float, str]], top_k: int, limit: int | None, quantiles: bool) -> DataFrame:
    keep = [c for c in ("fit", "unseen") if c in entities.columns]
    kinds = {"entity_id": dict(entities.dtypes)["entity_id"], **{c: dict(states.dtypes)[c] for c in ("state_id", "candidate_id")}}
    bank = bank_side(states, sorted({prior for _, _, prior in variants}), limit)
    left = entity_side(entities, ["entity_id"], keep, limit)
    grid = parameter_grid(states) if quantiles else []
    merged = merge_parts(posterior_parts(left, bank, kinds, variants, top_k, grid, "unseen" in keep), top_k)
    if not quantiles:
        return merged.drop("hist").withColumn("q", F.lit(None).cast("array<double>"))
    return with_quantiles(durable(merged), entities, bank, kinds, variants, grid, limit)


def pivots(f: np.ndarray, count: int = 8) -> np.ndarray:
    """Rows far from each other: each next pivot is the row farthest from those before."""
    chosen = [0]
    nearest = squared(f[:1], f)[0]
    while len(chosen) < min(count, len(f)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(f[chosen[-1:]], f)[0])
    return f[chosen]


def nearest(rows: np.ndarray, f: np.ndarray, spread: np.ndarray, extra=None, own: np.ndarray | None = None, count: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Per row: the state with the smallest distance + spread + extra, that total, the part without extra, and the pairs computed.

    The triangle inequality bounds a distance from below by the difference of both ends' distances to a pivot. The state of smallest
    bound gives a total that the best one cannot exceed; only states whose bound does not exceed it are computed, with all
    coordinates. ``extra(row, state)`` is not negative; ``own`` marks pairs to leave out; ties go to the first state.
    """
    marks = pivots(f, count)
    here, there = np.sqrt(squared(rows, marks)), np.sqrt(squared(f, marks))
    bound = np.zeros((len(rows), len(f)))
    for p in range(len(marks)):
        np.maximum(bound, np.abs(here[:, p, None] - there[None, :, p]), out=bound)
    # Distances to pivots carry rounding errors of about the scale times 1e-8; the bounds are lowered by more than that.
    bound = np.maximum(bound - 1e-6 * (1.0 + here.max(axis=1, initial=0.0)[:, None]), 0.0) ** 2 + spread[None, :]
    if own is not None:
        bound[own] = np.inf

    def totals(row: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cost = ((f[state] - rows[row]) ** 2).sum(axis=1) + spread[state]
        return cost if extra is None else cost + extra(row, state), cost

    every = np.arange(len(rows))
    first = bound.argmin(axis=1)
    ceiling = np.where(np.isfinite(bound[every, first]), totals(every, first)[0], -np.inf)
    row, state = np.nonzero(bound <= ceiling[:, None])
    total, cost = np.zeros(len(row)), np.zeros(len(row))
    for a in range(0, len(row), CELLS // 16):
        b = slice(a, a + CELLS // 16)
        total[b], cost[b] = totals(row[b], state[b])
    order = np.lexsort((state, total, row))
    heads = order[np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])] if len(order) else order
    best, least, plain = np.full(len(rows), -1), np.full(len(rows), np.inf), np.full(len(rows), np.inf)
    best[row[heads]], least[row[heads]], plain[row[heads]] = state[heads], total[heads], cost[heads]
    return best, least, plain, len(row)


def nearest_parts(left: Side, bank: Side, kinds: dict[str, str], strength: float, exclude_self: bool) -> DataFrame:
    """(entity_id, candidate_id, total, cost) of the best state of every (entity, bank block)."""

    def reduce(entities: dict, states: dict) -> Iterator[pa.RecordBatch]:
        candidates = states["candidate_id"].to_pylist()
        places: dict = {}
        for i, c in enumerate(candidates):
            places.setdefault(c, []).append(i)
        ids = entities["entity_id"].to_pylist()
        for part in parts(entities, states):
            own = None
            if exclude_self:
                own = np.zeros((part.stop - part.start, states["n"]), dtype=bool)
                for i, entity in enumerate(ids[part]):
                    own[i, places.get(entity, [])] = True

            def extra(row, state, part=part):
                return strength * ((states["theta"][state] - entities["center"][part][row]) ** 2).mean(axis=1)

            best, total, cost, _ = nearest(entities["fit"][part], states["f"], states["spread"].ravel(), extra if strength else None, own)
            found = np.flatnonzero(best >= 0)
            yield pa.RecordBatch.from_arrays([entities["entity_id"].take(pa.array(found + part.start)), states["candidate_id"].take(pa.array(best[found])), pa.array(total[found]), pa.array(cost[found])],
                                             names=["entity_id", "candidate_id", "total", "cost"])

    return reduce_tiles(left, bank, reduce, f"entity_id {kinds['entity_id']}, candidate_id {kinds['candidate_id']}, total double, cost double")


def pair_costs(left: Side, bank: Side, kinds: dict[str, str]) -> DataFrame:
    """(entity_id, state_id, cost) of every pair, written block by block."""

    def pairs(entities: dict, states: dict) -> Iterator[pa.RecordBatch]:
        for part in parts(entities, states, CELLS // 4):
            cost = squared(entities["fit"][part], states["f"]) + states["spread"].ravel()[None, :]
            n, m = cost.shape
            yield pa.RecordBatch.from_arrays([entities["entity_id"].take(pa.array(np.repeat(np.arange(part.start, part.stop), m))), states["state_id"].take(pa.array(np.tile(np.arange(m), n))), pa.array(cost.ravel())],
                                             names=["entity_id", "state_id", "cost"])

    return reduce_tiles(left, bank, pairs, f"entity_id {kinds['entity_id']}, state_id {kinds['state_id']}, cost double")
