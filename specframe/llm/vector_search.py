"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

Vectors become integers floor(scale * x). Rows are dealt into blocks; a block's index holds, per dimension, its rows in
the order of that dimension's value: runs of equal value are the posting segments. For a query q the segment of value v in
dimension j has the impact q[j] * v. Segments are processed by descending quantised size of their impact (levels halve),
each adding its impact to the accumulators of its rows. After a level, what is missing from any accumulator is at most
the sum over dimensions of the largest impact not yet processed; rows whose accumulator plus that bound reaches the k-th
best exact score known so far are the possible members. Levels that leave too much missing for any proof are processed with the
next one, and a level's postings are added in portions that fit a cache. Nothing else can enter the result: processing stops on this proof, once it
leaves out three quarters of the rows, and the possible members are scored exactly. If no early proof comes, all segments
are processed.

Blocks of queries meet blocks of the index by the pair's key (``functions.blocks``); a task holds one block of each. An index
block is copied once per block of queries, so these are small only while that is needed to give every task a pair, and grow
to ``QUERY_MOST`` numbers: the copies then are a small part of the work, which is queries times rows. Each
block gives at most k rows a query, and a window with a group limit keeps the k best.

Defined results. A null vector, or one holding a null, NaN or infinite component, takes no part, neither as query nor as
candidate. A shorter vector counts as padded with zeros, an empty one as all zeros. A component whose integer is beyond
2^27 is an error. A query's own row is left out, and only that: rows repeated under one id are candidates of each other,
and each row of a repeated query id gives its own list. Equal scores go by the smaller id, a null id last. Fewer than k
other rows: all of them. An empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import BLOCK, ROW, block_count, numbered, pack_blocks, task_count, tile_sides

# Numbers in a block of the index, and in a small and the largest block of queries; a row of either stays under 10 MB.
INDEX_CELLS = 1 << 20
QUERY_CELLS, QUERY_MOST = 1 << 14, 1 << 19
# Postings gathered before they are added; their rows and impacts stay in a core's cache.
PORTION = 1 << 15
LIMIT = 1 << 27
FOUND = "query_row long, query_id long, cand_row long, vec_id long, score long"
# The first level is at most this share of the largest impact, and leaves at most this share of what all dimensions together
# can add; before that no proof is tried. Each next one is half of the one before.
FIRST_LEVEL = 0.125
# Processing stops when at most this share of a block's rows is not proved out.
POSSIBLE = 0.25


def integer_vectors(vectors: DataFrame, is_query: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<long>, q boolean) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    slim = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    big = F.exists("v", lambda x: F.abs(x * scale) > LIMIT)
    cells = F.transform("v", lambda x: F.floor(x * scale))
    wrong = F.raise_error(F.lit("a vector component is too large for exact scores")).cast("array<bigint>")
    return slim.select("id", F.when(big, wrong).otherwise(cells).alias("v"), "q")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as int32, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width), dtype=np.int32)
    flat = np.asarray(lists.flatten())
    if len(flat) == len(lists) * width:
        out[:] = flat.reshape(len(lists), width)
    else:
        rows = np.repeat(np.arange(len(lists)), lengths)
        places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, places] = flat
    return out


def _packer(width: int, indexed: bool):
    def pack(table: pa.Table) -> pa.Table:
        matrix = _matrix(table["v"], width)
        columns = [pa.array([table[BLOCK][0].as_py()]), pa.array([table["id"].to_pylist()], pa.list_(pa.int64())), pa.array([table[ROW].to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())]
        if indexed:
            columns.append(pa.array([np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32).tobytes()], pa.binary()))
        return pa.Table.from_arrays(columns, names=[BLOCK, "ids", "rows", "matrix", "postings"][: len(columns)])

    return pack, f"{BLOCK} long, ids array<long>, rows array<long>, matrix binary" + (", postings binary" if indexed else "")


class BlockIndex:
    """Impact-ordered postings of one block, for queries with components of at most ``reach`` in absolute value.

    Numbers are held in a type in which every sum of products is exact: float64, or int64 where that is too narrow.
    """

    def __init__(self, matrix: np.ndarray, postings: np.ndarray, reach: int = LIMIT):
        self.n, self.width = matrix.shape
        self.postings = postings
        values = np.take_along_axis(matrix.T, postings.astype(np.intp), axis=1) if self.n else matrix.T
        # One sorted array for all dimensions: a search in it finds a bound in every dimension at once.
        self.step = np.int64(8 * LIMIT)
        self.keys = (values + self.step * np.arange(self.width)[:, None]).ravel()
        self.extreme = np.abs(values[:, [0, -1]].astype(np.int64)).max(axis=1) if self.n else np.zeros(self.width, dtype=np.int64)
        most = self.width * int(self.extreme.max(initial=0)) * reach
        self.kind = np.float64 if most < 1 << 53 else np.int64
        self.matrix, self.values = matrix.astype(self.kind), values.astype(self.kind)
        # Postings and their impacts, gathered here for one addition. Kept from query to query, as new memory costs more.
        self.rows, self.impacts = np.empty(PORTION + self.n, dtype=np.intp), np.empty(PORTION + self.n, dtype=self.kind)

    def _missing(self, q: np.ndarray, dims: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
        """The most that postings ``low`` to ``high`` of every dimension, those not yet processed, can add to one row."""
        end = np.where(q > 0, high - 1, np.minimum(low, self.n - 1))
        return int(np.where(low < high, np.maximum(q * self.values[dims, end], 0), 0).sum())

    def top(self, query: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and exact scores of all possible members of the k best, and the number of postings processed."""
        q = query.astype(self.kind)
        dims = np.flatnonzero((query != 0) & (self.extreme > 0))
        size = np.abs(query[dims]).astype(np.int64)
        largest = size * self.extreme[dims]

        def scored(rows: np.ndarray) -> np.ndarray:
            return (self.matrix[rows] @ q).astype(np.int64)

        def add(taken: int) -> None:
            if self.kind == np.int64:
                np.add.at(acc, self.rows[:taken], self.impacts[:taken])
            elif taken:
                acc[:] += np.bincount(self.rows[:taken], self.impacts[:taken], self.n)

        if self.n <= k + 1 or not len(dims):
            others = np.arange(self.n)
            others = others[others != own]
            return others, scored(others), 0
        acc = np.zeros(self.n, dtype=self.kind)
        base, starts = self.step * dims, self.n * dims
        low, high = np.zeros(len(dims), dtype=np.int64), np.full(len(dims), self.n)
        everything = self._missing(q[dims], dims, low, high)
        level, floor = max(1, int(largest.max() * FIRST_LEVEL)), None
        while True:
            bound = np.minimum(-(-level // size), 2 * LIMIT)
            new_low = np.maximum(low, np.searchsorted(self.keys, base - bound, side="right") - starts)
            new_high = np.minimum(high, np.searchsorted(self.keys, base + bound, side="left") - starts)
            missing = self._missing(q[dims], dims, new_low, new_high)
            if level > 1 and missing > FIRST_LEVEL * everything:
                level = max(1, level // 2)
                continue
            taken = 0
            for of, j, *ends in zip(q[dims], dims.tolist(), low.tolist(), new_low.tolist(), new_high.tolist(), high.tolist()):
                for a, b in (ends[:2], ends[2:]):
                    if a < b:
                        upto = taken + b - a
                        self.rows[taken:upto] = self.postings[j, a:b]
                        np.multiply(self.values[j, a:b], of, out=self.impacts[taken:upto])
                        taken = upto
                        if taken >= PORTION:
                            add(taken)
                            taken = 0
            add(taken)
            low, high = new_low, new_high
            if own >= 0:
                acc[own] = -np.inf if self.kind != np.int64 else np.iinfo(np.int64).min // 2
            best = np.argpartition(acc, self.n - k)[self.n - k :]
            exact = int(scored(best).min())
            floor = exact if floor is None else max(floor, exact)
            possible = np.flatnonzero(acc >= floor - missing)
            if level == 1 or len(possible) <= POSSIBLE * self.n:
                possible = possible[possible != own]
                return possible, scored(possible), int((low + self.n - high).sum())
            level = max(1, level // 2)


def _search(k: int, width: int):
    kinds = ["query_row", "query_id", "cand_row", "vec_id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # no query at all, or no vector
            return pa.table({name: pa.array([], pa.int64()) for name in kinds})
        ids, rows = right["rids"][0].as_py(), np.array(right["rrows"][0].as_py(), dtype=np.int64)
        present = np.array([x is not None for x in ids])
        ids = np.array([x if x is not None else np.iinfo(np.int64).max for x in ids], dtype=np.int64)
        queries = np.frombuffer(left["lmatrix"][0].as_buffer(), dtype=np.int32).reshape(-1, width)
        reach = int(max(-queries.min(initial=0).astype(np.int64), queries.max(initial=0)))
        matrix, postings = (np.frombuffer(right[name][0].as_buffer(), dtype=np.int32) for name in ("rmatrix", "rpostings"))
        index = BlockIndex(matrix.reshape(-1, width), postings.reshape(width, -1), reach)
        place = {row: n for n, row in enumerate(rows.tolist())}
        out: list[tuple] = []
        for query_id, query_row, q in zip(left["lids"][0].as_py(), left["lrows"][0].as_py(), queries):
            members, scores, _ = index.top(q, k, place.get(query_row, -1))
            order = np.lexsort((members, ids[members], ~present[members], -scores))[:k]
            best = members[order]
            out.append((np.full(len(best), query_row), [query_id] * len(best), rows[best], ids[best], ~present[best], scores[order]))
        query_row, cand_row, vec_id, missing, score = (np.concatenate([x[n] for x in out]) for n in (0, 2, 3, 4, 5))
        query_id = pa.array([x for part in out for x in part[1]], pa.int64())
        return pa.Table.from_arrays([pa.array(query_row, pa.int64()), query_id, pa.array(cand_row, pa.int64()), pa.array(vec_id, pa.int64(), mask=missing), pa.array(score, pa.int64())], names=kinds)

    return run


def query_block_count(queries: int, width: int, index_blocks: int, tasks: int) -> int:
    """As many blocks of queries as give each task a pair, none below the small size, and more only so that none exceeds the largest."""
    small, large = (block_count(queries, max(16, cells // width)) for cells in (QUERY_CELLS, QUERY_MOST))
    return max(large, min(small, block_count(tasks, index_blocks)))


def exact_top(vectors: DataFrame, is_query: Column, k: int, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (1 is best), vec_id, score: for every row that ``is_query`` marks, the k best of all other rows."""
    stored = numbered(integer_vectors(vectors, is_query, scale, id_col, vector_col), "vectors")
    total, asked, width = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    index_blocks = block_count(total, max(256, INDEX_CELLS // width))
    query_blocks = query_block_count(asked, width, index_blocks, task_count(vectors.sparkSession))
    index = pack_blocks(stored.drop("q"), index_blocks, *_packer(width, True))
    queries = pack_blocks(stored.where("q").drop("q"), query_blocks, *_packer(width, False))
    left, right = tile_sides(queries, index, query_blocks, index_blocks)
    found = left.groupBy("_tile").cogroup(right.groupBy("_tile")).applyInArrow(_search(k, width), FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "cand_row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
