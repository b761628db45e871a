"""Trie of conversation prefixes from sorted LCPs and range minima.

Every conversation c is rebuilt first: the first h turns of conversation c - c % 5 (all if it has fewer, none if absent),
then c's own turns after its first h, with h = crc32(decimal c) % 9. A node is a distinct sequence of the first d turns.

Steps. A turn becomes a fingerprint (128 bits of a SHA-256 over role and text) and the byte length of its text; texts go no further.
Rebuilt conversations are cut into segments of SEGMENT turns; all conversations with the same turns before a segment form a
group, known by a sum of position-bound hashes, and each group is a trie of its own whose root is a node of the segment
before. So rows are of bounded size however long a conversation is. Segments are range-sorted by (group, fingerprints), which puts
the members of every node side by side; a partition of the sorted rows is a block. Neighbours give the LCP array.

Inside a block a sparse table holds minima of the LCPs. Each candidate prefix (row i, depth d) binary-searches the first
row to the right, and independently the last row to the left, whose LCP is below d. A search that leaves the block goes on in a
sparse table over the minima of whole blocks and ends at a place known per block and depth (at most SEGMENT + 1 places, as LCPs
are bounded). Counts, bytes and leaves of a node are differences of prefix sums at its ends, smallest members range minima.
What a conversation adds in its later segments is summed up per conversation first.

What is broadcast is one summary row of about 72 x (SEGMENT + 1) bytes a block, with at most MAX_BLOCKS blocks. Positions, prefix hashes
and later sums are running sums over range partitions, so a conversation with a third of all turns is never one task. The ids whose
conversations end in one node stream through one task in order, since SHA-256 is sequential; memory there stays constant.

Defined results. Null role or text is empty. Turns are ordered by number, null first, then by fingerprint; repeated rows are
turns of their own. Rows without a conversation id belong to no conversation. A conversation whose rebuilt form has no turn is a
member of the root. An empty table has no root and gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_running
from ..session import durable, stage_path

SEGMENT = 32
BLOCK_ROWS = 50_000
MAX_BLOCKS = 16_384
HEAD = 8
EMPTY = hashlib.sha256(b"").hexdigest()
LARGEST = np.iinfo(np.int64).max
NODES = "left long, ends boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
LINKED = "block long, idx long, c long, seg long, end boolean, many boolean, lcp int, sizes array<long>, total long, owned long, leaf long, child long"


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 9


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos from 1, fp hex, size) of every turn."""
    speaker, said = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    print_ = F.substring(F.sha2(F.concat(F.length(speaker).cast("string"), F.lit(":"), speaker, said).cast("binary"), 256), 1, 32)
    slim = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"), print_.alias("fp"), F.octet_length(said).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    return global_running(slim, [F.col("turn").asc_nulls_first(), F.col("fp"), F.col("row")], {}, ["c"], "pos").select("c", "pos", "fp", "size")


def _rebuilt(turns: DataFrame, segment: int) -> DataFrame:
    """One row per conversation and segment: c, seg, length (of the conversation), end (it ends here), t (its turns in order).

    A conversation that fills its last segment also gets an empty one after it, so that all members of the node at the
    border are in the next group.
    """
    first = F.array_sort(F.collect_list(F.when(F.col("pos") <= HEAD, F.struct("pos", "fp", "size"))))
    own = turns.groupBy("c").agg(F.max("pos").alias("n"), first.alias("head"))
    base = own.select(F.col("c").alias("b"), F.col("head").alias("base"))
    h = head_length(F.col("c"))
    joined = own.drop("head").join(base, F.col("b") == F.col("c") - F.col("c") % 5, "left").withColumn("h", h)
    taken = F.least(F.col("h"), F.coalesce(F.size("base"), F.lit(0))).cast("int")
    taken = F.when(F.col("base").isNull(), F.lit(0)).otherwise(taken)
    meta = joined.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    meta = durable(meta.select("c", "taken", "length", F.when(F.col("taken") > 0, F.slice("base", F.lit(1), F.greatest(F.col("taken"), F.lit(1)))).alias("head")))
    tail = turns.where(F.col("pos") > h).join(meta.select("c", "taken", "length"), "c")
    tail = tail.select("c", "length", (F.col("taken") + F.col("pos") - h).alias("q"), "fp", "size")
    heads = meta.where(F.col("taken") > 0).select("c", "length", F.explode("head").alias("x")).select("c", "length", F.col("x.pos").alias("q"), "x.fp", "x.size")
    placed = tail.unionByName(heads).withColumn("seg", F.floor((F.col("q") - 1) / segment)).withColumn("end", F.lit(False))
    last, after = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / segment), F.floor(F.col("length") / segment)
    marks = meta.select("c", "length", last.alias("last"), F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), last, after))).alias("seg"))
    marks = marks.select("c", "length", F.lit(None).cast("long").alias("q"), F.lit(None).cast("string").alias("fp"), F.lit(None).cast("long").alias("size"), "seg", (F.col("seg") == F.col("last")).alias("end"))
    turn = F.when(F.col("q").isNotNull(), F.struct("q", "fp", "size"))
    return placed.unionByName(marks).groupBy("c", "seg").agg(F.max("length").alias("length"), F.max("end").alias("end"), F.array_sort(F.collect_list(turn)).alias("t"))


def _grouped(segments: DataFrame, segment: int) -> DataFrame:
    """c, seg, end, many (more than one segment), key (fingerprints), sizes, and the group (seg, g1, g2)."""
    hexes = F.array_join(F.transform("t", lambda x: x["fp"]), "")
    rows = segments.select("c", "seg", "end", (F.col("length") >= segment).alias("many"), F.unhex(hexes).alias("key"), F.transform("t", lambda x: x["size"]).alias("sizes"))
    mixed = F.sha2(F.concat(F.col("seg").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("key")), 256)
    part = lambda start: F.conv(F.substring(mixed, start, 15), 16, 10).cast("decimal(20,0)")
    long = rows.where("many").withColumn("h1", part(1)).withColumn("h2", part(16))
    long = global_running(long, [F.col("seg")], {"s1": "h1", "s2": "h2"}, ["c"], "_n")
    before = lambda s, h: ((F.col(s) - F.col(h)) % F.lit(1 << 60).cast("decimal(20,0)")).cast("long")
    columns = ["c", "seg", "end", "many", "key", "sizes"]
    long = long.select(*columns, before("s1", "h1").alias("g1"), before("s2", "h2").alias("g2"))
    zero = F.lit(0).cast("long")
    return durable(rows.where(~F.col("many")).select(*columns, zero.alias("g1"), zero.alias("g2")).unionByName(long))


def _sorted(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows in trie order, stored, with block and idx; the number of blocks."""
    count = rows.count()
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(MAX_BLOCKS, max(math.ceil(count / BLOCK_ROWS), min(wanted, math.ceil(count / 500)), 1))
    # Among equal keys the conversations that end come first, in the order of their ids.
    keys = [F.col("seg"), F.col("g1"), F.col("g2"), F.col("key"), ~F.col("end"), F.col("c")]
    placed = rows.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys).withColumn("m", F.monotonically_increasing_id())
    place = {"block": F.shiftright("m", 33), "idx": F.col("m").bitwiseAND(F.lit((1 << 33) - 1))}
    return durable(placed.withColumns(place).drop("m")), blocks


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks, one after the other, from batches ordered by block."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        blocks = np.asarray(table["block"])
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0]["block"][0].as_py() != int(blocks[a]):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _shared_turns(a: tuple, b: tuple) -> int:
    """LCP of two sorted rows (seg, g1, g2, key): -1 in different groups, else in turns."""
    if a[:3] != b[:3]:
        return -1
    x, y = bytes(a[3]), bytes(b[3])
    n = min(len(x), len(y)) // 16
    return next((i for i in range(n) if x[16 * i : 16 * i + 16] != y[16 * i : 16 * i + 16]), n)


def _linked(ordered: DataFrame, segment: int) -> DataFrame:
    """LCP with the row before, bytes and leaves that the row is the first or last to show; fingerprints are dropped."""
    key = F.struct("seg", "g1", "g2", "key")
    ends = ordered.groupBy("block").agg(F.min_by(key, "idx").alias("first"), F.max_by(key, "idx").alias("last"))
    borders, previous = {}, None
    for r in sorted(ends.collect(), key=lambda r: r["block"]):  # one row a block
        shared = -1 if previous is None else _shared_turns(tuple(previous["last"]), tuple(r["first"]))
        borders[r["block"]] = [shared, -1]
        if previous is not None:
            borders[previous["block"]][1] = shared
        previous = r
    told = ordered.sparkSession.sparkContext.broadcast(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _collected(batches):
            n = len(table)
            sizes = table["sizes"].chunk(0)
            lengths = np.asarray(sizes.value_lengths()).astype(np.int64)
            flat = np.asarray(sizes.flatten())
            rows = np.repeat(np.arange(n), lengths)
            depth = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            prints = np.zeros((n, segment, 2), dtype=np.uint64)
            prints[rows, depth] = np.frombuffer(b"".join(table["key"].to_pylist()), dtype=np.uint64).reshape(-1, 2)
            group = np.stack([np.asarray(table[x]) for x in ("seg", "g1", "g2")])
            lcp = np.full(n, borders_of(table)[0], dtype=np.int64)
            same = (prints[1:] == prints[:-1]).all(axis=2)
            lcp[1:] = np.minimum(np.logical_and.accumulate(same, axis=1).sum(axis=1), np.minimum(lengths[1:], lengths[:-1]))
            lcp[1:][(group[:, 1:] != group[:, :-1]).any(axis=0)] = -1
            following = np.r_[lcp[1:], borders_of(table)[1]]
            total = np.bincount(rows, flat, n).astype(np.int64)
            owned = np.bincount(rows, np.where(depth >= np.maximum(lcp, 0)[rows], flat, 0), n).astype(np.int64)
            end, seg = np.asarray(table["end"]), group[0]
            leaf = (end & (following < lengths)).astype(np.int64)
            child = ((seg > 0) & (lengths > 0) & (lcp <= 0)).astype(np.int64)
            columns = [*[table[x].chunk(0) for x in ("block", "idx", "c", "seg", "end", "many")], pa.array(lcp, pa.int32()), sizes, *map(pa.array, (total, owned, leaf, child))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in LINKED.split(", ")])

    def borders_of(table: pa.Table) -> list[int]:
        return told.value[table["block"][0].as_py()]

    return durable(ordered.mapInArrow(run, LINKED))


def _with_later(linked: DataFrame, blocks: int) -> DataFrame:
    """Adds, per row, what its conversation shows in later segments, and the children that the next segment adds at the border."""
    long = linked.where("many").select("c", "seg", "total", "owned", "leaf", "child")
    sums = {"t": "total", "o": "owned", "l": "leaf"}
    running = global_running(long, [F.desc("seg")], sums, ["c"], "_n")
    later = running.select("c", "seg", *[(F.col(k) - F.col(v)).alias(k) for k, v in sums.items()], F.lit(0).cast("long").alias("next"))
    zero = F.lit(0).cast("long")
    border = long.where(F.col("seg") > 0).select("c", (F.col("seg") - 1).alias("seg"), zero.alias("t"), zero.alias("o"), zero.alias("l"), F.col("child").alias("next"))
    extra = later.unionByName(border).groupBy("c", "seg").agg(*[F.sum(x).alias(x) for x in ("t", "o", "l", "next")])
    joined = linked.drop("many", "child").join(extra, ["c", "seg"], "left").fillna(0, ["t", "o", "l", "next"])
    return durable(joined.repartition(blocks, "block").sortWithinPartitions("block", "idx"))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of all windows of 2^k values."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half, low = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(low[:-half], low[half:]))
    return levels


def range_min(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum over [a, b) for each pair; the largest number where that is empty."""
    out = np.full(len(a), LARGEST)
    span = b - a
    some = np.flatnonzero(span > 0)
    level = np.frexp(span[some].astype(float))[1] - 1
    for k in np.unique(level):
        pick = some[level == k]
        out[pick] = np.minimum(levels[k][a[pick]], levels[k][b[pick] - (1 << int(k))])
    return out


def first_below(levels: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each candidate, the first place >= start whose value is below depth (or the length)."""
    place, n = start.copy(), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(place + (1 << k) <= n)
        step = fits[levels[k][place[fits]] >= depth[fits]]
        place[step] += 1 << k
    return place


def last_below(levels: list[np.ndarray], stop: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each candidate, the last place < stop whose value is below depth (or -1)."""
    place = stop.copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(place - (1 << k) >= 0)
        step = fits[levels[k][place[fits] - (1 << k)] >= depth[fits]]
        place[step] -= 1 << k
    return place - 1


SUMS = ("total", "owned", "leaf", "next")


class Block:
    """Arrays of one block of sorted rows."""

    def __init__(self, table: pa.Table, segment: int):
        get = lambda name: np.asarray(table[name]).astype(np.int64)
        self.number, self.n, self.segment = table["block"][0].as_py(), len(table), segment
        self.c, self.seg, self.lcp, self.own = get("c"), get("seg"), get("lcp"), get("owned")
        self.end, self.bytes = np.asarray(table["end"]), get("total")
        sizes = table["sizes"].chunk(0)
        self.lengths = np.asarray(sizes.value_lengths()).astype(np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.r_[0, np.cumsum(np.asarray(sizes.flatten()))].astype(np.int64)
        added = {"total": self.bytes + get("t"), "owned": self.own + get("o"), "leaf": get("leaf") + get("l"), "next": get("next")}
        self.sums = {k: np.r_[0, np.cumsum(v)] for k, v in added.items()}
        self.lows, self.ids = sparse_table(self.lcp), sparse_table(self.c)
        # Rows that branch off at depth d, in order, for each d.
        self.branches = [np.flatnonzero((self.lcp == d) & (self.lengths > d)) for d in range(segment + 1)]

    def branched(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Number of rows before each place that branch off at its depth."""
        out = np.zeros(len(place), dtype=np.int64)
        for d in np.unique(depth):
            at = depth == d
            out[at] = np.searchsorted(self.branches[d], place[at])
        return out

    def summary(self) -> dict[str, list]:
        depth = np.arange(self.segment + 1)
        right = first_below(self.lows, np.zeros(len(depth), np.int64), depth)
        left = last_below(self.lows, np.full(len(depth), self.n), depth)
        zero, full = np.zeros(len(depth), np.int64), np.full(len(depth), self.n)
        out = {"right": right, "left": left, "before": range_min(self.ids, zero, right), "after": range_min(self.ids, np.maximum(left, 0), full),
               "cut": self.branched(right, depth), "all": self.branched(full, depth), "size": np.array([self.n, self.lcp.min(), self.c.min()])}
        for k in SUMS:
            out[k] = np.r_[self.sums[k][right], self.sums[k][-1]]
        return {k: v.tolist() for k, v in out.items()}


class Frame:
    """What all blocks know about each other: offsets, sums before each block, and sparse tables over whole blocks."""

    def __init__(self, rows: dict[int, dict[str, list]]):
        numbers = sorted(rows)
        self.place = {b: i for i, b in enumerate(numbers)}
        stack = lambda name: np.array([rows[b][name] for b in numbers], dtype=np.int64)
        size = stack("size")
        self.offset = np.r_[0, np.cumsum(size[:, 0])]
        self.lows, self.ids = sparse_table(size[:, 1]), sparse_table(size[:, 2])
        edge = lambda x: np.concatenate([x, x[-1:]])
        self.right, self.left, self.before, self.after = (edge(stack(x)) for x in ("right", "left", "before", "after"))
        self.right[-1], self.before[-1] = 0, LARGEST
        every = stack("all")
        self.branch_base = np.concatenate([np.zeros((1, every.shape[1]), np.int64), np.cumsum(every, axis=0)])
        self.cut = edge(stack("cut"))
        self.cut[-1] = 0
        self.base, self.at = {}, {}
        for k in SUMS:
            x = stack(k)
            self.base[k] = np.r_[0, np.cumsum(x[:, -1])]
            self.at[k] = edge(x[:, :-1])
            self.at[k][-1] = 0

    def extents(self, block: Block, row: np.ndarray, depth: np.ndarray) -> dict[str, np.ndarray]:
        """For each candidate prefix: left and right end (global, right exclusive), smallest member, and sums and branches up to the right end."""
        here = self.place[block.number]
        stop, start = first_below(block.lows, row + 1, depth), last_below(block.lows, row + 1, depth)
        out_right, out_left = stop == block.n, start < 0
        low = range_min(block.ids, np.maximum(start, 0), stop)
        right, left = self.offset[here] + stop, self.offset[here] + start
        upto = {k: self.base[k][here] + block.sums[k][stop] for k in SUMS}
        branches = self.branch_base[here][depth] + block.branched(stop, depth)
        far = np.flatnonzero(out_right)
        if len(far):
            d, own = depth[far], np.full(len(far), here + 1)
            there = first_below(self.lows, own, d)
            right[far] = self.offset[there] + self.right[there, d]
            low[far] = np.minimum(low[far], np.minimum(range_min(self.ids, own, there), self.before[there, d]))
            for k in SUMS:
                upto[k][far] = self.base[k][there] + self.at[k][there, d]
            branches[far] = self.branch_base[there, d] + self.cut[there, d]
        far = np.flatnonzero(out_left)
        if len(far):
            d, own = depth[far], np.full(len(far), here)
            there = last_below(self.lows, own, d)
            left[far] = self.offset[there] + self.left[there, d]
            low[far] = np.minimum(low[far], np.minimum(range_min(self.ids, there + 1, own), self.after[there, d]))
        return {"left": left, "right": right, "low": low, "branches": branches, **upto}

    def nodes(self, block: Block) -> pa.RecordBatch:
        """The nodes that start at rows of the block."""
        here = self.place[block.number]
        known = np.maximum(block.lcp, 0)  # depth of the deepest prefix shared with the row before: the parent of the first own node
        known[(block.lcp < 0) & (block.seg == 0)] = -1  # the root has no parent
        from_depth = np.maximum(known, 0)
        many = block.lengths - from_depth + 1
        row = np.repeat(np.arange(block.n), many)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + from_depth[row]
        found = self.extents(block, row, depth)
        node = np.flatnonzero(depth > known[row])
        r, d = row[node], depth[node]
        x = {k: v[node] for k, v in found.items()}
        above = np.maximum(node - 1, 0)
        start = lambda k: self.base[k][here] + block.sums[k][r]
        deeper = block.flat[block.offsets[r] + np.maximum(d - 1, 0)] - block.flat[block.offsets[r]]  # bytes above the node in this segment
        convs = x["right"] - x["left"]
        branches = x["branches"] - (self.branch_base[here][d] + block.branched(r + 1, d))
        children = (block.lengths[r] > d) + branches + np.where(d == block.segment, x["next"] - start("next"), 0)
        shown = x["total"] - start("total") - convs * deeper
        distinct = x["owned"] - start("owned") - block.own[r] + block.bytes[r] - deeper
        root = (d == 0)
        columns = [pa.array(x["left"]), pa.array(block.end[r] & (block.lengths[r] == d)), pa.array(x["low"]), pa.array(block.seg[r] * block.segment + d),
                   pa.array(found["low"][above], mask=root), pa.array(convs), pa.array(children.astype(np.int64)), pa.array(x["leaf"] - start("leaf")), pa.array(shown - distinct)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODES.split(", ")])

    def endings(self, block: Block) -> pa.RecordBatch:
        row = np.flatnonzero(block.end)
        left = self.extents(block, row, block.lengths[row])["left"]
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(block.c[row])], names=["left", "c"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the joined ids of each node, from rows ordered by (left, c)."""
    current, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        lefts, ids = np.asarray(batch.column(0)), batch.column(1)
        cuts = [0, *(np.flatnonzero(lefts[1:] != lefts[:-1]) + 1).tolist(), len(lefts)] if len(lefts) else []
        for a, b in zip(cuts, cuts[1:]):
            text = ",".join(map(str, ids[a:b].to_pylist())).encode()
            if lefts[a] == current:
                digest.update(b"," + text)
                continue
            if current is not None:
                done.append((current, digest.hexdigest()))
            current, digest = int(lefts[a]), hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["left", "ends_sha256"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([digest.hexdigest()])], names=["left", "ends_sha256"])


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark, segment = conversations.sparkSession, SEGMENT
    rows = _grouped(_rebuilt(_turns(conversations, conv_col, turn_col, role_col, text_col), segment), segment)
    ordered, blocks = _sorted(rows)
    ready = _with_later(_linked(ordered, segment), blocks)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _collected(batches):
            block = Block(table, segment)
            own = block.summary()
            yield pa.RecordBatch.from_arrays([pa.array([block.number]), *[pa.array([v], pa.list_(pa.int64())) for v in own.values()]], names=["block", *own])

    names = ["right", "left", "before", "after", "cut", "all", "size", *SUMS]
    known = ready.mapInArrow(summaries, "block long, " + ", ".join(f"`{x}` array<long>" for x in names)).collect()  # one row a block
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not known:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in columns[:-1]) + ", ends_sha256 string")
    frame = spark.sparkContext.broadcast(Frame({r["block"]: {x: r[x] for x in names} for r in known}))

    def each(function):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _collected(batches):
                yield function(frame.value, Block(table, segment))

        return run

    path = stage_path(spark, "trie-nodes")
    ready.mapInArrow(each(Frame.nodes), NODES).write.parquet(path)
    nodes = spark.read.parquet(path)
    endings = ready.mapInArrow(each(Frame.endings), "left long, c long")
    digests = endings.repartition("left").sortWithinPartitions("left", "c").mapInArrow(_digests, "left long, ends_sha256 string")
    with_ends = nodes.where("ends").join(digests, "left").select(*columns)
    return with_ends.unionByName(nodes.where("NOT ends").withColumn("ends_sha256", F.lit(EMPTY)).select(*columns))
