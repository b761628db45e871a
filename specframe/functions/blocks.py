"""Blocked joins: two sides packed into rows of bounded size, and one task step per pair of blocks.

Where every row of one side has to meet every row of the other (queries and vectors, entities and a bank of states), the
rows are first dealt into numbered blocks of at most a given number of rows. A pair of blocks is then one row of a keyed
join, so executors hold two blocks at a time whatever the sizes of the sides, and nothing passes through the driver but
row counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import SMALL_ROWS, durable, stage_path

BLOCK, ROW = "_block", "_row"


def block_count(rows: int, rows_per_block: int) -> int:
    return max(1, math.ceil(rows / rows_per_block))


SLICES = 16


def beside(rows: DataFrame, facts: DataFrame, keys: list[str], along: str, limit: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per ``keys``), without moving ``rows`` if facts are few.

    Facts are stored and counted. Up to ``limit`` rows they are broadcast; beyond, both sides meet by key, each key dealt over
    slices of the whole-number column ``along``, so one with very many rows is not one task.
    """
    stored = durable(facts)
    if stored.count() <= (SMALL_ROWS if limit is None else limit):
        return rows.join(F.broadcast(stored), keys)
    sliced = rows.withColumn("_slice", F.coalesce(F.pmod(F.col(along), F.lit(SLICES)), F.lit(0)).cast("int"))
    copies = stored.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return sliced.join(copies, [*keys, "_slice"]).drop("_slice")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` into all of the session's shuffle partitions, where few bytes become many rows or much work.

    The adaptive planner merges partitions by the bytes they hold, down to one a core; a given number of partitions it leaves alone.
    A join or group by the same keys takes them as they lie.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table with a unique number ``_row`` beside every row, whatever its ids."""
    path = stage_path(df.sparkSession, name)
    df.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def pack_blocks(stored: DataFrame, blocks: int, pack: Callable, schema: str, by: Column | None = None) -> DataFrame:
    """``blocks`` numbered rows, each made by ``pack`` (pyarrow table -> pyarrow table of one row) from its share of ``stored``.

    Rows are dealt by a hash of their number (``_row``, see ``numbered``), so equal or missing ids do not gather; ``by`` deals
    them by a key instead, for keys with few rows each. ``pack`` sees ``_block`` beside the columns of ``stored``. The result is stored.
    """
    place = F.pmod(F.xxhash64(F.col(ROW) if by is None else by), F.lit(blocks)).cast("long")
    return durable(stored.withColumn(BLOCK, place).groupBy(BLOCK).applyInArrow(pack, schema))


# Most tiles that are dealt to a partition on average, whatever their number: a partition's bytes follow the blocks' size.
TILES_EACH = 8


def task_count(spark: SparkSession) -> int:
    """Tasks for work that is small in bytes and large in arithmetic: the shuffle partitions, or the cores several times over."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def tile_sides(left: DataFrame, right: DataFrame, left_blocks: int, right_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of every pair of blocks, dealt by the pair's key ``_tile``: columns of ``left`` prefixed ``l``, of ``right`` ``r``.

    Each block (``_block`` on both sides) is copied once per block of the other side. The number of partitions is given, as the planner
    would merge them by their bytes, and grows with the pairs, so a partition holds a few blocks however many there are.
    """
    wanted, pairs = task_count(left.sparkSession), left_blocks * right_blocks
    parts = max(1, min(pairs, wanted), math.ceil(pairs / TILES_EACH))
    a = left.select(*[F.col(c).alias("l" + c) for c in left.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(right_blocks - 1).cast("long"))).alias("_other"))
    b = right.select(*[F.col(c).alias("r" + c) for c in right.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(left_blocks - 1).cast("long"))).alias("_this"))
    a = a.select(*a.columns[:-1], (F.col("l" + BLOCK) * right_blocks + F.col("_other")).alias("_tile")).repartition(parts, "_tile")
    b = b.select(*b.columns[:-1], (F.col("_this") * right_blocks + F.col("r" + BLOCK)).alias("_tile")).repartition(parts, "_tile")
    return a, b


def tiles(left: DataFrame, right: DataFrame, left_blocks: int, right_blocks: int) -> DataFrame:
    """One row per pair of blocks, joined from ``tile_sides``."""
    a, b = tile_sides(left, right, left_blocks, right_blocks)
    return a.join(b, "_tile")
