"""Principal components of many rows from a tree of QR factors.

The rows [1, x] of a block are reduced to their triangular factor. Factors are stacked and reduced again, ``FAN`` at a
time, until one is left, so a task never holds more than ``FAN`` factors of (coordinates + 1)^2 numbers, whatever the
number of rows, and no covariance matrix is formed: small components keep their digits. The first row of the last factor
holds the mean; what is right of and below it is the factor of the centred rows, whose right singular vectors are the
components. They are found in the task of the last factor, and leave it as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packing import declared_axis
from ..session import small_side
from .features import pack

FAN = 8
BLOCK_ROWS = 2048
_FACTOR = "node long, height long, width long, factor binary"


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _numbers(height: int, width: int, factor: bytes) -> np.ndarray:
    return np.frombuffer(factor, dtype=np.float64).reshape(height, width)


def _first_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One factor per partition that has rows; rows are taken in blocks."""
    own = None
    for batch in batches:
        for low in range(0, len(batch), BLOCK_ROWS):
            part = batch.slice(low, BLOCK_ROWS)
            values = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            if not np.isfinite(values).all():
                raise ValueError("principal components need finite values")
            rows = np.column_stack([np.ones(len(part)), values])
            own = _triangle(rows if own is None else np.vstack([own, rows]))
    if own is not None:
        yield pa.RecordBatch.from_pylist([{"node": TaskContext.get().partitionId(), "height": own.shape[0], "width": own.shape[1], "factor": own.tobytes()}],
                                         schema=pa.schema([("node", pa.int64()), ("height", pa.int64()), ("width", pa.int64()), ("factor", pa.binary())]))


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [_numbers(r.height, r.width, r.factor) for r in pdf.sort_values("node").itertuples()]
    own = parts[0] if len(parts) == 1 else _triangle(np.vstack(parts))
    return pd.DataFrame([(pdf["parent"].iloc[0], own.shape[0], own.shape[1], np.ascontiguousarray(own).tobytes())], columns=["node", "height", "width", "factor"])


def factor(packed: DataFrame, column: str, partitions: int) -> DataFrame:
    """One row with the triangular factor of [1, rows]; no row for an empty table. ``column`` holds arrays of one length."""
    factors = packed.select(column).repartition(partitions).mapInArrow(_first_factors, _FACTOR)
    while partitions > 1:
        partitions = -(-partitions // FAN)
        factors = factors.withColumn("parent", F.floor(F.col("node") / FAN)).groupBy("parent").applyInPandas(_merged, _FACTOR)
    return factors


def components(packed: DataFrame, column: str, k: int, partitions: int = 64) -> DataFrame:
    """(comp, coord_index, loading, mean, width): the first ``k`` components, each with its largest absolute loading positive.

    At most rows - 1 components exist; ``width`` is the number of coordinates.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                own = _numbers(r.height, r.width, r.factor)
                if own.shape[0] < 2:
                    continue
                _, _, right = np.linalg.svd(own[1:, 1:], full_matrices=False)
                right = right[:k]
                pivot = np.sign(right[range(len(right)), np.abs(right).argmax(axis=1)])
                right = right * np.where(pivot == 0, 1.0, pivot)[:, None]
                count, width = right.shape
                yield pd.DataFrame({"comp": np.repeat(np.arange(count), width), "coord_index": np.tile(np.arange(width), count), "loading": right.ravel(),
                                    "mean": np.tile(own[0, 1:] / own[0, 0], count), "width": width})

    return factor(packed, column, partitions).mapInPandas(run, "comp int, coord_index int, loading double, mean double, width long")


def fit(features: DataFrame, k: int, partitions: int = 64) -> DataFrame:
    """components(block, coord, comp, coord_index, loading, mean, width) of features(entity_id, [block,] coord, value)."""
    order = [c for c in ("block", "coord") if c in features.columns]
    found = components(pack(features, ["entity_id"]), "f", k, partitions)
    axis = declared_axis(features, order).select(F.posexplode("_axis").alias("coord_index", "c")).select("coord_index", *[F.col(f"c.{c}").alias(c) for c in order])
    return axis.join(found, "coord_index").select(*order, "comp", "coord_index", "loading", "mean", "width")


def project(features: DataFrame, fitted: DataFrame, k: int) -> DataFrame:
    """scores(keys.., coord, value): the centred rows on the first ``k`` fitted components.

    Keys are all columns but block, coord and value. The loadings of a coordinate are one array, joined once and added up before
    the shuffle. An entity that lacks a fitted coordinate, or has one twice, is an error that names it.
    """
    order = [c for c in ("block", "coord") if c in features.columns]
    keys = [c for c in features.columns if c not in (*order, "value")]
    arrays = fitted.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("comp", "loading"))).alias("_l"), F.min("mean").alias("_m"), F.min("width").alias("_n"))
    centred = F.col("value") - F.col("_m")
    sums = [F.sum(centred * F.get(F.col("_l"), F.lit(c))["loading"]).alias(f"_{c}") for c in range(k)]
    joined = features.join(small_side(arrays), order)
    rows = joined.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("_seen"), F.count_distinct(*order).alias("_different"), F.min("_n").alias("_n"))
    wrong = F.concat(F.lit("coordinates are missing or repeated for "), F.col(keys[0]).cast("string"))
    whole = (F.col("_seen") == F.col("_n")) & (F.col("_different") == F.col("_n"))
    scores = F.when(whole, F.array(*[F.col(f"_{c}") for c in range(k)])).otherwise(F.raise_error(wrong).cast("array<double>"))
    return rows.select(*keys, F.posexplode(scores).alias("coord", "value")).where("value IS NOT NULL")
