"""Quality classifier: regularised quadratic discriminant over document statistics.

A document becomes a vector of transformed statistics (logs of sizes, arcsine square roots of shares). Each class gets its
mean and a covariance that is shrunk first towards the pooled covariance and then towards its own diagonal, so
classes with few labels still have a usable inverse. A score is the logistic of the difference of the two log densities plus the log
odds of the classes; the densities come from Mahalanobis lengths with the inverse Cholesky factors, made once on the
driver and held by every task.

The moments are sums over all labelled rows, made in partial sums per partition; nothing is sampled.

Defined results: null and empty texts have the statistics of an empty text and are scored like any other; several labels
of one id count as their largest; labels other than 0 and 1 are left out; without rows of both classes every score is the
share of label 1 among the labelled rows, or 0.5 without any; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_path

CUT = 0.3
TO_POOLED, TO_DIAGONAL = 0.1, 0.1
SIZE = 15  # statistics

_BYTES = np.zeros(256, dtype=np.int64)  # class of each byte


def _classes() -> None:
    groups = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "#*$%&|<>", "'\"()-/@_+=[]{}\\^`~")
    _BYTES[:] = len(groups)  # control characters
    for number, group in enumerate(groups):
        for character in group:
            _BYTES[ord(character)] = number
    _BYTES[0x80:] = len(groups) + 1
    _BYTES[0x80:0xC0] = len(groups) + 2  # later bytes of a character


_classes()
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, LOUD, SYMBOL, OTHER, CONTROL, WIDE, LATER = range(12)


def statistics(text: str | None) -> list[float]:
    """The SIZE transformed statistics of a text."""
    raw = (text or "").encode("utf-8")
    counts = np.bincount(_BYTES, weights=np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256), minlength=12)
    characters = counts.sum() - counts[LATER]
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, distinct, long_words = len(words), len(set(words)), sum(1 for w in words if len(w) > 20)
    share = lambda a, b: math.asin(math.sqrt(min(1.0, a / b))) if b else 0.0
    letters = counts[LOWER] + counts[UPPER] + counts[WIDE]
    return [
        math.log1p(n), math.log1p(characters / n) if n else 0.0, share(letters, characters), share(counts[UPPER], letters),
        share(counts[DIGIT], characters), share(counts[STOP], characters), share(counts[LOUD], characters), share(counts[SYMBOL], characters),
        share(counts[OTHER], characters), share(counts[CONTROL], characters), share(distinct, n), share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / len(lines)) if lines else 0.0, share(long_words, n), share(counts[WIDE], letters)]


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # class x SIZE
    roots: np.ndarray  # class x SIZE x SIZE: inverse Cholesky factors of the covariances
    offsets: np.ndarray  # per class: log share - log determinant / 2
    constant: float | None = None  # the score where one class is missing

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log_density = [self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.roots[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(log_density[1] - log_density[0], -500, 500)))


def discriminant(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """From each class's number of rows, sums and sums of outer products."""
    if n.min() < 2:
        return Discriminant(sums, squares, n, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = sums / n[:, None]
    own = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    roots, offsets = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * own[c] + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        roots.append(np.linalg.inv(factor))
        offsets.append(math.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(roots), np.array(offsets))


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    path = stage_path(docs.sparkSession, "statistics")
    slim = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    slim.mapInArrow(run, "doc_id long, x array<double>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def fit(stats: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality") -> Discriminant:
    """Fit on the labelled rows whose id fulfils ``usable``."""
    known = labels.filter(F.col(label_col).isin(0, 1) & usable).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + SIZE + SIZE * SIZE))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy()
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["y", "m"])

    partial = stats.join(known, "doc_id").select("x", "y").mapInArrow(run, "y int, m array<double>")
    sums = partial.select("y", F.posexplode("m")).groupBy("y", "pos").agg(F.sum("col").alias("s")).collect()  # 2 * (1 + SIZE + SIZE^2) rows
    total = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    for r in sums:
        total[r["y"], r["pos"]] = r["s"]
    return discriminant(total[:, 0], total[:, 1 : 1 + SIZE], total[:, 1 + SIZE :].reshape(2, SIZE, SIZE))


def score_column(model: Discriminant, x: Column) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist()).reshape(-1, SIZE)))

    return F.pandas_udf(run, "double")(x)
