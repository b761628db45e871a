"""Language-model scores by cross-entropy difference.

Two 4-gram models, one of a target corpus and one of the background, share one vocabulary: the bytes of UTF-8, each a symbol of its
own. A document's score is its mean loss per token under the background model less that under the target model, so
higher means nearer to the target. Nothing of a text is merged or left out: capitals, digits and all scripts count as they are. The tables hold the
4-grams that occur, so they grow with the variety of the corpus; they are not those of words, which would grow with its
length and need a join of every token with them.

All target and all background documents are counted. The models are matched: background counts are scaled to
the target's number of tokens, so smoothing weighs the same in both. A probability is interpolated with the next lower
order, p(x | c) = (count(c x) + ALPHA p(x | c')) / (count(c) + ALPHA), down to the uniform one. A task counts its 4-grams as
sorted arrays, and deals them into parts by their code; a part's arrays meet in a task and hold a few numbers per task that counted. The summed tables, one entry per 4-gram that occurs, are broadcast for scoring.

Defined results: a null or empty text has no token and all its figures are 0; one shorter than four characters is read after
line breaks, like every beginning; an empty target or background is the uniform model; repeated rows count each time; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER, ALPHA = 4, 5.0
SYMBOLS = 256
# Symbol of each UTF-8 byte.
CLASS = np.arange(SYMBOLS, dtype=np.uint32)
_START = bytes([10]) * (ORDER - 1)
# Tokens that a task counts at once, and parts into which codes are dealt by their remainder; a prime, so that all bytes decide.
PORTION, PARTS = 1 << 22, 509


def codes(text: str | None) -> np.ndarray:
    """4-gram codes of all tokens of a text; the first ones follow line breaks."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    symbols = CLASS[np.frombuffer(_START + text.encode("utf-8"), dtype=np.uint8)]
    out = symbols[: len(symbols) - ORDER + 1].copy()
    for i in range(1, ORDER):
        out <<= np.uint32(8)
        out |= symbols[i : len(symbols) - ORDER + 1 + i]
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


PACKED = "part int, codes binary, counts binary"


def _packed(part: int, keys: np.ndarray, counts: np.ndarray) -> list:
    return [pa.array([part], pa.int32()), pa.array([keys.astype(np.uint32).tobytes()], pa.binary()), pa.array([counts.astype(np.int64).tobytes()], pa.binary())]


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of (codes, counts) binaries, one after the other."""
    keys, counts = zip(*rows) if rows else ([], [])
    return np.frombuffer(b"".join(keys), dtype=np.uint32), np.frombuffer(b"".join(counts), dtype=np.int64)


def count_grams(docs: DataFrame, text_col: str = "text", side: str = "corpus") -> DataFrame:
    """(part, codes, counts): how often each 4-gram occurs in ``docs``, a row per part; ``side`` names the step in the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)), [], 0

        def merged():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _summed(np.concatenate([seen[0], keys]), np.concatenate([seen[1], counts]))

        for batch in batches:
            for text in batch.column(0):
                held.append(codes(text.as_py()))
                size += len(held[-1])
                if size >= PORTION:
                    seen, held, size = merged(), [], 0
        if held:
            seen = merged()
        place = seen[0] % np.uint32(PARTS)
        order = np.argsort(place, kind="stable")
        keys, counts, ends = seen[0][order], seen[1][order], np.searchsorted(place[order], np.arange(PARTS + 1))
        for part, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            if a < b:
                yield pa.RecordBatch.from_arrays(_packed(part, keys[a:b], counts[a:b]), names=["part", "codes", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = _summed(*_unpacked(list(zip(rows["codes"].to_pylist(), rows["counts"].to_pylist()))))
        return pa.Table.from_arrays(_packed(rows["part"][0].as_py(), *total), names=["part", "codes", "counts"])

    run.__name__, add.__name__ = f"count_{side}", f"add_{side}"
    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, PACKED).groupBy("part").applyInArrow(add, PACKED)


def _counted(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The summed counts in order of their codes, read part by part."""
    return _summed(*_unpacked([(bytes(r["codes"]), bytes(r["counts"])) for r in grams.toLocalIterator()]))


class Gram:
    """Probabilities of one corpus' 4-grams, from the counts of those that occur."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        n = counts.astype(np.float64)
        uniform = np.full(SYMBOLS, 1.0 / SYMBOLS)
        c1, c2 = (np.bincount(keys & np.uint32(SYMBOLS**k - 1), n, SYMBOLS**k) for k in (1, 2))
        self.p1 = (c1 + ALPHA * uniform) / (n.sum() + ALPHA)
        self.p2 = ((c2.reshape(SYMBOLS, SYMBOLS) + ALPHA * self.p1) / (c2.reshape(SYMBOLS, SYMBOLS).sum(axis=1, keepdims=True) + ALPHA)).ravel()
        self.k3, self.c3 = _summed(keys & np.uint32(SYMBOLS**3 - 1), n)
        self.t3 = np.bincount(self.k3 >> np.uint32(8), self.c3, SYMBOLS**2)  # of contexts of two symbols
        self.k4, self.c4 = keys, n
        self.kt, self.t4 = _summed(keys >> np.uint32(8), n)  # of contexts of three symbols

    @staticmethod
    def _of(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def losses(self, wanted: np.ndarray) -> np.ndarray:
        """-log2 p of each 4-gram's last symbol after its first three."""
        three = wanted & np.uint32(SYMBOLS**3 - 1)
        p3 = (self._of(self.k3, self.c3, three) + ALPHA * self.p2[wanted & np.uint32(SYMBOLS**2 - 1)]) / (self.t3[three >> np.uint32(8)] + ALPHA)
        p4 = (self._of(self.k4, self.c4, wanted) + ALPHA * p3) / (self._of(self.kt, self.t4, wanted >> np.uint32(8)) + ALPHA)
        return -np.log2(p4)


class Models:
    """Losses under both models: a table of all 4-grams that occur in either corpus, and the models themselves for others."""

    def __init__(self, target: Gram, background: Gram):
        self.pair = (target, background)
        self.keys = np.union1d(target.k4, background.k4)
        self.table = np.stack([m.losses(self.keys).astype(np.float32) for m in self.pair])

    def mean_losses(self, own: np.ndarray) -> tuple[float, float]:
        if not len(own):
            return 0.0, 0.0
        if not len(self.keys):
            return tuple(float(m.losses(own).mean()) for m in self.pair)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        new = np.flatnonzero(self.keys[at] != own)
        found = self.table[:, at].astype(np.float64)
        if len(new):
            found[:, new] = [m.losses(own[new]) for m in self.pair]
        a, b = found.mean(axis=1)
        return float(a), float(b)


def fit(target: DataFrame, background: DataFrame, text_col: str = "text") -> Models:
    """The models of target and background, matched in mass."""
    a, b = _counted(count_grams(target, text_col, "target")), _counted(count_grams(background, text_col, "background"))
    match = a[1].sum() / b[1].sum() if a[1].sum() > 0 and b[1].sum() > 0 else 1.0
    return Models(Gram(*a), Gram(b[0], b[1] * match))


def score_documents(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (bits a token), score (their difference)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            sizes, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                own = codes(text)
                sizes.append(len(own))
                losses = fitted.mean_losses(own)
                a.append(losses[0])
                b.append(losses[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(np.subtract(b, a), pa.float64())],
                names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
