"""Benchmark decontamination: n-gram hits, then Smith-Waterman alignment.

Words are lower-cased (A-Z) and lose ASCII punctuation. Every test item is cut into n-grams, and one pass over the
corpus counts them. An item's seeds are its rare n-grams: those no more frequent than ``rare_share`` of all corpus
n-grams, and in any case those up to ``SEED_FACTOR`` times the median of its own that occur. Seeds are reported and decide
nothing: no rule on counts can tell which n-grams an edited copy keeps. A second pass finds all n-grams, rare or not,
in every whole text. Hits of one item on near diagonals form a place, and unless the place holds too few of the item's words for the
threshold, the item is aligned with the words of that place (match 2, mismatch -1, gap -1). The score is the local alignment
over the score of a perfect copy; substituting a share e of the words costs 1.5 e. Pairs at ``threshold`` or above are
returned; a copy without one intact n-gram has no place.

Both passes are maps over the documents: no text is shuffled, and an n-gram or an item that occurs in a third of all
documents is no group anywhere. Items are read in chunks of at most ``CHUNK_WORDS`` words, and only one chunk's
index is broadcast at a time, so the benchmark may have any size; each chunk costs two passes.

Items of fewer than ``min_words`` words are too short for edits to mean anything: they count only where all their words
stand intact and in order; an item shorter than one n-gram, only where it is a whole document.

Defined results: items without words match nothing; null and empty texts match
nothing; repeated documents and repeated items each give rows of their own; a null id is carried as null; an empty table on
either side gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_WORDS = 500_000
SEED_FACTOR = 4  # times the median count of an item's n-grams
MATCH, MISMATCH, GAP = 2, -1, -1
_PUNCTUATION = string.punctuation.encode()
RESULT = "doc_id long, item_id long, score double, first_word long, last_word long, n_seeds long"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").lower().translate(None, _PUNCTUATION).split() if text else []


def alignment(item: np.ndarray, place: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two id sequences, and the last position of it in ``place``.

    One numpy row per word of the item; gaps along the row are a running maximum.
    """
    columns = np.arange(len(place), dtype=np.int64)
    above, best, at = np.zeros(len(place) + 1, dtype=np.int64), 0, -1
    for word in item:
        row = np.maximum(above[:-1] + np.where(place == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row - GAP * columns) + GAP * columns
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), top
        above = np.concatenate([[0], row])
    return best, at


@dataclass
class Index:
    """Test items as word-id arrays, and their n-grams as sorted codes with (item, offset) lists."""

    n: int
    item_ids: list
    items: list[np.ndarray]
    vocabulary: dict[bytes, int]
    codes: np.ndarray  # distinct n-gram codes, sorted
    first: np.ndarray  # first entry of each code in ``entries``; one more at the end
    entries: np.ndarray  # rows (item, offset)
    min_words: int = 8  # shorter items have to stand intact
    tiny: dict[tuple, list[int]] = field(default_factory=dict)  # items shorter than one n-gram, by their words
    seed: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))  # per entry
    distinct: tuple | None = None  # of _counted_words
    scratch: np.ndarray | None = None  # count of each word in a text; zero between texts

    @staticmethod
    def build(rows: list[tuple], n: int, min_words: int = 8) -> Index:
        vocabulary: dict[bytes, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], dtype=np.int64) for _, words in rows]
        own = Index(n, [i for i, _ in rows], items, vocabulary, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, 2), np.int64))
        codes = [own.grams(item) for item in items]
        flat = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
        places = np.array([(i, o) for i, c in enumerate(codes) for o in range(len(c))], dtype=np.int64).reshape(-1, 2)
        order = np.argsort(flat, kind="stable")
        own.codes, counts = np.unique(flat, return_counts=True)
        own.first, own.entries = np.concatenate([[0], np.cumsum(counts)]), places[order]
        own.seed, own.min_words = np.ones(len(own.entries), dtype=bool), min_words
        for number, item in enumerate(items):
            if 0 < len(item) < n:
                own.tiny.setdefault(tuple(item.tolist()), []).append(number)
        return own

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Codes of the n-grams at every position; -1 where a word is not the benchmark's."""
        length = len(ids) - self.n + 1
        if length <= 0:
            return np.zeros(0, dtype=np.int64)
        base, code, whole = len(self.vocabulary) + 1, np.zeros(length, dtype=np.int64), np.ones(length, dtype=bool)
        for i in range(self.n):
            part = ids[i : i + length]
            whole &= part > 0
            code = code * base + part  # wraps alike on both sides once the vocabulary is very large
        return np.where(whole, code & np.int64(0x7FFFFFFFFFFFFFFF), -1)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text, and the codes' numbers, of the benchmark's n-grams."""
        codes = self.grams(ids)
        positions = np.flatnonzero(codes >= 0)
        if len(positions) == 0 or len(self.codes) == 0:
            return positions[:0], positions[:0]
        found = np.searchsorted(self.codes, codes[positions])
        found[found == len(self.codes)] = 0
        good = self.codes[found] == codes[positions]
        return positions[good], found[good]

    def with_seeds(self, counts: np.ndarray, rare: float) -> Index:
        """Mark the entries that are seeds, given the corpus count of each code."""
        per_entry = np.repeat(counts, np.diff(self.first))
        frame = pd.DataFrame({"item": self.entries[:, 0], "count": per_entry})
        # Only n-grams that occur can seed; the median of all would be 0 where most copies are edited alike.
        middle = frame[frame["count"] > 0].groupby("item")["count"].median()
        half = frame["item"].map(middle).fillna(0).to_numpy()
        self.seed = per_entry <= np.maximum(SEED_FACTOR * half, rare)
        return self

    def _counted_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of every item, their counts, and where each item's begin; made once in each process."""
        if self.distinct is None:
            parts = [np.unique(item, return_counts=True) for item in self.items]
            begins = np.concatenate([[0], np.cumsum([len(w) for w, _ in parts])]).astype(np.int64)
            self.distinct = (np.concatenate([w for w, _ in parts]), np.concatenate([c for _, c in parts]), begins)
            self.scratch = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        return self.distinct

    def _shared(self, item: int, words: np.ndarray) -> int:
        """How many words of the item can be matched with these words: no alignment matches more."""
        own, counts, begins = self._counted_words()
        own, counts = own[begins[item] : begins[item + 1]], counts[begins[item] : begins[item + 1]]
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == words], minlength=len(own)), counts).sum())

    def _limit(self, item: int, threshold: float) -> float:
        return 1.0 if len(self.items[item]) < self.min_words else threshold

    def _possible(self, candidates: np.ndarray, ids: np.ndarray, threshold: float) -> np.ndarray:
        """Those of the items (sorted) of which the whole text holds words enough for the threshold."""
        own, counts, begins = self._counted_words()
        seen, n = np.unique(ids, return_counts=True)
        self.scratch[seen] = n
        sizes = begins[candidates + 1] - begins[candidates]
        ends = np.cumsum(sizes)
        flat = np.repeat(begins[candidates] - (ends - sizes), sizes) + np.arange(ends[-1])
        shared = np.add.reduceat(np.minimum(self.scratch[own[flat]], counts[flat]), ends - sizes)
        self.scratch[seen] = 0
        return candidates[shared >= np.fromiter((self._limit(i, threshold) * len(self.items[i]) for i in candidates), dtype=np.float64, count=len(candidates))]

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int, int]]:
        """(item number, score, first and last word, seeds) of the items whose best place reaches the threshold."""
        ids = self.numbers(words_of(text))
        if len(ids) < self.n:
            return [(item, 1.0, 0, len(ids) - 1, 0) for item in self.tiny.get(tuple(ids.tolist()), [])]
        positions, numbers = self.hits(ids)
        if len(positions) == 0:
            return []
        sizes = self.first[numbers + 1] - self.first[numbers]
        ends = np.cumsum(sizes)
        entry = np.repeat(self.first[numbers] - (ends - sizes), sizes) + np.arange(ends[-1])
        items, begins, seeds = self.entries[entry, 0], np.repeat(positions, sizes) - self.entries[entry, 1], self.seed[entry]
        keep = np.isin(items, self._possible(np.unique(items), ids, threshold))
        items, begins, seeds = items[keep], begins[keep], seeds[keep]
        order = np.lexsort((begins, items))
        items, begins, seeds = items[order], begins[order], seeds[order]
        found, at = np.unique(items, return_index=True)
        out = []
        for item, low, high in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(items)]):
            limit = self._limit(item, threshold)
            best = self._best_place(item, begins[low:high], ids, limit)
            if best[0] >= limit:
                out.append((item, *best, int(np.count_nonzero(seeds[low:high]))))
        return out

    def _best_place(self, number: int, begins: np.ndarray, ids: np.ndarray, threshold: float) -> tuple[float, int, int]:
        item = self.items[number]
        size, best = len(item), (-1.0, 0, 0)
        for group in np.split(begins, np.flatnonzero(np.diff(begins) > size // 2) + 1):
            low, high = int(group[0]), int(group[-1])
            starts, hits = np.unique(group, return_counts=True)
            for start in starts[hits >= size - self.n + 1].tolist():
                if start >= 0 and np.array_equal(ids[start : start + size], item):
                    return 1.0, start, start + size - 1
            slack = size // 2
            from_word = max(0, low - slack)
            place = ids[from_word : high + size + slack]
            # A score takes at least that many words of the item.
            if self._shared(number, place) < max(best[0], threshold) * size:
                continue
            score, last = alignment(item, place)
            value = score / (MATCH * size)
            if value > best[0]:
                _, back = alignment(item[::-1], place[: last + 1][::-1])
                best = (value, from_word + last - back, from_word + last)
        return best


def _chunks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items in chunks of bounded size, read one after the other."""
    rows, held = [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        words = words_of(r["t"])
        if not words:
            continue
        rows.append((r["i"], words))
        held += len(words)
        if held >= CHUNK_WORDS:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _counted(docs: DataFrame, index: Index, text_col: str) -> tuple[np.ndarray, int]:
    """Corpus count of each of the index's n-grams, and of all n-grams; map-side sums of at most one row a code."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts, total = np.zeros(len(own.codes), dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = own.numbers(words_of(text))
                total += max(0, len(ids) - own.n + 1)
                np.add.at(counts, own.hits(ids)[1], 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(counts[used], total), pa.int64())], names=["code", "n"])

    sums = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts, total = np.zeros(len(index.codes), dtype=np.int64), 0
    for r in sums.toLocalIterator():
        if r["code"] < 0:
            total = r["n"]
        else:
            counts[r["code"]] = r["n"]
    return counts, total


def indexes(docs: DataFrame, benchmark: DataFrame, n: int = 3, min_words: int = 8, rare_share: float = 1e-6, item_col: str = "item_id",
            text_col: str = "text") -> list:
    """Broadcast indexes with their seeds marked, one per chunk of the benchmark."""
    out = []
    for rows in _chunks(benchmark, item_col, text_col):
        index = Index.build(rows, n, min_words)
        counts, total = _counted(docs, index, text_col)
        out.append(docs.sparkSession.sparkContext.broadcast(index.with_seeds(counts, rare_share * total)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, score, first_word, last_word (of the best place), n_seeds."""

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                rows = [(i, own.item_ids[m[0]], *m[1:]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in own.matches(t, threshold)]
                columns = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "score", "first_word", "last_word", "n_seeds"])

        return run

    slim = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    found = [slim.mapInArrow(finder(shared), RESULT) for shared in indexes(docs, benchmark, text_col=text_col, **options)]
    if not found:
        return slim.sparkSession.createDataFrame([], RESULT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns; a filter without a shuffle."""

    def free(shared) -> Column:
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([not shared.value.matches(t, threshold) for t in texts], dtype="bool")

        return F.pandas_udf(run, "boolean")(F.col(text_col))

    for shared in indexes(docs, benchmark, text_col=text_col, **options):
        docs = docs.filter(free(shared))
    return docs
