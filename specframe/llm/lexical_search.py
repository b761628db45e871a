"""Ranked lexical search: term-at-a-time over short posting lists, document-at-a-time over long ones.

Terms are the maximal runs of code points other than ASCII non-alphanumerics, with only A-Z lower-cased. With N documents
that hold a term, L terms in all of them, n terms in one of them, df documents with a term and tf its count in one:

    w = floor(1000 ln((2N + 2) / (2 df + 1)))        m = 100 - b + (b n N) div L        (b = 50)
    score = sum over the item's distinct terms of w ((10^9 tf) div (1000 tf + 20 m))

Steps. One pass over the texts stores, per document, n and the counts of the terms that items use; N, L and df are
aggregates of that table. A second pass reads it in shards of bounded size. A shard's postings are inverted; then, per
item, the short lists are added up term at a time into accumulators, and these, in document order, act as one more list
whose entries are bounded by their maximum. Together with the long lists it is walked document at a time, in blocks
of 256 documents: a block whose bounds (maxima of every long list and of the accumulators inside it) add up to less than the k-th
best score known is skipped, any other is scored exactly. Accumulators are lower bounds of scores, so their k-th best
already is a threshold before the walk starts. A shard gives at most k rows an item; a window with a group limit merges them.

Items are taken in chunks of at most CHUNK_TERMS terms (one item's terms stay together), so what is broadcast is bounded;
each chunk reads the texts once.

Defined results. A null or termless text is no document and no item. Item rows under one id (null included) are one item with the terms
of all its rows. Document rows under one id are documents of their own. Equal scores go by ascending document id, nulls last.
Scores of 0 are left out. Empty tables give no rows. A term may be of any length; a text is cut into pieces of about 4 MB
between terms. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_running
from ..session import durable, stage_path

CHUNK_TERMS = 500_000
PIECE = 1 << 22
# A shard is closed at this many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 22
# Lists in at most this share of a shard's documents are short.
SHORT = 1 / 32
BLOCK_DOCS = 256
B = 50
COUNTED = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((c + 32 if 0x41 <= c < 0x5B else c) if c in _KEPT else 0x20 for c in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, as UTF-8, piece by piece."""
    if text is None:
        return
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    start = 0
    while start < len(data):
        end = len(data) if len(data) - start <= PIECE else data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _counter(shared):
    """Counts of the vocabulary's terms in each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, size = shared.value.get, len(shared.value)
        for batch in batches:
            ids, totals, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, parts = 0, []
                for words in terms_of(text.as_py()):
                    n += len(words)
                    known = np.fromiter((x for x in map(numbers, words) if x is not None), dtype=np.int64)
                    parts.append(np.unique(known, return_counts=True))
                if not n:
                    continue
                used, times = parts[0]
                if len(parts) > 1:
                    sums = np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), size).astype(np.int64)
                    used = np.flatnonzero(sums)
                    times = sums[used]
                ids.append(doc_id)
                totals.append(n)
                terms.append(used.astype(np.int32))
                counts.append(times.astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *x]), pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


class Shard:
    """Inverted lists of some documents, in ascending order of document id (nulls last), with block maxima of the long ones."""

    def __init__(self, ids: list, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, total: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids, self.docs = [ids[i] for i in order], len(ids)
        place = np.empty(self.docs, dtype=np.int64)
        place[order] = np.arange(self.docs)
        m = np.array([100 - B + (B * int(x) * documents) // total for x in n], dtype=np.int64)
        owner = np.repeat(np.arange(self.docs), lengths)
        tf = counts.astype(np.int64)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
        by_term = np.lexsort((place[owner], terms))
        self.doc, self.impact = place[owner][by_term], impact[by_term]
        self.starts = np.searchsorted(terms[by_term], np.arange(len(weights) + 1))
        self.blocks = -(-self.docs // BLOCK_DOCS)
        self.long: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def long_list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of a list's blocks, and the largest impact in each."""
        if term not in self.long:
            a, b = self.starts[term], self.starts[term + 1]
            cuts = a + np.searchsorted(self.doc[a:b], np.arange(self.blocks + 1) * BLOCK_DOCS)
            most = np.zeros(self.blocks, dtype=np.int64)
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            most[full] = np.maximum.reduceat(self.impact[a:b], cuts[full] - a)
            self.long[term] = cuts, most
        return self.long[term]

    def accumulate(self, lists: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: documents of the short lists in order, with their summed impacts."""
        docs = np.concatenate([np.zeros(0, np.int64), *[self.doc[self.starts[t] : self.starts[t + 1]] for t in lists]])
        impacts = np.concatenate([np.zeros(0, np.int64), *[self.impact[self.starts[t] : self.starts[t + 1]] for t in lists]])
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        heads = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
        return docs[heads], np.add.reduceat(impacts[order], heads) if len(heads) else impacts

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents (places) and exact scores of the k best, best first, and the number of blocks scored."""
        lengths = self.starts[query + 1] - self.starts[query]
        few = max(1, int(self.docs * SHORT))
        docs, sums = self.accumulate(query[(lengths > 0) & (lengths <= few)].tolist())
        longs = [self.long_list(t) for t in query[lengths > few].tolist()]
        threshold = int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 1
        threshold = max(1, threshold)
        if not longs:
            return (*_best(docs, sums, k), 0)
        edges = np.searchsorted(docs, np.arange(self.blocks + 1) * BLOCK_DOCS)
        bounds = np.zeros(self.blocks, dtype=np.int64)
        full = np.flatnonzero(edges[1:] > edges[:-1])
        if len(full):
            bounds[full] = np.maximum.reduceat(sums, edges[full])
        for _, most in longs:
            bounds += most
        places, scores, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for block in range(self.blocks):
            if bounds[block] < threshold:
                continue
            scored += 1
            part = np.zeros(BLOCK_DOCS, dtype=np.int64)
            a, b = edges[block], edges[block + 1]
            part[docs[a:b] - block * BLOCK_DOCS] = sums[a:b]
            for cuts, _ in longs:
                a, b = cuts[block], cuts[block + 1]
                part[self.doc[a:b] - block * BLOCK_DOCS] += self.impact[a:b]
            inside = np.flatnonzero(part >= threshold)
            if len(inside):
                places, scores = _best(np.r_[places, inside + block * BLOCK_DOCS], np.r_[scores, part[inside]], k)
                if len(scores) == k:
                    threshold = max(threshold, int(scores[-1]))
        return places, scores, scored


def _best(places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = scores > 0
    places, scores = places[keep], scores[keep]
    order = np.lexsort((places, -scores))[:k]
    return places[order], scores[order]


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, total = shared.value

        def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            terms = table["terms"].chunk(0)
            shard = Shard(table["doc_id"].to_pylist(), np.asarray(table["n"]), np.asarray(terms.value_lengths()), np.asarray(terms.flatten()), np.asarray(table["counts"].chunk(0).flatten()), weights, documents, total)
            out: list[list] = [[], [], []]
            for item, query in enumerate(queries):
                places, scores, _ = shard.top(query, k)
                out[0].extend([item] * len(places))
                out[1].extend(shard.ids[p] for p in places)
                out[2].extend(scores.tolist())
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["item", "doc_id", "score"])

        held, docs, postings = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            docs += batch.num_rows
            postings += len(batch.column(2).flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield answer(held)
                held, docs, postings = [], 0, 0
        if held:
            yield answer(held)

    return run


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, terms, chunk): the distinct terms of each item id, and the chunk it is worked in."""
    slim = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("t"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for words in terms_of(text.as_py()):
                    own = sorted(set(words))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "term"])

    pairs = slim.mapInArrow(split, "item_id long, term binary").distinct()
    grouped = pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms")).withColumn("_size", F.size("terms"))
    placed = global_running(grouped, [F.col("item_id").asc_nulls_first()], {"_upto": "_size"})
    return durable(placed.select("item_id", "terms", F.floor((F.col("_upto") - F.col("_size")) / CHUNK_TERMS).cast("long").alias("chunk")))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (1 is best), doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    asked = item_terms(items, item_col, item_text_col)
    path = stage_path(spark, "ranked")
    spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").write.parquet(path)
    for chunk in sorted(r["chunk"] for r in asked.select("chunk").distinct().collect()):
        rows = asked.where(F.col("chunk") == chunk).select("item_id", "terms").collect()
        vocabulary = {term: i for i, term in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        queries = [np.array(sorted(vocabulary[bytes(t)] for t in r["terms"]), dtype=np.int64) for r in rows]
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        shared = context.broadcast(vocabulary)
        counted_path = stage_path(spark, "term-counts")
        texts.mapInArrow(_counter(shared), COUNTED).write.parquet(counted_path)
        counted = spark.read.parquet(counted_path)
        documents, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(vocabulary), dtype=np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            frequency[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], dtype=np.int64)
        ready = context.broadcast((queries, weights, documents, total))
        found = counted.mapInArrow(_searcher(ready, k), FOUND)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        shared.destroy()
        ready.destroy()
    return spark.read.parquet(path)
