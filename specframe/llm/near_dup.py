"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

A document is the set of its k-word shingles. Its sketch has ``coords`` coordinates, filled in rounds: in round i every
shingle is thrown into one random bin with a value in [i, i + 1), and a bin keeps its smallest value; after ``coords``
rounds bin j is offered every shingle in round ``coords`` + j, so every coordinate is filled for certain. A coordinate of
two sketches agrees with the Jaccard similarity of the sets as probability, and the number that agree is concentrated at
least as well as for independent minima, at a cost of about size + coords * log(coords) hashes.

Steps, each with its own shuffle of slim rows:

1. Sketches in one pass over the texts. Documents with equal sets fall together by a 128-bit fingerprint of the set; only
   the smallest id of each goes on, so copies cost nothing more, however many they are.
2. ``bands`` runs of ``coords / bands`` coordinates are hashed; equal hashes make a bucket. Each bucket gets a hub: its
   member with the most company over all buckets, which in a group of edited copies is mostly the text they come from.
   Every member is paired with its hub only.
3. Pairs whose sketches agree in fewer coordinates than a similarity at the threshold would give (six standard deviations
   of slack) go out; the others are confirmed on the full sets of both texts.
4. Confirmed links are closed to components. Buckets whose members are now all in one component are finished. Documents of the
   others are dealt into blocks of bounded size, and every two blocks that buckets connect are compared inside one task by
   sketches and full sets; only links that join two components leave it, and are confirmed like the others. So
   no pair of one bucket stays undecided, yet a large group never becomes all its pairs.

With 160 coordinates in 32 bands a pair at similarity 0.8 shares no bucket with probability 3e-6, at 0.85 with 9e-9.

Defined results: a text with fewer than k words is one shingle, its whole sequence; a null text and one without words
have size 0 and no link. Rows that share an id are one node: each row gets its own size and all get one component. A null id
is never a representative: such a row has the component of the documents with an equal set, or null without one. Ties
go to the smallest id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import stage_path
from .common import fresh

COORDS, BANDS = 160, 32
BLOCK = 2000  # documents; a task compares two blocks
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered, as UTF-8; bytes know exactly the six white space characters of the word class."""
    return text.encode("utf-8").lower().split() if text else []


def shingle_set(text: str | None, k: int) -> set:
    """The exact set that a link is confirmed on."""
    words = words_of(text)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def shingle_hashes(texts: list, k: int) -> list[np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.array([w for ws in words for w in ws], dtype=object)
    if len(flat) == 0:
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    codes = pd.util.hash_array(flat, categorize=False)
    ends = np.cumsum(sizes)
    joined = np.zeros(len(codes), dtype=np.uint64)
    for i in range(min(k, len(codes))):
        joined[: len(codes) - i] = mix64(joined[: len(codes) - i] * np.uint64(3) + codes[i:] + _STEP)
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist()):
        if size >= k:
            out.append(np.unique(joined[end - size : end - k + 1]))
        elif size:
            code = np.array([size], dtype=np.uint64)
            for c in codes[end - size : end]:
                code = mix64(code * np.uint64(5) + c)
            out.append(code)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketch(items: np.ndarray, coords: int) -> np.ndarray:
    """The sketch of a non-empty set of hashes: per coordinate (round, value) packed in 64 bits, round in the upper 16."""
    out = np.full(coords, _EMPTY)
    first, step = 0, max(1, 2048 // len(items))
    while first < 2 * coords:
        last = min(first + step, coords if first < coords else 2 * coords)
        rounds = np.arange(first, last, dtype=np.uint64)[:, None]
        hashes = mix64(items[None, :] ^ mix64(rounds * _STEP + np.uint64(1)))
        value = (rounds << np.uint64(48)) | (hashes >> np.uint64(16))
        if first < coords:
            # The low 16 bits choose the bin; the value uses the other 48.
            bins = ((hashes & np.uint64(0xFFFF)) * np.uint64(coords)) >> np.uint64(16)
            np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        else:
            np.minimum.at(out, rounds.ravel().astype(np.int64) - coords, value.min(axis=1))
        if out.max() != _EMPTY:
            break
        first = last
    return out


def _rows(k: int, coords: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_seed = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(11))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                sets = shingle_hashes(piece.column(1).to_pylist(), k)
                one, two, band, signature = [], [], [], []
                for items in sets:
                    if len(items) == 0:
                        one.append(0), two.append(0), band.append([]), signature.append([])
                        continue
                    one.append(int(mix64(items).sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix64(items ^ _STEP).sum(dtype=np.uint64).view(np.int64)))
                    filled = sketch(items, coords)
                    code = band_seed.copy()
                    for column in filled.reshape(bands, -1).T:
                        code = mix64(code * np.uint64(31) + column)
                    band.append(code.view(np.int64))
                    # One byte a coordinate is enough to tell similar from different; eight go in a long.
                    signature.append(mix64(filled).astype(np.uint8).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                     pa.array(band, pa.list_(pa.int64())), pa.array(signature, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands", "signature"])

    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str, coords: int = COORDS, bands: int = BANDS) -> DataFrame:
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, f1 long, f2 long, bands array<bigint>, signature array<bigint>"
    return slim.mapInArrow(_rows(k, coords, bands), schema)


def _differing(a: str, b: str, longs: int) -> Column:
    """Number of differing bytes between two arrays of longs: fold every byte of the xor to one bit, and count."""
    total = F.lit(0)
    for i in range(longs):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        total = total + F.bit_count(x)
    return total


def _similar(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()
        for batch in batches:
            a, b, at, bt = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for left, right in zip(at, bt):
                if left != last:
                    last, last_set = left, shingle_set(left, k)
                other = shingle_set(right, k)
                shared = len(last_set & other)
                keep.append(100 * shared >= percent * (len(last_set) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(a, keep) if y], pa.int64()), pa.array([x for x, y in zip(b, keep) if y], pa.int64())], names=["src", "dst"])

    return run


def _spanning(k: int, percent: int):
    limit = _most_differing(percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids, label, block, size = (pdf[c].to_numpy() for c in ("doc_id", "label", "block", "n_shingles"))
        bands, signature = np.array(pdf["bands"].tolist()), np.array(pdf["signature"].tolist()).view(np.uint8)
        sets = shingle_hashes(pdf["text"].tolist(), k)
        numbers = np.unique(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.uint64)
        sets = [np.searchsorted(numbers, s) for s in sets]
        own = np.zeros(len(numbers), dtype=bool)
        label, found = label.copy(), []
        crossing = pdf["low"].iloc[0] != pdf["high"].iloc[0]
        for i in range(len(ids) - 1):
            rest = slice(i + 1, None)
            wanted = (label[rest] != label[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
            if crossing:
                wanted &= block[rest] != block[i]
            others = np.flatnonzero(wanted) + i + 1
            others = others[(bands[others] == bands[i]).any(axis=1)]
            others = others[(signature[others] != signature[i]).sum(axis=1) <= limit]
            if len(others) == 0:
                continue
            own[sets[i]] = True
            shared = np.array([np.count_nonzero(own[sets[j]]) for j in others])
            own[sets[i]] = False
            for j in others[100 * shared >= percent * (len(sets[i]) + size[others] - shared)].tolist():
                if label[j] != label[i]:  # one link for each two components is enough
                    found.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return run


def _most_differing(percent: int) -> float:
    """Differing coordinates that two sets at the threshold exceed with a probability of about 1e-9."""
    j = percent / 100
    return COORDS * (1 - j) + 6 * math.sqrt(COORDS * j * (1 - j)) + 1


class _Search:
    """The state of one run: representatives, bucket members, confirmed links."""

    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str):
        self.k, self.percent = k, percent
        self.rows = _stored(sketches(docs, k, id_col, text_col), "sketches")
        filled = self.rows.filter("n_shingles > 0")
        self.classes = filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
        reps = filled.join(self.classes.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        # Rows that share an id with a representative stay in too, so all texts of that id are searched.
        self.reps = reps.select("doc_id", "n_shingles", "bands", "signature")
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        # Rows with one id and different sets hang together by that id.
        shared = filled.filter("doc_id IS NOT NULL").select("doc_id", "f1", "f2", "n_shingles").join(self.classes, ["f1", "f2", "n_shingles"])
        self.by_id = shared.filter("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))

    def members(self) -> DataFrame:
        """(bucket, doc_id, rank) of the buckets with company; the rank is the member's company over all buckets."""
        entries = self.reps.select("doc_id", F.explode("bands").alias("bucket")).distinct()
        sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shared = _stored(entries.join(sizes, "bucket"), "buckets")
        company = shared.groupBy("doc_id").agg(F.sum("size").alias("rank"))
        return _stored(shared.join(company, "doc_id").select("bucket", "doc_id", "rank"), "members")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (src, dst) whose full sets reach the threshold."""
        slim = self.reps.select("doc_id", "n_shingles", "signature")
        longs = COORDS // 8
        a = slim.select(F.col("doc_id").alias("src"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
        b = slim.select(F.col("doc_id").alias("dst"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
        near = (100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")) & (_differing("sa", "sb", longs) <= _most_differing(self.percent))
        likely = pairs.distinct().join(a, "src").join(b, "dst").filter(near).select("src", "dst")
        likely = _stored(likely.distinct(), "likely")
        left = self.texts.select(F.col("doc_id").alias("src"), F.col("text").alias("ta"))
        right = self.texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("tb"))
        full = likely.join(right, "dst").join(left, "src").select("src", "dst", "ta", "tb")
        return _stored(full.mapInArrow(_similar(self.k, self.percent), "src long, dst long").distinct(), "links")

    def labels(self, links: DataFrame) -> DataFrame:
        nodes = links.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        return _stored(connected_components(nodes, links), "labels").withColumnRenamed("node_id", "doc_id")

    def links(self) -> DataFrame:
        members = self.members()
        if members.isEmpty():  # no two documents share a bucket
            return members.select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"))
        hub = members.groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("doc_id")).alias("minus"))).alias("h")).select("bucket", (-F.col("h.minus")).alias("hub"))
        met = members.join(hub, "bucket").filter("doc_id <> hub")
        found = self.confirmed(met.select(F.least("doc_id", "hub").alias("src"), F.greatest("doc_id", "hub").alias("dst")))
        # The hub has met every member of its bucket; buckets that have come together are finished.
        still_open = _stored(self._apart(met.select("bucket", "doc_id"), self.labels(found)), "open")
        if still_open.isEmpty():
            return found
        return found.unionByName(self.confirmed(self._across(still_open)))

    def _across(self, still_open: DataFrame) -> DataFrame:
        """Pairs that join what is still apart in the open buckets: a spanning set of links, found inside blocks.

        Documents that open buckets connect make a cluster; a cluster is dealt into blocks of about BLOCK documents, and
        a task gets two of its blocks. It looks at every pair that shares a bucket there and puts out only what links.
        """
        least = still_open.groupBy("bucket").agg(F.min("doc_id").alias("dst"))
        edges = still_open.join(least, "bucket").filter("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst")
        apart = still_open.select("doc_id", "label").distinct()
        clusters = _stored(connected_components(apart.select(F.col("doc_id").alias("node_id")), edges), "clusters")
        blocks = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        placed = apart.join(clusters.withColumnRenamed("node_id", "doc_id"), "doc_id").join(blocks, "component")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
        rows = placed.join(self.reps, "doc_id").join(self.texts, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id", "label", "n_shingles", "bands", "signature", "text")
        return rows.groupBy("component", "low", "high").applyInPandas(_spanning(self.k, self.percent), "src long, dst long")

    def _apart(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of buckets that still hold more than one component, with the component as ``label``."""
        labelled = rows.drop("label").join(labels, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
        return labelled.join(mixed, "bucket", "left_semi")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable), kept (is it itself)."""
    search = _Search(docs, k, percent, id_col, text_col)
    links = search.links().unionByName(search.by_id)
    labels = search.labels(links)
    classes = search.classes.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    with_words = search.rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"])
    without = search.rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = with_words.select("doc_id", "n_shingles", "component").unionByName(without)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, all columns.

    Rows are numbered once and stored with their texts, and the numbers are what is linked: rows that share an id, or have none,
    meet by their texts alone. Of a component the row with the smallest id stays (null last), then the smallest hash of its text.
    Documents without words stay, each for itself.
    """
    spark, row, key = docs.sparkSession, fresh("row"), fresh("key")
    path = stage_path(spark, "dedup-rows")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    found = near_duplicates(stored, k, percent, row, text_col).select("doc_id", "component_id")
    order = stored.select(F.col(row).alias(key), F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), F.col(row)).alias("order"))
    # One minimum per component, combined before the shuffle.
    kept = found.join(order, F.col("doc_id") == F.col(key)).groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first")[row].alias(key))
    return stored.join(kept, F.col(row) == F.col(key), "left_semi").select(*docs.columns)
