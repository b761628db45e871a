"""Toxicity by compression distance: which of two dictionaries makes a window of text shorter.

Two zstandard dictionaries share a base, trained on windows of ordinary text. Each ends in a part of its own: the
toxic one in a dictionary trained on what recurs in toxic documents and is new to ordinary ones (words with a run of
``GRAM`` characters that no ordinary training document has, which stand after many different words), the ordinary one in a dictionary of the same size trained
on further ordinary windows. Because the base is common, most windows compress to the same length under both, and the
gain (ordinary length - toxic length) of a window is large only where it holds toxic material.

A document's features are its largest gains, the numbers of windows at rising thresholds of gain, and its length. Their
weights come from logistic regression on documents that the dictionaries were not trained on; the cut with the best F-measure
there is moved to ``CUT``, so the score reads alike on every corpus.

Fitting reads at most ``max_toxic`` and ``max_ordinary`` labelled documents, the first by hash of the id, and at most ``max_bytes`` of
text per label: a bounded sample whose sizes are parameters. One task fits it; dictionaries are trained on at most ``MAX_WINDOWS``
of its windows each, in a seeded order. Scoring covers whole texts of all rows, without a shuffle.

Defined results: a text without a window of some gain, so any null or empty text, scores 0; without a labelled
document of both kinds every score is 0; repeated texts are used once for fitting, and of rows that share an id the smallest text; equal texts get equal scores; an empty
table gives an empty result. Other columns pass by untouched.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 6  # words
GRAM = 6  # characters
BASE_BYTES, OWN_BYTES = 96 * 1024, 4 * 1024
MAX_TOXIC, MAX_ORDINARY = 4000, 6000
MAX_BYTES = 64 * 1024 * 1024  # of sampled texts, per label
FIT_SHARE = 0.6  # of the sample for the dictionaries, the rest for the weights
CUT = 0.7
BETA = 0.5
MAX_WINDOWS = 80_000  # that a dictionary is trained on
STEPS = tuple(range(2, 11))  # thresholds of gain, bytes
MODEL = pa.schema([("toxic", pa.binary()), ("ordinary", pa.binary()), *[(name, pa.list_(pa.float64())) for name in ("centre", "spread", "weights")]])


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]  # the first is the constant


def windows(text: str) -> list[bytes]:
    """Runs of WINDOW lower-cased words, side by side, as bytes."""
    words = text.lower().split()
    return [(" " + " ".join(words[i : i + WINDOW]) + " ").encode() for i in range(0, len(words), WINDOW)]


def compressor(content: bytes):
    settings = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=1, min_match=6, target_length=0, strategy=zstandard.STRATEGY_DFAST,
        write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=settings)


def gains(text: str, toxic, ordinary) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one, per window."""
    with_toxic, with_ordinary = toxic.compress, ordinary.compress
    return np.array([len(with_ordinary(w)) - len(with_toxic(w)) for w in windows(text)], dtype=np.int64)


def features(gain: np.ndarray) -> list[float]:
    top = np.sort(gain)[::-1][:3].tolist() + [0, 0, 0]
    return [*map(float, top[:3]), *[math.log1p(int((gain >= s).sum())) for s in STEPS], math.log1p(len(gain))]


def _trained(samples: list[bytes], size: int, **options) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _grams(word: str) -> set[str]:
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def train_dictionaries(toxic: list[str], ordinary: list[str], seed: int = 7) -> tuple[bytes, bytes]:
    rng = random.Random(seed)
    plain = sorted({w for text in ordinary for w in windows(text)})
    rng.shuffle(plain)
    half = len(plain) // 2
    base = _trained(plain[:half][:MAX_WINDOWS], BASE_BYTES)
    own = _trained(plain[half:][:MAX_WINDOWS], OWN_BYTES, k=32, d=6)
    known: set[str] = set()
    for word in {w for text in ordinary for w in text.lower().split()}:
        known |= _grams(f" {word} ")
    after: dict[str, set[str]] = defaultdict(set)  # words in front of each new word: copies of one text give one
    new = []
    for text in toxic:
        words = text.lower().split()
        for before, word in zip(["", *words], words):
            if not _grams(f" {word} ") <= known:
                after[word].add(before)
        new.extend(f" {w} " for w in sorted(set(words) & after.keys()))
    needed = max(2, math.ceil(0.01 * len(toxic)))
    recurring = [w for w in new if len(after[w.strip()]) >= needed]
    rng.shuffle(recurring)
    samples = [" ".join(recurring[i : i + 8]).encode() for i in range(0, len(recurring), 8)]
    special = _trained(samples, OWN_BYTES, k=24, d=6) if samples else b""
    pad = base[: OWN_BYTES]
    return base + (pad + special)[-OWN_BYTES:], base + (pad + own)[-OWN_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(hessian, x.T @ (y - p) - ridge * beta)
    return beta


def best_cut(value: np.ndarray, y: np.ndarray) -> float:
    """The value midway between two documents at which calling everything above it toxic has the best F-measure.

    Precision weighs twice as much as recall (BETA), since a false alarm costs a clean document.
    """
    order = np.argsort(-value, kind="stable")
    sorted_value, hits = value[order], np.cumsum(y[order])
    score = (1 + BETA**2) * hits / (np.arange(1, len(y) + 1) + BETA**2 * y.sum())
    ends = np.append(sorted_value[:-1] > sorted_value[1:], True)  # ties stay together
    at = int(np.argmax(np.where(ends, score, -1)))
    below = sorted_value[at + 1] if at + 1 < len(y) else sorted_value[at] - 1.0
    return float((sorted_value[at] + below) / 2)


def fit(rows: list[tuple[str, int]], seed: int = 7) -> ToxicityModel | None:
    """``rows``: (text, label) in a fixed order. None if one of the labels is missing."""
    rows = list(dict.fromkeys((t or "", int(y)) for t, y in rows))
    toxic, ordinary = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    cut_t, cut_o = math.ceil(len(toxic) * FIT_SHARE), math.ceil(len(ordinary) * FIT_SHARE)
    with_toxic, with_ordinary = train_dictionaries(toxic[:cut_t], ordinary[:cut_o], seed)
    a, b = compressor(with_toxic), compressor(with_ordinary)
    x = np.array([features(gains(t, a, b)) for t in [*toxic[cut_t:], *ordinary[cut_o:]]])
    y = np.array([1.0] * (len(toxic) - cut_t) + [0.0] * (len(ordinary) - cut_o))
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(x)), np.clip((x - centre) / spread, -4, 4)])
    weights = _logistic(x, y)
    weights[0] += math.log(CUT / (1 - CUT)) - best_cut(x @ weights, y)
    return ToxicityModel(with_toxic, with_ordinary, tuple(centre), tuple(spread), tuple(weights))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY,
                    max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(i, t, y): id, text and label of the first documents by hash of the id, per label; ``usable`` is a condition on the id column.

    The ids are chosen from the labels alone; at most max_toxic + max_ordinary of them are broadcast to the texts. An id has one
    text, the smallest. Texts above a hundredth of ``max_bytes`` are left out, and of each label what goes beyond ``max_bytes`` in the order
    of the hashes, so neither the number of rows nor their bytes grow with the input.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & usable).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    order = F.md5(F.col("i").cast("string").cast("binary"))
    chosen = known.filter("y = 1").orderBy(order).limit(max_toxic).union(known.filter("y = 0").orderBy(order).limit(max_ordinary))
    ids = chosen.groupBy("i").agg(F.max("y").alias("y"))
    fitting = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) <= max_bytes // 100
    texts = docs.filter(fitting).select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(ids), "i")
    texts = texts.groupBy("i", "y").agg(F.min("t").alias("t"))
    # The window holds one label's part of the sample, whose rows are bounded above.
    running = F.sum(F.octet_length("t")).over(Window.partitionBy("y").orderBy(order, "i").rowsBetween(Window.unboundedPreceding, 0))
    return texts.withColumn("bytes", running).filter(F.col("bytes") <= max_bytes).select("i", "t", "y")


def fit_sample(sample: DataFrame, seed: int = 7) -> ToxicityModel | None:
    """The model of ``labelled_sample``'s rows, fitted in one task; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(str(r["i"]), r["t"], r["y"]) for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: r[:2])
        random.Random(1).shuffle(rows)
        model = fit([(t, y) for _, t, y in rows], seed)
        if model is not None:
            yield pa.RecordBatch.from_pylist([vars(model)], schema=MODEL)

    found = sample.coalesce(1).mapInArrow(run, "toxic binary, ordinary binary, centre array<double>, spread array<double>, weights array<double>").collect()
    if not found:
        return None
    row = found[0]
    return ToxicityModel(bytes(row["toxic"]), bytes(row["ordinary"]), tuple(row["centre"]), tuple(row["spread"]), tuple(row["weights"]))


def score_column(model: ToxicityModel | None, text: Column) -> Column:
    """The score of a text as a double."""
    if model is None:
        return F.lit(0.0)
    ready: list = []

    def score(texts: pd.Series) -> pd.Series:
        if not ready:
            ready.extend([compressor(model.toxic), compressor(model.ordinary)])
        rows = [features(gains(t or "", *ready)) for t in texts]
        if not rows:
            return pd.Series([], dtype="float64")
        x = np.array(rows)
        z = np.clip((x - np.array(model.centre)) / np.array(model.spread), -4, 4)
        value = z @ np.array(model.weights[1:]) + model.weights[0]
        return pd.Series(np.where(x[:, 0] < STEPS[0], 0.0, 1.0 / (1.0 + np.exp(-np.clip(value, -500, 500)))))

    return F.pandas_udf(score, "double")(text)


def score_documents(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the score as one more column."""
    return docs.withColumn(name, score_column(model, F.col(text_col)))
