import math
import re
from collections import Counter

import numpy as np
import pytest

from specframe.llm import lexical_search

from helpers import ODD, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(ASCII_LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(TERM.findall((text or "").translate(ASCII_LOWER)))
    out = []
    for item, terms in queries.items():
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k):
    got = lexical_search.ranked_search(documents(spark, docs), spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, score string"), k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def corpus(seed, n):
    """Zipf words, so that lists of every length occur; some copies, some words in every document."""
    rng = np.random.default_rng(seed)
    docs = [(int(i), " ".join(f"W{x}" if x % 3 else f"w{x}, the" for x in rng.zipf(1.3, int(rng.integers(1, 80))) % 400)) for i in rng.permutation(n)]
    return docs + [(int(i), docs[0][1]) for i in range(n, n + n // 3)]


@pytest.mark.parametrize("chunk, shard", [(500_000, 1 << 15), (60, 150)])
def test_equals_brute_force(spark, monkeypatch, chunk, shard):
    monkeypatch.setattr(lexical_search, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    docs, rng = corpus(2, 900), np.random.default_rng(9)
    items = [(i, " ".join(f"w{x}" for x in rng.zipf(1.25, 12) % 400) + " the") for i in range(15)]
    assert found(spark, docs, items, 10) == brute(docs, items, 10)


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "WORD of Ñ à 文字"), (None, "same, text"), (4, "twice"), (4, "here; word"), (5, "word word"), (6, "nowhere-known")]
    docs = [*ODD, (8, "À à é É"), (9, "w\x00word\x7fOF")]
    assert found(spark, docs, items, 4) == brute(docs, items, 4)
    assert found(spark, [], items, 4) == [] and found(spark, docs, [], 4) == []


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 10)
    text = "Ab cd " * 20 + "x" * 50 + " É,f"
    assert [w.decode() for part in lexical_search.terms_of(text) for w in part] == TERM.findall(text.translate(ASCII_LOWER))


def test_blocks_are_skipped():
    """A rare term decides: the walk over the list that every document holds skips most blocks."""
    n = 20_000
    terms = np.concatenate([[0, 1] if i % 150 == 0 else [0] for i in range(n)])
    lengths = np.array([2 if i % 150 == 0 else 1 for i in range(n)])
    shard = lexical_search.Shard(list(range(n)), np.full(n, 10), lengths, terms, np.ones(len(terms), np.int64), np.array([1, 9000]), n, 10 * n)
    places, _, scored = shard.top(np.array([0, 1]), 20)
    assert places.tolist() == [150 * i for i in range(20)] and scored <= shard.blocks
    shard = lexical_search.Shard(list(range(n)), np.full(n, 10), lengths, terms, np.where(np.arange(len(terms)) < 5000, 9, 1), np.array([100, 9000]), n, 10 * n)
    assert shard.top(np.array([0, 1]), 20)[2] < shard.blocks / 2
