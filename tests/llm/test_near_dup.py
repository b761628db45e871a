import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD, documents

from specframe.llm import near_dup


def plain(rows, k, percent=80):
    """Components by comparing every pair of distinct sets; rows that share an id are one node."""
    sets = [near_dup.shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or (sets[i] and sets[j] and 100 * shared >= percent * union):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def as_key(r):
    return tuple(-1 if x is None else x for x in r)


def test_sketch_estimates_similarity_without_bias():
    rng = np.random.default_rng(0)
    for size in (2, 40, 700):
        found, true = [], []
        for _ in range(80):
            items = np.unique(rng.integers(0, 2**63, 2 * size).astype(np.uint64))
            a, b = items[: int(1.6 * size)], items[int(0.4 * size):]
            found.append((near_dup.sketch(a, 160) == near_dup.sketch(b, 160)).mean())
            true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(found) - np.mean(true)) < 0.02
        assert np.std(np.array(found) - np.array(true)) < 0.06
    assert (near_dup.sketch(np.array([7], dtype=np.uint64), 160) != np.uint64(2**64 - 1)).all()


@pytest.mark.parametrize("k", [2, 5])
def test_components_against_all_pairs(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10_000_000), " ".join(words)))
    rows += [(20_000_000 + i, rows[0][1]) for i in range(30)]
    docs = documents(spark, rows)
    got = near_dup.near_duplicates(docs, k=k).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain(rows, k))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = near_dup.deduplicated(docs, k=k)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in plain(rows, k)})


def test_odd_rows(spark):
    rows = ODD + [(8, "A WORD or two HERE"), (9, "same  text\ntwice"), (5, "a word or two here")]
    got = near_dup.near_duplicates(documents(spark, rows), k=2).collect()
    expected = [(i, n, None if i is None and n == 0 else c) for i, n, c in plain(rows, 2)]
    assert sorted(map(as_key, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(as_key, expected))
    kept = near_dup.deduplicated(documents(spark, rows), k=2)
    # Two texts stand under id 5: the first is also 7's, the second that of the row without an id and of 8.
    assert sorted(r["text"] for r in kept.filter("doc_id = 5").collect()) == ["a word or two here", "same text twice"]
    assert kept.filter("doc_id IS NULL OR doc_id IN (7, 8, 9)").count() == 0 and kept.filter("doc_id IN (1, 2, 3)").count() == 3
    assert near_dup.near_duplicates(documents(spark, rows).limit(0), k=2).count() == 0
    assert near_dup.deduplicated(documents(spark, rows).limit(0)).count() == 0


def test_byte_difference_expression(spark):
    a, b = [0x1122334455667788, -1, 0], [0x1122334455667788, 0x7FFFFFFFFFFFFF00, 0x0100000000000080]
    df = spark.createDataFrame([(a, b)], "sa array<bigint>, sb array<bigint>")
    count = lambda x, y: sum(p != q for p, q in zip((x & (2**64 - 1)).to_bytes(8, "big"), (y & (2**64 - 1)).to_bytes(8, "big")))
    assert df.select(near_dup._differing("sa", "sb", 3)).first()[0] == sum(map(count, a, b))


def test_rows_that_share_an_id_or_have_none_lose_no_text(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(40))
    different = [text() for _ in range(30)]
    third = [(7, t) for t in different[:10]] + [(None, t) for t in different[10:20]]
    rows = third + third + [(100 + i, t) for i, t in enumerate(different[20:])] + [(None, different[0]), (3, different[15])]
    runs = [sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in near_dup.deduplicated(documents(spark, rows).repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and sorted(t for *_, t in runs[0]) == sorted(different)
    ids = {t: (None if none else i) for none, i, t in runs[0]}
    assert ids[different[0]] == 7 and ids[different[15]] == 3 and ids[different[11]] is None
