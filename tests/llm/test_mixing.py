import itertools
import random

import numpy as np
import pytest
from helpers import ODD, documents

from specframe.llm import mixing


def test_knapsack_finds_the_best_sum():
    rng = random.Random(3)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4)))
        counts = np.array([rng.randint(0, 3) for _ in lengths])
        budget = rng.randint(0, 70)
        picks = mixing.knapsack(lengths, counts, budget)
        assert (picks >= 0).all() and (picks <= counts).all()
        sums = {sum(a * b for a, b in zip(take, lengths.tolist())) for take in itertools.product(*[range(c + 1) for c in counts.tolist()])}
        assert int((picks * lengths).sum()) == max(s for s in sums if s <= budget)


def test_fit_counts_meets_the_budget():
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(rng.integers(1, 4000, 600)), None
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.0, 0.01, 0.37, 0.8, 1.0):
        budget = int(total * share)
        taken = mixing.fit_counts(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        assert budget - int((taken * lengths).sum()) in (0, *range(3))


def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: 3.0 * sizes[s] for s in over})


def test_mix_against_plain_shares(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 60))), None, rng.choice(["a", "B", "é", "z", None, "hot", "hot", "hot"])) for i in range(900)]
    rows += [(2000 + i, "x y", None, "tiny") for i in range(3)] + [(3000 + i, "same length text", None, "hot") for i in range(400)]
    docs = documents(spark, rows)
    got = mixing.mix_sources(docs).toPandas()
    sizes = got.groupby("source", dropna=False)["size"].sum()
    sizes = {None if s != s or s is None else s: int(v) for s, v in sizes.items()}
    expected = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got.itertuples():
        source = None if r.source is None or r.source != r.source else r.source
        assert r.target == pytest.approx(expected[source], rel=1e-12)
        assert r.source_size == sizes[source] and r.taken == r.copies * r.size and 0 <= r.copies <= 3
    for source, own in got.assign(source=got.source.fillna("-")).groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 2
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    key = ["doc_id", "copies"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))


def test_odd_rows_and_stage(spark):
    docs = documents(spark, [(i, t, None, "s" if i != 6 else None) for i, t in ODD])
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == len(ODD)
    assert (got[got["size"] == 0].taken == 0).all()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.filter("trim(text) = ''").count() == 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_stage_keeps_the_decision_of_every_row(spark):
    rng = random.Random(8)
    text = lambda i: f"t{i} " + " ".join("w" for _ in range(rng.randint(1, 40)))
    rows = [(i, text(i), None, rng.choice(["a", "b", "c", None])) for i in range(400)]
    rows += [(None, text(1000 + i), None, rng.choice(["a", "b", "c"])) for i in range(300)]  # a third of the corpus has no id
    rows += [(7, text(2000 + i), None, rng.choice(["a", "b", "c"])) for i in range(200)]
    docs = documents(spark, rows)
    decided = mixing.mix_sources(docs).toPandas()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.toPandas()
    got["size"] = got.text.str.split().str.len()
    own = decided.assign(source=decided.source.fillna("-"))
    words = got.assign(source=got.source.fillna("-")).groupby("source")["size"].sum()
    for source, group in own.groupby("source"):
        assert abs(words[source] - group.target.iloc[0]) <= 2
    taken = own.groupby(["source", "size"]).copies.sum()
    copies = got.assign(source=got.source.fillna("-")).groupby(["source", "size"]).size()
    assert taken[taken > 0].to_dict() == copies.to_dict()
    # The choice by the seeded order of ids is that of mix_sources where no id repeats.
    alone = documents(spark, rows[:7] + rows[8:400])
    expected = mixing.mix_sources(alone).filter("copies > 0").toPandas()
    assert dict(zip(expected.doc_id, expected.copies)) == mixing.mixed_documents(alone).toPandas().groupby("doc_id").size().to_dict()
