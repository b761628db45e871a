import random

import numpy as np
from helpers import ODD, documents
from pyspark.sql import functions as F

from specframe.llm import toxicity

BAD = ["grubbish", "nastyword", "vilething", "horridly"]


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["the", "ing", "an", "re", "on", "ti", "es", "or", "st", "en", "ha", "ou"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 200))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus(1200, 4)
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_sample(toxicity.labelled_sample(docs, known, F.col("doc_id") % 3 != 1))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_documents(docs, model).collect()}
    held = [(got[i], y) for i, y in labels if i % 3 == 1]
    hits = [(s >= toxicity.CUT) == bool(y) for s, y in held]
    assert np.mean(hits) > 0.95 and all(0 <= s <= 1 for s, _ in held)
    odd = toxicity.score_documents(documents(spark, ODD), model)
    assert odd.columns == [*documents(spark, ODD).columns, "toxicity"]
    scores = {(r["doc_id"], r["text"]): r["toxicity"] for r in odd.collect()}
    assert scores[(1, None)] == scores[(2, "")] < toxicity.CUT
    assert toxicity.score_documents(documents(spark, ODD).limit(0), model).count() == 0


def test_without_labels_every_score_is_zero(spark):
    docs = documents(spark, ODD)
    for rows in ([], [(1, 1), (5, 1)], [(None, 1), (5, None)]):
        known = spark.createDataFrame(rows, "doc_id long, toxic int")
        model = toxicity.fit_sample(toxicity.labelled_sample(docs, known, F.lit(True)))
        assert model is None
        assert {r["toxicity"] for r in toxicity.score_documents(docs, model).collect()} == {0.0}


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(50)] + [(3, f"another text of three {i}") for i in range(40)])
    known = spark.createDataFrame([(i, i % 2) for i in range(50)] * 2, "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, known, F.lit(True), max_toxic=6, max_ordinary=8).collect()
    assert 3 <= sum(r["y"] for r in rows) <= 6 and len(rows) <= 14 and len({r["i"] for r in rows}) == len(rows)
    large = documents(spark, [(i, "word " * 20) for i in range(40)] + [(i, "word " * 400) for i in range(40, 50)])
    rows = toxicity.labelled_sample(large, known, F.lit(True), max_bytes=1500).collect()
    assert rows == []  # a hundredth of 1,500 bytes is less than any of these texts
    rows = toxicity.labelled_sample(large, known, F.lit(True), max_bytes=10_000).collect()
    assert {r["i"] for r in rows} == set(range(40))
    rows = toxicity.labelled_sample(large, known, F.lit(True), max_bytes=10_000, max_toxic=5).collect()
    assert 2 <= sum(r["y"] for r in rows) <= 5


def test_the_task_fits_what_a_plain_call_fits(spark):
    rows, labels = corpus(150, 8)
    sample = toxicity.labelled_sample(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    plain = sorted((str(r["i"]), r["t"], r["y"]) for r in sample.collect())
    random.Random(1).shuffle(plain)
    assert toxicity.fit_sample(sample) == toxicity.fit([(t, y) for _, t, y in plain])


def test_best_cut_maximises_the_f_measure():
    rng = np.random.default_rng(2)
    value, y = np.round(rng.normal(size=60), 1), (rng.random(60) < 0.4).astype(float)
    f = lambda c: 1.25 * y[value > c].sum() / ((value > c).sum() + 0.25 * y.sum())
    assert f(toxicity.best_cut(value, y)) == max(f(c) for c in np.append(value, value.min() - 1))
