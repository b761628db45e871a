import math
import random

import numpy as np
from helpers import ODD, documents
from pyspark.sql import functions as F

from specframe.llm import quality_model


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(1)
    data = [rng.normal(size=(40, 15)), rng.normal(1.0, 2.0, size=(90, 15))]
    n, sums = np.array([40.0, 90.0]), np.array([d.sum(axis=0) for d in data])
    squares = np.array([d.T @ d for d in data])
    model = quality_model.discriminant(n, sums, squares)
    pooled = sum(len(d) * np.cov(d.T, bias=True) for d in data) / 130
    x = rng.normal(size=(5, 15))
    logs = []
    for d in data:
        cov = 0.9 * np.cov(d.T, bias=True) + 0.1 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-6 * np.eye(15)
        away = x - d.mean(axis=0)
        logs.append(math.log(len(d) / 130) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = [rng.choice(["alpha", "beta", "gamma", "of", "the", "rain"]) + str(rng.randint(0, 99) if rng.random() < 0.2 else "") for _ in range(rng.randint(20, 90))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    docs, known = documents(spark, rows), spark.createDataFrame(labels + labels[:5] + [(9999, 1), (3, None), (4, 7)], "doc_id long, quality int")
    stats = quality_model.statistics_table(docs)
    model = quality_model.fit(stats, known, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["s"] for r in stats.select("doc_id", quality_model.score_column(model, F.col("x")).alias("s")).collect()}
    held = [(got[i] >= quality_model.CUT) == bool(y) for i, y in labels if i % 5 == 0]
    assert np.mean(held) > 0.97
    odd = quality_model.statistics_table(documents(spark, ODD))
    scores = [r["s"] for r in odd.select(quality_model.score_column(model, F.col("x")).alias("s")).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert quality_model.statistics_table(docs.limit(0)).count() == 0


def test_missing_class_gives_a_constant(spark):
    stats = quality_model.statistics_table(documents(spark, ODD))
    for rows, expected in (([], 0.5), ([(1, 1), (2, 1), (3, 1)], 1.0)):
        model = quality_model.fit(stats, spark.createDataFrame(rows, "doc_id long, quality int"), F.lit(True))
        assert {r["s"] for r in stats.select(quality_model.score_column(model, F.col("x")).alias("s")).collect()} == {expected}
