import math
from collections import Counter

import pytest
from helpers import ODD, documents

from specframe.llm import lm_score


def plain_losses(target, background):
    """A dictionary version of both models."""
    def symbols(text):
        return [int(lm_score.CLASS[10])] * 3 + [int(lm_score.CLASS[b]) for b in text.encode()]

    def grams(texts):
        out = Counter()
        for t in texts:
            s = symbols(t or "")
            out.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        return out

    a, b = grams(target), grams(background)
    scale = sum(a.values()) / sum(b.values())
    models = []
    for counts in (a, {g: n * scale for g, n in b.items()}):
        def p(context, x, counts=counts):
            lower = p(context[1:], x, counts) if context else 1 / lm_score.SYMBOLS
            size = len(context) + 1
            own = sum(n for g, n in counts.items() if g[4 - size :] == (*context, x))
            total = sum(n for g, n in counts.items() if g[4 - size : 3] == tuple(context))
            return (own + lm_score.ALPHA * lower) / (total + lm_score.ALPHA)
        models.append(p)

    def loss(text):
        s = symbols(text)
        values = [[-math.log2(p(tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s))] for p in models]
        return [sum(v) / len(v) for v in values]

    return loss


def test_losses_against_a_dictionary_model(spark):
    target = ["The rain in Spain.", "stays mainly", "in the plain, é 42!"]
    background = target + ["NOISE ### ### NOISE", "plain noise\nand rain"]
    docs = documents(spark, list(enumerate(background)))
    models = lm_score.fit(docs.filter("doc_id < 3"), docs)
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs, models).collect()}
    loss = plain_losses(target, background)
    for i in (0, 2, 3, 4):
        a, b = loss(background[i])
        assert got[i]["target_loss"] == pytest.approx(a, rel=1e-5) and got[i]["background_loss"] == pytest.approx(b, rel=1e-5)
        assert got[i]["score"] == pytest.approx(b - a, abs=1e-4) and got[i]["n_tokens"] == len(background[i].encode())
    assert got[0]["score"] > got[3]["score"]


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    models = lm_score.fit(docs.limit(0), docs)
    got = lm_score.score_documents(docs, models).collect()
    assert len(got) == len(ODD)
    empty = [r for r in got if r["doc_id"] in (1, 2)]
    assert all(r["n_tokens"] == 0 and r["score"] == 0.0 for r in empty)
    assert lm_score.score_documents(docs.limit(0), models).count() == 0


def test_capitals_digits_and_scripts_are_told_apart(spark):
    """Nothing of a text is merged: texts that differ in capitals, digits, signs or letters of another script score apart."""
    good = ["RAIN IN 1234", "дождь идет", "rain & sun", "雨が降る"]
    other = ["SNOW ON 5678", "мышка спит", "rain | sun", "猫が寝る"]
    docs = documents(spark, list(enumerate(good + other)))
    models = lm_score.fit(docs.filter("doc_id < 4"), docs)
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs, models).collect()}
    assert all(got[i] > 0.1 + got[i + 4] for i in range(4))
    unseen = lm_score.score_documents(documents(spark, [(9, "Ωψ ~^ zq 90")]), models).collect()[0]
    assert unseen["n_tokens"] == len("Ωψ ~^ zq 90".encode()) and unseen["target_loss"] > 0 and unseen["background_loss"] > 0


def test_portions_and_tasks_add_up(spark):
    texts = ["ab ab ab", "Ab 12", None, "", "é雨" * 40] * 7
    parts = lm_score.count_grams(documents(spark, list(enumerate(texts))).repartition(5))
    keys, counts = lm_score._counted(parts)
    want = Counter(int(c) for t in texts for c in lm_score.codes(t))
    assert dict(zip(keys.tolist(), counts.tolist())) == want and keys.tolist() == sorted(want)
