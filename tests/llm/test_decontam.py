import random

import numpy as np
from helpers import ODD, documents

from specframe.llm import decontam

RNG = random.Random(12)
COMMON = ["the", "of", "and", "to", "in", "is"]


def sentence(n):
    return [RNG.choice(COMMON) if RNG.random() < 0.4 else "".join(RNG.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 25)), rng.integers(0, 4, rng.integers(1, 40))
        score, at = decontam.alignment(a, b)
        assert score == plain_alignment(a.tolist(), b.tolist())
        assert plain_alignment(a.tolist(), b[: at + 1].tolist()) == score


def planted():
    items = [(i, sentence(RNG.randint(15, 50))) for i in range(12)]
    docs, expected = [], set()
    for i in range(150):
        words = sentence(RNG.randint(40, 200))
        if i % 3 == 0:
            item, passage = items[i % 12]
            passage = list(passage)
            if i % 2:  # every seventh word changed, one word put in, one taken out
                for j in range(3, len(passage), 7):
                    passage[j] = "changed"
                passage.insert(5, "more")
                del passage[9]
            at = RNG.randrange(len(words))
            words = words[:at] + [w.capitalize() + "," for w in passage] + words[at:]
            expected.add((i, item))
        docs.append((i, " ".join(words)))
    return docs, items, expected


def test_copies_and_edited_copies_are_found(spark, monkeypatch):
    rows, items, expected = planted()
    rows += [(1000 + i, " ".join(items[1][1])) for i in range(200)]  # an item that leaked everywhere
    expected |= {(1000 + i, 1) for i in range(200)}
    docs = documents(spark, rows)
    tests = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items], "item_id long, text string, score string")
    got = decontam.contaminated(docs, tests).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected
    words = {i: decontam.words_of(t) for i, t in rows}
    for r in got:
        item = decontam.words_of(" ".join(dict(items)[r["item_id"]]))
        best = plain_alignment(item, words[r["doc_id"]])
        assert abs(r["score"] - best / (2 * len(item))) < 1e-9
        assert plain_alignment(item, words[r["doc_id"]][r["first_word"] : r["last_word"] + 1]) == best
    monkeypatch.setattr(decontam, "CHUNK_WORDS", 60)  # several chunks give the same
    again = decontam.contaminated(docs, tests).collect()
    key = lambda rs: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in rs)
    assert key(again) == key(got)
    kept = decontam.clean(docs, tests)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in expected}


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    tests = spark.createDataFrame([(1, None), (2, ""), (3, "same text twice"), (None, "word " * 20), (4, "nothing of this is in any of the documents here")], "item_id long, text string")
    got = decontam.contaminated(docs, tests).collect()
    found = [(r["doc_id"], r["item_id"], r["score"]) for r in got]
    assert sorted(found, key=str) == [(4, None, 1.0), (5, 3, 1.0), (5, 3, 1.0), (7, 3, 1.0)]
    assert decontam.contaminated(docs, tests.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), tests).count() == 0
    assert decontam.clean(docs, tests.limit(0)).count() == len(ODD)


def test_many_copies_of_one_edited_form_beside_a_verbatim_one(spark):
    item = [f"w{i}" for i in range(50)]
    edited = ["changed" if i % 5 == 4 else w for i, w in enumerate(item)]
    rows = [(i, f"head{i} " + " ".join(edited) + f" tail{i}") for i in range(300)] + [(300, " ".join(item))]
    rows += [(301 + i, " ".join(sentence(60))) for i in range(20)]
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in decontam.contaminated(docs, tests).collect()}
    assert set(got) == set(range(301))
    assert got[300]["score"] == 1.0 and got[0]["score"] == plain_alignment(decontam.words_of(" ".join(item)), decontam.words_of(rows[0][1])) / 100
    assert {r["doc_id"] for r in decontam.clean(docs, tests).collect()} == set(range(301, 321))


def test_short_items_count_where_they_stand_intact(spark):
    items = [(1, "The quick brown fox jumps"), (2, "two words"), (3, "one two three"), (4, "..."), (5, None)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = [(10, "long ago the quick, brown fox jumps over it"), (11, "the quick red fox jumps"), (12, "Two words!"), (13, "these are two words more"),
            (14, "zero one two three"), (15, "one two four three"), (16, ""), (17, None), (18, "quick brown fox jumps the quick brown fox")]
    docs = documents(spark, rows)
    got = {(r["doc_id"], r["item_id"], r["score"], r["first_word"], r["last_word"]) for r in decontam.contaminated(docs, tests).collect()}
    assert got == {(10, 1, 1.0, 2, 6), (12, 2, 1.0, 0, 1), (14, 3, 1.0, 1, 3)}
    assert sorted(r["doc_id"] for r in decontam.clean(docs, tests).collect()) == [11, 13, 15, 16, 17, 18]


def test_found_pairs_equal_aligning_every_pair(spark):
    rng = random.Random(31)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(4, 24)))) for i in range(25)]
    rows = []
    for i in range(90):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        passage = rng.choice(items)[1].split()
        for j in range(rng.randint(0, 4)):
            passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
        at = rng.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + passage + words[at:])))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {}
    for i, text in rows:
        for j, item in items:
            a, b = item.split(), text.split()
            score = plain_alignment(a, b) / (2 * len(a))
            shares = any(a[x : x + 3] == b[y : y + 3] for x in range(len(a) - 2) for y in range(len(b) - 2))
            if shares and score >= (0.5 if len(a) >= 8 else 1.0):
                expected[(i, j)] = score
    # A place reaches half an item beyond its hits on either side, so a score may miss far words; none is missed at the threshold by more than that.
    assert set(got) <= set(expected) and all(got[k] <= expected[k] for k in got)
    assert {k for k, v in expected.items() if v >= 0.6} <= set(got) and len(got) > 60
