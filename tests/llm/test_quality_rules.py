import math
import random
import re
from collections import Counter

import numpy as np
from helpers import ODD, documents

from specframe.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(200):
        lang = rng.choice(["en", "de", "xx", None])
        common = rules.COMMON_WORDS.get(lang, rules.COMMON_WORDS["en"])
        words = [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 150))]
        if i % 10 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 7 == 0:
            words = words + words[:9]
        rows.append((i, "\n".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9)), lang))
    return rows + [(1000, "one two three\none two three\n\n  \none two three", "en"), (1001, "a b c a b c", "en"), (1002, "x x x x", "en")]


def test_counts_and_verdicts(spark):
    rows = corpus() + [(2000 + (i or 0), t) for i, t in ODD]
    got = {(r["doc_id"]): r for r in rules.judge(documents(spark, [r for r in rows if r[0] != 2005])).collect()}
    counted = {r["doc_id"]: r for r in rules.counts(documents(spark, rows)).collect()}
    refs = rules.references(rules.counts(documents(spark, rows)))
    langs = {r[0]: r[2] if len(r) > 2 else None for r in rows}
    for doc_id, text, *_ in rows:
        if doc_id not in got:
            continue
        r, expected = got[doc_id], plain(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected, text
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        c = counted[doc_id]
        if c["n_chars"] >= rules.MIN_CHARS:
            parts = [*c["classes"], c["n_chars"] - sum(c["classes"])]
            shares = [x / c["n_chars"] for x in parts]
            lang = langs[doc_id]
            expected_distance = distance(shares, refs[lang][0]) if lang in refs else min(distance(shares, ref[0]) for ref in refs.values())
            assert abs(r["char_distance"] - expected_distance) < 0.02  # the references differ by the few rows left out
        else:
            assert r["char_distance"] == 0.0
        assert r["kept"] == (not r["base_failed"] and r["char_distance"] <= rules.MAX_CHAR_DISTANCE and r["word_distance"] <= rules.MAX_WORD_DISTANCE)
    shouted = [got[i]["char_distance"] for i in range(0, 200, 10) if counted[i]["n_chars"] >= rules.MIN_CHARS]
    assert shouted and min(shouted) > rules.MAX_CHAR_DISTANCE


def test_class_counts_cover_the_text(spark):
    text = "abc ABC 12\t\n.,;:!?'\"()-/ #*$%&|<>@_+=[]{}\\^`~ é文"
    row = rules.counts(documents(spark, [(1, text)])).first()
    expected = [len(re.findall(p, text)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:]", r"[!?'\"()\-/]", r"[#*$%&|<>@_+=\[\]{}\\^`~]")]
    assert row["classes"] == expected and row["n_chars"] == len(text)
    assert np.isclose(sum(expected), len(text) - 2)


def test_empty_table(spark):
    assert rules.judge(documents(spark, ODD).limit(0)).count() == 0
    assert rules.judge(documents(spark, ODD)).count() == len(ODD)
