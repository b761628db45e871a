import re

from helpers import ODD, documents

from specframe.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(licenses.UPPER, licenses.LOWER)

TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License. And again: UNDER THE MIT LICENSE!", "under CC BY-NC 4.0, cc (by) nc", "SPDX-License-Identifier: GPL-3.0-or-later",
    "Licensed under the GNU Lesser General Public License, version 2.1 or later.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "the BSD 3-Clause License and the ISC license", "Mit License", "underthe mit license", "CC-BY-NC-SA 4.0 license", "nothing here", "licence licence licence", "All rights reserved. Public domain? placed into the public domain",
    "Licensed under the mit license " * 40, "é licensed under the éMIT License", "under the mit licenseé", "cc\nby\tnc",
]


def plain_base(text):
    words = WORD.findall((text or "").translate(LOW))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def plain_places(text):
    words = WORD.findall((text or "").translate(LOW))
    reduced = " " + " ".join(words) + " "
    hits = []
    for group in licenses.rule_groups():
        for rule in group["rules"]:
            hits += [(m.start(), -m.end(), rule["priority"], rule["number"], group["label"], rule["weight"]) for m in re.finditer(rule["pattern"], reduced)]
    hits.sort()
    kept = []
    for i, h in enumerate(hits):
        if not any(g[0] <= h[0] and g[1] <= h[1] and g[2] <= h[2] for g in hits[:i]):
            kept.append((h[4], h[5], h[0], -h[1]))
    return kept


def test_base_and_rules_against_plain_search(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, (_, t) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r, base = got[i], plain_base(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base, text
        places = plain_places(text)
        assert [(p["label"], p["weight"], p["begin"], p["end"]) for p in r["places"] or []] == places, text
        assert r["labels"] == ",".join(sorted({p[0] for p in places} | ({*base[4].split(",")} - {""})))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(places or base[1])


def test_suppression(spark):
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(documents(spark, list(enumerate(TEXTS)))).collect()}
    assert got[0] == "apache-2" and got[3] == "gpl-3" and got[4] == "lgpl-2.1"
    assert "bsd-3" in got[6] and "isc" in got[6]


def test_there_are_hundreds_of_rules():
    groups = licenses.rule_groups()
    numbers = [r["number"] for g in groups for r in g["rules"]]
    assert len(numbers) > 300 and len(set(numbers)) == len(numbers)
    for g in groups:  # a keyword stands in every match that a name pattern can make on its own
        assert g["keywords"] and all(k == k.lower() for k in g["keywords"])


def test_empty_table(spark):
    assert licenses.scan(documents(spark, ODD).limit(0)).count() == 0


def shortest_matches(pattern):
    """A shortest text for every alternative of a rule's pattern, without its bounds."""
    options = lambda branches: [t for b in branches for t in sequence(b)]

    def sequence(parts):
        out = [""]
        for kind, value in parts:
            name = str(kind)
            if name == "LITERAL":
                own = [chr(value)]
            elif name == "IN":
                own = [chr(value[0][1])]
            elif name == "ANY":
                own = ["x"]
            elif name == "BRANCH":
                own = options(value[1])
            elif name == "SUBPATTERN":
                own = sequence(value[3])
            else:  # repeats
                assert name in ("MAX_REPEAT", "MIN_REPEAT")
                own = [t * value[0] for t in sequence(value[2])] if value[0] else [""]
            out = [a + b for a in out for b in own]
        return out

    return sorted(set(sequence(re._parser.parse(pattern.removeprefix("(?<= )").removesuffix("(?= )")))))


def test_every_rule_fires_on_its_own_match_alone(spark):
    cases = []
    for group in licenses.rule_groups():
        for rule in group["rules"]:
            cases += [(rule["number"], t) for t in shortest_matches(rule["pattern"])]
    assert {n for n, _ in cases} == {r["number"] for g in licenses.rule_groups() for r in g["rules"]}
    texts = sorted({t for _, t in cases}) + ["placed into the public\ndomain", "released under MIT", "All rights reserved."]
    got = {texts[r["doc_id"]]: r for r in licenses.scan(documents(spark, list(enumerate(texts)))).collect()}
    for text in texts:
        expected = plain_places(text)
        assert expected and [(p["label"], p["weight"], p["begin"], p["end"]) for p in got[text]["places"] or []] == expected, text
    reduced = spark.createDataFrame([(t, f" {t} ") for t in {t for _, t in cases}], "text string, reduced string")
    fired = {r["text"]: set(r["numbers"]) for r in reduced.select("text", licenses.detections(reduced["reduced"])["number"].alias("numbers")).collect()}
    assert all(number in fired[text] for number, text in cases)
