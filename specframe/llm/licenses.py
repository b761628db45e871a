"""License scans by ordered signature rules, in DataFrame expressions only.

A text is reduced to its words in lower case with single spaces. Each license family has a name pattern and literal
keywords of which every match must hold one; each form is a way to invoke a license, with a priority and a weight. Family
times form gives the rules. Work is gated by what the rules themselves must hold, in the reduced text: families are looked
at only where some form's literal stands, a family only where one of its keywords does, a rule only where a literal of its own
form does. All places of all rules that ran are then ordered by start, longer first, and a place is suppressed if a place of the
same or a stronger priority contains it: the notice
``licensed under the gnu lesser general public license`` silences the ``general public license`` inside it.

Beside the rules stand the base phrases, which are counted at every place and whose labels always stay.

Everything is evaluated inside the row; nothing is shuffled and no text leaves its task.

Defined results: a null text is an empty one: no words, no places, null first and last word, empty labels, score 0. Equal
texts get equal results; two rules on the same place count once, for the stronger priority and then the earlier rule; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

# Words of a scan: runs of ASCII letters and digits and of everything beyond ASCII.
SCAN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCAN_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Base phrases and their labels; fixed values.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_V = "(?:v ?|version )?"  # before a version number
_LATER = "(?: or (?:any |at your option any )?later(?: version)?| only)?"
# Families: label, pattern of the name in reduced text, keywords. Names are public license names.
FAMILIES = (
    ("mit", "(?:mit|expat)", ("mit", "expat")), ("mit-0", "mit (?:0|no attribution)", ("mit",)), ("x11", "x11", ("x11",)), ("isc", "isc", ("isc",)),
    ("bsd", "(?:berkeley software distribution|bsd)", ("bsd", "berkeley")), ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause|bsd 0 clause)", ("0bsd", "zero clause", "0 clause")),
    ("bsd-2", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", ("2 clause", "two clause", "simplified bsd", "freebsd")),
    ("bsd-3", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", ("3 clause", "three clause", "new bsd", "modified bsd", "revised bsd")),
    ("bsd-4", "(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)", ("4 clause", "original bsd", "old bsd")),
    ("apache", "apache(?: software)?", ("apache",)), ("apache-1", f"apache(?: software)?(?: licen[sc]e)? {_V}1(?: 0)?", ("apache",)), ("apache-1.1", f"apache(?: software)?(?: licen[sc]e)? {_V}1 1", ("apache",)),
    ("apache-2", f"apache(?: software)?(?: licen[sc]e)? {_V}2(?: 0)?", ("apache",)),
    ("gpl", "(?:gnu )?(?:general public|gpl)", ("general public", "gpl")), ("gpl-1", f"(?:gnu )?(?:general public licen[sc]e|gpl) ?{_V}1(?: 0)?{_LATER}", ("general public", "gpl")),
    ("gpl-2", f"(?:gnu )?(?:general public licen[sc]e|gpl) ?{_V}2(?: 0)?{_LATER}", ("general public", "gpl")), ("gpl-3", f"(?:gnu )?(?:general public licen[sc]e|gpl) ?{_V}3(?: 0)?{_LATER}", ("general public", "gpl")),
    ("lgpl", "(?:gnu )?(?:(?:lesser|library) general public|lgpl)", ("lesser general", "library general", "lgpl")), ("lgpl-2", f"(?:gnu )?(?:library general public licen[sc]e|lgpl) ?{_V}2(?: 0)?{_LATER}", ("library general", "lgpl")),
    ("lgpl-2.1", f"(?:gnu )?(?:lesser general public licen[sc]e|lgpl) ?{_V}2 1{_LATER}", ("lesser general", "lgpl")), ("lgpl-3", f"(?:gnu )?(?:lesser general public licen[sc]e|lgpl) ?{_V}3(?: 0)?{_LATER}", ("lesser general", "lgpl")),
    ("agpl", "(?:gnu )?(?:affero general public|agpl)", ("affero", "agpl")), ("agpl-3", f"(?:gnu )?(?:affero general public licen[sc]e|agpl) ?{_V}3(?: 0)?{_LATER}", ("affero", "agpl")),
    ("gfdl", "(?:gnu )?(?:free documentation|gfdl|fdl)", ("documentation", "fdl")), ("mpl-1", f"(?:mozilla public(?: licen[sc]e)?|mpl) ?{_V}1(?: 0)?", ("mozilla", "mpl")),
    ("mpl-1.1", f"(?:mozilla public(?: licen[sc]e)?|mpl) ?{_V}1 1", ("mozilla", "mpl")), ("mpl-2", f"(?:mozilla public(?: licen[sc]e)?|mpl) ?{_V}2(?: 0)?", ("mozilla", "mpl")),
    ("epl-1", f"(?:eclipse public(?: licen[sc]e)?|epl) ?{_V}1(?: 0)?", ("eclipse", "epl")), ("epl-2", f"(?:eclipse public(?: licen[sc]e)?|epl) ?{_V}2(?: 0)?", ("eclipse", "epl")),
    ("cddl", f"(?:common development and distribution(?: licen[sc]e)?|cddl)(?: ?{_V}1(?: [01])?)?", ("common development", "cddl")), ("cpl-1", "(?:common public|cpl)", ("common public", "cpl")),
    ("eupl", f"(?:european union public(?: licen[sc]e)?|eupl)(?: ?{_V}1(?: [012])?)?", ("european union public", "eupl")), ("artistic-1", f"artistic(?: licen[sc]e)? {_V}1(?: 0)?", ("artistic",)),
    ("artistic-2", f"artistic(?: licen[sc]e)? {_V}2(?: 0)?", ("artistic",)), ("boost-1", f"(?:boost software(?: licen[sc]e)?|boost|bsl)(?: ?{_V}1(?: 0)?)?", ("boost", "bsl")),
    ("zlib", "(?:zlib(?: libpng)?)", ("zlib",)), ("libpng", "libpng(?: 2 0)?", ("libpng",)), ("unlicense", "(?:the )?unlicense", ("unlicense",)), ("wtfpl", "(?:do what the fuck you want to public|wtfpl)", ("do what the", "wtfpl")),
    ("cc0", f"(?:creative commons zero|cc0|cc zero)(?: ?{_V}1 0)?(?: universal)?", ("commons zero", "cc0", "cc zero")),
    ("cc-by", "(?:creative commons attribution|cc by)(?: [1234] [05])?", ("commons attribution", "cc by")), ("cc-by-sa", "(?:creative commons attribution share ?alike|cc by sa)(?: [1234] [05])?", ("share", "by sa")),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|cc by nc)(?: [1234] [05])?", ("commercial", "by nc")), ("cc-by-nd", "(?:creative commons attribution no ?deriv(?:ative)?s?|cc by nd)(?: [1234] [05])?", ("deriv", "by nd")),
    ("cc-by-nc-sa", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1234] [05])?", ("share", "nc sa")), ("cc-by-nc-nd", "(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s?|cc by nc nd)(?: [1234] [05])?", ("deriv", "nc nd")),
    ("ofl-1.1", f"(?:sil open font|open font|ofl)(?: licen[sc]e)?(?: ?{_V}1 1)?", ("open font", "ofl")), ("odbl", "(?:open database|odbl|odc odbl)", ("open database", "odbl")), ("odc-by", "(?:open data commons attribution|odc by)", ("open data commons", "odc by")),
    ("pddl", "(?:public domain dedication and|pddl)", ("public domain", "pddl")), ("psf", "(?:python software foundation|psf)", ("python software", "psf")), ("php-3", f"php(?: licen[sc]e)? {_V}3(?: 01?)?", ("php",)),
    ("postgresql", "postgresql", ("postgresql",)), ("ncsa", "(?:university of illinois ncsa open source|ncsa)", ("ncsa",)), ("openssl", "(?:openssl|ssleay)", ("openssl", "ssleay")), ("ms-pl", "(?:microsoft public|ms pl)", ("microsoft public", "ms pl")),
    ("ms-rl", "(?:microsoft reciprocal|ms rl)", ("microsoft reciprocal", "ms rl")), ("afl-3", f"(?:academic free|afl)(?: licen[sc]e)? ?{_V}3(?: 0)?", ("academic free", "afl")), ("osl-3", f"(?:open software|osl)(?: licen[sc]e)? ?{_V}3(?: 0)?", ("open software", "osl")),
    ("sspl-1", "(?:server side public|sspl)", ("server side", "sspl")), ("busl-1.1", "(?:business source|busl)", ("business source", "busl")), ("elastic-2", f"elastic(?: licen[sc]e)? {_V}2(?: 0)?", ("elastic",)),
)
# Forms: pattern around the name (N), priority (0 is strongest), weight, literals of which every match must hold one.
FORMS = (
    ("spdx licen[sc]e identifier N", 0, 1.0, (" spdx licen",)),
    ("(?:licen[sc]ed|released|distributed|published|provided|available|offered) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?N(?: (?:public )?licen[sc]e)?(?: as published by the free software foundation)?", 1, 0.9,
     ("ed under ", "available under ", " to you under ")),
    ("(?:governed by|covered by|subject to|pursuant to|in accordance with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?N(?: licen[sc]e)?", 1, 0.8,
     (" governed by ", " covered by ", " subject to ", " pursuant to ", " in accordance with ")),
    ("under (?:the )?N licen[sc]e", 1, 0.8, (" licen",)),
    ("licen[sc]e (?:is )?N(?: licen[sc]e)?", 2, 0.7, (" licen",)),
    ("(?:the )?N licen[sc]e(?: agreement)?", 2, 0.6, (" licen",)),
)
# Clauses by which a license shows without its name: label, pattern, keyword.
CLAUSES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("bsd-3", "neither the name of .{1,120}? nor the names of its contributors may be used to endorse", "nor the names"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", "advertising materials"),
    ("apache-2", "you may not use this file except in compliance with the licen[sc]e", "in compliance with"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "free software"),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "free software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[sc]e", "source code form"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", "you just do what the fuck you want to", "do what the"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "hereby granted"),
    ("cc0", "has waived all copyright and related or neighboring rights", "neighboring rights"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("proprietary", "all rights reserved", "rights reserved"),
)
CLAUSE_PRIORITY, CLAUSE_WEIGHT, BASE_WEIGHT = 1, 0.9, 0.9
PRIORITIES = 3

RULE_TYPE = "array<struct<keywords:array<string>,label:string,rules:array<struct<number:int,pattern:string,priority:int,weight:double,needs:array<string>>>>>"


def rule_groups() -> list[dict]:
    """Families and clauses with their rules in order; whole words only."""
    whole = lambda pattern: f"(?<= ){pattern}(?= )"
    groups, number = [], 0
    for label, pattern, keyword in CLAUSES:
        groups.append({"keywords": [keyword], "label": label, "rules": [{"number": number, "pattern": whole(pattern), "priority": CLAUSE_PRIORITY, "weight": CLAUSE_WEIGHT, "needs": [keyword]}]})
        number += 1
    for label, name, keywords in FAMILIES:
        rules = []
        for form, priority, weight, needs in FORMS:
            rules.append({"number": number, "pattern": whole(form.replace("N", name)), "priority": priority, "weight": weight, "needs": list(needs)})
            number += 1
        groups.append({"keywords": list(keywords), "label": label, "rules": rules})
    return groups


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(text: Column, pattern: Column) -> Column:
    """(begin, end) of every match, from the pieces between the matches and the matches themselves."""
    return F.transform(F.array(F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))), lambda x: F.aggregate(
        F.zip_with(x["found"], F.slice(x["between"], F.lit(1), F.size(x["found"])), lambda f, b: F.struct(F.length(b).alias("skip"), F.length(f).alias("size"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("places")),
        lambda a, m: F.struct((a["at"] + m["skip"] + m["size"]).alias("at"), F.concat(a["places"], F.array(F.struct((a["at"] + m["skip"]).alias("begin"), (a["at"] + m["skip"] + m["size"]).alias("end")))).alias("places")),
        lambda a: a["places"]))[0]


def detections(text: Column) -> Column:
    """Places of all rules in reduced text, as an ordered array of (begin, longest, priority, number, end, label, weight)."""
    groups = rule_groups()
    table = lambda own: F.from_json(F.lit(json.dumps(own)), RULE_TYPE)
    holds = lambda literals: F.exists(literals, lambda k: F.contains(text, k))
    invoked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in sorted({k for form in FORMS for k in form[3]})])
    near = F.filter(F.when(invoked, table(groups)).otherwise(table(groups[: len(CLAUSES)])), lambda g: holds(g["keywords"]))
    hits = F.flatten(F.transform(near, lambda g: F.flatten(F.transform(F.filter(g["rules"], lambda r: holds(r["needs"])), lambda r: F.transform(_places(text, r["pattern"]), lambda p: F.struct(
        p["begin"].alias("begin"), (-p["end"]).alias("longest"), r["priority"].alias("priority"), r["number"].alias("number"), p["end"].alias("end"), g["label"].alias("label"), r["weight"].alias("weight")))))))
    return F.array_sort(hits)


def surviving(ordered: Column) -> Column:
    """The detections that no earlier one of the same or a stronger priority contains: one walk with the furthest end per priority."""
    start = F.struct(F.array(*[F.lit(-1)] * PRIORITIES).alias("ends"), F.array().cast("array<struct<label:string,weight:double,begin:int,end:int>>").alias("kept"))

    def step(a: Column, d: Column) -> Column:
        furthest = F.array_max(F.slice(a["ends"], F.lit(1), d["priority"] + 1))
        ends = F.transform(a["ends"], lambda e, i: F.when(i == d["priority"], F.greatest(e, d["end"])).otherwise(e))
        own = F.array(F.struct(d["label"].alias("label"), d["weight"].alias("weight"), d["begin"].alias("begin"), d["end"].alias("end")))
        return F.struct(ends.alias("ends"), F.when(furthest >= d["end"], a["kept"]).otherwise(F.concat(a["kept"], own)).alias("kept"))

    return F.aggregate(ordered, start, step, lambda a: a["kept"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places (label, weight, begin, end in reduced text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("n_words", F.regexp_count("text", F.lit(SCAN_WORD)).cast("long"))
    words = F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), SCAN_GAP, " "))
    rows = rows.select("doc_id", "n_words", F.concat(F.lit(" "), words, F.lit(" ")).alias("reduced"))
    for i, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"b{i}", F.when(F.contains("reduced", F.lit(f" {phrase} ")), F.split("reduced", f"(?<= ){phrase}(?= )", -1)))
    rows = rows.withColumn("places", surviving(detections(F.col("reduced"))))
    n_base, firsts, lasts, base_labels = F.lit(0).cast("long"), [], [], []
    for i, (phrase, label) in enumerate(BASE):
        pieces = F.col(f"b{i}")
        n_base = n_base + F.when(pieces.isNotNull(), F.size(pieces) - 1).otherwise(0)
        firsts.append(F.when(pieces.isNotNull(), _spaces(F.get(pieces, F.lit(0))) - 1))
        lasts.append(F.when(pieces.isNotNull(), F.col("n_words") - (_spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split())))
        base_labels.append(F.when(pieces.isNotNull(), F.lit(label)))
    found = F.array_compact(F.array(*base_labels))
    own = F.coalesce(F.transform("places", lambda p: p["label"]), F.array().cast("array<string>"))
    weights = F.coalesce(F.array_max(F.transform("places", lambda p: p["weight"])), F.lit(0.0))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        joined(found).alias("base_labels"), joined(F.concat(found, own)).alias("labels"),
        F.greatest(weights, F.when(n_base > 0, F.lit(BASE_WEIGHT)).otherwise(0.0)).alias("score"), "places")
