"""URL filter: host and path rules over a weighted vocabulary of URL terms.

A rule is a host, a slash and a start of a path. It fits its host and every subdomain if the url's path starts with the
rule's; the longest rule wins. A url without a rule is judged by terms: one Aho-Corasick pass finds every strict and soft
term in the lower-cased url after ``://``; a hit counts if no letter or digit stands on either side of it. One strict hit
or ``soft_needed`` distinct soft terms reject.

Defined results: a null url and one without ``://`` have an empty host and path and are allowed; equal urls get equal
verdicts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# Terms that reject alone, and terms of which several different ones are needed. Plain lists, meant to be replaced by a site's own.
STRICT_TERMS = ("casino", "casinos", "porn", "porno", "pornos", "xxx", "hardcore", "hentai", "camgirl", "camgirls", "escorts", "viagra", "cialis", "sexcam", "sexcams", "milf", "warez", "keygen", "roulette", "jackpots")
SOFT_TERMS = ("win", "free", "bonus", "bet", "bets", "betting", "poker", "slots", "loan", "loans", "cheap", "adult", "sex", "nude", "pills", "pharma", "crack", "torrent", "spam", "prize", "winner", "lottery", "dating", "hot", "deal", "deals", "click", "crypto", "profit", "cash")

RESULT = "rule string, rule_verdict string, strict_hits long, soft_terms long"
_AUTOMATA: dict[tuple, object] = {}


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    """The worker's automaton for a vocabulary; a term in both lists is strict."""
    if (strict, soft) not in _AUTOMATA:
        import ahocorasick

        built = ahocorasick.Automaton()
        for term in soft:
            built.add_word(term, (term, False))
        for term in strict:
            built.add_word(term, (term, True))
        built.make_automaton()
        _AUTOMATA[strict, soft] = built
    return _AUTOMATA[strict, soft]


def count_terms(text: str, terms) -> tuple[int, int]:
    """Strict hits, and different soft terms, that stand on their own in ``text``."""
    hits, soft = 0, set()
    for end, (term, strict) in terms.iter(text):
        begin = end - len(term) + 1
        before, after = text[begin - 1 : begin] if begin else "", text[end + 1 : end + 2]
        if before.isalnum() or after.isalnum():
            continue
        if strict:
            hits += 1
        else:
            soft.add(term)
    return hits, len(soft)


def best_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """The longest fitting rule and its verdict. ``by_host``: rule host to (path, rule, verdict)."""
    best: tuple[str | None, str | None] = (None, None)
    start = 0
    while True:
        for rule_path, rule, verdict in by_host.get(host[start:], ()):
            if path.startswith(rule_path) and (best[0] is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        dot = host.find(".", start)
        if dot < 0:
            return best
        start = dot + 1


def filter_urls(pages: DataFrame, rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS, soft_needed: int = 2,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_terms; one row per row of ``pages``, no shuffle."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, _, rest = rule.partition("/")
        by_host.setdefault(host, []).append(("/" + rest, rule, verdict))
    strict, soft = tuple(strict), tuple(soft)

    def judge(host: pd.Series, path: pd.Series, rest: pd.Series) -> pd.DataFrame:
        terms = automaton(strict, soft)
        ruled = [best_rule(h, p, by_host) for h, p in zip(host, path)]
        found = [count_terms(r, terms) for r in rest]
        return pd.DataFrame({"rule": [r for r, _ in ruled], "rule_verdict": [v for _, v in ruled],
                             "strict_hits": [a for a, _ in found], "soft_terms": [b for _, b in found]})

    url = F.coalesce(F.col(url_col), F.lit(""))
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    lowered = F.translate(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), UPPER, LOWER)
    parts = pages.select(F.col(id_col).alias("page_id"), F.translate(F.regexp_extract(url, whole, 1), UPPER, LOWER).alias("host"),
                         F.regexp_extract(url, whole, 2).alias("path"), lowered.alias("rest"))
    judged = parts.withColumn("j", F.pandas_udf(judge, RESULT)("host", "path", "rest"))
    method = F.when((F.col("j.strict_hits") >= 1) | (F.col("j.soft_terms") >= soft_needed), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "j.rule", F.coalesce("j.rule_verdict", method).alias("verdict"), "j.strict_hits", "j.soft_terms")
