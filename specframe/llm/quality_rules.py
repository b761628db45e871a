"""Quality rules by distribution divergence, in DataFrame expressions only.

Two histograms of a document are compared with references of languages by Jensen-Shannon distance (base 2, between 0
and 1): shares of character classes, and shares of each common word of the language among all words. The references
are the median shares over all documents of a language, so they come from the input itself. A document is held against its own
language; with another language or none it takes the nearest reference. Documents with fewer than ``MIN_CHARS`` characters or
``MIN_WORDS`` words are not judged by the histogram concerned: so small a sample says little.

Beside the divergence stand plain counts of words, symbols, repeated lines and repeated 3-word windows, with two hard
limits. Repeated windows are found inside the row: window hashes are sorted with their positions, neighbours compared, and the
gaps between the repeated positions added up, so a document costs n log n and no shuffle of words is needed.

Defined results: a null text is an empty one; it has no words and fails the base rules; a row's verdict depends on its own text
and language and on the medians only; repeated rows count each time in the medians; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_path
from .common import GAP, WORD

MIN_CHARS, MIN_WORDS = 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.18, 0.26

# Character classes, each a Java pattern of one or more characters; what is in none is the last class.
CLASSES = (r"[a-z]+", r"[A-Z]+", r"[0-9]+", r"[\x20\x09-\x0D]+", r"[.,;:]+", r"[!?'\x22()\-/]+", r"[#*$%&|<>@_+=\[\]{}\\^`~]+")

# Frequent words of each language; a fixed value, short because only their shares matter.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del"),
}
_ALL_WORDS = tuple(sorted({w for words in COMMON_WORDS.values() for w in words}))


def _removed(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in runs of ``pattern``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def words_array(text: Column) -> Column:
    """The words of a text; one split, without the empty pieces at its ends."""
    trimmed = F.regexp_replace(F.regexp_replace(text, "^" + GAP, ""), GAP + "$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words that stand in a window of ``size`` words found twice or more, the first included.

    Windows are equal if the 64-bit hashes of their words' hashes are.
    """
    def repeated(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.struct(
            F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]).alias("h"), i.alias("p")))
        return _with(F.sort_array(windows), lambda ordered: _with(
            F.sort_array(F.transform(F.filter(ordered, lambda w, i: (w["h"] == F.get(ordered, i - 1)["h"]) | (w["h"] == F.get(ordered, i + 1)["h"])), lambda w: w["p"])),
            lambda places: F.coalesce(F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(size), F.coalesce(p - F.get(places, i - 1), F.lit(size)))), F.lit(0), lambda a, x: a + x), F.lit(0))))

    return F.when(F.size(words) < size + 1, F.lit(0)).otherwise(_with(F.transform(words, lambda w: F.xxhash64(w)), repeated)).cast("long")


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once: bound to a lambda variable, where a repeated expression would be computed again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _equal(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(word))).cast("long")


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document all counts that the rules need; one pass over the texts, no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    split = base.withColumn("words", words_array(F.col("text")))
    common = F.filter(F.transform("words", lambda w: F.lower(F.regexp_replace(w, r"[.,;:!?]+$", ""))), lambda w: w.isin(*_ALL_WORDS))
    lines = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    row = split.select("doc_id", "lang", "text", "words", common.alias("common"), lines.alias("lines"))
    n_chars = F.length("text").cast("long")
    classes = [_removed(F.col("text"), pattern) for pattern in CLASSES]
    return row.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), n_chars.alias("n_chars"),
        F.array(*classes).alias("classes"), _removed(F.col("text"), r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        F.array(*[_equal(F.col("common"), word) for word in _ALL_WORDS]).alias("common"))


def _shares(parts: Column, total: Column) -> Column:
    """Shares of the parts of a total and, last, of the rest; all 0 for an empty total."""
    safe = F.greatest(total, F.lit(1)).cast("double")
    rest = total - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat(parts, F.array(rest)), lambda x: x / safe)


def distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of an array of shares from fixed ones."""
    def term(a: Column, b: Column) -> Column:
        middle = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / middle)).otherwise(0.0) + F.when(b > 0, b * F.log2(b / middle)).otherwise(0.0)

    terms = F.zip_with(p, F.array(*[F.lit(float(x)) for x in q]), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _own_words(lang: str) -> Column:
    return F.array(*[F.get("common", F.lit(_ALL_WORDS.index(word))) for word in COMMON_WORDS[lang]])


def references(counted: DataFrame, accuracy: int = 1000) -> dict[str, tuple[list[float], list[float]]]:
    """Per language the median share of each character class and of each of its common words, over all its documents that
    are long enough; scaled to sum to 1. Medians are mergeable sketches and stay put when a share of the corpus is junk. A
    row a language comes to the driver."""
    out = {}
    for lang in sorted(COMMON_WORDS):
        fit = counted.filter((F.col("lang") == lang) & (F.col("n_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS))
        both = fit.select(_shares(F.col("classes"), F.col("n_chars")).alias("c"), _shares(_own_words(lang), F.col("n_words")).alias("w"))
        medians = lambda name, size: F.array(*[F.percentile_approx(F.get(name, F.lit(i)), 0.5, accuracy) for i in range(size)])
        row = both.agg(medians("c", len(CLASSES) + 1).alias("c"), medians("w", len(COMMON_WORDS[lang]) + 1).alias("w")).first()
        if row["c"][0] is not None:
            out[lang] = ([x / (sum(row["c"]) or 1.0) for x in row["c"]], [x / (sum(row["w"]) or 1.0) for x in row["w"]])
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept."""
    path = stage_path(docs.sparkSession, "rule-counts")
    counts(docs, id_col, text_col, lang_col).write.parquet(path)
    counted = docs.sparkSession.read.parquet(path)
    known = references(counted)
    shares = counted.withColumn("char_shares", _shares(F.col("classes"), F.col("n_chars")))
    for lang in known:
        shares = shares.withColumn(f"c_{lang}", distance(F.col("char_shares"), known[lang][0]))
        shares = shares.withColumn(f"w_{lang}", distance(_shares(_own_words(lang), F.col("n_words")), known[lang][1]))
    any_char, any_word = [F.col(f"c_{lang}") for lang in known], [F.col(f"w_{lang}") for lang in known]
    own_char, own_word = F.lit(None).cast("double"), F.lit(None).cast("double")
    for lang in known:
        own_char, own_word = F.when(F.col("lang") == lang, F.col(f"c_{lang}")).otherwise(own_char), F.when(F.col("lang") == lang, F.col(f"w_{lang}")).otherwise(own_word)
    least = lambda found: F.lit(0.0) if not found else found[0] if len(found) == 1 else F.least(*found)
    named = F.col("lang").isin(*known) if known else F.lit(False)
    char_distance = F.when(F.col("n_chars") < MIN_CHARS, 0.0).when(named, own_char).otherwise(least(any_char))
    word_distance = F.when(F.col("n_words") < MIN_WORDS, 0.0).when(named, own_word).otherwise(least(any_word))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    spaces = F.get("classes", F.lit(3))  # the white space of the word class
    out = shares.select("doc_id", "n_words", (F.col("n_chars") - spaces).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), char_distance.alias("char_distance"), word_distance.alias("word_distance"))
    fits = (F.col("char_distance") <= MAX_CHAR_DISTANCE) & (F.col("word_distance") <= MAX_WORD_DISTANCE)
    return out.withColumn("kept", ~F.col("base_failed") & fits)
