"""The registered queries opN_<name> and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lexical_search, licenses, lm_score, mixing, near_dup, prefix_trie, quality_model, quality_rules, token_files, toxicity, url_filter, vector_search
from .common import GAP, LOWER, UPPER, WORD, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return wrap


def _crc_mod(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def _term_pattern(term: str) -> str:
    return f"regexp_matches(rest, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')"


_STRICT = " OR ".join(_term_pattern(t) for t in url_filter.STRICT_TERMS)
_SOFT = " + ".join(f"CAST({_term_pattern(t)} AS INT)" for t in url_filter.SOFT_TERMS)


@query("op2_quality_model")
def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_crc_mod(5) == 0, F.lit(False))
    stats = quality_model.statistics_table(table(spark, sf_dir, "documents"))
    model = quality_model.fit(stats, table(spark, sf_dir, "labels"), ~held)
    scored = stats.select("doc_id", held.alias("held_out"), quality_model.score_column(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_model.CUT).cast("int"))


@query("op3_url_filter", f"""
WITH cut AS (
  SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS raw FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(raw, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(raw, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS rest FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN {_STRICT} OR {_SOFT} >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op4_licenses")
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(_crc_mod(3) == 1, F.lit(False))
    model = toxicity.fit_sample(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), ~held))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op7_near_dup", f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) WHEN len(ws) = 1 THEN ws ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT doc_id, n AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept FROM n JOIN r ON r.x = doc_id GROUP BY doc_id, n""")
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def _rules_sql() -> str:
    """The rules in SQL: counts, median shares per language, Jensen-Shannon distances, limits."""
    rules = quality_rules
    classes = [f"length(text) - length(regexp_replace(text, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for p in rules.CLASSES]
    common = {lang: [f"len(list_filter(cw, lambda x: x = '{word}'))" for word in words] for lang, words in rules.COMMON_WORDS.items()}

    def shares(parts: list[str], total: str) -> str:
        return f"[x / CAST(greatest({total}, 1) AS DOUBLE) for x in [{', '.join(parts)}, {total} - ({' + '.join(parts)})]]"

    def distance(p: str, q: str) -> str:
        one = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((z[1] + z[2]) / 2)) ELSE 0 END"
        return f"sqrt(greatest(0, list_sum([{one.format('z[1]')} + {one.format('z[2]')} for z in list_transform(range(1, len({p}) + 1), lambda i: [{p}[i], {q}[i]])]) / 2))"

    langs = list(rules.COMMON_WORDS)
    words = ", ".join(f"{shares(common[lang], 'n_words')} AS w_{lang}" for lang in langs)
    medians = lambda column, size: "list_transform([" + ", ".join(f"quantile_disc({column}[{i + 1}], 0.5)" for i in range(size)) + "], lambda x: x)"
    refs = "\nUNION ALL ".join(
        f"SELECT '{lang}' AS l, {medians('cs', len(rules.CLASSES) + 1)} AS rc, {medians(f'w_{lang}', len(common[lang]) + 1)} AS rw FROM f "
        f"WHERE lang = '{lang}' AND n_chars >= {rules.MIN_CHARS} AND n_words >= {rules.MIN_WORDS} HAVING count(*) > 0" for lang in langs)
    own = "CASE r.l " + " ".join(f"WHEN '{lang}' THEN w_{lang}" for lang in langs) + " END"
    return f"""
WITH b AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM b),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS k FROM t WHERE len(ws) >= 3),
o AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
v AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM o CROSS JOIN (VALUES (0), (1), (2)) q(d) GROUP BY 1),
c AS (SELECT doc_id, lang, text, length(text) AS n_chars, len(ws) AS n_words, length(regexp_replace(text, '{GAP}', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, list_transform(ws, lambda x: lower(regexp_replace(x, '[.,;:!?]+$', ''))) AS cw FROM t),
f AS (SELECT *, {shares(classes, 'n_chars')} AS cs, {words} FROM c),
r AS ({refs}),
d AS (SELECT doc_id, r.l, f.lang = r.l AS own, {distance('cs', 'rc')} AS dc, {distance(f'({own})', 'rw')} AS dw FROM f CROSS JOIN r),
m AS (SELECT doc_id, coalesce(max(dc) FILTER (own), min(dc)) AS dc, coalesce(max(dw) FILTER (own), min(dw)) AS dw FROM d GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(v.n, 0) > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(v.n, 0) > 50 * n_words) AND (n_chars < {rules.MIN_CHARS} OR coalesce(dc, 0) <= {rules.MAX_CHAR_DISTANCE}) AND (n_words < {rules.MIN_WORDS} OR coalesce(dw, 0) <= {rules.MAX_WORD_DISTANCE}) AS kept
FROM f LEFT JOIN v USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("op8_quality_rules", _rules_sql())
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_lm_score")
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled good; background: all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # The labels grow with the corpus, so they are merged at every size and never broadcast.
    good = labels.filter("quality = 1").select("doc_id").distinct().hint("merge")
    models = lm_score.fit(docs.join(good, "doc_id", "left_semi"), docs)
    return lm_score.score_documents(docs, models)


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op13_exact_top", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""")
def op13_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.exact_top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(column: str) -> str:
    return f"regexp_extract_all(translate({column}, '{UPPER}', '{LOWER}'), '{_TERM}')"


@query("op12_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_split('text')} AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS big_n, CAST(sum(len(ts)) AS BIGINT) AS big_l FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({_split('text')}) AS term FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM q JOIN df USING (term) CROSS JOIN s),
c AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM w JOIN tf USING (term) CROSS JOIN s GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM k WHERE rank <= 50""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


# Unsigned crc32 of a decimal id, bit by bit: SQL has no such function, so the table of its 256 steps is derived first.
_CRC = """crc_bits AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS steps FROM crc_bits WHERE k = 8)"""


@query("op11_prefix_trie", f"""
WITH RECURSIVE {_CRC},
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32)) AS pos,
  concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT c, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: xor(a >> 8, steps[1 + (xor(a, b) & 255)])), 4294967295) % 9 AS h FROM ids CROSS JOIN crc_table),
r AS (SELECT h.c, t.pos, t.said, t.size FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.pos <= h.h
  UNION ALL SELECT h.c, least(h.h, coalesce(b.n, 0)) + t.pos - h.h, t.said, t.size FROM h JOIN t ON t.c = h.c AND t.pos > h.h LEFT JOIN ids b ON b.c = h.c - h.c % 5),
e AS (SELECT c, 0 AS pos, sha256('') AS said, 0 AS size FROM ids UNION ALL SELECT c, pos, sha256(said), size FROM r),
o AS (SELECT c, pos, size, string_agg(said, '') OVER (PARTITION BY c ORDER BY pos) AS path, pos = max(pos) OVER (PARTITION BY c) AS last FROM e),
o2 AS (SELECT c, pos, size, last, sha256(path) AS node FROM o),
o3 AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY pos) AS parent FROM o2),
n AS (SELECT node, parent, pos AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM o3 GROUP BY ALL),
k AS (SELECT parent AS node, count(*) AS kids FROM n WHERE parent IS NOT NULL GROUP BY 1),
first AS (SELECT node, parent, own, CAST(k.kids IS NULL AS INT) AS leaf FROM n LEFT JOIN k USING (node)),
up AS (SELECT node AS top, parent, own, leaf FROM first UNION ALL SELECT f.node, f.parent, up.own, up.leaf FROM up JOIN first f ON up.parent = f.node),
s AS (SELECT top AS node, sum(own) AS saved, sum(leaf) AS leaves FROM up GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.kids, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n p ON p.node = n.parent LEFT JOIN k ON k.node = n.node JOIN s ON s.node = n.node""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
