"""Mixing sources to target weights by fitting subset sums.

Sources take weights by rank (1, 2, 3, repeating) and share the words of the whole corpus; no source may give more than
``max_repeats`` times its size, and what it cannot give goes to the others by weight. A source's target is then met in
three steps: whole passes over all its documents; for the rest, a number of documents for every exact length; and
documents drawn by a seeded order within each length.

The numbers per length come from counts alone (one row per source and length, however many documents there are). Lengths
are walked from long to short and each gets its share of the budget with the rounding carried on, so what is open at the
end is below one longest document. Room for twice the longest document is left out of that walk and filled by a bounded
knapsack over all the documents still free: a dynamic programme over the reachable sums, one step per length and power of
two of its count.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own and ranks last;
rows that share an id are documents of their own; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hash_hex
from ..functions.ranking import global_running, hash_rank
from ..session import durable, stage_path
from .common import fresh, word_count

WEIGHTS = (1, 2, 3)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sum is as near below ``budget`` as can be.

    Reachable sums are the bits of one integer; each length enters as bundles of 1, 2, 4 ... documents, and for every
    sum the first bundle that reached it is kept, which is enough to walk back.
    """
    picks = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or len(lengths) == 0:
        return picks
    mask, reached = (1 << (budget + 1)) - 1, 1
    bundles: list[tuple[int, int]] = []
    owner = np.full(budget + 1, -1, dtype=np.int32)
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        left, size = min(count, budget // length), 1
        while left > 0:
            size = min(size, left)
            new = (reached << (length * size)) & mask & ~reached
            if new:
                raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), dtype=np.uint8)
                owner[np.flatnonzero(np.unpackbits(raw, bitorder="little")[: budget + 1])] = len(bundles)
                bundles.append((i, size))
                reached |= new
            left, size = left - size, size * 2
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    while at > 0:
        i, size = bundles[owner[at]]
        picks[i] += size
        at -= int(lengths[i]) * size
    return picks


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length (all positive) for ``budget`` words, at most ``counts`` of each."""
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        taken = counts.copy()
    elif budget > 0:
        plain = max(0, budget - 2 * int(lengths[0]))
        wanted = np.cumsum(lengths * counts).astype(np.float64) * (plain / total)
        used = 0
        for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
            taken[i] = max(0, min(count, int((wanted[i] - used) // length)))
            used += int(taken[i]) * length
        taken += knapsack(lengths, counts - taken, budget - used)
    out = np.zeros(len(lengths), dtype=np.int64)
    out[order] = taken
    return out


def _picks(pdf: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = pdf["size"].to_numpy(), pdf["n"].to_numpy()
    budget = int(pdf["rest"].iloc[0])
    return pd.DataFrame({"source": pdf["source"], "size": lengths, "n": counts, "picks": fit_counts(lengths, counts, budget), "passes": pdf["passes"]})


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """source, source_size, target: shares of all words by weight, none above ``max_repeats`` times its source's size.

    Each round fixes the sources that are above and shares the rest anew; a round is one aggregate over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_running(sources, [F.col("source").asc_nulls_last()], {}, name="place")
    by_weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", by_weight)
    most = F.col("source_size") * float(max_repeats)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, -1
    while True:
        is_fixed = most <= F.col("weight") * level
        row = ranked.agg(F.sum(F.when(is_fixed, most)), F.sum(F.when(~is_fixed, F.col("weight"))), F.count_if(is_fixed)).first()
        if row[2] == fixed or row[1] is None:
            break
        fixed, level = row[2], (total - (row[0] or 0.0)) / row[1]
    return ranked.select("source", "source_size", F.least(most, F.col("weight") * level).cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeats: int = 3, seed: str = "mix", id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies (how often the mix takes it), taken (words).

    With ``row_col``, a stored column that tells all rows apart, it is returned as row_id and orders rows that share an id.
    """
    own = [F.col(row_col).alias("row_id")] if row_col else []
    sized = durable(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *own))
    targets = durable(source_targets(sized, weights, max_repeats))
    budget = F.floor(F.col("target") + 0.5)
    plans = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(max_repeats), F.floor(budget / F.col("source_size")))).otherwise(0).cast("long"))
    plans = plans.withColumn("rest", F.when(F.col("passes") < max_repeats, budget - F.col("passes") * F.col("source_size")).otherwise(0).cast("long"))
    lengths = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    lengths = _same(lengths, plans, ["source"], ["passes", "rest"])
    picks = lengths.groupBy("source").applyInPandas(_picks, "source string, size long, n long, picks long, passes long")
    known = _same(sized, durable(picks), ["source", "size"], ["n", "picks", "passes"])
    # Only lengths that are taken in part need an order among their documents.
    part = (F.col("picks") > 0) & (F.col("picks") < F.col("n"))
    if row_col:
        key = F.when(F.col("doc_id").isNull(), hash_hex(seed, F.lit("row"), F.col("row_id"))).otherwise(hash_hex(seed, F.col("doc_id")))
        ranked = hash_rank(known.filter(part), ["source", "size"], seed, "row_id", "place", key=key)
    else:
        ranked = hash_rank(known.filter(part), ["source", "size"], seed, "doc_id", "place")
    whole = known.filter(~part).withColumn("place", F.lit(0).cast("long"))
    copies = F.col("passes") + F.when((F.col("picks") > 0) & (F.col("place") <= F.col("picks")), 1).otherwise(0)
    columns = sized.columns
    taken = ranked.unionByName(whole).select(*columns, copies.cast("long").alias("copies"))
    empty = sized.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("copies"))
    out = _same(taken.unionByName(empty), targets, ["source"], ["source_size", "target"])
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    renamed = {key: fresh(key) for key in keys}
    right = right.select(*[F.col(key).alias(name) for key, name in renamed.items()], *columns)
    matched = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(name)) for key, name in renamed.items()])
    return left.join(right, matched).select(*left.columns, *columns)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each row as often as the mix takes that row.

    Rows are numbered once and stored with their texts, so the decision on a row reaches it whatever its id is.
    """
    spark, row, key, copies, copy = docs.sparkSession, fresh("row"), fresh("key"), fresh("copies"), fresh("copy")
    path = stage_path(spark, "mix-rows")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    per_row = mix_sources(stored, row_col=row, **options).filter("copies > 0").select(F.col("row_id").alias(key), F.col("copies").cast("int").alias(copies))
    joined = stored.join(per_row, F.col(row) == F.col(key))
    repeated = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*[stored[c] for c in docs.columns])
