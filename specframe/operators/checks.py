"""Named checks and guarded selections.

A check table is checks(check, passed, observed, threshold). Guards turn violations into a job error when
the guarded table is computed; the guard itself is one aggregated row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guard(df: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``df``, failing with ``message`` if ``violations`` has any row."""
    flag = violations.agg(F.count(F.lit(1)).alias("_bad")).select(
        F.when(F.col("_bad") == 0, True).otherwise(F.raise_error(F.concat(
            F.lit(message + ": "), F.col("_bad").cast("string"), F.lit(" rows")))).cast("boolean").alias("_ok"))
    return df.join(F.broadcast(flag)).where(F.col("_ok")).drop("_ok")


def tall_checks(row: DataFrame, checks: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """One aggregated row -> one row per check; each entry is (passed, observed, threshold)."""
    items = [F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"),
                      observed.cast("double").alias("observed"), F.lit(float(threshold)).alias("threshold"))
             for name, (passed, observed, threshold) in checks.items()]
    return row.select(F.explode(F.array(*items)).alias("_c")).select("_c.*")


def zero_count(column: str) -> tuple[Column, Column, float]:
    value = F.coalesce(F.col(column), F.lit(0))
    return value == 0, value, 0.0


def validate_edges(edges: DataFrame, other: DataFrame, tol: float = 1e-10) -> DataFrame:
    """Symmetry, zero diagonal, sign and equal positive support of two matrices edges(src, dst, value).

    Both directions of a pair meet in one aggregate, so no self join is needed.
    """
    both = edges.select("src", "dst", "value", F.lit(0).alias("m")).unionByName(
        other.select("src", "dst", "value", F.lit(1).alias("m")))
    forward, backward = F.col("src") < F.col("dst"), F.col("src") > F.col("dst")

    def side(keep: Column, m: int) -> Column:
        return F.coalesce(F.sum(F.when(keep & (F.col("m") == m), F.col("value"))), F.lit(0.0))

    pairs = both.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        *[side(forward, m).alias(f"f{m}") for m in (0, 1)], *[side(backward, m).alias(f"r{m}") for m in (0, 1)],
        *[F.count_if((F.col("src") == F.col("dst")) & (F.abs("value") > tol) & (F.col("m") == m)).alias(f"d{m}") for m in (0, 1)],
        *[F.count_if((F.col("value") < 0) & (F.col("m") == m)).alias(f"n{m}") for m in (0, 1)])
    differs = ((F.col("f0") > 0) != (F.col("f1") > 0)).cast("bigint") + ((F.col("r0") > 0) != (F.col("r1") > 0)).cast("bigint")
    row = pairs.agg(
        *[F.count_if(F.abs(F.col(f"f{m}") - F.col(f"r{m}")) > tol).alias(f"asymmetric{m}") for m in (0, 1)],
        *[F.sum(f"d{m}").alias(f"diagonal{m}") for m in (0, 1)], *[F.sum(f"n{m}").alias(f"negative{m}") for m in (0, 1)],
        F.sum(differs).alias("support"))
    names = {0: "first", 1: "second"}
    return tall_checks(row, {
        **{f"{names[m]}_symmetric": zero_count(f"asymmetric{m}") for m in (0, 1)},
        **{f"{names[m]}_zero_diagonal": zero_count(f"diagonal{m}") for m in (0, 1)},
        **{f"{names[m]}_non_negative": zero_count(f"negative{m}") for m in (0, 1)},
        "same_support": zero_count("support")})


def validate_keys(dim: DataFrame, key: str, first: int = 1) -> DataFrame:
    """Ids are exactly first..first+n-1: as many distinct ids as rows, within that range."""
    row = dim.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum("_c").alias("n"), F.count_if(F.col("_c") > 1).alias("dup"))
    return tall_checks(row, {
        "unique": zero_count("dup"), "starts_at_first": (F.col("lo") == first, F.col("lo"), first),
        "dense": (F.col("hi") - F.col("lo") + 1 == F.col("n"), F.col("hi") - F.col("lo") + 1 - F.col("n"), 0)})


def check_axes(df: DataFrame, entity: str, axes: dict[str, list[str]]) -> DataFrame:
    """Every entity has the same set of axis values, for each named axis.

    An axis value used by all entities is counted once per entity; the per-entity sets are deduplicated by a
    map-side combined aggregate.
    """
    total = df.select(entity).distinct().agg(F.count(F.lit(1)).alias("_n"))
    out = None
    for name, columns in axes.items():
        seen = df.select(entity, *columns).distinct().groupBy(*columns).agg(F.count(F.lit(1)).alias("_c"))
        row = seen.join(F.broadcast(total)).agg(F.count_if(F.col("_c") != F.col("_n")).alias("off"))
        one = tall_checks(row, {f"same_{name}": zero_count("off")})
        out = one if out is None else out.unionByName(one)
    return out


def check_partition(ids: DataFrame, train: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """Train and holdout cover every id exactly once."""
    tagged = ids.select(key, F.lit(1).alias("i"), F.lit(0).alias("s")).unionByName(
        train.select(key, F.lit(0).alias("i"), F.lit(1).alias("s"))).unionByName(
        holdout.select(key, F.lit(0).alias("i"), F.lit(1).alias("s")))
    row = tagged.groupBy(key).agg(F.sum("i").alias("i"), F.sum("s").alias("s")).agg(
        F.count_if((F.col("i") > 0) & (F.col("s") == 0)).alias("uncovered"),
        F.count_if(F.col("s") > 1).alias("repeated"), F.count_if((F.col("i") == 0) & (F.col("s") > 0)).alias("unknown"))
    return tall_checks(row, {n: zero_count(c) for n, c in
                             (("covers_every_id", "uncovered"), ("each_id_once", "repeated"), ("no_unknown_id", "unknown"))})


def subset_entities(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the chosen ids; repeated or unknown ids are an error."""
    repeated = ids.groupBy(key).count().where(F.col("count") > 1)
    unknown = ids.join(df.select(key).distinct(), key, "left_anti")
    kept = df.join(ids.select(key), key, "left_semi")
    return guard(guard(kept, repeated, "repeated ids"), unknown, "ids out of range")


def finite(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def check_bounds(candidates: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Each parameter finite and inside its range, and at least two rows; one pass over the table."""
    row = candidates.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~finite(p)).alias(f"f_{p}") for p in ranges],
        *[F.count_if(finite(p) & ~F.col(p).between(lo, hi)).alias(f"r_{p}") for p, (lo, hi) in ranges.items()])
    return tall_checks(row, {
        "at_least_two_rows": (F.col("n") >= 2, F.col("n"), 2),
        **{f"{p}_finite": zero_count(f"f_{p}") for p in ranges}, **{f"{p}_in_range": zero_count(f"r_{p}") for p in ranges}})


def rule_rows(name: str, table: str, expected: int) -> dict:
    """The table has ``expected`` rows; violations are the rows too many or too few."""
    return {"name": name, "table": table, "value": F.abs(F.count(F.lit(1)) - expected)}


def rule_usable(name: str, table: str, columns: list[str]) -> dict:
    """Every cell of the columns is a finite number; violations are the rows with one that is not."""
    bad = F.lit(False)
    for column in columns:
        bad = bad | ~finite(F.col(column).cast("double"))
    return {"name": name, "table": table, "value": F.count_if(bad)}


def rule_held(name: str, table: str, column: str, value: float) -> dict:
    """A column is ``value`` in every row; violations are the other rows, nulls among them."""
    return {"name": name, "table": table, "value": F.count_if(~F.coalesce(F.col(column) == value, F.lit(False)))}


def rule_once(name: str, table: str, keys: list[str], cells: int) -> dict:
    """Every one of ``cells`` key combinations stands once; violations are repeats and missing combinations."""
    def frame(tables: dict[str, DataFrame]) -> DataFrame:
        each = tables[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
        return each.agg((F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)) + F.greatest(F.lit(0), F.lit(cells) - F.count(F.lit(1)))).alias("v"))

    return {"name": name, "frame": frame}


def rule_agree(name: str, left: str, right: str, keys: list[str], column: str, tolerance: float) -> dict:
    """Two tables hold the same keys with values no further apart than ``tolerance``; a key on one side only is a violation."""
    def frame(tables: dict[str, DataFrame]) -> DataFrame:
        a, b = (tables[t].select(*keys, F.col(column).cast("double").alias(f"_{side}")) for t, side in ((left, "a"), (right, "b")))
        near = F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.lit(False))
        return a.join(b, keys, "full_outer").agg(F.count_if(~near).alias("v"))

    return {"name": name, "frame": frame}


def rule_axis(name: str, table: str, column: str, order: str, expected: list) -> dict:
    """The distinct values of a short axis, in the order of their first ``order``, are ``expected``; violations are unequal places."""
    def frame(tables: dict[str, DataFrame]) -> DataFrame:
        values = tables[table].groupBy(column).agg(F.min(order).alias("_o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", column))), lambda x: x[column]).alias("_v"))
        places = F.sequence(F.lit(0), F.greatest(F.size("_v"), F.lit(len(expected))) - 1)
        wanted = F.array(*[F.lit(x) for x in expected])
        return values.select(F.size(F.filter(places, lambda i: ~F.coalesce(F.get("_v", i) == F.get(wanted, i), F.lit(False)))).alias("v"))

    return {"name": name, "frame": frame}


def rule_recorded(name: str, record: dict, key: str, expected) -> dict:
    """A metadata record carries ``key`` with the expected value; a missing entry, or nothing to expect, is a violation."""
    return {"name": name, "fixed": int(expected is None or key not in record or record[key] != expected)}


def check_tables(tables: dict[str, DataFrame], rules: list[dict]) -> DataFrame:
    """checks(check, passed, observed, threshold) of a stored collection; observed counts violations and 0 passes.

    Rules come from the ``rule_`` functions. Those that need one table row by row share one pass over it.
    """
    spark = next(iter(tables.values())).sparkSession
    parts, shared = [], {}
    for rule in rules:
        if "table" in rule:
            shared.setdefault(rule["table"], []).append(rule)
        elif "frame" in rule:
            parts.append(rule["frame"](tables).select(F.lit(rule["name"]).alias("check"), F.col("v").cast("double").alias("observed")))
        else:
            parts.append(spark.range(1).select(F.lit(rule["name"]).alias("check"), F.lit(float(rule["fixed"])).alias("observed")))
    for table, own in shared.items():
        row = tables[table].agg(*[rule["value"].cast("double").alias(f"v{i}") for i, rule in enumerate(own)])
        cells = F.array(*[F.struct(F.lit(rule["name"]).alias("check"), F.col(f"v{i}").alias("observed")) for i, rule in enumerate(own)])
        parts.append(row.select(F.explode(cells).alias("c")).select("c.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("check", (F.col("observed") == 0).alias("passed"), "observed", F.lit(0.0).alias("threshold"))


def align_models(reference: DataFrame, candidate: DataFrame, key: str, group: str, values: list[str]) -> DataFrame:
    """Join two result tables 1:1; repeated ids, different id sets or different groups are an error."""
    a = reference.select(key, F.col(group).alias("_ga"), *[F.col(v).alias(f"reference_{v}") for v in values])
    b = candidate.select(key, F.col(group).alias("_gb"), *[F.col(v).alias(f"candidate_{v}") for v in values])
    repeated = a.select(key, F.lit(0).alias("s")).unionByName(b.select(key, F.lit(1).alias("s"))).groupBy(key, "s").count().where(F.col("count") > 1)
    joined = a.join(b, key, "full_outer")
    same = F.when(F.col("_ga").isNull() | F.col("_gb").isNull(), F.raise_error(F.lit("models cover different ids")).cast("string")).when(
        F.col("_ga") != F.col("_gb"), F.raise_error(F.lit("models disagree on a group")).cast("string")).otherwise(F.col("_ga"))
    out = joined.select(key, same.alias(group), *[F.col(f"{s}_{v}") for v in values for s in ("reference", "candidate")])
    return guard(out, repeated, "repeated ids")


def attach_oof(table: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of the one prediction made in the fold that held the id out; missing or repeated is an error."""
    marked = predictions.withColumn("_hit", F.lit(True))
    joined = table.join(marked, keys, "left")
    checked = joined.withColumn("_hit", F.when(F.col("_hit"), True).otherwise(F.raise_error(F.lit("missing prediction")).cast("boolean")))
    return guard(checked.where(F.col("_hit")).drop("_hit"), predictions.groupBy(*keys).count().where(F.col("count") > 1), "repeated predictions")


def exclude_consumed(ids: DataFrame, split: DataFrame, key: str, role: str) -> DataFrame:
    """Ids without those already used in ``role``; only ids the split table knows remain."""
    used = split.where(F.col("role") == role).select(key)
    return ids.join(used, key, "left_anti").join(split.select(key), key, "left_semi")


def split_failures(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results(item, ok, error) -> (rows that worked, failed(item, error))."""
    return results.where(F.col("error").isNull()).drop("error"), results.where(F.col("error").isNotNull()).select("item", "error")


def fail_if_any(df: DataFrame, failed: DataFrame) -> DataFrame:
    return guard(df, failed, "items failed")


def concat_folds(folds: list[DataFrame], ids: DataFrame, key: str) -> DataFrame:
    """Union of out-of-fold tables; every id must occur exactly once."""
    out = folds[0]
    for fold in folds[1:]:
        out = out.unionByName(fold)
    counts = out.groupBy(key).count()
    wrong = ids.select(key).join(counts, key, "full_outer").where(F.coalesce("count", F.lit(0)) != 1)
    unknown = out.join(ids.select(key), key, "left_anti")
    return guard(guard(out, wrong.select(key), "ids not covered once"), unknown, "unknown ids")


def dedupe_keep_first(df: DataFrame, columns: list[str], digits: int, position: str) -> DataFrame:
    """First row by position of every set of equal rounded columns; a combinable aggregate, not a window."""
    keys = [F.round(F.col(c), digits).alias(f"_k{i}") for i, c in enumerate(columns)]
    rest = [c for c in df.columns if c != position]
    return df.groupBy(*keys).agg(F.min(F.struct(position, *rest)).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def set_difference_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ``missing`` names are only in a, ``extra`` names only in b."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    return left.join(right, key, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull()).select(
        key, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("side"))


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))
