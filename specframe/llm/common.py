"""What several corpus operators share: the word class, table access, column names that cannot clash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of characters other than space and \t \n \v \f \r; the same text works in Java and RE2.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(name: str) -> str:
    """A column name that no input table carries."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def attach(docs: DataFrame, text_col: str, function, returns: str, name: str) -> DataFrame:
    """``docs`` with one Arrow-evaluated column computed from the text; all other columns pass by untouched."""
    return docs.withColumn(name, F.pandas_udf(function, returns)(F.col(text_col)))


def with_extra(docs: DataFrame, extra: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Join ``extra`` (one row per key, null included) to ``docs``; column names of ``docs`` win no matter what they are."""
    join_key = fresh("key")
    renamed = extra.withColumnRenamed(key, join_key)
    return docs.join(renamed, docs[key].eqNullSafe(renamed[join_key]), "inner").select(*[docs[c] for c in docs.columns], *columns)
