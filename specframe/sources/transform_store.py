"""A versioned store of fitted transforms: named tables and parameters that are saved, found again and read back.

A version's tables are written first, below a folder of their own. The version exists from the moment its one manifest row is
committed, so readers see all of a version or nothing of it, and a save that fails leaves the earlier versions as they were.
Everything is read and written by Spark, so the store may lie wherever Spark can write.

Layout: <root>/<name>/manifest (one row per version) and <root>/<name>/tables/<version>-<unique>/<table>.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, folder string, tables map<string, struct<rows: bigint, schema: string>>, parameters map<string, string>"


@dataclass(frozen=True)
class Fitted:
    """A fitted transform as read back: its tables are DataFrames, its parameters plain values."""

    name: str
    version: int
    tables: dict[str, DataFrame]
    parameters: dict[str, object] = field(default_factory=dict)


def manifest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One row per saved version; an empty table where nothing has been saved."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"not a name for a transform: {name!r}")
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/{name}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def save(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame], parameters: dict[str, object] | None = None) -> int:
    """Save the tables and parameters (JSON values) as the next version; returns its number, from 1."""
    version = (manifest(spark, root, name).agg(F.max("version")).first()[0] or 0) + 1
    folder, entries = f"{version:06d}-{uuid.uuid4().hex}", {}
    for table, df in tables.items():
        path = f"{root}/{name}/tables/{folder}/{table}"
        df.write.parquet(path)
        entries[table] = (spark.read.parquet(path).count(), df.schema.json())
    row = (version, folder, entries, {key: json.dumps(value) for key, value in (parameters or {}).items()})
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/{name}/manifest")
    return version


def _evolved(df: DataFrame, expected: StructType, where: str) -> DataFrame:
    """Expected columns first, null where an older version lacks them; further columns stay. Another type is an error."""
    have = {f.name: f.dataType for f in df.schema}
    for f in expected:
        if f.name in have and have[f.name] != f.dataType:
            raise ValueError(f"{where}.{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    columns = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in expected]
    return df.select(*columns, *[c for c in df.columns if c not in expected.names])


def load(spark: SparkSession, root: str, name: str, version: int | None = None, expected: dict[str, str] | None = None) -> Fitted:
    """The given version, or the newest; ``expected`` maps table -> DDL of the columns that the reader wants.

    Two saves that ran at once may share a number; of those the last by folder name is read, by everyone. A version that does not exist, and
    a table whose rows are not those that were saved, are errors.
    """
    rows = manifest(spark, root, name)
    found = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version"), F.desc("folder")).limit(1).collect()
    if not found:
        raise LookupError(f"no version {'' if version is None else f'{version} '}of {name} is saved in {root}")
    row, tables = found[0], {}
    for table, entry in row["tables"].items():
        df = spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{root}/{name}/tables/{row['folder']}/{table}")
        if df.count() != entry["rows"]:
            raise ValueError(f"{name} {row['version']}: {table} does not hold the {entry['rows']} rows that were saved")
        tables[table] = df
    for table, ddl in (expected or {}).items():
        if table not in tables:
            raise ValueError(f"{name} {row['version']} has no table {table}")
        tables[table] = _evolved(tables[table], StructType.fromDDL(ddl), f"{name} {row['version']}: {table}")
    return Fitted(name, row["version"], tables, {key: json.loads(value) for key, value in row["parameters"].items()})


def versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(version, table, rows) of everything saved under the name."""
    return manifest(spark, root, name).select("version", F.explode("tables").alias("table", "entry")).select("version", "table", F.col("entry.rows").alias("rows"))
