"""File sources and sinks: listings, text matrices, dimensions, stored collections, reports, manifests."""

from __future__ import annotations

import hashlib
from codecs import BOM_UTF8
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_running
from ..operators.checks import finite, guard

# Files up to this length are read as one row; larger ones in pieces of this many bytes.
WHOLE_BYTES, PIECE_BYTES = 64 << 20, 1 << 14
PIECES = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("piece", pa.binary())])
# Endings of names that Spark's text reader takes for compressed.
PACKED = ("gz", "bz2", "deflate", "snappy", "lz4", "zst")


def discover_files(spark: SparkSession, root: str, groups: list[str], pattern: str = "*", cap: int | None = None) -> DataFrame:
    """files(path, grp, entity_id) under ``root/<group>/``, the entity being the parent directory.

    ``cap`` keeps the first files per group by path. Contents are not read. No file at all is an error.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(
        [f"{root}/{g}" for g in groups]).select("path")
    names = F.array(*[F.lit(g) for g in groups])
    parts = F.split("path", "/")
    files = listing.select("path", F.element_at(F.filter(names, lambda g: F.array_contains(parts, g)), 1).alias("grp"),
                           F.element_at(parts, -2).alias("entity_id"))
    if cap is not None:
        order = Window.partitionBy("grp").orderBy("path")
        files = files.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).drop("_r")
    empty = files.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return guard(files, empty, f"no files below {root}")


def read_dense_matrix(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Whitespace-separated square matrix text -> edges(src, dst, value) without zeros; shape and finiteness are checked.

    Lines are numbered by (file, block offset, order in block), so text split over files and tasks keeps its row order.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    order = [F.col(c).asc() for c in ("_f", "_b", "_i")]
    numbered = global_running(lines.where(F.trim("value") != ""), order, {}, name="_r")
    split = numbered.select((F.col("_r") - 1).alias("src"), F.split(F.trim("value"), r"\s+").alias("cells"))
    shape = split.agg(F.count(F.lit(1)).alias("r"), F.min(F.size("cells")).alias("lo"), F.max(F.size("cells")).alias("hi")).where(
        (F.col("r") != n) | (F.col("lo") != n) | (F.col("hi") != n))
    cells = split.select("src", F.posexplode("cells").alias("dst", "text")).select(
        "src", F.col("dst").cast("bigint").alias("dst"), F.expr("try_cast(text AS double)").alias("value"))
    broken = cells.where(~finite("value"))
    return guard(guard(cells.where(F.col("value") != 0), shape, f"matrix is not {n} x {n}"), broken, "matrix has non-finite cells")


def check_dimension(df: DataFrame, required: list[str], key: str, numeric: list[str], members: DataFrame | None = None) -> DataFrame:
    """A dimension with its required columns, unique keys, finite numbers and all required members."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = guard(df.select(*required), df.groupBy(key).count().where("count > 1"), "repeated keys")
    out = guard(out, df.where(~F.forall(F.array(*[F.col(c).cast("double") for c in numeric]), finite)), "non-finite values")
    if members is not None:
        out = guard(out, members.select(key).distinct().join(df.select(key), key, "left_anti"), "required members are absent")
    return out


def read_dimension(spark: SparkSession, path: str, schema: str, required: list[str], key: str, numeric: list[str],
                   members: DataFrame | None = None) -> DataFrame:
    return check_dimension(spark.read.csv(path, header=True, schema=schema, enforceSchema=False), required, key, numeric, members)


def write_collection(df: DataFrame, path: str, partition: str | None = "segment") -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition and partition in df.columns else writer).parquet(path)


def read_collection(spark: SparkSession, path: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """A stored collection; columns that older files lack get their default."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(row: DataFrame, path: str) -> None:
    """A summary row as one JSON document."""
    row.coalesce(1).write.mode("overwrite").json(path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes, start, n, piece): lines of each file split, newlines put back, as numbered pieces of at most ``PIECE_BYTES``."""
    split, held, n = None, bytearray(), 0

    def cut(least: int) -> list[tuple]:
        nonlocal held, n
        out = []
        while len(held) >= least and held:
            out.append((*split, n, bytes(held[:PIECE_BYTES])))
            held, n = held[PIECE_BYTES:], n + 1
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECES.types)], schema=PIECES)

    for lines in batches:
        for key, line in zip(zip(*(lines.column(i).to_pylist() for i in range(3))), lines.column(3).to_pylist()):
            if key != split:
                if held:
                    yield batch(cut(1))
                split, n = key, 0
            held += line
            held += b"\n"
            if len(held) >= 64 * PIECE_BYTES:
                yield batch(cut(PIECE_BYTES))
    if held:
        yield batch(cut(1))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes, sha256) of pieces in order; a file's bytes pass one at a time through its hash.

    Lines end in a newline that the file's last line may lack, and the reader drops a byte order mark; the file's length tells which.
    """
    file, taken, plain, marked = None, 0, None, None

    def close() -> pa.RecordBatch:
        rest = file[1] - taken
        if rest not in (0, 1, len(BOM_UTF8), len(BOM_UTF8) + 1):
            raise ValueError(f"{file[0]}: {taken} of {file[1]} bytes read")
        found = (plain if rest < len(BOM_UTF8) else marked).copy()
        found.update(b"\n" * (rest % len(BOM_UTF8)))
        return pa.RecordBatch.from_pydict({"path": [file[0]], "bytes": pa.array([file[1]], pa.int64()), "sha256": [found.hexdigest()]})

    for pieces in batches:
        for path, size, piece in zip(*(pieces.column(name).to_pylist() for name in ("path", "bytes", "piece"))):
            if (path, size) != file:
                if file is not None:
                    yield close()
                file, taken, plain, marked, last = (path, size), 0, hashlib.sha256(), hashlib.sha256(BOM_UTF8), b""
            for digest in (plain, marked):
                digest.update(last)
                digest.update(memoryview(piece)[:-1])
            taken += len(last) + len(piece) - 1
            last = piece[-1:]
    if file is not None:
        yield close()


def artifact_manifest(spark: SparkSession, root: str) -> DataFrame:
    """manifest(path, bytes, sha256) of every file below ``root`` that Spark lists, whatever its length; it leaves out empty files and names that begin with _ or a dot.

    Files up to ``WHOLE_BYTES`` are a row each. Larger ones, which neither fit in a row nor should, are read in splits as lines that end in a newline
    byte, and their pieces pass in order through one hash, as SHA-256 is sequential; a task holds some pieces. Readers would unpack files
    named as compressed ones, so these stay rows up to 2 GB, and are an error beyond.
    """
    def found(pattern: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)

    whole = found("*").where(F.col("length") <= WHOLE_BYTES)
    packed = found(f"*.{{{','.join(PACKED)}}}").where(F.col("length") > WHOLE_BYTES)
    rows = whole.unionByName(packed).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    facts = F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_block_start")
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root).where(
        (facts[1] > WHOLE_BYTES) & ~facts[0].rlike(rf"\.({'|'.join(PACKED)})$"))
    path = F.url_decode(F.replace(facts[0], F.lit("+"), F.lit("%2B")))  # as the other reader gives it
    pieces = lines.select(path.alias("path"), facts[1].alias("bytes"), facts[2].alias("start"), F.col("value").cast("binary").alias("line")).mapInArrow(
        _pieces, "path string, bytes long, start long, n long, piece binary")
    large = pieces.repartition("path").sortWithinPartitions("path", "start", "n").mapInArrow(_digests, "path string, bytes long, sha256 string")
    return rows.unionByName(large).select(F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/')}/\E", "").alias("path"), "bytes", "sha256")
