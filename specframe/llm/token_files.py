"""Token-id files: concatenated ids with Elias-Fano document boundaries.

``write_token_files`` puts documents in ascending id order, encodes whole texts and writes blocks; ``read_token_files``
reads the blocks back and returns one row per document. A block is one row of a Parquet table that Spark's own
committer writes, so a lost executor or a second attempt never leaves half a block, and any store that Spark can write
will do. Columns of a block:

    part, block      place in the order (range partition, block in it)
    n_docs, n_ids    sizes
    doc_ids          the documents' ids, in order
    ids              the ids, unsigned little-endian, ``id_bytes`` wide (2 if every id is below 2^16, else 4)
    low_bits, low, high, hints    Elias-Fano code of the n_docs + 1 boundaries in ``ids``

Boundaries are relative to their block; only one 64-bit offset per block is ever made, as a running sum over blocks.

Defined results: a null text is an empty one (only the end id); a null id sorts first; rows that share an id stand in
the order of their text's hash, each as a document of its own; an empty table gives no blocks and no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage_path
from . import elias_fano

BLOCK_IDS = 1 << 20  # ids after which a block is closed; a longer single document is a block of its own
CACHE_PIECES = 300_000  # pieces in each of the two generations that one Python worker remembers
# Every white space character of Python and of Unicode but the space itself.
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]

BLOCK_SCHEMA = ("part int, block int, n_docs int, n_ids long, doc_ids array<bigint>, id_bytes int, ids binary, "
                "low_bits int, low binary, high binary, hints binary")
ROW_SCHEMA = "doc_id long, part int, block int, offset long, n_tokens long, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level BPE files: itself if printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)}


class Memory(dict):
    """Values by key; a value that is not there yet is made, and kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


class PieceEncoder:
    """A tokenizer with a memory for pieces of text.

    Byte-level BPE never merges across its splitting pattern, and the pattern always splits before a single space
    between two other characters. A text without wider gaps is therefore cut there; a piece that was not met before is
    split by the pattern, and each new part goes through the tokenizer's model once. Any other text (wide gaps, other
    white space beside a space, a special token), and any tokenizer of another kind, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec["pre_tokenizer"] or {}
        self.cuts = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and spec["normalizer"] is None
        self.special = [t["content"] for t in spec["added_tokens"]]
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype, self.code = ("<u4", "I") if wide else ("<u2", "H")
        self.split, self.letters, self.model = regex.compile(PATTERN).findall, _byte_letters(), self.tokenizer.model
        # What follows a space. A full generation becomes the older one, so pieces in use outlive those seen once.
        self.pieces: dict[str, bytes] = Memory(self._spaced)
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _tokens(self, shown: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _part(self, part: str) -> bytes:
        if part not in self.parts:
            self.parts[part] = self._tokens(part.encode("utf-8").decode("latin-1").translate(self.letters))
        return self.parts[part]

    def _word(self, word: str) -> bytes:
        """Ids of a space and a run of letters, which the pattern keeps whole."""
        ids = self.pieces.get(word) or self.older.get(word)
        if ids is None:
            # Printable ASCII stands for itself, so only other letters need their stand-ins.
            shown = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = self._tokens(self.letters[0x20] + shown)
        self.pieces[word] = ids
        return ids

    def _spaced(self, piece: str) -> bytes:
        """Ids of a space and a piece that is not in the younger generation."""
        known = self.older.get(piece)
        if known is not None:
            return known
        if piece.isalpha():
            return self._word(piece)
        if piece[:-1].isalpha() and piece[-1] in ".,":
            return self._word(piece[:-1]) + self._part(piece[-1])
        return b"".join(map(self._part, self.split(" " + piece)))

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._part(piece)
        return b"".join(map(self._part, self.split(piece)))

    def _cut(self, text: str) -> list[str] | None:
        if not self.cuts or any(s in text for s in self.special):
            return None
        pieces = text.split(" ")
        # A gap that is wider than one space, or at an end of the text, is seen as a whole by the pattern.
        if len(pieces) > 1 and not all(pieces):
            return None
        if any(c in text and (c + " " in text or " " + c in text) for c in OTHER_SPACE):
            return None
        return pieces

    def batch(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) if t else [] for t in texts]
        if len(self.pieces) > CACHE_PIECES:
            self.older, self.pieces = self.pieces, Memory(self._spaced)
        if len(self.parts) > CACHE_PIECES:
            self.parts.clear()
        get = self.pieces.__getitem__
        out = []
        for text, pieces in zip(texts, cut):
            if pieces is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes())
            elif pieces:
                out.append(self._piece(pieces[0]) + b"".join(map(get, pieces[1:])))
            else:
                out.append(b"")
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker, so its memory serves later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _block(part: int, number: int, doc_ids: list, codes: list[bytes], dtype: str) -> pa.RecordBatch:
    width = int(dtype[-1])
    ends = np.cumsum([0, *[len(c) // width for c in codes]])
    code = elias_fano.encode(ends)
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(doc_ids)], pa.int32()),
         pa.array([int(ends[-1])], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([width], pa.int32()),
         pa.array([b"".join(codes)], pa.binary()), pa.array([code.low_bits], pa.int32()), pa.array([code.low], pa.binary()),
         pa.array([code.high], pa.binary()), pa.array([code.hints], pa.binary())],
        names=["part", "block", "n_docs", "n_ids", "doc_ids", "id_bytes", "ids", "low_bits", "low", "high", "hints"])


def write_token_files(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` in ascending id order and write the blocks to ``path``.

    The texts are shuffled once, by range of (id, text hash, row number), so one id with very many rows is
    split as well.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        part, number, ids, codes, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for doc_id, code in zip(piece.column(0).to_pylist(), own.batch(texts)):
                    ids.append(doc_id)
                    codes.append(code + end)
                    held += len(codes[-1]) // len(end)
                    if held >= block_ids:
                        yield _block(part, number, ids, codes, own.dtype)
                        number, ids, codes, held = number + 1, [], [], 0
        if ids:
            yield _block(part, number, ids, codes, own.dtype)

    slim = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    keyed = slim.withColumn("h", F.xxhash64("t")).withColumn("n", F.monotonically_increasing_id())
    order = [F.col("i").asc_nulls_first(), "h", "n"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("i", "t")
    placed.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                code = elias_fano.EliasFano(r["n_docs"] + 1, r["low_bits"], r["low"], r["high"], r["hints"])
                ends = elias_fano.decode(code)
                ids = np.frombuffer(r["ids"], dtype=f"<u{r['id_bytes']}").astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                n = r["n_docs"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()),
                     pa.array(ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "part", "block", "offset", "n_tokens", "ids_crc32"])

    stored = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # Offsets: within a part over its blocks, and over the parts, of which there is one a writing task.
    blocks = stored.select("part", "block", "n_ids")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("_in", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).select("part", "_before")
    starts = inside.join(parts, "part").select("part", "block", (F.col("_in") + F.col("_before")).alias("_start"))
    return (stored.mapInArrow(rows, ROW_SCHEMA).join(starts, ["part", "block"])
            .select("doc_id", (F.col("_start") + F.col("offset")).cast("long").alias("start"), "n_tokens", "ids_crc32"))


def fetch(blocks: DataFrame, part: int, block: int, number: int) -> list[int]:
    """The ids of document ``number`` of one block, by two selects; for a reader that wants single documents."""
    r = blocks.filter((F.col("part") == part) & (F.col("block") == block)).first()
    code = elias_fano.EliasFano(r["n_docs"] + 1, r["low_bits"], bytes(r["low"]), bytes(r["high"]), bytes(r["hints"]))
    first, last = elias_fano.select(code, number), elias_fano.select(code, number + 1)
    return np.frombuffer(bytes(r["ids"]), dtype=f"<u{r['id_bytes']}")[first:last].tolist()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write the blocks to a new place in the shared folder and read them back."""
    path = stage_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary, id_col, text_col, end_id)
    return read_token_files(docs.sparkSession, path)
