import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from specframe.llm import elias_fano, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, dtype=np.int64)) if steps else np.zeros(0, dtype=np.int64)
    code = elias_fano.encode(values)
    assert elias_fano.decode(code).tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert elias_fano.select(code, i) == values[i]
    if len(values) > 100:
        bits = 8 * (len(code.low) + len(code.high))
        assert bits <= len(values) * (2 + max(0.0, np.log2(max(1, values[-1]) / len(values))) + 1) + 64


def test_elias_fano_rejects_falling_values():
    with pytest.raises(ValueError):
        elias_fano.encode([3, 2])


TEXTS = ["plain words, and more.", " leading", "trailing ", "two  spaces", "line\nbreak\n\n", "tab\t here", " \n", "it's we'll don't", "ñandú É 123abc", "a<|endoftext|>b", "\u3000wide\u00a0space x", "x" * 50, "!!! ???", "e\u0301 combining", "😀 emoji 😀"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Z9.,'\n\t é文😀\u00a0\x1c_-")), max_size=30), min_size=1, max_size=5))
def test_piecewise_encoding_equals_the_tokenizer(texts):
    own, plain = token_files.encoder(PATH), Tokenizer.from_file(PATH)
    for text, code in zip(texts + TEXTS, own.batch(texts + TEXTS)):
        assert np.frombuffer(code, dtype=own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


def check(rows, got):
    plain = Tokenizer.from_file(PATH)
    start = 0
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by_start = sorted(got, key=lambda r: r["start"])
    for group_end in range(len(order)):
        doc_id = order[group_end][0]
        r = by_start[group_end]
        assert r["doc_id"] == doc_id and r["start"] == start
        candidates = [np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, t in rows if i == doc_id]
        assert (r["n_tokens"], r["ids_crc32"]) in {(len(c), zlib.crc32(c.tobytes())) for c in candidates}
        start += r["n_tokens"]


def test_files_round_trip(spark, tmp_path):
    rows = ODD + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = documents(spark, rows).repartition(3)
    check(rows, token_files.encode_documents(docs, PATH).collect())
    path = str(tmp_path / "blocks")
    token_files.write_token_files(docs, path, PATH, block_ids=20)
    check(rows, token_files.read_token_files(spark, path).collect())
    blocks = spark.read.parquet(path)
    assert blocks.count() > 5
    first = blocks.orderBy("part", "block").first()
    assert len(token_files.fetch(blocks, first["part"], first["block"], 0)) >= 1
    assert token_files.encode_documents(docs.limit(0), PATH).count() == 0
