import random

import public_tokenizers
import pytest
from helpers import documents
from tokenizers import Tokenizer

import corpus_pipeline
from specframe.llm import decontam, near_dup, toxicity

BAD = ["grubbish", "nastyword", "vilething"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    syllables = ["the", "ing", "an", "re", "on", "ti", "es", "or", "st", "en"]
    words = lambda n: ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    items = [words(25) for _ in range(4)]
    rows, labels = [], []
    for i in range(400):
        text = words(rng.randint(40, 150))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        if i % 40 == 7:
            text[20:20] = items[i % 4]
        rows.append((i, " ".join(text), "en", f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "copy") for i in range(0, 400, 20)]
    rows += [(2000, None, None, None), (2001, "", "en", None), (2001, "", "en", None)]
    path = tmp_path_factory.mktemp("tables")
    documents(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_every_stage(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = sorted((r["doc_id"], r["text"]) for r in docs.filter("text IS NOT NULL").collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "token_files":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{name}"))
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    toxic = {i for i, t, *_ in rows if t and any(b in t.split() for b in BAD)}
    gone = set(ids(kept["toxicity"][0])) - set(ids(kept["toxicity"][1]))
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) <= 0.03 * (len(rows) - len(toxic)), len(gone - toxic)
    source, result = kept["near_dup"]
    expected = {r["component_id"] for r in near_dup.near_duplicates(source, k=5).collect()}
    # 2001 stands there twice without words: such rows are linked with nothing, and each stays.
    assert set(ids(result)) == expected and len(ids(result)) == len(expected) + 1 and ids(result).count(2001) == 2
    assert not {i for i in ids(result) if 1000 <= i < 2000 and i - 1000 in ids(result)}
    source, result = kept["decontamination"]
    holds = lambda t: any(" ".join(w) in " ".join(x.decode() for x in decontam.words_of(t)) for w in items)
    assert sorted(ids(result)) == sorted(r["doc_id"] for r in source.collect() if not holds(r["text"]))
    source, result = kept["mixing"]
    assert set(ids(result)) <= set(ids(source)) and max(ids(result).count(i) for i in set(ids(result))) <= 3
    source, result = kept["token_files"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {r["doc_id"]: len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in source.collect()}
    got = sorted(result.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(ids(source))
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == size[r["doc_id"]]
        start += r["n_tokens"]
    assert before and toxicity.CUT == 0.7


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 200
