"""A corpus pipeline: each stage works on all that the stage before it kept, and writes Parquet for the next one.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``docs``.

toxicity         rows scored toxic go; the model is fitted on the labelled documents of the given folder
near_dup         one document of each group of near-duplicates (5-word shingles, similarity 0.8) stays
decontamination  documents that hold a benchmark item, copied or edited, go
mixing           every document as often as the mix of sources takes it; sources, sizes and targets are those of this stage's input
token_files      token files in ascending id order, read back: doc_id, start, n_tokens, ids_crc32
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specframe.llm import decontam, mixing, near_dup, token_files, toxicity
from specframe.llm.common import table
from specframe.llm.queries import VOCABULARY
from specframe.session import stage_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = toxicity.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return docs.filter(toxicity.score_column(toxicity.fit_sample(sample), F.col("text")) < toxicity.CUT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_files", token_output),
]

# Trained dictionaries, alignment and knapsack fitting are beyond SQL; tests compare the pipeline with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = stage_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
