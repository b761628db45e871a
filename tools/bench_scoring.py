"""Scoring at a stated size: states x entities x coordinates, made by Spark; prints seconds of pair reduction and of the whole summary.

usage: python tools/bench_scoring.py [states entities coordinates] [--memory 1g]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from specframe.operators import scoring

    parser = argparse.ArgumentParser()
    parser.add_argument("sizes", nargs="*", type=int, default=[49_152, 327, 40])
    parser.add_argument("--memory", default="1g")
    args = parser.parse_args()
    states, entities, width = args.sizes
    spark = (SparkSession.builder.master("local[8]").config("spark.driver.memory", args.memory).config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def array(size: int, name: str, seed: int):
        cell = lambda i: (F.xxhash64(F.lit(seed), F.col("id"), i) % 2_000_000) / 1_000_000.0
        return F.transform(F.sequence(F.lit(1), F.lit(size)), cell).alias(name)

    bank = spark.range(states).select(F.format_string("s%08d", "id").alias("state_id"), F.format_string("c%08d", F.floor(F.col("id") / 24)).alias("candidate_id"), array(width, "f", 1), F.lit(0.1).alias("spread"), array(15, "theta", 2), F.lit(0.0).alias("prior"))
    people = spark.range(entities).select(F.col("id").alias("entity_id"), array(width, "fit", 3))
    for quantiles in (False, True, False, True):
        start = time.time()
        passed = scoring.posterior_pass(people, bank, [("main", 0.5, "prior")], 10, quantiles=quantiles)
        rows = scoring.posterior_summary(passed, [f"p{i}" for i in range(15)]).collect()
        print(f"{states} x {entities} x {width}, {args.memory} heap, quantiles {quantiles}: {time.time() - start:.1f} s, {len(rows)} rows", flush=True)


if __name__ == "__main__":
    main()
