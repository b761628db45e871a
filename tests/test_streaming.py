"""The stream gives the same epochs as the batch, and late rows are dropped."""

from pyspark.sql import functions as F

from specframe.streaming.epochs import run_available, stream_epoch_power

SCHEMA = "k string, ts timestamp, value double"


def test_stream_equals_batch(spark, tmp_path):
    base = spark.range(400).select(F.concat(F.lit("k"), (F.col("id") % 2).cast("string")).alias("k"),
                                   F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 3).alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    source = str(tmp_path / "in")
    base.write.parquet(source)
    stream = stream_epoch_power(spark.readStream.schema(SCHEMA).parquet(source), ["k"], "40 seconds", "20 seconds", "10 seconds")
    got = {(r["k"], r["epoch_start"]): (r["n"], r["power"]) for r in run_available(spark, stream, "t").collect()}
    want = {(r["k"], r["epoch_start"]): (r["n"], r["power"]) for r in stream_epoch_power(base, ["k"], "40 seconds", "20 seconds", "10 seconds").collect()}
    assert len(got) > 40 and all(want[k] == v for k, v in got.items())
    last = max(t for _, t in want)
    assert len(want) - len(got) <= 6 and all((last - k[1]).total_seconds() <= 40 for k in want if k not in got)


def test_late_rows_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    for i, seconds in enumerate(([0, 5, 90, 95], [100], [1, 2, 200], [300])):
        spark.createDataFrame([("a", s) for s in seconds], "k string, s int").select(
            "k", F.timestamp_seconds(F.lit(1700000000) + F.col("s")).alias("ts"), F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(str(source / f"b{i}"))
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    out = run_available(spark, stream_epoch_power(rows, ["k"], "20 seconds", "10 seconds", "10 seconds"), "late").collect()
    early = [r for r in out if r["epoch_start"].timestamp() <= 1700000000]
    assert early and all(r["n"] <= 2 for r in early)
