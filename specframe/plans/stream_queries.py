"""The streaming form of the sliding epochs, run over the events table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..sources import views
from ..streaming.epochs import run_available, stream_epoch_power
from .registry import query


@query("stream_epoch_power", """
x AS (SELECT event_type AS channel, epoch_us(ts) AS us, value / 100.0 AS value FROM events),
e AS (SELECT channel, (us // 86400000000 - k.k) AS day, us, value FROM x CROSS JOIN (VALUES (0), (1)) k(k))
SELECT channel, CAST(day - 19723 AS BIGINT) AS epoch, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value * value), 6) AS power
FROM e WHERE (day + 2) * 86400000000 <= (SELECT max(us) FROM x) - 3600000000 GROUP BY channel, day
""")
def stream_epoch_power_query(spark, sf):
    schema = views.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = stream.select(F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 100.0).alias("value"))
    out = run_available(spark, stream_epoch_power(rows, ["channel"], "48 hours", "24 hours", "1 hour"), "epoch-power")
    day = F.datediff(F.col("epoch_start").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return out.select("channel", day.alias("epoch"), "n", rnd("mean").alias("mean"), rnd("power").alias("power"))
