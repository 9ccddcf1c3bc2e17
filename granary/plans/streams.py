"""Queries that run a stream over a given table to its end, and the image gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.tables import read
from granary.sources.shared import new_path
from granary.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def drain(stream: DataFrame, mode: str, report: dict | None = None) -> DataFrame:
    """Drain a stream into a table in the shared folder: a part for each batch, written anew if the batch is repeated.

    Of a complete result the last batch holds all; updates of all batches are returned. ``report`` gets late_rows and,
    for each batch, state_rows.
    """
    path = new_path(stream.sparkSession)
    last, seen, running = [], {}, []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        last.append(batch)
        for query in running:
            jobs.late_rows(query, seen)

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query = writer.start()
    try:
        running.append(query)
        query.awaitTermination()
        if report is not None:
            report["late_rows"] = jobs.late_rows(query, seen)
            report["state_rows"] = [sum(x["numRowsTotal"] for x in p["stateOperators"]) for p in query.recentProgress]
    finally:
        query.stop()
    if not last:
        return stream.sparkSession.createDataFrame([], stream.schema)
    part = f"/batch={last[-1]}" if mode == "complete" else ""
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows{part}")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over the table; the pattern lets the source take a single file as well as a folder."""
    table = read(spark, sf, "events")
    rows = spark.readStream.schema(table.schema).parquet(f"{sf}/events[.]parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has passed, and whether the ranks of their percentiles are right within the sketch's error."""
    days = drain(jobs.latency(_events(spark, sf), span="1 day", late="1 hour", request="event_id"), "append").drop("sketch")
    samples = read(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("route"), F.col("value").cast("double").alias("v"))
    same = (F.col("day") == F.to_date("start")) & (F.col("route") == F.col("event_type"))
    below, upto = (F.count_if(F.col("v") < F.col(p)) / F.col("timed") for p in ("p50", "p95")), (F.count_if(F.col("v") <= F.col(p)) / F.col("timed") for p in ("p50", "p95"))
    good = [(b <= share + jobs.RANK_ERROR) & (u >= share - jobs.RANK_ERROR) for share, b, u in zip((0.5, 0.95), below, upto, strict=True)]
    checked = days.join(samples, same, "left").groupBy("start", "event_type", "n", "timed", "p50", "p95", "max").agg(*[g.alias(f"p{k}_within") for g, k in zip(good, (50, 95), strict=True)])
    return checked.select(F.unix_millis("start").alias("start_ms"), "event_type", "n", "p50_within", "p95_within", "max")


def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = drain(jobs.over_limit(_events(spark, sf), 2, span="1 hour"), "update")
    latest = rows.groupBy("user_id", "start").agg(F.max("n").alias("n"))
    return latest.select("user_id", F.unix_millis("start").alias("start_ms"), "n", (F.col("n") - 2).alias("rejected"))


QUERIES["stream_latency"] = stream_latency
SQL["stream_latency"] = """
SELECT epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS start_ms, event_type, count(*) AS n, true AS p50_within, true AS p95_within, max(value) AS max
FROM events GROUP BY CAST(ts AS DATE), event_type
HAVING CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
"""
QUERIES["stream_rate_limit"] = stream_rate_limit
SQL["stream_rate_limit"] = "SELECT user_id, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, count(*) AS n, count(*) - 2 AS rejected FROM events GROUP BY ALL HAVING count(*) > 2"
