"""The stream of new documents reads each micro-batch once and keeps one of each content."""

import datetime as dt

from granary.streaming import jobs

SCHEMA = "source_id string, raw_text string, crawled_at timestamp"
DAY = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, rows):
    """Rows arrive, and are put behind those of the runs before."""
    spark.createDataFrame([(*row, DAY) for row in rows], SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = jobs.ingest(stream, str(tmp_path / "store"), str(tmp_path / "cp")).start()
    query.awaitTermination()
    return query.recentProgress


def store(spark, tmp_path):
    return spark.read.parquet(str(tmp_path / "store"))


def test_a_batch_is_read_once(spark, tmp_path):
    progress = run(spark, tmp_path, [(str(i), f"text {i % 40}") for i in range(200)])
    # a state that is written by each of two readings counts twice
    assert sum(x["numRowsUpdated"] for p in progress for x in p["stateOperators"]) == 40
    progress = run(spark, tmp_path, [(str(i), f"text {i % 50}") for i in range(200, 400)])
    assert sum(x["numRowsUpdated"] for p in progress for x in p["stateOperators"]) == 10
    assert store(spark, tmp_path).count() == store(spark, tmp_path).select("content_hash").distinct().count() == 50


def test_rows_without_a_source_or_text(spark, tmp_path):
    run(spark, tmp_path, [(None, "a"), (None, "A "), (None, "b"), ("1", None), ("2", None), ("3", "c"), ("3", "d")])
    assert sorted(map(str, (r.raw_text and r.raw_text.strip().lower() for r in store(spark, tmp_path).collect()))) == ["None", "a", "b", "c", "d"]


def test_the_store_knows_contents_and_sources(spark, tmp_path):
    run(spark, tmp_path, [("1", "a"), ("2", "b"), (None, None)])
    stream = spark.createDataFrame([("3", "A"), ("2", "new"), ("4", "d"), ("5", None), (None, "e")], "source_id string, raw_text string").selectExpr("*", "timestamp'2024-01-02' AS crawled_at")
    stream.write.parquet(str(tmp_path / "in2"))
    # a stream that begins anew has no state, only the store
    jobs.ingest(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in2")), str(tmp_path / "store"), str(tmp_path / "cp2")).start().awaitTermination()
    assert sorted((str(r.source_id), str(r.raw_text)) for r in store(spark, tmp_path).collect()) == [("1", "a"), ("2", "b"), ("4", "d"), ("None", "None"), ("None", "e")]
