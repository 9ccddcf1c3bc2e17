"""Queries that write a given table with a sink, read it back with its source, and return what came back; own embedders and streams of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from granary.functions import folds
from granary.functions import sql as S
from granary.operators import embedder, search
from granary.plans.streams import drain
from granary.plans.tables import SOURCES, read, sources
from granary.sources import files
from granary.sources.index import IndexStore
from granary.sources.shared import new_path
from granary.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("read_raw_docs", f"WITH {SOURCES} SELECT source_id, title, url, reliability_level, md5(raw_text) AS digest FROM s")
def q_raw(spark, sf):
    path = new_path(spark)
    files.write_raw_docs(sources(spark, sf), path)
    return files.read_raw_docs(spark, path, lines=True).select("source_id", "title", "url", "reliability_level", F.md5("raw_text").alias("digest"))


@query("read_chunks", f"WITH {SOURCES} SELECT source_id || '#0' AS chunk_id, source_id, title, md5(raw_text) AS digest FROM s")
def q_chunks(spark, sf):
    path = new_path(spark)
    chunks = sources(spark, sf).select(F.concat("source_id", F.lit("#0")).alias("chunk_id"), F.col("raw_text").alias("text"), "source_id", "title", "url", "reliability_level")
    files.write_chunks(chunks, path)
    return files.read_chunks(spark, path, lines=True).select("chunk_id", "source_id", "title", F.md5("text").alias("digest"))


_EVENT = "event_id long, user_id long, event_type string, value double, logged_at timestamp"


@query("append_event_log", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def q_append(spark, sf):
    """The log in two parts, one behind the other."""
    path, events = new_path(spark), read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    files.append_event_log(events.where("event_id % 2 = 0"), path)
    files.append_event_log(events.where("event_id % 2 <> 0"), path)
    return files.read_event_log(spark, path, _EVENT).where("logged_at is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("read_event_log", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def q_log(spark, sf):
    path = new_path(spark)
    read(spark, sf, "events").select("event_id", "event_type", "value", F.struct("ts", "event_id").alias("at")).write.json(path)
    schema = "event_id long, event_type string, value double, at struct<ts:timestamp,event_id:long>"
    return files.read_event_log(spark, path, schema, newest=100, at="at").select("event_id", "event_type", "value")


@query("read_report_csv", "SELECT c_custkey, c_name, c_mktsegment, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def q_csv(spark, sf):
    path = new_path(spark)
    rows = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    files.write_report_csv(rows, path)
    return files.read_report_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")


@query("decode_text_files", "SELECT md5(replace(text, chr(10), ' ')) AS digest, count(*) AS n FROM documents GROUP BY 1")
def q_decode(spark, sf):
    """Texts as lines of text files."""
    path = new_path(spark)
    read(spark, sf, "documents").select(F.replace("text", F.lit("\n"), F.lit(" "))).write.option("maxRecordsPerFile", 10_000).text(path)
    found = files.decode_text_files(spark, f"{path}/*.txt")
    # files end with a line break
    return found.select(F.explode(F.split(F.regexp_replace("raw_text", r"\n$", ""), "\n")).alias("line")).groupBy(F.md5("line").alias("digest")).agg(F.count("*").alias("n"))


@query("write_docs_chunks_index", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, bool_and(source > 's') AS fresh FROM documents GROUP BY 1")
def q_write(spark, sf):
    """All sources in buckets, then those of the later names once more: only their buckets are overwritten, with all rows that belong there."""
    path, docs = new_path(spark), read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    bucket = F.pmod(F.hash("source"), F.lit(64))
    files.write_buckets(docs.withColumn("fresh", F.lit(False)), path, key="source")
    again = docs.where(F.col("source") > "s").select(bucket.alias("b")).distinct()
    files.write_buckets(docs.withColumn("b", bucket).join(again, "b").withColumn("fresh", F.col("source") > "s").drop("b"), path, key="source")
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.bool_and("fresh").alias("fresh"))


def _chunks(spark, sf, text=None):
    """A chunk of each document; ``text`` may change it."""
    docs = read(spark, sf, "documents").select(F.concat("doc_id", F.lit("#0")).alias("chunk_id"), F.col("doc_id").cast("string").alias("source_id"), "text")
    return search.with_embedding(docs if text is None else docs.withColumn("text", text))


_NORM = f"CASE WHEN len({S.tokens('t')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm"


def _digest(rows):
    square = F.aggregate(F.map_values("embedding"), F.lit(0.0), lambda a, w: a + w * w)
    return rows.select("chunk_id", "source_id", F.md5("text").alias("digest"), F.round(square, 6).alias("norm"), "embedding_version")


@query("upsert_index", f"""
WITH d AS (
  SELECT CAST(doc_id AS VARCHAR) || '#0' AS chunk_id, CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'Bản mới. ' || text ELSE text END AS t FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR) || '#new', 'new' || CAST(doc_id AS VARCHAR), text FROM documents WHERE doc_id % 3 = 0
)
SELECT chunk_id, source_id, md5(t) AS digest, {_NORM}, 'hash-256' AS embedding_version FROM d
""")
def q_upsert(spark, sf):
    """All documents are indexed; a third comes in again with other texts, under their own and under new sources, twice."""
    index = IndexStore(spark, new_path(spark))
    index.rebuild(_chunks(spark, sf))
    again = _chunks(spark, sf, F.concat(F.lit("Bản mới. "), "text")).where("pmod(cast(source_id AS long), 3) = 0")
    moved = _chunks(spark, sf).where("pmod(cast(source_id AS long), 3) = 0")
    known = moved.withColumn("source_id", F.concat(F.lit("x"), "source_id"))  # ids that stay are known: left out
    moved = moved.withColumns({"chunk_id": F.concat("source_id", F.lit("#new")), "source_id": F.concat(F.lit("new"), "source_id")})
    for _ in range(2):
        index.upsert(again.unionByName(moved))
    index.upsert(known)
    return _digest(index.read())


@query("reembed_stale", f"WITH d AS (SELECT doc_id, text AS t FROM documents) SELECT CAST(doc_id AS VARCHAR) || '#0' AS chunk_id, CAST(doc_id AS VARCHAR) AS source_id, md5(t) AS digest, {_NORM}, 'hash-256' AS embedding_version FROM d")
def q_reembed(spark, sf):
    """An index in which a quarter has vectors of another version, and none has it any more."""
    index = IndexStore(spark, new_path(spark))
    old = F.pmod(F.col("source_id").cast("long"), F.lit(4)) == 0
    rows = _chunks(spark, sf)
    rows = rows.withColumn("embedding", F.when(~old, F.col("embedding"))).withColumn("embedding_version", F.when(old, "legacy").otherwise(F.col("embedding_version")))
    index.rebuild(rows)
    index.reembed(search.with_embedding, search.HASH_VERSION)
    return _digest(index.read())


@query("read_query_plan", "SELECT r_name AS \"group\", CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS INT) AS place, n_name AS query FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_plan(spark, sf):
    path = new_path(spark)
    named = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    groups = named.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("q"))
    groups.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "q"))).alias("groups")).coalesce(1).write.json(path)
    return files.read_query_plan(spark, path).select("group", F.col("place"), "query")


@query("merge_broken_lines")
def q_merge(spark, sf):
    merge = folds.line_udf(folds.merge_lines)
    return read(spark, sf, "documents").select("doc_id", merge("text").alias("merged")).withColumn("n", F.length("merged"))


@query("drop_low_value_lines")
def q_drop(spark, sf):
    drop = folds.line_udf(folds.drop_poor_lines)
    return read(spark, sf, "documents").select("doc_id", drop("text").alias("kept")).withColumn("n", F.length("kept"))


@query("register_embedder", "SELECT doc_id, len(text)::DOUBLE AS chars, (len(text) - len(replace(text, ' ', '')))::DOUBLE AS spaces, 'counts-1' AS embedding_version FROM documents")
def q_embedder(spark, sf):
    counts = lambda texts: np.array([(len(t), t.count(" ")) for t in texts], float).reshape(-1, 2)
    rows = embedder.embed(read(spark, sf, "documents").select("doc_id", "text"), "text", counts, "counts-1")
    return rows.select("doc_id", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("spaces"), "embedding_version")


@query("stream_ingest_dedupe", f"SELECT DISTINCT {S.content_hash('text')} AS content_hash FROM documents")
def q_ingest(spark, sf):
    """All documents arrive as a stream; the store holds one of each content."""
    path, table = new_path(spark), read(spark, sf, "documents")
    arriving = spark.readStream.schema(table.schema).parquet(f"{sf}/documents[.]parquet").select(
        F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("raw_text"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("crawled_at")
    )
    jobs.ingest(arriving, f"{path}/store", f"{path}/state").start().awaitTermination()
    return spark.read.parquet(f"{path}/store").select("content_hash")


@query("stream_crawl_progress", "SELECT CAST(user_id % 4 AS VARCHAR) AS run, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY ALL")
def q_progress(spark, sf):
    table = read(spark, sf, "events")
    rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events[.]parquet")
    rows = rows.withColumns({"ts": F.col("ts").cast("timestamp"), "run": F.col("user_id") % 4})
    updates = drain(jobs.crawl_progress(rows, "run", "event_type", "user_id"), "update")
    return jobs.total_progress(updates).select("run", F.col("kind").alias("event_type"), "n")
