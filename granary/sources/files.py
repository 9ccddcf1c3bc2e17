"""Readers and writers: raw documents, chunks, logs, reports, text files, query plans. Images are in ``images``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = (
    "source_id string, source_type string, title string, file_name string, url string, page int, crawled_at timestamp, "
    "reliability_level string, content_type string, content_hash string, dedupe_key string"
)
RAW = f"metadata struct<{METADATA.replace(' string', ':string').replace(' int', ':int').replace(' timestamp', ':timestamp')}>, raw_text string"
CHUNK = "chunk_id string, text string, metadata struct<source_id:string,title:string,url:string,reliability_level:string,category:string>"


def read_raw_docs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One JSON file, or line, a document, flattened; an unreadable one gives a row of nulls with an empty text."""
    rows = spark.read.schema(RAW).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return rows.select("metadata.*", F.coalesce("raw_text", F.lit("")).alias("raw_text"))


def _nested(df: DataFrame, struct: T.StructType) -> Column:
    """The columns that the struct names; those that are missing are null."""
    return F.struct(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct])


def write_raw_docs(docs: DataFrame, path: str) -> None:
    """One JSON line a document: metadata and raw_text."""
    struct = T.StructType.fromDDL(RAW)["metadata"].dataType
    docs.select(_nested(docs, struct).alias("metadata"), "raw_text").write.json(path)


def read_chunks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON arrays of chunks, or a chunk a line, one row a chunk."""
    return spark.read.schema(CHUNK).option("multiLine", not lines).json(path).select("chunk_id", "text", "metadata.*")


def write_chunks(chunks: DataFrame, path: str) -> None:
    struct = T.StructType.fromDDL(CHUNK)["metadata"].dataType
    chunks.select("chunk_id", "text", _nested(chunks, struct).alias("metadata")).write.json(path)


def read_event_log(spark: SparkSession, path: str, schema: str, newest: int | None = None, at: str = "logged_at") -> DataFrame:
    """JSON lines without the malformed ones, the newest first if a number is given."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc(at)).limit(newest) if newest else rows


def append_event_log(events: DataFrame, path: str) -> None:
    events.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def read_report_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_report_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def decode_text_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, source_type by suffix, and the text of files as UTF-8, bytes that aren't left out."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return rows.select(name.alias("file_name"), F.when(suffix.isin("pdf", "docx", "txt"), suffix).otherwise("txt").alias("source_type"), text.alias("raw_text"))


def write_buckets(df: DataFrame, path: str, key: str = "source_id", buckets: int = 64) -> None:
    """Parquet in buckets of the key; only the buckets that come are overwritten."""
    bucketed = df.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
    bucketed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_query_plan(spark: SparkSession, path: str) -> DataFrame:
    """group, place and query of a nested JSON file {group: [query, ...]}."""
    schema = T.StructType([T.StructField("groups", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    groups = rows.select(F.explode("groups").alias("group", "queries"))
    return groups.select("group", F.posexplode("queries").alias("place", "query"))
