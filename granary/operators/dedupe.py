"""Exact duplicates and versions: by content hash, by source, by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import content_hash, squash


def source_id(seed: Column) -> Column:
    return F.substring(F.sha1(seed.cast("binary")), 1, 16)


def short_hash(value: Column) -> Column:
    """Logs carry this instead of text."""
    return F.substring(F.sha2(value.cast("binary"), 256), 1, 12)


def canonical(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, content_hash, duplicate_of (smallest key of the hash) and is_duplicate. Only keys and hashes are shuffled.

    The smallest key per hash is a partial aggregate, so a hot hash is never gathered in one task; the
    join back is one that adaptive execution can split.
    """
    hashed = docs.select(key, content_hash(F.col(text)).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("duplicate_of"))
    return hashed.join(first, "content_hash").select(key, "content_hash", "duplicate_of", (F.col(key) != F.col("duplicate_of")).alias("is_duplicate"))


def new_documents(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows with the stored document of the same content_hash and another key, if any."""
    known = stored.groupBy("content_hash").agg(F.min(key).alias("stored_key"), F.max(key).alias("other_key"))
    other = F.when(F.col("stored_key") != F.col(key), F.col("stored_key")).when(F.col("other_key") != F.col(key), F.col("other_key"))
    return incoming.join(known, "content_hash", "left").select(key, "content_hash", other.alias("duplicate_of"), other.isNotNull().alias("is_duplicate"))


def latest_and_backup(versions: DataFrame, source: str, at: str, tie: str) -> DataFrame:
    """The newest version of each source is live, the one before it its backup."""
    order = Window.partitionBy(source).orderBy(F.desc(at), F.desc(tie))
    ranked = versions.withColumn("place", F.row_number().over(order)).where("place <= 2")
    return ranked.withColumn("state", F.when(F.col("place") == 1, "live").otherwise("backup")).drop("place")


def dedupe_index(chunks: DataFrame, source: str, text: str, ordinal: str) -> DataFrame:
    """The first chunk of each (source, normalised text): a partial aggregate over the text's hash."""
    digest = F.sha2(squash(F.lower(F.col(text))).cast("binary"), 256)
    return chunks.groupBy(source, digest.alias("text_hash")).agg(F.min(ordinal).alias(ordinal), F.count("*").alias("copies"))


def upsert(stored: DataFrame, incoming: DataFrame, source: str, chunk: str) -> DataFrame:
    """Stored chunks of sources that come in again go; of the incoming ones those with a known id are left out."""
    kept = stored.join(incoming.select(source).distinct(), source, "left_anti")
    return kept.unionByName(incoming.join(kept.select(chunk), chunk, "left_anti"))
