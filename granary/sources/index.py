"""The search index as files: chunks with vectors, in buckets of their source, switched as a whole.

Rows lie under ``data/version=V/bucket=B``; a manifest names the version of each bucket. A writer stages the
buckets that it changes under a version of its own, and adds a manifest when all of them are there. So readers see the
index before or after, never in between, and what a lost driver or executor has left behind is never read.

An upsert changes only the buckets of the sources that come in. Stored rows are never shuffled: what goes to them is the
list of incoming sources, which is broadcast, for so many buckets at a time that it stays below a bound.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sources.shared import stored

#: Ids that are broadcast at once. A single bucket with more of them is joined.
BROADCAST_IDS = 500_000


class IndexStore:
    """An index in a folder that the driver and all executors share.

    Rows need chunk_id and source_id; all other columns are kept as they are and must be those of the first write.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, broadcast_ids: int = BROADCAST_IDS):
        self.spark, self.path, self.buckets, self.broadcast_ids = spark, path.rstrip("/"), buckets, broadcast_ids
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _names(self, folder: str) -> list[str]:
        at = self._jvm_path(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._files.listStatus(at)] if self._files.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(x) for x in self._names("manifests") if x.isdigit())

    def _state(self, number: int | None = None) -> dict:
        """versions and schema, as of the newest or an earlier manifest."""
        numbers = self._numbers()
        if not numbers:
            return {"versions": {}, "schema": None}
        source = self._files.open(self._jvm_path(f"{self.path}/manifests/{numbers[-1] if number is None else number:09}"))
        try:
            return json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()

    def manifest(self, number: int | None = None) -> dict[int, str]:
        """bucket -> version, as of the newest or an earlier manifest; empty before the first write."""
        return {int(b): v for b, v in self._state(number)["versions"].items()}

    def _switch(self, before: list[int], versions: dict[int, str], schema: dict) -> None:
        """Add a manifest; fails if another writer has added one since ``before``."""
        number = before[-1] + 1 if before else 0
        final, staged = (self._jvm_path(f"{self.path}/manifests/{x}") for x in (f"{number:09}", f".{uuid.uuid4().hex}"))
        out = self._files.create(staged, False)
        out.write(bytearray(json.dumps({"versions": versions, "schema": schema}).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(staged, final):
            self._files.delete(staged, False)
            raise RuntimeError("another writer has changed the index meanwhile")

    # rows

    def _bucket(self) -> Column:
        return F.pmod(F.hash("source_id"), F.lit(self.buckets))

    def read(self, buckets: Iterable[int] | None = None, number: int | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        return self._rows(buckets, number).drop("version", "bucket")

    def _rows(self, buckets: Iterable[int] | None = None, number: int | None = None) -> DataFrame:
        wanted = None if buckets is None else set(buckets)
        state = self._state(number)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in state["versions"].items() if wanted is None or int(b) in wanted]
        schema = T.StructType([*T.StructType.fromJson(state["schema"]), T.StructField("version", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def _stage(self, rows: DataFrame, version: str) -> None:
        rows.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")

    def _staged(self, version: str) -> dict[int, str]:
        names = self._names(f"data/version={version}")
        return {int(x.removeprefix("bucket=")): version for x in names if x.startswith("bucket=")}

    # writers

    def rebuild(self, chunks: DataFrame) -> None:
        """An index of these chunks alone."""
        before, version = self._numbers(), uuid.uuid4().hex
        self._stage(chunks.withColumn("bucket", self._bucket()).repartition("bucket"), version)
        self._switch(before, self._staged(version), chunks.schema.jsonValue())

    def upsert(self, chunks: DataFrame) -> None:
        """Stored chunks of sources that come in go; of the incoming ones those go that have the id of a chunk that stays.

        Chunks without a source delete nothing. Chunks that come in several times are all added.
        """
        before, versions, version = self._numbers(), self.manifest(), uuid.uuid4().hex
        incoming = stored(chunks.withColumn("bucket", self._bucket()))
        ids = stored(incoming.where("source_id <> ''").select("bucket", "source_id").distinct())
        counts = {r.bucket: r.n for r in incoming.select("bucket").distinct().join(ids.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").fillna(0).collect()}
        for group in _packed(counts, self.broadcast_ids):
            there = [b for b in group if b in versions]
            if there:
                self._stage(self.without(there, ids.where(F.col("bucket").isin(group)), sum(counts[b] for b in group)), version)
        kept = {b: v for b, v in versions.items() if b not in counts} | self._staged(version)
        new = incoming
        if kept:
            new = self._unknown(incoming, [f"{self.path}/data/version={v}/bucket={b}" for b, v in kept.items()])
        self._stage(new.repartition("bucket"), version)
        self._switch(before, {b: v for b, v in versions.items() if b not in counts} | self._staged(version), self._state()["schema"] or chunks.schema.jsonValue())

    def without(self, buckets: list[int], ids: DataFrame, n: int) -> DataFrame:
        """Stored rows of these buckets but for n sources; stored rows stay where they are."""
        gone = ids.select("source_id")
        gone = F.broadcast(gone) if n <= self.broadcast_ids else gone
        return self._rows(buckets).drop("version").join(gone, "source_id", "left_anti")

    def _unknown(self, incoming: DataFrame, paths: list[str]) -> DataFrame:
        """Incoming chunks whose id no row under the paths has."""
        there = self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).select("chunk_id")
        ids = incoming.select("chunk_id").distinct()
        if ids.count() <= self.broadcast_ids:
            clash = F.broadcast(there.join(F.broadcast(ids), "chunk_id", "left_semi").distinct())
            return incoming.join(clash, "chunk_id", "left_anti")
        return incoming.join(there, "chunk_id", "left_anti")

    def reembed(self, embed: Callable[[DataFrame], DataFrame], version: str, force: bool = False) -> int:
        """Give rows whose embedding_version isn't the active one new vectors; returns how many buckets were written.

        ``embed`` gets the stored columns but for embedding and embedding_version, and adds both.
        """
        before, versions, own = self._numbers(), self.manifest(), uuid.uuid4().hex
        stale = F.lit(True) if force else ~F.col("embedding_version").eqNullSafe(version)
        buckets = [r.bucket for r in self._rows().where(stale).select("bucket").distinct().collect()]
        if buckets:
            rows = self._rows(buckets).drop("version")
            fresh = embed(rows.where(stale).drop("embedding", "embedding_version"))
            self._stage(rows.where(~stale).unionByName(fresh), own)
            self._switch(before, versions | self._staged(own), self._state()["schema"])
        return len(buckets)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all that the newest manifests don't name. Readers of older ones, and writers that are at work, lose their rows."""
        numbers = self._numbers()
        named = {v for n in numbers[-keep:] for v in self.manifest(n).values()}
        for name in self._names("data"):
            if name.removeprefix("version=") not in named:
                self._files.delete(self._jvm_path(f"{self.path}/data/{name}"), True)
        for n in numbers[:-keep]:
            self._files.delete(self._jvm_path(f"{self.path}/manifests/{n:09}"), False)


def _packed(counts: dict[int, int], most: int) -> Iterable[list[int]]:
    """Buckets in groups whose counts stay below a bound together; one that is larger is a group of its own."""
    group, total = [], 0
    for bucket, n in sorted(counts.items()):
        if group and total + n > most:
            yield group
            group, total = [], 0
        group.append(bucket)
        total += n
    if group:
        yield group
