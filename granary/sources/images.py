"""Image files: written one a row, read as bytes or with Spark's image source, measured, and listed by folder."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.folds import image_quality_stack
from granary.sources.shared import stored

#: Pixels that are measured at once.
STACK_PIXELS = 4_000_000
#: At most so many of Spark's parts of a list of files go into one task.
FILE_PARTS = 64
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
METRICS = "blur_score double, brightness double, green_ratio double, issues array<string>"


def png(rgb: np.ndarray) -> bytes:
    """A PNG file of 8-bit pixels, height x width x 3."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width, _ = rgb.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1).astype(np.uint8)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 1)) + part(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray | None:
    """Pixels of a PNG file, height x width x 3, in the order blue, green, red; None for all but whole files of plain 8-bit RGB without profiles, whose lines aren't filtered or by one neighbour."""
    view, at, head, body, kind = memoryview(data), 8, None, [], b""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    while kind != b"IEND":
        if at + 12 > len(data):
            return None
        length, kind = struct.unpack_from(">I4s", data, at)
        end = at + 8 + length
        if end + 4 > len(data) or zlib.crc32(view[at + 4 : end]) != struct.unpack_from(">I", data, end)[0]:
            return None
        if kind == b"IHDR" and head is None and at == 8 and length == 13:
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT" and head:
            body.append(view[at + 8 : end])
        elif kind not in (b"IEND", b"tEXt", b"tIME", b"pHYs"):
            return None
        at = end + 4
    if not head or head[2:] != (8, 2, 0, 0, 0) or min(head[:2]) < 1:
        return None
    width, height = head[:2]
    size, reader = height * (1 + 3 * width), zlib.decompressobj()
    try:
        lines = reader.decompress(b"".join(body), size + 1)
    except zlib.error:
        return None
    if len(lines) != size or not reader.eof or reader.unused_data:
        return None
    lines = np.frombuffer(lines, np.uint8).reshape(height, 1 + 3 * width)
    filters = lines[:, 0]
    if filters.max() > 2:
        return None
    pixels = (lines.copy() if filters.any() else lines)[:, 1:].reshape(height, width, 3)
    for y in np.flatnonzero(filters):
        if filters[y] == 1:
            pixels[y] = np.cumsum(pixels[y], axis=0, dtype=np.uint8)
        elif y:
            pixels[y] += pixels[y - 1]
    return pixels[..., ::-1]


def tasks(spark: SparkSession) -> int:
    """So many tasks share the work on a table of files: enough for all cores, and few beside the files."""
    return max(32, 4 * spark.sparkContext.defaultParallelism)


def write_files(rows: DataFrame, path: str, content: str, *folders: str) -> None:
    """One file a row with the bytes of ``content`` and a line break, in folders named after columns; on any file system that Spark writes to."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file":
        # Hadoop would start a process for each local file and folder, to set its permissions
        system.mkdirs(at)
        _write_local(rows, system.makeQualified(at).toUri().getPath(), content, *folders)
    else:
        write_text(rows, path, content, *folders)


def write_text(rows: DataFrame, path: str, content: str, *folders: str) -> None:
    """``write_files`` with Spark's own writer."""
    # the text writer passes bytes on as they are; decoders of images stop at the end mark
    rows.select(*folders, F.col(content).cast("string").alias("value")).write.option("maxRecordsPerFile", 1).partitionBy(*folders).text(path)


def _folder_name(name: str, value: str | None) -> str:
    """As Spark names the folders of ``partitionBy``."""
    return f"{name}={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', value) if value else '__HIVE_DEFAULT_PARTITION__'}"


def _write_local(rows: DataFrame, path: str, content: str, *folders: str) -> None:
    """Each task writes its own files into the shared folder. A file appears whole, and a task that runs again writes the same files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in batches:
            for value, *names in zip(batch["content"], *[batch[f] for f in folders], strict=True):
                into = "/".join([path, *map(_folder_name, folders, names)])
                n = seen[into] = seen.get(into, -1) + 1
                if not n:
                    os.makedirs(into, exist_ok=True)
                with open(hidden := f"{into}/_{uuid.uuid4().hex}", "wb") as file:
                    file.write((value or b"") + b"\n")
                os.replace(hidden, f"{into}/part-{part:05}-{n}.txt")
            yield pd.DataFrame({"n": [len(batch)]})

    rows.select(*[F.col(f).cast("string").alias(f) for f in folders], F.col(content).alias("content")).mapInPandas(write, "n long").agg(F.sum("n")).collect()


def _url_decoded(c: Column) -> Column:
    """A plus sign stays."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def folder(path: Column, name: str) -> Column:
    """The value of a folder ``name=value`` on the way to a file; null if there is none."""
    return F.nullif(_url_decoded(F.regexp_extract(path, rf"/{name}=([^/]*)/", 1)), F.lit(""))


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of all files below a folder. The folder is listed now, and once for all uses of the result."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(tasks(spark)))  # else a task for each folder
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")
    finally:
        spark.conf.set(_LISTING, before)
    return files


def fewer_tasks(files: DataFrame) -> DataFrame:
    """Spark counts a file as 4 MB at least, and so a task has a few: several such tasks are one."""
    parts = files.rdd.getNumPartitions()
    return files.coalesce(max(min(parts, tasks(files.sparkSession)), parts // FILE_PARTS))


def list_files(spark: SparkSession, path: str, *folders: str, files: DataFrame | None = None) -> DataFrame:
    """path, length and the values of folders of all files below a folder; none of them is opened. A folder that isn't there has no files. ``files``: its files_below."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [F.lit(None).cast("string").alias(n) for n in folders]
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.range(0).select(F.lit("").alias("path"), F.lit(0).cast("long").alias("length"), *names)
    files = (files_below(spark, path) if files is None else files).select("path", "length").where("path NOT LIKE '%/\\_%'")
    return fewer_tasks(files).select("path", "length", *[folder(F.col("path"), n).alias(n) for n in folders])


def read_images(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """JPEG and PNG files with their path, size, metrics and issues; a file that can't be read has the issue ``unreadable``.

    Plain PNG files are decoded where they are measured. If there are others, Spark's image source reads the folder as well. ``files``:
    the folder's files_below. What was measured is stored.
    """
    files = (files_below(spark, path) if files is None else files).select("path", "content")
    found = stored(fewer_tasks(files).mapInPandas(_measure_files, f"path string, width int, height int, {METRICS}"))
    left = found.where("width IS NULL").select("path")
    if left.isEmpty():
        return found
    images = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.origin", "image.width", "image.height", "image.data")
    measured = images.withColumnRenamed("origin", "path").mapInPandas(_measure_pixels, found.schema)
    # the image source encodes paths as URLs, and writes the root of local ones in another way
    local = lambda path: F.regexp_replace(path, "^file:/+", "/").alias("at")
    others = left.withColumn("at", local("path")).join(measured.select(local(_url_decoded(F.col("path"))), *found.columns[1:]), "at").drop("at")
    return found.where("width IS NOT NULL").unionByName(others)


def _measure_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Plain PNG files; the others have no size yet."""
    for batch in batches:
        rows = []
        for content in batch["content"]:
            pixels = png_pixels(content)
            rows.append((None,) * 6 if pixels is None else (pixels.shape[1], pixels.shape[0], *image_quality_stack(pixels[None])[0]))
        measured = pd.DataFrame(rows, columns=["width", "height", "blur_score", "brightness", "green_ratio", "issues"], index=batch.index)
        yield pd.concat([batch[["path"]], measured.astype({"width": "Int32", "height": "Int32"})], axis=1)


def _measure_pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found: dict[int, tuple] = {}
        by_size = defaultdict(list)
        for n, (width, height) in enumerate(zip(batch["width"].tolist(), batch["height"].tolist(), strict=True)):
            if width > 0 and height > 0:
                by_size[width, height, len(batch["data"].iloc[n]) // (width * height)].append(n)
            else:
                found[n] = (0.0, 0.0, 0.0, ["unreadable"])
        for (width, height, channels), members in by_size.items():
            step = max(1, STACK_PIXELS // (width * height))
            for at in range(0, len(members), step):
                some = members[at : at + step]
                pixels = np.frombuffer(b"".join(batch["data"].iloc[n] for n in some), np.uint8).reshape(len(some), height, width, channels)
                found |= dict(zip(some, image_quality_stack(pixels), strict=True))
        measured = pd.DataFrame([found[n] for n in range(len(batch))], columns=["blur_score", "brightness", "green_ratio", "issues"], index=batch.index)
        yield pd.concat([batch[["path", "width", "height"]], measured], axis=1)


def dataset_summary(raw: DataFrame, clean: DataFrame, rejected: DataFrame, manifest: DataFrame) -> DataFrame:
    """kind, name and counts: files of each class, of each reason for a rejection, and of each source's domain.

    ``raw`` and ``clean`` have class_label and image_id, ``rejected`` class_label and reason, as their folders say; ``manifest`` has
    image_id, source_domain and license_note. A licence is missing if the note is null, blank or ``unknown``; a file
    that the manifest doesn't name has the domain null.
    """
    count = lambda rows, name: rows.groupBy("class_label").agg(F.count("*").alias(name))
    classes = count(raw, "raw").join(count(clean, "clean"), "class_label", "full").join(count(rejected, "rejected"), "class_label", "full")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    none = F.lit(0).cast("long")
    by_class = classes.select(F.lit("class").alias("kind"), F.col("class_label").alias("name"), zero("raw"), zero("clean"), zero("rejected"), none.alias("missing_licence"))
    reasons = rejected.groupBy("reason").agg(F.count("*").alias("rejected"))
    by_reason = reasons.select(F.lit("reason").alias("kind"), F.col("reason").alias("name"), none.alias("raw"), none.alias("clean"), "rejected", none.alias("missing_licence"))
    named = raw.join(manifest.select("image_id", "source_domain", "license_note"), "image_id", "left")
    missing = F.count_if(F.lower(F.trim(F.coalesce("license_note", F.lit("")))).isin("", "unknown"))
    domains = named.groupBy("source_domain").agg(F.count("*").alias("raw"), missing.alias("missing_licence"))
    by_domain = domains.select(F.lit("domain").alias("kind"), F.col("source_domain").alias("name"), "raw", none.alias("clean"), none.alias("rejected"), "missing_licence")
    return by_class.unionByName(by_reason).unionByName(by_domain)
