"""Image files of every kind by the fast ways and by Spark's own: the same folders, pixels and measures."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.plans import images as P
from granary.sources import images as I


def png(pixels, kinds=(0,), colour=2, extra=b""):
    """A PNG file with the given filters of its lines, one after the other."""
    height, width = pixels.shape[:2]
    lines, before = [], np.zeros_like(pixels[0])
    for y, line in enumerate(pixels):
        kind = kinds[y % len(kinds)]
        left = np.concatenate([np.zeros_like(line[:1]), line[:-1]])
        lines.append(bytes([kind]) + (line - {0: 0, 1: left, 2: before, 3: ((left.astype(int) + before) // 2).astype(np.uint8)}[kind]).astype(np.uint8).tobytes())
        before = line
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    body = zlib.compress(b"".join(lines))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + extra + part(b"IDAT", body[:9]) + part(b"IDAT", body[9:]) + part(b"IEND", b"")


@pytest.fixture
def noise():
    return np.random.default_rng(8).integers(0, 256, (33, 41, 3), dtype=np.uint8)


@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (0, 1, 2, 2, 1)])
def test_pixels_come_back(noise, kinds):
    assert (I.png_pixels(png(noise, kinds) + b"\n")[..., ::-1] == noise).all()


def test_other_files_are_left_to_the_image_source(noise):
    whole = png(noise)
    broken = bytearray(whole)
    broken[60] ^= 1
    for data in (b"", b"no image", whole[:-5], whole[:50], bytes(broken), png(noise, (0, 3)), png(noise[..., 0], colour=0), png(noise, extra=struct.pack(">I", 4) + b"gAMA" + b"\0\1\2\3" + struct.pack(">I", zlib.crc32(b"gAMA\0\1\2\3")))):
        assert I.png_pixels(data) is None


def test_kinds_of_files_together(spark, tmp_path, noise):
    """Files that are decoded here and in the image source have the measures of their pixels, whatever their folder is called."""
    kinds = {1: png(noise), 2: png(noise, (1, 2)), 3: png(noise, (0, 3)), 4: png(noise)[:-30], 5: b"", 6: None}
    rows = spark.createDataFrame([(f"a+b %{n}/ü=", n, c) for n, c in kinds.items()], "class_label string, image_id long, content binary")
    I.write_files(rows, str(tmp_path / "in"), "content", "class_label", "image_id")
    got = {int(r.i): r for r in I.read_images(spark, str(tmp_path / "in")).withColumn("i", I.folder(F.col("path"), "image_id")).withColumn("c", I.folder(F.col("path"), "class_label")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and all(r.c == f"a+b %{n}/ü=" for n, r in got.items())
    measures = {(got[n].width, got[n].height, got[n].blur_score, got[n].brightness, got[n].green_ratio) for n in (1, 2, 3)}
    assert len(measures) == 1 and measures.pop()[:2] == (41, 33)
    assert got[5].issues == got[6].issues == ["unreadable"]


def test_folders_as_spark_names_them(spark, tmp_path):
    values = [None, "", " ", "plain", "a b/ü", "".join(map(chr, range(1, 128))), "x.y", "%41"]
    rows = spark.createDataFrame([(v, i, b"1") for i, v in enumerate(values)] + [("twice", 99, b"2"), ("twice", 99, None)], "a string, b long, content binary")
    I.write_files(rows, f"file://{tmp_path}/own", "content", "a", "b")
    I.write_text(rows, f"file://{tmp_path}/spark", "content", "a", "b")
    tree = lambda top: sorted((os.path.relpath(d, top), open(f"{d}/{n}", "rb").read()) for d, _, names in os.walk(top) for n in names if n.startswith("part-"))
    assert tree(tmp_path / "own") == tree(tmp_path / "spark") and len(tree(tmp_path / "own")) == 10
    assert not [n for _, _, names in os.walk(tmp_path / "own") for n in names if not n.startswith("part-")]


def tasks_of(spark, run):
    """Tasks of each stage that ``run`` started."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group := f"tasks {id(run)}", "")
    try:
        run()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_listing_has_no_task_for_each_folder(spark, tmp_path):
    rows = spark.range(600).select(F.lit("c").alias("class_label"), F.col("id").alias("image_id"), F.lit(I.png(np.zeros((2, 2, 3)))).alias("content"))
    I.write_files(rows, str(tmp_path / "in"), "content", "class_label", "image_id")
    most = max(32, 4 * spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")  # two files a part
    try:
        assert max(tasks_of(spark, lambda: I.list_files(spark, str(tmp_path / "in"), "image_id").collect())) <= most
        assert max(tasks_of(spark, lambda: I.read_images(spark, str(tmp_path / "in")).collect())) <= most
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_summary_lists_and_reads_few_times(spark):
    """Pictures in 500 folders, of which each listing or reading with a task a folder would be 500 tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        assert sum(tasks_of(spark, lambda: P.q_summary(spark, "/root/testdata/sf0.001").collect())) < 1500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_picture_without_tiles_follows_from_remainders():
    values = np.random.default_rng(2).normal(size=64)
    for n in (*range(60), 420, 427, 1_000_002, 10**12 + 6):
        assert P.picture_file(n, values) == I.png(P.picture(n, values))
