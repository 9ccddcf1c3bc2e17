"""Image files: bytes that come back, metrics by definition, listings by folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.folds import image_quality_stack
from granary.sources import images as I


def test_metrics_by_definition():
    r = np.random.default_rng(4)
    stack = r.integers(0, 256, (3, 9, 12, 3), dtype=np.uint8)
    for pixels, got in zip(stack, image_quality_stack(stack), strict=True):
        blue, green, red = (pixels[..., c].astype(int) for c in range(3))
        gray = np.round(0.299 * red + 0.587 * green + 0.114 * blue)
        values = []
        for y in range(9):
            for x in range(12):
                at = lambda i, j: gray[abs(i) if i < 9 else 16 - i, abs(j) if j < 12 else 22 - j]  # noqa: E731  mirrored at the border
                values.append(at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * gray[y, x])
        leaf = np.mean([(g > q + 8) and (g > b + 8) and (g > 45) for q, g, b in zip(red.ravel(), green.ravel(), blue.ravel())])
        assert got[:3] == (pytest.approx(np.var(values), abs=0.01), pytest.approx(gray.mean(), abs=0.01), pytest.approx(leaf, abs=0.001))
        assert got[3][0] == "too_small"


def test_files_come_back(spark, tmp_path):
    leaf = np.full((320, 330, 3), (40, 200, 40), np.uint8)
    r = np.random.default_rng(1)
    noise = r.integers(0, 255, (400, 340, 3), dtype=np.uint8)
    rows = spark.createDataFrame([("rust", 1, I.png(leaf)), ("rust", 2, I.png(noise)), ("a b/ü", 3, b"no image")], "class_label string, image_id long, content binary")
    I.write_files(rows, str(tmp_path / "files"), "content", "class_label", "image_id")
    got = {int(r.i): r for r in I.read_images(spark, str(tmp_path / "files")).withColumn("i", I.folder(F.col("path"), "image_id")).collect()}
    assert (got[1].width, got[1].height, got[1].green_ratio, got[1].issues) == (330, 320, 1.0, ["blurred"])
    assert got[1].brightness == pytest.approx(0.299 * 40 + 0.587 * 200 + 0.114 * 40, abs=0.5)
    assert (got[2].width, got[2].height) == (340, 400) and "blurred" not in got[2].issues
    assert got[3].issues == ["unreadable"]
    listed = I.list_files(spark, str(tmp_path / "files"), "class_label", "image_id").collect()
    assert sorted((r.class_label, r.image_id) for r in listed) == [("a b/ü", "3"), ("rust", "1"), ("rust", "2")]
    assert next(r.length for r in listed if r.image_id == "1") == len(I.png(leaf)) + 1
    assert I.list_files(spark, str(tmp_path / "nothing"), "class_label").collect() == []


def test_summary(spark):
    raw = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("b", "9")], "class_label string, image_id string")
    clean = raw.where("image_id = '1'")
    rejected = spark.createDataFrame([("a", "blurred"), ("c", "blurred")], "class_label string, reason string")
    manifest = spark.createDataFrame([("1", "x.org", "CC BY"), ("2", "x.org", None), ("3", "y.org", " UNKNOWN ")], "image_id string, source_domain string, license_note string")
    got = sorted(map(tuple, I.dataset_summary(raw, clean, rejected, manifest).collect()), key=str)
    assert got == sorted([("class", "a", 2, 1, 1, 0), ("class", "b", 2, 0, 0, 0), ("class", "c", 0, 0, 1, 0), ("reason", "blurred", 0, 0, 2, 0), ("domain", "x.org", 2, 0, 0, 1), ("domain", "y.org", 1, 0, 0, 1), ("domain", None, 1, 0, 0, 1)], key=str)
