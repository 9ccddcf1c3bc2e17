"""Queries that write the rows of ``embeddings`` as image files and work on the files.

A vector's values are the tiles of a picture; size, light, colour and sharpness follow from the id, so that
every rule of the image gate is met.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.plans.tables import HOSTS, pick, pick_sql, read
from granary.sources import images as I
from granary.sources.shared import new_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@lru_cache
def _pattern(side: int) -> np.ndarray:
    return np.where(np.indices((side, side)).sum(0) % 2, 10, -10).astype(np.int16)


def picture(n: int, values) -> np.ndarray:
    """RGB pixels: eight by eight tiles around a level, with a fine pattern; flat for every sixth id, grey for every fourth."""
    side = 240 if n % 5 == 0 else 320
    level = {0: 20, 1: 235}.get(n % 7)
    tiles = np.full(64, level or 120) if level or n % 6 == 0 else 120 + np.clip(np.floor(20 * np.asarray(values, float)[:64]), -40, 40)
    gray = tiles.astype(np.int16).reshape(8, 8).repeat(side // 8, 0).repeat(side // 8, 1)
    if n % 6:
        gray += _pattern(side)
    rgb = np.empty((side, side, 3), np.uint8)
    rgb[..., 0] = rgb[..., 2] = gray
    rgb[..., 1] = gray if n % 4 == 0 else np.minimum(255, gray + 40)
    return rgb


@lru_cache(420)
def _without_tiles(n: int) -> bytes:
    return I.png(picture(n, None))


def picture_file(n: int, values) -> bytes:
    """The picture as a PNG file. Without tiles it follows from the remainders of the id alone."""
    return _without_tiles(n % 420) if n % 7 < 2 or n % 6 == 0 else I.png(picture(n, values))


@F.pandas_udf(T.BinaryType())
def _png(ids: pd.Series, vectors: pd.Series) -> pd.Series:
    return pd.Series([picture_file(int(n), v) for n, v in zip(ids, vectors, strict=True)])


def _written(spark, sf):
    """Pictures of all rows, in folders of their class and id."""
    path = new_path(spark)
    rows = read(spark, sf, "embeddings").repartition(I.tasks(spark), "vec_id")
    rows = rows.select(F.col("label").alias("class_label"), F.col("vec_id").alias("image_id"), _png("vec_id", "embedding").alias("content"))
    I.write_files(rows, path, "content", "class_label", "image_id")
    return path


_LIT = "CASE WHEN vec_id % 7 = 0 THEN 20 WHEN vec_id % 7 = 1 THEN 235 END"
_PATTERN = "CASE WHEN vec_id % 6 = 0 THEN [0] ELSE [-10, 10] END"
_TILES = f"CASE WHEN {_LIT} IS NOT NULL THEN [{_LIT}] WHEN vec_id % 6 = 0 THEN [120] ELSE list_transform(embedding, lambda x: 120 + greatest(-40, least(40, floor(20 * CAST(x AS DOUBLE))))) END"
_GRAY = "list_avg(flatten(list_transform(tiles, lambda t: list_transform(pattern, lambda p: round(0.413 * (t + p) + 0.587 * CASE WHEN vec_id % 4 = 0 THEN t + p ELSE least(255, t + p + 40) END)))))"
_FIRST = "CASE WHEN vec_id % 5 = 0 THEN 'too_small' WHEN vec_id % 6 = 0 THEN 'blurred' WHEN vec_id % 7 = 0 THEN 'too_dark' WHEN vec_id % 7 = 1 THEN 'too_bright' WHEN vec_id % 4 = 0 THEN 'no_leaf' END"
_ISSUES = "array_to_string(list_filter([CASE WHEN vec_id % 5 = 0 THEN 'too_small' END, CASE WHEN vec_id % 6 = 0 THEN 'blurred' END, CASE WHEN vec_id % 7 = 0 THEN 'too_dark' END, CASE WHEN vec_id % 7 = 1 THEN 'too_bright' END, CASE WHEN vec_id % 4 = 0 THEN 'no_leaf' END], lambda x: x IS NOT NULL), ',')"


@query("read_images", f"SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 240 ELSE 320 END AS width, CASE WHEN vec_id % 5 = 0 THEN 240 ELSE 320 END AS height, CAST(floor({_GRAY}) AS BIGINT) AS brightness, CASE WHEN vec_id % 4 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS green_ratio, {_ISSUES} AS issues FROM (SELECT vec_id, {_TILES} AS tiles, {_PATTERN} AS pattern FROM embeddings)")
def q_read(spark, sf):
    rows = I.read_images(spark, _written(spark, sf))
    n = I.folder(F.col("path"), "image_id").cast("long")
    return rows.select(n.alias("vec_id"), "width", "height", F.floor("brightness").alias("brightness"), "green_ratio", F.array_join("issues", ",").alias("issues"))


_LICENCE = "CASE WHEN vec_id % 5 = 1 THEN NULL WHEN vec_id % 5 = 2 THEN ' ' WHEN vec_id % 5 = 3 THEN 'Unknown' ELSE 'CC BY' END"


@query("image_dataset_summary", f"""WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, {_FIRST} AS reason, {pick_sql(HOSTS, 'vec_id')} AS domain, vec_id % 5 IN (1, 2, 3) AS missing FROM embeddings)
SELECT 'class' AS kind, label AS name, count(*) AS raw, count(*) FILTER (reason IS NULL) AS clean, count(reason) AS rejected, 0 AS missing_licence FROM e GROUP BY label
UNION ALL SELECT 'reason', reason, 0, 0, count(*), 0 FROM e WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'domain', domain, count(*), 0, 0, count(*) FILTER (missing) FROM e GROUP BY domain""")
def q_summary(spark, sf):
    """Pictures are written, judged, and written again as clean or by the first reason against them; then the files are counted."""
    raw, verdicts = _written(spark, sf), new_path(spark)
    files = I.files_below(spark, raw)
    reasons = I.read_images(spark, raw, files).select("path", F.try_element_at("issues", F.lit(1)).alias("reason"))
    place = [I.folder(F.col("path"), n).alias(n) for n in ("class_label", "image_id")]
    judged = I.fewer_tasks(files.select("path", "content")).join(reasons, "path").select("content", F.coalesce("reason", F.lit("clean")).alias("verdict"), *place)
    I.write_files(judged, verdicts, "content", "verdict", "class_label", "image_id")
    note = F.expr(_LICENCE)
    manifest = read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), pick(HOSTS, F.col("vec_id")).alias("source_domain"), note.alias("license_note"))
    again = I.list_files(spark, verdicts, "verdict", "class_label", "image_id").withColumnRenamed("verdict", "reason")
    return I.dataset_summary(I.list_files(spark, raw, "class_label", "image_id", files=files), again.where("reason = 'clean'"), again.where("reason <> 'clean'"), manifest)
