"""The given tables as the entities that the jobs work on, in Spark and in SQL.

``documents`` are raw sources: host, title, reliability and version follow from the id by fixed
rules, so that every branch of the policies is met; one in nine counts as cut down by cleaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import sql as S

HOSTS = ("khuyennongvn.gov.vn", "vov.vn", "shopee.vn", "facebook.com", "blog.example.com", "news.example.org", "khoa.edu.vn", "fao.org")
TITLES = (
    "Bón phân và tưới nước cho cà phê", "Bệnh vàng lá, rệp sáp hại cây", "Thu hoạch trái chín tại Gia Lai", "Chọn giống TR4 tái canh ở Đắk Lắk",
    "Hotline công ty TNHH phân bón", "Kinh nghiệm tổng quan", "Địa hình và thổ nhưỡng vùng trồng", "Tỉa cành tạo tán, chi phí năng suất",
    "Untitled", "Ghép cải tạo vườn già",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values, n: str) -> str:
    return f"list_extract({S.listed(values)}, CAST({n} % {len(values)} AS INT) + 1)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        d.cast("string").alias("source_id"),
        pick(TITLES, d).alias("title"),
        F.concat(F.lit("https://www."), pick(HOSTS, d), F.lit("/"), "source", F.lit("/"), d.cast("string")).alias("url"),
        F.when(d % 11 == 0, "manual").when(d % 7 == 0, "internet").alias("reliability_level"),
        F.col("text").alias("raw_text"),
        F.when(d % 9 == 0, F.substring("text", 1, 60)).otherwise(F.col("text")).alias("cleaned_text"),
        F.col("source").alias("host_group"),
        "n_chars",
    )


SOURCES = f"""s AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS source_id, {pick_sql(TITLES, 'doc_id')} AS title,
    'https://www.' || {pick_sql(HOSTS, 'doc_id')} || '/' || source || '/' || doc_id AS url,
    CASE WHEN doc_id % 11 = 0 THEN 'manual' WHEN doc_id % 7 = 0 THEN 'internet' END AS reliability_level,
    text AS raw_text, CASE WHEN doc_id % 9 = 0 THEN substr(text, 1, 60) ELSE text END AS cleaned_text,
    source AS host_group, n_chars
  FROM documents
)"""
