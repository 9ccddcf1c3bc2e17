"""Classification by lexicon, coverage of topics and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import config
from granary.functions.text import fold, hits, once, squash, total


def _folded(term: str) -> str:
    import unicodedata

    marks = unicodedata.normalize("NFD", term.lower())
    return "".join(c for c in marks if unicodedata.category(c) != "Mn").replace("đ", "d")


FOLDED = {key: tuple(_folded(t) for t in terms) for key, (_, terms) in config.CATEGORIES.items()}


def classify(text: Column, categories=FOLDED, fallback: str = config.FALLBACK_CATEGORY) -> Column:
    """struct(category, confidence, n_terms): one hit a term, 1.5 more for each of several words; first category wins ties.

    All terms are tested within the row, without multiplying rows by terms.
    """
    return once(squash(fold(text)), lambda folded: _best(folded, categories, fallback))


def _best(folded: Column, categories, fallback: str) -> Column:
    def scored(place: int, key: str, terms) -> Column:
        # each term is looked for once: terms of several words count in the thousands
        found = total([F.when(F.contains(folded, F.lit(t)), 1001 if " " in t else 1).otherwise(0) for t in terms])
        return once(found, lambda n: F.struct(
            (n % 1000 + 1.5 * F.floor(n / 1000)).alias("score"), F.lit(-place).alias("order"), F.lit(key).alias("category"), (n % 1000).alias("n_terms")
        ))

    scores = [scored(place, key, terms) for place, (key, terms) in enumerate(categories.items())]
    return once(F.array_max(F.array(*scores)), lambda best: F.struct(
        F.when(best["score"] > 0, best["category"]).otherwise(fallback).alias("category"),
        F.round(F.least(F.lit(1.0), best["score"] / 4.0), 3).alias("confidence"),
        best["n_terms"].alias("n_terms"),
    ))


def coverage(sources: DataFrame, text: Column, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """topic, source and its matched terms, for sources with any; one row per pair that matches."""
    matched = F.array(*[F.struct(F.lit(k).alias("topic"), hits(F.lower(text), t).alias("terms")) for k, t in topics.items()])
    rows = sources.withColumn("m", F.explode(F.filter(matched, lambda m: F.size(m["terms"]) > 0)))
    return rows.withColumns({"topic": F.col("m.topic"), "terms": F.slice("m.terms", 1, 5)}).drop("m")


def coverage_report(matched: DataFrame, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row for every topic: sources, official ones, covered or gap."""
    spark = matched.sparkSession
    every = spark.createDataFrame([(k,) for k in topics], "topic string")
    counts = matched.groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.col("reliability_level") == "official").alias("official"))
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, "topic", "left").select(
        "topic", n.alias("n"), F.coalesce("official", F.lit(0)).alias("official"), F.when(n > 0, "covered").otherwise("gap").alias("status")
    )


def top_sources(matched: DataFrame, k: int = 4) -> DataFrame:
    """The best sources of each topic; ranking prunes within each partition before the shuffle."""
    order = Window.partitionBy("topic").orderBy(F.desc("quality_score"), "doc_id")
    return matched.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
