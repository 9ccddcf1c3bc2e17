"""Quality gate at ingest and quality report of sources: two formulas, kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.config import POLICY, Policy
from granary.functions.text import duplicate_line_ratio, flags, noise_line_ratio, signal_ratio
from granary.sources import policy as P


def _shrunk(raw: Column, cleaned: Column) -> Column:
    return (F.length(raw) > 0) & (F.length(cleaned) / F.length(raw) < 0.15)


def _reliability_penalty(level: Column, policy: Policy) -> Column:
    by = policy.reliability_penalty
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in by.items()], F.lit(by["internet"]))


def indexing_warnings(title, url, raw, cleaned, policy: Policy = POLICY) -> Column:
    own = [("cleaned_text_too_short", F.length(cleaned) < 500), ("too_much_text_removed", _shrunk(raw, cleaned))]
    return flags(own + P.source_warning_pairs(title, url, cleaned, policy))


def indexing_quality_score(level, raw, cleaned, warnings, policy: Policy = POLICY) -> Column:
    score = (
        1.0
        - _reliability_penalty(level, policy)
        - F.least(F.lit(0.5), F.size(warnings) * 0.08)
        - F.when(F.length(cleaned) < 500, 0.18).otherwise(0.0)
        - F.when(_shrunk(raw, cleaned), 0.12).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9)  # sums of decimals, not of their binary errors


def review(level: Column, score: Column, warnings: Column, policy: Policy = POLICY) -> dict[str, Column]:
    """review_status, indexing_status, decision_reason and blocking_warnings."""
    blocking = F.filter(warnings, lambda w: w.isin(*policy.critical))
    passed = (score >= policy.min_quality) & (F.size(blocking) == 0)
    manual, trusted = passed & (level == "manual"), passed & level.isin("official", "semi_official")
    bad = (score < 0.25) | (F.size(blocking) >= 3)
    ok = manual | trusted
    return {
        "review_status": F.when(ok, "approved").when(bad, "rejected").otherwise("needs_review"),
        "indexing_status": F.when(ok, "indexed").when(bad, "blocked").otherwise("held_for_review"),
        "decision_reason": F.when(manual, "manual source passed quality gate")
        .when(trusted, "trusted source passed quality gate")
        .when(bad, "critical quality/reliability risk")
        .otherwise("source needs human review before indexing"),
        "blocking_warnings": blocking,
    }


def gate(sources: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Warnings, quality score and decision of each source, in one pass over its row."""
    title, url, raw, cleaned = (F.col(c) for c in ("title", "url", "raw_text", "cleaned_text"))
    level = P.infer_reliability(url, F.col("reliability_level"), policy)
    scored = sources.withColumn("warnings", indexing_warnings(title, url, raw, cleaned, policy)).withColumn(
        "quality_score", indexing_quality_score(F.col("reliability_level"), raw, cleaned, F.col("warnings"), policy)
    )
    return scored.withColumns(review(level, F.col("quality_score"), F.col("warnings"), policy))


#: Characters at the beginning of a source, and its length, that the rules look at.
_HEAD, _LONG = 1200, 2000


def _beginnings(chunks: DataFrame) -> DataFrame:
    """source_id and ``head``: the first characters of its chunks, joined by line breaks; few chunks of each source are grouped."""
    order = Window.partitionBy("source_id").orderBy("ordinal")
    before = F.coalesce(F.sum(F.length("part") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = chunks.select("source_id", "ordinal", F.substring(F.coalesce("text", F.lit("")), 1, _HEAD).alias("part"))
    # a chunk and its line break are one character at least, so no more chunks than characters matter
    few = parts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= _HEAD).withColumn("before", before).where(F.col("before") < _HEAD)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "part")))
    joined = F.array_join(F.transform(ordered, lambda x: x["part"]), "\n")
    return few.groupBy("source_id").agg(F.substring(joined, 1, _HEAD).alias("head"))


def rebuild_gate(sources: DataFrame, chunks: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """source_id, review_status, indexing_status, chunk_count and quality_score (where it was worked out) of each source, for a rebuild of the index.

    The first chunk's stored decision holds; where it has none, the source's chunks are judged anew, as if nothing had
    been removed from them. A source without chunks is held. ``chunks`` has source_id, ordinal, text, title, url,
    reliability_level, review_status and indexing_status.
    """
    meta = F.struct("title", "url", "reliability_level", "review_status", "indexing_status")
    length = F.length(F.coalesce("text", F.lit("")))
    first = chunks.groupBy("source_id").agg(F.min_by(meta, "ordinal").alias("f"), F.sum(length).alias("chars"), F.count("*").alias("chunk_count"))
    rows = sources.select("source_id").distinct().join(first, "source_id", "left")
    is_ = lambda status, review_: F.coalesce(F.col("f.indexing_status") == status, F.lit(False)) | F.coalesce(F.col("f.review_status") == review_, F.lit(False))
    known = [("indexed", "approved"), ("blocked", "rejected"), ("held_for_review", "needs_review")]
    stored_ = F.coalesce(*[F.when(is_(i, r), F.struct(F.lit(r).alias("review_status"), F.lit(i).alias("indexing_status"))) for i, r in known])
    held = F.struct(F.lit("needs_review").alias("review_status"), F.lit("held_for_review").alias("indexing_status"))
    rows = rows.withColumn("stored", F.when(F.col("f").isNull(), held).otherwise(stored_))
    open_ = rows.where(F.col("stored").isNull()).select("source_id", "f", "chars", "chunk_count")
    heads = _beginnings(chunks.join(open_.select("source_id"), "source_id", "left_semi"))
    # the rules see the beginning and how long it goes on
    total = F.least(F.lit(_LONG), F.col("chars") + F.col("chunk_count") - 1).cast("int")
    text = F.when(total > F.length("head"), F.rpad("head", total, F.lit(" "))).otherwise(F.col("head"))
    again = open_.join(heads, "source_id").select(
        "source_id", F.col("f.title").alias("title"), F.col("f.url").alias("url"), F.col("f.reliability_level").alias("reliability_level"), F.lit("").alias("raw_text"), text.alias("cleaned_text")
    )
    judged = gate(again, policy).select("source_id", F.col("review_status").alias("new_review"), F.col("indexing_status").alias("new_indexing"), "quality_score")
    return rows.join(judged, "source_id", "left").select(
        "source_id",
        F.coalesce("stored.review_status", "new_review").alias("review_status"),
        F.coalesce("stored.indexing_status", "new_indexing").alias("indexing_status"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.round("quality_score", 3).alias("quality_score"),
    )


def rebuild_union(chunks: DataFrame, decided: DataFrame) -> DataFrame:
    """All chunks of the sources that are indexed, with the decision on their source."""
    indexed = decided.where("indexing_status = 'indexed'").select("source_id", "review_status", "indexing_status", "quality_score")
    return chunks.drop("review_status", "indexing_status", "quality_score").join(indexed, "source_id")


def source_quality(sources: DataFrame, *also: str, policy: Policy = POLICY) -> DataFrame:
    """Report row of each source; ``sources`` has chunk_count and avg_chunk_chars, null without chunks. ``also`` names columns to keep."""
    title, url, raw, cleaned = (F.col(c) for c in ("title", "url", "raw_text", "cleaned_text"))
    ratios = sources.withColumns(
        {
            "level": P.infer_reliability(url, F.col("reliability_level"), policy),
            "duplicate_line_ratio": duplicate_line_ratio(cleaned),
            "noise_line_ratio": noise_line_ratio(cleaned),
            "vietnamese_signal_ratio": signal_ratio(cleaned),
        }
    )
    own = [
        ("cleaned_text_too_short", F.length(cleaned) < 500),
        ("too_much_text_removed", _shrunk(raw, cleaned)),
        ("possible_boilerplate_or_marketing_noise", F.col("noise_line_ratio") > 0.18),
        ("high_duplicate_lines", F.col("duplicate_line_ratio") > 0.16),
        ("chunks_too_small", F.col("avg_chunk_chars") < 350),
        ("missing_source_locator", F.coalesce(url, F.lit("")) == ""),
        ("internet_source_needs_review", F.col("level") == "internet"),
    ]
    warned = ratios.withColumn("warnings", flags(own + P.source_warning_pairs(title, url, cleaned, policy)))
    score = (
        1.0
        - _reliability_penalty(F.col("level"), policy)
        - F.least(F.lit(0.45), F.size("warnings") * 0.07)
        - F.least(F.lit(0.2), F.col("noise_line_ratio"))
        - F.least(F.lit(0.2), F.col("duplicate_line_ratio"))
        - P.source_penalty(F.col("warnings"), policy)
    )
    scored = warned.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), score), 9))
    return scored.withColumns(review(F.col("level"), F.col("quality_score"), F.col("warnings"), policy)).select(
        "source_id", "title", "url", F.col("level").alias("reliability_level"),
        F.length(raw).alias("raw_char_count"), F.length(cleaned).alias("cleaned_char_count"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.round(F.coalesce("avg_chunk_chars", F.lit(0.0)), 1).alias("avg_chunk_chars"),
        "duplicate_line_ratio", "noise_line_ratio", "vietnamese_signal_ratio", "quality_score", "warnings",
        "review_status", "indexing_status", "decision_reason", *also,
    )


def warning_counts(report: DataFrame) -> DataFrame:
    return report.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def quality_summary(report: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Counts by each property, in long form, with chunk sums and the mean score.

    With the chunks of the search index (source_id; without samples) there are rows of the property ``index``: how many chunks it
    has, how many may be in it, and how far these are apart.
    """
    names = ("reliability_level", "source_type", "review_status", "indexing_status")
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    typed = report if "source_type" in report.columns else report.withColumn("source_type", P.source_type(F.col("url")))
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("property"), known(c).alias("value")) for c in names]))
    counts = (
        typed.select(parts.alias("p"), "chunk_count", "quality_score")
        .groupBy(F.col("p.property").alias("property"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("n"), F.sum("chunk_count").alias("chunks"), F.round(F.avg("quality_score"), 3).alias("mean_score"))
    )
    if index is None:
        return counts
    none = F.lit(0).cast("long")
    there = index.agg(F.count("*").alias("there")).select("there", none.alias("allowed"))
    allowed = report.agg(F.sum(F.when(F.col("indexing_status") == "indexed", F.col("chunk_count"))).alias("allowed")).select(none.alias("there"), "allowed")
    both = there.unionByName(allowed).agg(F.sum("there").alias("there"), F.coalesce(F.sum("allowed"), F.lit(0)).alias("allowed"))
    rows = F.explode(
        F.array(
            F.struct(F.lit("vector_chunk_count").alias("value"), F.col("there").alias("n")),
            F.struct(F.lit("chunks_indexable").alias("value"), F.col("allowed").alias("n")),
            F.struct(F.lit("real_index_drift").alias("value"), F.abs(F.col("allowed") - F.col("there")).alias("n")),
        )
    )
    drift = both.select(rows.alias("r")).select(F.lit("index").alias("property"), "r.value", "r.n", F.lit(None).cast("long").alias("chunks"), F.lit(None).cast("double").alias("mean_score"))
    return counts.unionByName(drift)


#: Steps of a source on its way into the index, and the report's column that says whether it is done.
STEPS = (("raw", "raw_char_count"), ("clean", "cleaned_char_count"), ("chunk", "chunk_count"), ("index", "chunk_count"))


def source_progress(report: DataFrame) -> DataFrame:
    """source_id, the steps that are done, and their percentage."""
    done = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.lit(name)) for name, c in STEPS]))
    return report.select("source_id", F.array_join(done, ",").alias("done"), F.round(F.size(done) * 100 / len(STEPS)).cast("int").alias("percent"))


def source_views(report: DataFrame, most: int = 18) -> DataFrame:
    """view, place and source_id of the first sources under each of the dashboard's filters, the worst first.

    Filters: all, warnings, each review status and each level of reliability. A row goes to its filters within
    one pass; ranking prunes before the shuffle.
    """
    views = F.array_compact(F.array(F.lit("all"), F.when(F.size("warnings") > 0, "warnings"), F.col("review_status"), F.col("reliability_level")))
    rows = report.select(F.explode(views).alias("view"), "source_id", F.round("quality_score", 4).alias("score"), "cleaned_char_count")
    order = Window.partitionBy("view").orderBy("score", F.desc("cleaned_char_count"), "source_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("view", "place", "source_id")
