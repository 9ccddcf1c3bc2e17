"""Request logs, events and crawls: latency, rate limits, ring buffers, erasure, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.shared import stored


def percentiles(samples: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of each key, with linear interpolation.

    Different values are counted and dealt by range, so that each task ranks a part of a key's values; a
    hot key is spread. Only the sizes of the parts meet.
    """
    counted = samples.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    parts = stored(counted.repartitionByRange(key, "v").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy(key, "part").agg(F.sum("n").alias("size"))
    order = Window.partitionBy(key).orderBy("part")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"before": before, "all": F.sum("size").over(Window.partitionBy(key))})
    within = Window.partitionBy(key, "part").orderBy("v")
    sizes = sizes.select(F.col(key).alias("__key"), F.col("part").alias("__part"), "before", "all")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("part") == F.col("__part"))
    ranked = parts.withColumn("stop", F.sum("n").over(within)).join(sizes, same).withColumn("stop", F.col("stop") + F.col("before"))
    holds = lambda place: (F.col("stop") - F.col("n") <= place) & (place < F.col("stop"))
    found = []
    for name, share in shares.items():
        at = (F.col("all") - 1) * share
        found += [F.max(F.when(holds(F.floor(at)), F.col("v"))).alias(f"{name}_low"), F.max(F.when(holds(F.ceil(at)), F.col("v"))).alias(f"{name}_high"), F.max(at - F.floor(at)).alias(f"{name}_rest")]
    rows = ranked.groupBy(key).agg(*found)
    return rows.select(key, *[(F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * F.col(f"{k}_rest")).alias(k) for k in shares])


def latency_report(samples: DataFrame, key: str, ms: str) -> DataFrame:
    """Count, exact p50 and p95 (linear interpolation) and maximum for each key and for ``*``, all."""
    twice = samples.select(F.explode(F.array(F.col(key), F.lit("*"))).alias(key), F.col(ms).alias(ms))
    counts = twice.groupBy(key).agg(F.count("*").alias("n"), F.max(ms).alias("max"))
    ranks = percentiles(twice, key, ms, {"p50": 0.5, "p95": 0.95}).withColumnRenamed(key, "__key")
    joined = counts.join(ranks, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.select(key, "n", F.round("p50", 2).alias("p50"), F.round("p95", 2).alias("p95"), "max")


def ring_buffer(log: DataFrame, stream: str, at: str, tie: str, n: int) -> DataFrame:
    """The newest n rows of each stream; ranking prunes before the shuffle."""
    order = Window.partitionBy(stream).orderBy(F.desc(at), F.desc(tie))
    return log.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def recent(log: DataFrame, at: str, tie: str, n: int, most: int = 500) -> DataFrame:
    return log.orderBy(F.desc(at), F.desc(tie)).limit(max(1, min(n, most)))


def over_limit(log: DataFrame, key: str, at: str, limit: int, span: str = "1 minute") -> DataFrame:
    """Requests beyond the budget of each key and window."""
    counted = log.groupBy(key, F.window(at, span).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return counted.select(key, F.col("w.start").alias("start"), "n", (F.col("n") - limit).alias("rejected"))


def erase_sessions(log: DataFrame, sessions: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """The log without the sessions, and one audit row for each of them: a hash and a count, never the id."""
    kept = log.join(sessions, session, "left_anti")
    gone = log.join(sessions, session, "left_semi").groupBy(session).agg(F.count("*").alias("erased"))
    return kept, gone.select(F.substring(F.sha2(F.col(session).cast("string").cast("binary"), 256), 1, 12).alias("session_hash"), "erased")


def progress(events: DataFrame, run: str, kind: str, key: str, done: tuple[str, ...], planned: Column) -> DataFrame:
    """Distinct keys of each kind and the share of planned work that is over, for each run."""
    per = events.groupBy(run).pivot(kind, list(done)).agg(F.count_distinct(key))
    total = sum(F.coalesce(F.col(k), F.lit(0)) for k in done)
    processed = F.least(total, planned)
    return per.select(run, *[F.coalesce(k, F.lit(0)).alias(k) for k in done], processed.alias("processed"), F.round(processed * 100 / planned, 1).alias("percent"))


def best_per_key(rows: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """The row with the highest score of each key, the first one among equals; an aggregate, so no window is sorted."""
    others = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(seq)))
    return rows.groupBy(key).agg(best.alias("b")).select(key, *[F.col(f"b.{c}").alias(c) for c in others])


def first_seen(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Distinct keys in order of their first place."""
    return rows.groupBy(key).agg(F.min(place).alias(place))


def within_budget(rows: DataFrame, group: str, key: str, variant: str, target: int) -> DataFrame:
    """Variants are used in order, only while fewer than ``target`` distinct keys were found before."""
    first = rows.groupBy(group, key).agg(F.min(variant).alias(variant))
    new = first.groupBy(group, variant).agg(F.count("*").alias("new"))
    every = rows.select(group, variant).distinct().join(new, [group, variant], "left").fillna(0, ["new"])
    before = F.coalesce(F.sum("new").over(Window.partitionBy(group).orderBy(variant).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return every.withColumn("before", before).where(F.col("before") < target)
