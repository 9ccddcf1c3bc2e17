"""Structured Streaming twins of the logs: new documents, latency, rate limits, crawl progress.

Windows leave the state when the watermark has passed them; rows later than the watermark are dropped and
counted (``late_rows``). Crawl progress keeps the keys of its runs until a run has been idle for a given time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.functions.text import content_hash


def new_hashes(arriving: DataFrame, at: str = "crawled_at", horizon: str = "1 day") -> DataFrame:
    """Arriving documents without those whose content was seen within the horizon."""
    hashed = arriving.withColumn("content_hash", content_hash(F.col("raw_text")))
    return hashed.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["content_hash"])


def ingest(arriving: DataFrame, store: str, checkpoint: str, at: str = "crawled_at"):
    """Write what is new to the store as well: each micro-batch is checked against it, by content and by source."""

    def write(batch: DataFrame, _: int) -> None:
        # a batch is read once: which of several copies it keeps may differ from one reading to the next
        try:
            known = batch.sparkSession.read.parquet(store).select("source_id", "content_hash")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
        else:
            contents = known.select(F.col("content_hash").alias("known_hash")).distinct()
            batch = batch.join(contents, F.col("content_hash").eqNullSafe(F.col("known_hash")), "left_anti").join(known.select("source_id").distinct(), "source_id", "left_anti")
        batch.write.mode("append").parquet(store)

    return new_hashes(arriving, at).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


#: Values that a latency sketch keeps on its largest level, and the rank error that it stays below: more than three
#: times what 99 of 100 sketches of that size stay below.
SKETCH_VALUES = 800
RANK_ERROR = 0.02


def latency(
    requests: DataFrame, route: str = "event_type", ms: str = "value", at: str = "ts", span: str = "5 minutes", late: str = "10 minutes",
    request: str | None = None,
) -> DataFrame:
    """Count, p50, p95, maximum and a mergeable sketch of each route and window, once the watermark has passed the window.

    With a ``request`` column a request that is delivered again within the watermark counts once, and
    late rows (by the watermark of the batch before) are dropped, and counted, one by one. Percentiles are those of a rank that is off by RANK_ERROR at most.
    Rows without a duration count in n only.
    """
    rows = requests.withWatermark(at, late)
    if request:
        rows = rows.dropDuplicatesWithinWatermark([request])
    value = F.col(ms).cast("double")
    windows = rows.groupBy(F.window(at, span).alias("w"), route).agg(
        F.count("*").alias("n"), F.count(value).alias("timed"), F.kll_sketch_agg_double(value, SKETCH_VALUES).alias("sketch"), F.max(value).alias("max")
    )
    return windows.select(F.col("w.start").alias("start"), route, "n", "timed", "sketch", *_quantiles(), "max")


def _quantiles() -> list:
    of = lambda share: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share)))
    return [of(0.5).alias("p50"), of(0.95).alias("p95")]


def merged_latency(windows: DataFrame, *by: str) -> DataFrame:
    """The report over several windows, from their sketches; the rank error stays what it is."""
    merged = windows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("timed").alias("timed"), F.kll_merge_agg_double("sketch").alias("sketch"), F.max("max").alias("max"))
    return merged.select(*by, "n", "timed", "sketch", *_quantiles(), "max")


def late_rows(query, seen: dict[tuple[int, int], int]) -> int:
    """Rows dropped as too late so far. ``seen`` carries the counts of batches from call to call: a query remembers its last hundred."""
    for progress in query.recentProgress:
        for nth, operator in enumerate(progress["stateOperators"]):
            seen[progress["batchId"], nth] = operator["numRowsDroppedByWatermark"]
    return sum(seen.values())


def over_limit(requests: DataFrame, limit: int, key: str = "user_id", at: str = "ts", span: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    counted = requests.withWatermark(at, late).groupBy(F.window(at, span).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(F.col("w.start").alias("start"), key, "n", (F.col("n") - limit).alias("rejected"))


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Parts of a run and kind, so that one that holds most keys is spread.
PROGRESS_PARTS = 32


class _Keys(StatefulProcessor):
    """The keys of one part of a run and kind, and how many there are."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", "key string", "seen boolean")
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, newest = (self.n.get() or (0,))[0], 0
        for part in rows:
            for one in part["key"].dropna().unique():
                if not self.keys.containsKey((one,)):
                    self.keys.updateValue((one,), (True,))
                    n += 1
            newest = max(newest, int(part["at_ms"].max()))
        self.n.update((n,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield self._row(key, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = (self.n.get() or (0,))[0]
        self.keys.clear()
        self.n.clear()
        yield self._row(key, n, True)

    @staticmethod
    def _row(key, n: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]], "kind": [key[1]], "part": [key[2]], "n": [n], "closed": [closed]})

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the state store on disk with incremental checkpoints."""
    if not spark.conf.get(_STATE_STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def crawl_progress(events: DataFrame, run: str, kind: str, key: str, at: str = "ts", late: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """Updates of the distinct keys of each run and kind: run, kind, part, n and closed.

    A key counts once, however many batches lie between its events. ``total_progress`` adds up the parts. With
    ``idle_ms`` the keys of a part are let go when the watermark has passed its newest event by so much; its last row is
    marked closed, and a run that goes on after that begins anew. Null keys don't count.
    """
    keyed_state(events.sparkSession)
    rows = events.withWatermark(at, late) if idle_ms is not None else events
    rows = rows.select(
        F.col(run).cast("string").alias("run"),
        F.col(kind).cast("string").alias("kind"),
        F.pmod(F.xxhash64(key), F.lit(PROGRESS_PARTS)).cast("int").alias("part"),
        F.col(key).cast("string").alias("key"),
        F.unix_millis(F.col(at)).alias("at_ms"),
        at,
    )
    return rows.groupBy("run", "kind", "part").transformWithStateInPandas(
        _Keys(idle_ms), "run string, kind string, part int, n long, closed boolean", "update", "none" if idle_ms is None else "eventTime"
    )


def total_progress(updates: DataFrame) -> DataFrame:
    """n of each run and kind, from all updates so far: counts of a part only rise."""
    latest = updates.groupBy("run", "kind", "part").agg(F.max("n").alias("n"))
    return latest.groupBy("run", "kind").agg(F.sum("n").alias("n"))
