"""Streams over several batches: progress that counts a key once, windows that leave the state, late rows, sketches."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.plans.streams import drain
from granary.streaming import jobs

SCHEMA = "event_id long, ts timestamp, run long, kind string, page string, ms double"
BEGIN = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def folder(spark, tmp_path, files):
    """One file a batch, in this order."""
    path = tmp_path / "in"
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path / f"f{n:03}"))
    # file streams take the oldest files first
    import os

    for n in range(len(files)):
        for root, _, names in os.walk(path / f"f{n:03}"):
            for name in names:
                os.utime(os.path.join(root, name), (1_700_000_000 + 60 * n,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def events(n, days, seed=1):
    r = random.Random(seed)
    return [(i, BEGIN + dt.timedelta(seconds=r.randrange(days * 86400)), r.randrange(3), r.choice(("a", "b", None)), r.choice([None, *map(str, range(40))]), r.choice((None, r.lognormvariate(3, 1)))) for i in range(n)]


@pytest.mark.parametrize("n", [1, 3, 10])
def test_progress_is_that_of_the_batch_query(spark, tmp_path, n):
    rows = events(600, 20)
    size = -(-len(rows) // n)
    stream = folder(spark, tmp_path, [rows[i : i + size] for i in range(0, len(rows), size)])
    updates = drain(jobs.crawl_progress(stream, "run", "kind", "page"), "update")
    got = {(r.run, r.kind): r.n for r in jobs.total_progress(updates).collect()}
    keys = {}
    for _, _, run, kind, page, _ in rows:
        keys.setdefault((str(run), kind), set()).update([page] if page is not None else [])
    assert got == {k: len(v) for k, v in keys.items()}


def test_idle_runs_are_let_go(spark, tmp_path):
    day = lambda d, run, page: (0, BEGIN + dt.timedelta(days=d), run, "a", page, None)
    files = [[day(0, 1, "x"), day(0, 1, "y"), day(0, 2, "x")], [day(1, 1, "x"), day(1, 2, "z")], [day(9, 2, "x")], [day(20, 2, "w")]]
    report = {}
    updates = drain(jobs.crawl_progress(folder(spark, tmp_path, files), "run", "kind", "page", late="1 hour", idle_ms=5 * 86_400_000), "update", report)
    closed = {(r.run, r.n) for r in updates.where("closed").groupBy("run", "part").agg(F.max("n").alias("n")).collect()}
    assert {run for run, _ in closed} == {"1", "2"}
    assert {r.run: r.n for r in jobs.total_progress(updates.where("run = '1'")).collect()} == {"1": 2}


def test_windows_leave_the_state(spark, tmp_path):
    files = [[(40 * d + i, BEGIN + dt.timedelta(days=d, minutes=i), 1, "ab"[i % 2], "p", float(i)) for i in range(40)] for d in range(15)]
    report = {}
    got = drain(jobs.latency(folder(spark, tmp_path, files), "kind", "ms", span="1 day", late="1 hour", request="event_id"), "append", report)
    # the last day is open, and the one before may be until the next batch
    assert got.count() in (2 * 13, 2 * 14) and report["late_rows"] == 0
    assert max(report["state_rows"]) <= 2 * (40 + 2 * 2) and report["state_rows"][-1] <= report["state_rows"][2]
    assert {(r.n, r.p50, r.p95, r.max) for r in got.where("kind = 'a'").collect()} == {(20, 18.0, 36.0, 38.0)}


def test_late_and_repeated_rows(spark, tmp_path):
    at = lambda hours, i: (i, BEGIN + dt.timedelta(hours=hours), 1, "a", "p", 1.0)
    files = [[at(0, 1), at(0, 2)], [at(30, 3), at(0.5, 4)], [at(30.5, 9)], [at(1, 5), at(2, 6), at(31, 7), at(31, 7)], [at(60, 8)]]
    report = {}
    got = drain(jobs.latency(folder(spark, tmp_path, files), "kind", "ms", span="1 day", late="2 hours", request="event_id"), "append", report)
    # two rows of the first day come when it is gone: rows are late by the watermark of the batch before
    assert report["late_rows"] == 2 and sorted(r.n for r in got.collect()) == [3, 3]


def test_sketches_merge_within_their_error(spark):
    r = np.random.default_rng(1)
    values = np.concatenate([r.lognormal(3, 1, 30_000), np.full(10_000, 7.5)])
    table = spark.createDataFrame([(int(i), BEGIN + dt.timedelta(minutes=int(i) % 7000), 1, "a", "p", float(v)) for i, v in enumerate(values)], SCHEMA)
    windows = jobs.latency(table, "kind", "ms", span="6 hours")
    got = jobs.merged_latency(windows, "kind").first()
    assert windows.count() == 20 and (got.n, got.timed) == (40_000, 40_000) and got.max == values.max()
    for share, x in ((0.5, got.p50), (0.95, got.p95)):
        assert (values < x).mean() <= share + jobs.RANK_ERROR and (values <= x).mean() >= share - jobs.RANK_ERROR


def test_no_durations(spark):
    table = spark.createDataFrame([(1, BEGIN, 1, "a", "p", None)], SCHEMA)
    assert [(r.n, r.timed, r.p50, r.max) for r in jobs.latency(table, "kind", "ms").collect()] == [(1, 0, None, None)]
