"""The index store: upserts against brute force, switches as a whole, no shuffle of stored rows."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import search
from granary.sources.index import IndexStore

SCHEMA = "chunk_id string, source_id string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(index):
    return sorted(map(tuple, index.read().select("chunk_id", "source_id", "text").collect()), key=str)


def brute(stored, incoming):
    sources = {s for _, s, _ in incoming if s}
    kept = [r for r in stored if r[1] not in sources]
    known = {c for c, _, _ in kept}
    return kept + [r for r in incoming if r[0] not in known]


@pytest.mark.parametrize("ids", [1000, 3])  # all incoming ids at once; a few buckets at a time, and joins beyond the bound
def test_upserts_by_brute_force(spark, tmp_path, ids):
    r = random.Random(8)
    index, want = IndexStore(spark, str(tmp_path / "index"), buckets=5, broadcast_ids=ids), []
    row = lambda k: (f"c{r.randrange(60)}", r.choice([None, "", *(f"s{i}" for i in range(25))]), f"t{k}")
    for step, n in enumerate((40, 15, 0, 30)):
        rows = [row((step, i)) for i in range(n)]
        if step == 0:
            index.rebuild(frame(spark, rows))
            want = rows
        else:
            index.upsert(frame(spark, rows))
            want = brute(want, rows)
        assert content(index) == sorted(want, key=str), step
    again = frame(spark, [r for r in rows if r[1]])
    index.upsert(again)
    once = content(index)
    index.upsert(again)
    assert content(index) == once


def test_a_writer_that_fails_changes_nothing(spark, tmp_path):
    index = IndexStore(spark, str(tmp_path), buckets=4)
    rows = [(f"c{i}", f"s{i}", "old") for i in range(20)]
    index.rebuild(frame(spark, rows))
    broken = frame(spark, [(f"c{i}", f"s{i}", "new") for i in range(10)]).withColumn("text", F.when(F.col("source_id") == "s7", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        index.upsert(broken)
    assert content(index) == sorted(rows)
    # one that is lost between its rows and its manifest leaves rows that nobody reads
    index._stage(frame(spark, rows).withColumn("bucket", F.lit(1)), "lost")
    assert content(index) == sorted(rows)
    before = index._numbers()
    index.upsert(frame(spark, [("c1", "s1", "new")]))
    with pytest.raises(RuntimeError):  # the other of two writers that have begun together
        index._switch(before, {}, None)
    assert ("c1", "s1", "new") in content(index) and ("c1", "s1", "old") in [tuple(r) for r in index.read(number=0).collect()]
    index.vacuum(keep=1)
    assert len(index._names("data")) == len(set(index.manifest().values())) and len(content(index)) == 20


def test_only_touched_buckets_are_written_and_stored_rows_stay_in_place(spark, tmp_path):
    index = IndexStore(spark, str(tmp_path), buckets=8)
    index.rebuild(frame(spark, [(f"c{i}", f"s{i}", "old") for i in range(200)]))
    before = index.manifest()
    index.upsert(frame(spark, [("c3", "s3", "new")]))
    changed = [b for b, v in index.manifest().items() if before[b] != v]
    assert len(before) == 8 and len(changed) == 1
    ids = frame(spark, [("c3", "s3", "new")]).select("source_id")
    plan = index.without(list(before), ids, 1)._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("FileScan")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan[:scan]


def test_reembedding(spark, tmp_path):
    index = IndexStore(spark, str(tmp_path), buckets=4)
    rows = search.with_embedding(frame(spark, [(f"c{i}", f"s{i}", f"word{i} and others") for i in range(12)]))
    stale = rows.withColumn("embedding_version", F.when(F.col("source_id") == "s5", "legacy").otherwise(F.col("embedding_version")))
    index.rebuild(stale.withColumn("embedding", F.when(F.col("source_id") != "s5", F.col("embedding"))))
    assert index.reembed(search.with_embedding, search.HASH_VERSION) == 1
    got = index.read().collect()
    want = {r.chunk_id: r.embedding for r in rows.collect()}
    assert {r.embedding_version for r in got} == {search.HASH_VERSION} and {r.chunk_id: r.embedding for r in got} == want
    assert index.reembed(search.with_embedding, search.HASH_VERSION) == 0
    assert index.reembed(search.with_embedding, search.HASH_VERSION, force=True) == len(index.manifest())


def test_empty_index(spark, tmp_path):
    index = IndexStore(spark, str(tmp_path))
    assert index.manifest() == {}
    index.rebuild(frame(spark, []))
    assert index.manifest() == {} and content(index) == []
    index.upsert(frame(spark, [("c", "s", "t")]))
    assert content(index) == [("c", "s", "t")]
