"""Rebuild of the index from stored decisions, and links within a budget."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import discovery, quality

CHUNK = "source_id string, ordinal int, text string, title string, url string, reliability_level string, review_status string, indexing_status string"


def test_first_chunk_decides(spark):
    long = "Nội dung kỹ thuật về cây cà phê. " * 20
    meta = ("Cà phê", "https://khuyennongvn.gov.vn/x", None)
    rows = [
        ("kept", 1, "b", *meta, "rejected", None), ("kept", 0, "a", *meta, "approved", None),
        ("gone", 0, "a", *meta, None, "blocked"), ("held", 0, "a", *meta, "needs_review", None),
        ("judged", 0, long, *meta, None, None), ("judged", 1, None, *meta, "approved", None),
        ("short", 0, "a", "Cà phê", "https://shopee.vn/x", None, None, None), ("parts", 2, "z" * 60, *meta, None, None), *[("parts", i, "Cây cà phê, " * 5, *meta, None, None) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)],
    ]
    chunks = spark.createDataFrame(rows, CHUNK).repartition(4)
    sources = spark.createDataFrame([(s,) for s in ("kept", "gone", "held", "judged", "short", "parts", "empty")], "source_id string")
    got = {r.source_id: r for r in quality.rebuild_gate(sources, chunks).collect()}
    status = {s: (r.review_status, r.indexing_status, r.chunk_count) for s, r in got.items()}
    assert status == {
        "kept": ("approved", "indexed", 2), "gone": ("rejected", "blocked", 1), "held": ("needs_review", "held_for_review", 1), "empty": ("needs_review", "held_for_review", 0),
        "judged": ("approved", "indexed", 2), "short": ("needs_review", "held_for_review", 1), "parts": ("approved", "indexed", 10),
    }
    # what is judged is all chunks, in order, joined by line breaks
    for name in ("judged", "short", "parts"):
        own = sorted((r for r in rows if r[0] == name), key=lambda r: r[1])
        joined = spark.createDataFrame([(name, *own[0][3:6], "", "\n".join(r[2] or "" for r in own))], "source_id string, title string, url string, reliability_level string, raw_text string, cleaned_text string")
        want = quality.gate(joined).first()
        assert (got[name].review_status, got[name].quality_score) == (want.review_status, pytest.approx(round(want.quality_score, 3)))
    union = quality.rebuild_union(chunks, quality.rebuild_gate(sources, chunks)).collect()
    assert {r.source_id for r in union} == {"kept", "judged", "parts"} and len(union) == 14


@pytest.mark.parametrize("n", [0, 1, 37, 500])
def test_first_rows_of_a_whole_table(spark, n):
    r = random.Random(n)
    rows = [(r.randrange(40), f"u{i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "page int, url string").repartition(7)
    got = sorted((x.place, x.page, x.url) for x in discovery.first_n(frame, n, "page", "url").collect())
    assert got == [(i, *x) for i, x in enumerate(sorted(rows)[:n], 1)]


def test_links_within_a_budget(spark):
    links = [("http://a.vn/1", 3), ("http://a.vn/2", 1), ("http://a.vn/1", 2), ("https://a.vn/3", 1), ("http://b.vn/1", 1), ("ftp://a.vn/1", 1), ("http://a.vn/4", 9), ("http://a.vn/5", 9)]
    links = spark.createDataFrame(links, "url string, page int")
    seeds, seen = spark.createDataFrame([("http://www.a.vn",)], "url string"), spark.createDataFrame([("http://a.vn/2",)], "url string")
    got = {r.url: r.state for r in discovery.triage(links, seeds, seen, budget=3, order=("page",)).collect()}
    assert got == {"http://a.vn/2": "seen", "https://a.vn/3": "queued", "http://a.vn/1": "queued", "http://a.vn/4": "queued", "http://a.vn/5": "over_budget", "http://b.vn/1": "candidate_external"}
    assert discovery.triage(links, seeds, seen).where("state = 'queued'").count() == 4
    assert discovery.triage(links.limit(0), seeds, seen, 3, ("page",)).collect() == []
