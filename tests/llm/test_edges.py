"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from granary.llm import bpe, decontaminate, langid, licenses, media, minhash, quality, queries, substring, suffix, tokencount

LONG = "the long text goes on " * 9000
ROWS = [
    (1, "The same text, twice. " * 6, "en"), (1, "The same text, twice. " * 6, "en"), (None, "no id here, only some words", None), (None, None, None),
    (2, None, "en"), (3, "", "fr"), (4, LONG, "en"), (5, "The same text, twice. " * 6, None), (6, "\x00\x1f \t\n", "xx"), (7, "日本語 text é", "fr"),
]
EXTRA = {c: f"'{c}'" for c in ("n_tokens", "node", "tag", "runs", "id", "name", "score", "labels", "kept", "hit_id", "lang_pred", "packed")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "'s' AS source", "cast(length(text) as long) AS n_chars", *[f"{v} AS {c}" for c, v in EXTRA.items()]
    )


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "long text goes on the long text goes on the long text"), (None, "only some words"), (2, None)], "item_id long, text string")
    return {
        "bpe": lambda d: bpe.encode_documents(d, queries.VOCABULARY, queries.PATTERN),
        "licenses": licenses.scan_documents,
        "media": media.store_texts,
        "quality": lambda d: quality.score_documents(d, labels),
        "decontaminate": lambda d: decontaminate.find_hits(d, bench),
        "minhash": minhash.classify,
        "substring": substring.measure,
        "suffix": suffix.measure,
        "langid": langid.identify,
        "tokencount": lambda d: tokencount.count_tokens(d, queries.VOCABULARY, queries.PATTERN),
    }


@pytest.mark.parametrize("name", ["bpe", "licenses", "media", "quality", "decontaminate", "minhash", "substring", "suffix", "langid", "tokencount"])
def test_operator(spark, name):
    run = operators(spark)[name]
    got = run(frame(spark, ROWS)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    one = [tuple(r) for r in got if r.doc_id == 1]
    assert len(one) == 2 and one[0] == one[1]
    empty = run(frame(spark, []))
    assert empty.collect() == [] and empty.columns == run(frame(spark, ROWS)).columns


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "long text goes on the long text goes on the long text")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    frame(spark, ROWS).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, sf_dir, step):
    _, stage = corpus_pipeline.STAGES[step]
    out = stage(spark, frame(spark, ROWS), sf_dir)
    if step + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == corpus_pipeline.COLUMNS
    assert stage(spark, frame(spark, []), sf_dir).collect() == []
    got = out.collect()
    assert len(got) <= len(ROWS)
    ids = {r.doc_id for r in got}
    if step == 0:
        assert 6 not in ids and 3 not in ids and {1, 4, 7} <= ids
    if step == 1:
        assert 5 not in ids and [r.doc_id for r in got].count(1) == 1
    if step == 2:
        assert 5 not in ids and 4 in ids
    if step == 3:
        assert 4 not in ids and 1 in ids


def test_run(spark, sf_dir):
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert 1 in got and 5 not in got and 6 not in got


@pytest.mark.parametrize("lang", [None, "und"])
def test_texts_with_letters_stay_without_languages(spark, lang):
    docs = frame(spark, [(i, text, lang) for i, text, _ in ROWS])
    kept = [str(r.doc_id) for r in langid.keep_identified(docs).collect()]
    assert sorted(kept) == sorted(["1", "1", "None", "4", "5", "7"])
