"""The driver contract, and plans that have to stay as they are."""

import contextlib
import io

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_reading_is_pruned_and_stays_in_the_engine(spark):
    text = plan(entry.queries()["canonical_docs"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "Python" not in text and "Arrow" not in text
    assert "Python" not in plan(entry.queries()["flagship"](spark, SF))
    assert "PushedFilters: [In(event_type" in plan(entry.queries()["valid_feedback"](spark, SF))
