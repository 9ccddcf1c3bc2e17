"""Registered queries on odd rows against their own SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = [
    "1219 first line\n1219 second line\n  2 third  \n0 zero",
    "a header 12\nx\na header 7\ny\nA HEADER 345\nz",
    "　wide space \n\ttab stays\t\n em ",
    "line ΑΣ\nline ασ\nLINE ΑΣ\nİstanbul\nistanbul\nISTANBUL",
    "four\nfour\nfour\n" + "\n".join(["x" * 121] * 3 + ["y" * 120] * 3 + ["z" * 5] * 2),
    "",
    " \n \n",
    None,
]


def both(spark, path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(path)), con.sql(entry.oracle_sql()[name])
    return [sorted(map(repr, rows)) for rows in (map(tuple, got.select(*want.columns).collect()), want.fetchall())]


@pytest.mark.parametrize("name", ["drop_repeated_headers"])
def test_odd_documents(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, "documents", list(enumerate(TEXTS)), "doc_id long, text string")
    assert got == want and len(got) >= 7
