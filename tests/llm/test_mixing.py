"""Mixing against its SQL on a table with ties, nulls and repeats, and its bounds."""

import duckdb

from tallyhouse.llm import mixing
from tallyhouse.llm.queries import ORACLE_SQL

ROWS = [
    (1, "a b c", None, "x"), (2, "a " * 50, None, "x"), (3, "", None, "x"),
    (4, None, None, "y"), (5, "one two", None, "y"), (5, "one two", None, "y"),
    (None, "no id here", None, None), (7, "q w e r t y", None, None),
    *[(k, "w " * (k % 7), None, "zz") for k in range(10, 120)],
]


def sql(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    return con.execute(
        "select doc_id, size, source_size, target, taken from (" + ORACLE_SQL["op5_mix_sources"] + ")"
    ).fetchall()


def test_equals_sql_and_keeps_bounds(documents):
    docs = documents(ROWS, "1 as target").withColumnRenamed("lang", "size")
    got = [tuple(r) for r in mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got, key=repr) == sorted(sql(ROWS), key=repr)
    assert all(0 <= r[4] <= 3 * r[1] for r in got)


def test_taken_words_come_near_the_target(documents):
    rows = [(k, "w " * (1 + k % 9), None, f"s{k % 3}") for k in range(3000)]
    got = mixing.mix(documents(rows)).groupBy("source").agg(
        {"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 9 for r in got)


def test_cap_sends_the_excess_to_the_others(spark):
    sizes = spark.createDataFrame([("a", 600), ("b", 600), ("c", 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["c"] == 300 and abs(got["a"] - 1000 / 3) < 1e-9 and abs(sum(got.values()) - 1300) < 1e-9


def test_empty_and_sizeless_tables(documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r["taken"] for r in mixing.mix(documents([(1, None, None, "a")])).collect()] == [0]


def test_rows_come_as_often_as_taken(documents):
    docs = documents(ROWS, "doc_id as nth")
    want = mixing.mix(docs).where("times > 0").groupBy("doc_id").sum("times").collect()
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert {r[0]: r[1] for r in want} == {r[0]: r[1] for r in got.groupBy("doc_id").count().collect()}


def test_no_empty_document_is_copied_beyond_the_cap(spark, documents):
    """A source at its cap has no budget left, so texts without words need no further copy."""
    rows = [(1, "word " * 1000, None, "a"), (2, "two words", None, "b")]
    rows += [(k, "", None, "b") for k in range(3, 60)]
    docs = documents(rows)
    times = {r["doc_id"]: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    assert times[2] == mixing.CAP and set(times) >= set(range(2, 60))
    assert max(times[k] for k in range(3, 60)) == mixing.CAP
    assert {r["times"] for r in mixing.mix(docs).where("source = 'b'").collect()} == {mixing.CAP}
