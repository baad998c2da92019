"""Decontamination against a direct count on texts with every awkward case."""

import random
import re

from tallyhouse.llm import decontaminate
from tallyhouse.llm.common import WORD

BENCHMARK = "item_id long, text string"


def words(text):
    return re.findall(WORD, (text or "").translate(
        {a: a + 32 for a in range(ord("A"), ord("Z") + 1)}))


def expected(rows, items):
    out = []
    for row in rows:
        mine, hit, found = words(row[1]), set(), set()
        for item, text in items:
            theirs = words(text)
            n = min(13, len(theirs))
            windows = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
            for i in range(len(mine) - n + 1 if n else 0):
                if tuple(mine[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
        out.append((row[0], len(mine), len(hit), len(found), sorted(found),
                    bool(hit) and 20 * len(hit) >= len(mine)))
    return sorted(out, key=repr)


def got(docs, benchmark):
    return sorted((tuple(r) for r in decontaminate.contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()), key=repr)


def test_equals_a_direct_count(spark, documents):
    pick = random.Random(4)
    text = lambda n: " ".join(pick.choice(["A", "b", "Ça", "d9", "é"]) for _ in range(n))
    long = text(60)
    items = [(1, long[:90]), (2, "short one"), (2, "Short ONE!"), (10, text(14)), (None, text(13)),
             (3, ""), (4, None), (5, text(20))]
    rows = [(1, long), (2, f"x {long} {long} y short-one"), (3, None), (4, ""), (5, "..."),
            (None, "short one"), (6, items[3][1] + " " + "w " * 400), (7, "SHORT  one"),
            (7, "SHORT  one"), *[(k, text(pick.randint(0, 90))) for k in range(20, 60)]]
    docs = documents(rows, "1 as at").withColumnRenamed("lang", "words")
    assert got(docs, spark.createDataFrame(items, BENCHMARK)) == expected(rows, items)


def test_without_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    rows, items = [(1, "a b c"), (2, "q")], [(1, "b c")]
    assert got(documents(rows), spark.createDataFrame(items, BENCHMARK)) == expected(rows, items)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], BENCHMARK)
    assert got(documents([]), none) == []
    assert got(documents([(1, "a b")]), none) == [(1, 2, 0, 0, [], False)]


def test_clean_keeps_rows_whole(spark, documents):
    docs = documents([(1, "a b c"), (2, "clean text"), (2, "clean text"), (None, None)], "7 as key")
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, "a b c")], BENCHMARK))
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == [
        (2, "clean text"), (2, "clean text"), (None, None)]
