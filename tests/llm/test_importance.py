"""Importance resampling against a direct computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.llm import importance
from tallyhouse.llm.common import ship

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def runs(text):
    words = WORD.findall((text or "").translate(LOWER))
    spans = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(s.encode()) % 10_000 for s in spans]


def plain(docs, target):
    counted = [(doc_id, *runs(text)) for doc_id, text in docs]
    s, t = Counter(), Counter()
    for _, _, found in counted:
        s.update(found)
    for text in target:
        t.update(runs(text)[1])
    whole, aimed = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (whole + 10_000) / ((s[b] + 1) * (aimed + 10_000))))
        for b in range(10_000)
    ]
    out = []
    for doc_id, n_words, found in counted:
        own = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"42:{own}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, n_words >= 20, None])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(drawn[: 5 * len(drawn) // 100]):
        row[5] = k + 1
    return sorted(((*r[:4], r[5]) for r in out), key=repr)


def got(documents, spark, docs, target, extra="1 as rank"):
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    result = importance.resample(documents(docs, extra), aim)
    rows = result.select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in rows), key=repr)


@given(st.text(alphabet="aB c.,'\n-é日_1", max_size=60))
@settings(max_examples=500, deadline=None)
def test_buckets_of_any_text(text):
    n, found = importance.run_buckets(text.encode(), 3, 10_000)
    assert (n, found.tolist()) == runs(text)


def corpus(n, seed):
    pick = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "δ", "naïve", "x1", "日本", "delta's"]
    return [" ".join(pick.choices(words, k=pick.randint(0, 60))) for _ in range(n)]


def test_equals_a_direct_computation(spark, documents):
    ship(spark)
    texts = [None, "", "...", "one two", "w " * 50_000, *corpus(300, 1)]
    docs = [*enumerate(texts), (None, texts[20]), (None, texts[21]), (7, texts[7]), (7, texts[8])]
    target = [None, "", *corpus(20, 2)]
    want = plain(docs, target)
    assert got(documents, spark, docs, target) == want
    assert sum(r[4] is not None for r in want) > 5


def test_ties_go_to_the_smaller_id(spark):
    rows = [(k, 5) for k in range(40)] + [(None, 5), (100, 9), (50, 5), (50, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, score long").repartition(5)
    ranked = importance.ranked(frame, 50, 100).collect()
    drawn = sorted((r["rank"], r["doc_id"]) for r in ranked if r["rank"])
    assert drawn == [(1, 100), *((k + 2, k) for k in range(21))] and len(ranked) == len(rows)


def test_no_rows_and_no_target(spark, documents):
    ship(spark)
    assert got(documents, spark, [], ["a b"]) == []
    docs = list(enumerate(corpus(60, 3)))
    assert got(documents, spark, docs, []) == plain(docs, [])
