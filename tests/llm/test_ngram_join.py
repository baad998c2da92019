"""The similarity join against all pairs, and what the pruning may drop."""

import random
from math import comb

import pytest

from tallyhouse.llm import ngram_join
from tallyhouse.llm.common import ship

PICK = random.Random(11)
VOCABULARY = [f"w{k}" for k in range(400)]


def text(n):
    return " ".join(PICK.choice(VOCABULARY) for _ in range(n))


def edited(source, edits):
    words = source.split()
    for _ in range(edits):
        words[PICK.randrange(len(words))] = PICK.choice(VOCABULARY)
    return " ".join(words)


def brute(rows):
    """(doc_id, class_id, n_links) by comparing all sets."""
    sets = {}
    for _, t in rows:
        sets.setdefault(frozenset(ngram_join.shingle_set(t or "").tolist()), len(sets))
    distinct = [s for s in sets if s]
    near = {s: set() for s in distinct}
    for k, a in enumerate(distinct):
        for b in distinct[k + 1:]:
            if len(a & b) >= 0.8 * len(a | b):
                near[a].add(b)
                near[b].add(a)
    ids, classes = {}, {}
    for d, t in rows:
        ids.setdefault(frozenset(ngram_join.shingle_set(t or "").tolist()), []).append(d)
    for s in distinct:
        if s not in classes:
            group, todo = set(), [s]
            while todo:
                if (x := todo.pop()) not in group:
                    group.add(x)
                    todo += near[x]
            named = [d for x in group for d in ids[x] if d is not None]
            classes |= {x: min(named, default=None) for x in group}
    out = []
    for d, t in rows:
        s = frozenset(ngram_join.shingle_set(t or "").tolist())
        out.append((d, classes[s], len(near[s])) if s else (d, d, 0))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    out, nth = [], 0
    for _ in range(12):
        base = text(PICK.randint(30, 200))
        for edits in (0, 0, 1, 2, 4, 8):
            out.append((nth, edited(base, edits)))
            nth += 1
    hub = text(120)
    out += [(500 + k, edited(hub, PICK.randint(0, 6))) for k in range(80)]
    out += [(900, None), (901, ""), (902, "..."), (903, "two words"), (904, "Two, WORDS"),
            (905, "one"), (None, "two words"), (None, None), (906, out[0][1]), (906, out[0][1]),
            (907, "very long " * 3000)]
    return out


@pytest.mark.parametrize("block", [256, 16])
def test_equals_all_pairs(spark, documents, rows, monkeypatch, block):
    ship(spark)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CANDIDATE_BLOCK", block)
    docs = documents(rows, "1 as label").withColumnRenamed("lang", "size")
    got = ngram_join.similarity_join(docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_one_row_of_each_class_stays(spark, documents, rows):
    ship(spark)
    docs = documents(rows, "1 as place").withColumnRenamed("lang", "first")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute(rows)
    worded = [w for w in want if w[1] is not None and w[0] not in (900, 901, 902)]
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None and i not in (900, 901, 902)) == sorted(
        {w[1] for w in worded})
    assert {900, 901, 902} <= set(ids) and ids.count(None) == 1


def test_no_rows(spark, documents):
    ship(spark)
    assert ngram_join.similarity_join(documents([])).count() == 0
    assert ngram_join.one_of_each(documents([])).count() == 0


def test_a_pair_at_the_threshold_is_rarely_dropped():
    least = ngram_join.least_matches(0.8, 1e-6)
    for n, need in least.items():
        lost = sum(comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(need))
        assert lost < 2e-5
    assert least[128] > 64
