"""Base spans against the plain patterns; contexts that lead to unseen identifiers."""

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.llm import pii
from tallyhouse.llm.common import ship

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="ab@.@-+12 3450().\né_", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_numbers():
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1111 1", "x4111111111111111y",
                 "0001.002.255.0255", "1.2.3.256", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824.", "+1 2",
                 "a@b.c@d.e", "a@b@c.d", "@b.c", "a@b..c", "٤@b.c"):
        assert pii.base_spans(text) == plain(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_runs_stay_linear():
    began = time.process_time()
    for run in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "a." * 150_000, "1 " * 150_000,
                "a@" * 100_000, "+1" + " " * 300_000):
        pii.base_spans(run)
        list(pii.candidates(run, []))
    assert time.process_time() - began < 10


def rows():
    pick = random.Random(8)
    noise = lambda: " ".join(pick.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(5))
    out = []
    for k in range(20):
        out.append((k, f"{noise()} please call +1 (555) 010-{1000 + k} {noise()}"))
    out.append((100, f"{noise()} please call 555-0199-77 {noise()}"))
    out.append((101, f"{noise()} order number 555-0199-78 {noise()}"))
    out.append((102, f"the same again: 555-0199-77"))
    return out + [(103, None), (104, ""), (None, "x@y.org"), (105, "x@y.org"), (105, "x@y.org"),
                  (106, "no data " * 20_000)]


def test_contexts_add_spans_and_base_ones_stay(spark, documents):
    ship(spark)
    docs = documents(rows(), "1 as value").withColumnRenamed("lang", "pattern")
    got = pii.find_personal(docs).collect()
    assert len(got) == len(rows())
    texts = dict(rows())
    spans = {r["doc_id"]: r["spans"] for r in got}
    for r in got:
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain(texts[r["doc_id"]] or ""))
        assert r["base"] == want and set(want.split(",")) <= {*r["spans"].split(","), ""}
    for doc_id in (100, 102):
        at = texts[doc_id].index("555")
        assert spans[doc_id] == f"phone:{at}:{at + 11}"
    assert spans[101] == "" and spans[105] == "email:0:7"


def test_no_rows(spark, documents):
    ship(spark)
    assert pii.find_personal(documents([])).count() == 0


def test_identifiers_with_spaces_and_in_text_without_them(spark, documents):
    ship(spark)
    record = '{"id":%d,"name":"Bob","note":"' + "x" * 80 + '","tel":"%s","z":1}'
    given = [(k, f"please call +1 (555) 010-{1000 + k} now") for k in range(12)]
    given += [(20 + k, record % (k, f"+1 555 010 {2000 + k}")) for k in range(12)]
    given += [(40 + k, f"我们的电话是+1 555 010 {3000 + k}谢谢") for k in range(12)]
    given += [(60 + k, f"mail=a{k}@b.org,fon=+1 555 010 {4000 + k}") for k in range(12)]
    asked = {100: ("please call (555) 010-1234 now", "(555) 010-1234"),
             101: ("please call 555 010 1234 now", "555 010 1234"),
             102: (record % (9, "555-0199-78"), "555-0199-78"),
             103: ("我们的电话是555-0199-79谢谢", "555-0199-79"),
             104: ("mail=a@b.org,fon=555-0199-80", "555-0199-80")}
    docs = documents(given + [(k, text) for k, (text, _) in asked.items()])
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal(docs).collect()}
    for k, (text, value) in asked.items():
        at = text.index(value)
        assert f"phone:{at}:{at + len(value)}" in spans[k].split(","), (k, spans[k])


def test_rounds_go_on_until_nothing_is_new(spark):
    rows = []
    for k in range(6):
        rows += [(f"p{k}", f"seed{n}", 3, [3]) for n in range(4)]
        rows += [(f"p{k}", f"v{n}", None, [3]) for n in (k - 1, k) if n >= 0]
    graph = spark.createDataFrame(rows, "pattern string, value string, seed int, shapes array<int>")
    got = {(r["value"], r["kind"]) for r in pii.bootstrapped(graph).collect()}
    assert got == {(f"v{k}", 3) for k in range(6)}


def test_each_count_is_of_its_own_kind(spark, documents):
    """Uneven numbers of each kind, so that no count can stand for another."""
    texts = [
        "a@b.cd 10.0.0.1 and x@y.zz",
        "4111 1111 1111 1111, 5500-0055-5555-5559; 4012888888881881",
        "+1 743 555 3824 or 1.2.3.4 or 4.3.2.1 or 9.9.9.9", "none", "", None,
    ]
    found = pii.find_personal(documents(list(enumerate(texts)))).collect()
    for row in found:
        kinds = [kind for kind, *_ in plain(texts[row["doc_id"]] or "")]
        counts = [row[f"n_{name}"] for name in pii.KINDS]
        assert counts == [kinds.count(kind) for kind in range(len(pii.KINDS))], row
    assert {sum(r[f"n_{name}"] for r in found) for name in pii.KINDS} == {1, 2, 3, 4}


def test_counts_of_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in pii.find_personal(docs).collect():
        kinds = [kind for kind, *_ in plain(texts[row["doc_id"]] or "")]
        assert [row[f"n_{name}"] for name in pii.KINDS] == [kinds.count(k) for k in range(4)]
