"""Fill-in-the-middle texts against a plain split into tokens, and back."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhouse.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = infill.reordered(docs).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    want = []
    for doc_id, text in rows:
        n, form, output, before, between = plain(doc_id, text)
        want.append((doc_id, n, form, output, before, between, text or ""))
    assert got == sorted(want, key=repr)
    return {row[2] for row in got}


def test_all_forms_and_odd_texts(spark):
    texts = [
        "one two  three\tfour\nfive ", " lead", "trail \n\x0b\f\r ", "  ", "", None, "a",
        "tags <P> in it", "<S", "a<M> b", "< P>", "$1 \\E \\Q {3}+ (x) $3", "𝒳 é 日本   x y",
        "ends with <", "<P", "M> <S x", "\x1c\x1d\x85 nel",
    ]
    rows = [(k, text) for text in texts for k in range(40)]
    assert check(spark, [*rows, (None, "no id at all"), (1, "a b"), (1, "a b")]) == {
        "plain", "psm", "spm"
    }


@given(st.lists(st.text(alphabet="ab \t\n<PSM>é𝒳", max_size=30), min_size=20, max_size=20))
@settings(max_examples=5, deadline=None)
def test_any_text(spark, texts):
    check(spark, list(enumerate(texts)))


def test_very_long_texts_need_no_stack(spark):
    reordered = [k for k in range(60) if plain(k, "x")[1] != "plain"][:4]
    texts = ["word " * 400_000, "w" * 2_000_000, " " * 2_000_000, "é\n" * 300_000]
    assert "plain" not in check(spark, list(zip(reordered, texts, strict=True)))


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.reordered(docs).count() == 0
    odd = spark.createDataFrame([(1, "x y", 7, "q")], "k long, body string, n long, output string")
    assert infill.reordered(odd, "k", "body").count() == 1
