"""The pipeline against its parts, and a checkout without the operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallyhouse import queries as registered
from tallyhouse.llm import decontaminate, ngram_join, toxicity
from tallyhouse.llm.common import stored, table

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def test_stages_are_the_five_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination",
        "mixing to target weights", "token output"]


def test_each_stage_takes_effect(spark):
    docs = table(spark, SF, "documents").selectExpr("*", "doc_id * 2 as size")
    before = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, SF), "test-stage")
        assert after.columns == docs.columns and after.where("size != doc_id * 2").isEmpty()
        kept.append((before, after))
        before = after
    ids = lambda frame: [r["doc_id"] for r in frame.select("doc_id").collect()]

    given, calm = kept[0]
    model = toxicity.train(given, table(spark, SF, "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(given, model).collect()}
    assert set(ids(calm)) == {d for d, s in scores.items() if s < 0.7} != set(scores)

    classes = {r["doc_id"]: r["class_id"] for r in ngram_join.similarity_join(calm).collect()}
    assert sorted(ids(kept[1][1])) == sorted(set(classes.values())) and len(classes) > len(
        set(classes.values()))

    judged = decontaminate.contamination(kept[2][0], table(spark, SF, "benchmark")).collect()
    assert sorted(ids(kept[2][1])) == sorted(r["doc_id"] for r in judged if not r["contaminated"])

    out = stored(corpus_pipeline.STAGES[-1][1](spark, before, SF), "test-stage").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(ids(before))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(before.select("doc_id", "text").collect())
    start = 0
    for r in sorted(out, key=lambda r: r["start"]):
        n = len(tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids) + 1
        assert (r["start"], r["n_tokens"]) == (start, n)
        start += n
    assert np.all(np.diff([r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]) >= 0)


def test_repeated_and_empty_rows_go_through(spark, documents):
    rows = [(1, None), (2, ""), (None, None), (3, "some words of a text that repeats here"),
            (3, "some words of a text that repeats here"), (4, "x " * 30_000)]
    docs = documents(rows, "1 as bad")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
    assert {r["doc_id"] for r in docs.collect()} <= {1, 2, 3, 4, None}


def test_no_rows(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
    assert docs.count() == 0


def test_the_rest_works_without_the_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(
        "llm", "corpus_pipeline.py", ".git", "__pycache__", "tests"))
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in"
         " e.queries(), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, check=True)
    own = str(len(registered.REGISTERED))
    assert said.stdout.split() == [own, "False", own]


def test_nothing_else_imports_the_operators():
    for path in [*REPO.glob("tallyhouse/**/*.py"), *REPO.glob("*.py")]:
        inside = "llm" in path.parts or path.name in ("corpus_pipeline.py", "__spark_entry__.py")
        assert inside or "llm" not in path.read_text()
