"""Personal data by fixed patterns and by contexts bootstrapped from them.

The fixed patterns find what is surely personal. The two words to the left of each
find, its lexical pattern, also stand before identifiers that the fixed patterns
miss. Patterns and instances form a graph, an edge for each pair that occurs. A pattern
is as good as the share of its instances that are known to be of a kind; an instance
is as likely as its patterns together make it. Rounds of both, as joins and sums over
the whole corpus's graph, accept patterns and instances only when they are confident,
and the places of what was accepted are added to the spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import stored, text_key

KINDS = ("email", "ip", "card", "phone")

# Fixed by the data contract. The possessive forms match the same texts as plain ones
# and never read a long run twice.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IP_PART, _CARD_DIGITS, _PHONE_DIGITS = 255, (13, 19), (9, 15)

#: Known instances a pattern needs; what a pattern and an instance
#: must score; words of a pattern.
LEAST_KNOWN, LEAST_PATTERN, LEAST_INSTANCE = 3, 0.7, 0.7
CONTEXT_WORDS, CONTEXT_CHARS = 2, 80

_TOKEN_SIGN = re.compile(r"[0-9@]")
# Scripts written without spaces or with endings joined to numbers; they are no part of an
# identifier, and each character is a word.
_UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u2e80-\ud7ff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
#: Where a field starts in text without spaces.
_FIELD = re.compile(r"[,;&?{|](?=[^,;&?{|]*\w)")
# Runs that may be identifiers: words with marks, groups of hex digits between colons, and
# groups of digits with spaces, parentheses and hyphens between them.
_PART = rf"[^\W{_UNSPACED}]"
_RUN = re.compile(rf"(?:{_PART}|[.%+@-])++")
_COLONS = re.compile(r"(?<![\w:])[0-9A-Fa-f]*+(?::[0-9A-Fa-f]*+){3,}+(?:\.[0-9]++)*+")
_GROUPS = re.compile(
    rf"(?<![.%+@-])(?<!{_PART})\+?\(?[0-9]++"
    r"(?:(?:[ \u00a0]?[()-][ \u00a0()-]{0,2}+|[ \u00a0.])[0-9]++)*+"
)
_IN_RUN = re.compile(rf"{_PART}|@")
_MOST_DIGITS = 19
_EDGES = "\"'`.,;:!?()[]{}<>*$&%#|=/\\"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``local@label(.label)+``, from one @ sign to the next."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _AT.match(text, at)
        start = at
        if domain:
            while start > free and _LOCAL.match(text, start - 1):
                start -= 1
        if start < at:
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for nth, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + nth % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and then place."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _TOKEN_SIGN.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") for part in m[0].split(".")]
        if all(len(part) <= 3 and int(part or 0) <= _IP_PART for part in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= _CARD_DIGITS[0]:
            digits = _digits(m[0])
            if _CARD_DIGITS[0] <= len(digits) <= _CARD_DIGITS[1] and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if _PHONE_DIGITS[0] <= len(_digits(m[0])) <= _PHONE_DIGITS[1]:
                out.append((3, *m.span()))
    return out


def pattern_before(text: str, start: int) -> str:
    """The words left of a place, lowered and joined; a mark where there are none.

    Where text without spaces leads up to the place, only its last field counts.
    """
    left = text[max(0, start - CONTEXT_CHARS) : start].lower()
    if left and not left[-1].isspace():
        tail = left.split()[-1]
        if fields := list(_FIELD.finditer(tail)):
            left = tail[fields[-1].end() :]
    return " ".join(_WORD.findall(left)[-CONTEXT_WORDS:]) or "^"


def shapes(token: str) -> list[int]:
    """The kinds whose identifiers may look like this."""
    digits = len(_digits(token))
    return [
        kind for kind, fits in enumerate((
            "@" in token and len(token) >= 4,
            digits >= 4 and (token.count(".") >= 3 or token.count(":") >= 3),
            digits >= 8,
            6 <= digits <= 15 and not re.search(r"[^0-9+(). \u00a0-]", token),
        )) if fits
    ]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs with a digit or @ between the spans, without the marks around them.

    What adjoins a span is a piece of it. Digits in groups are a run whole, if they are not
    more than any kind has, and in their parts.
    """
    found, free = set(), 0
    for first, last in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))]:
        if free < first and _TOKEN_SIGN.search(text, free, first):
            runs = [m.span() for m in _RUN.finditer(text, free, first)]
            runs += [m.span() for m in _COLONS.finditer(text, free, first)]
            for m in _GROUPS.finditer(text, free, first):
                start, end = m.span()
                if end < len(text) and _IN_RUN.match(text, end):
                    end = start + len(m[0].rstrip("0123456789").rstrip(" \u00a0().-"))
                if text[start] == "(" and ")" not in m[0]:
                    start += 1
                if len(_digits(text[start:end])) <= _MOST_DIGITS:
                    runs.append((start, end))
            for start, end in runs:
                if start == free > 0 or end == first < len(text):
                    continue
                run = text[start:end]
                left = 0 if run[:1] in ("(", ":") else len(run) - len(run.lstrip(_EDGES))
                right = len(run) if run[-1:] == ":" else len(run.rstrip(_EDGES))
                if left < right and _TOKEN_SIGN.search(run):
                    found.add((start + left, start + right))
        free = max(free, last)
    yield from sorted(found)


_FOUND = (
    "doc_id long, key struct<a: long, b: long>, base array<struct<kind: int, start: int, stop: int>>,"
    " seen array<struct<pattern: string, value: string, seed: int, shapes: array<int>,"
    " start: int, stop: int>>"
)
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_SEEN = pa.struct([
    ("pattern", pa.string()), ("value", pa.string()), ("seed", pa.int32()),
    ("shapes", pa.list_(pa.int32())), ("start", pa.int32()), ("stop", pa.int32()),
])


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases, seen = [], []
        for text in batch.column(2).to_pylist():
            text = text or ""
            spans = base_spans(text)
            bases.append([{"kind": k, "start": a, "stop": b} for k, a, b in spans])
            near = [
                {"pattern": pattern_before(text, a), "value": text[a:b].lower(), "seed": k,
                 "shapes": [k], "start": a, "stop": b}
                for k, a, b in spans
            ]
            for a, b in candidates(text, spans):
                fits = shapes(text[a:b])
                if fits:
                    near.append({
                        "pattern": pattern_before(text, a), "value": text[a:b].lower(),
                        "seed": None, "shapes": fits, "start": a, "stop": b,
                    })
            seen.append(near)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(bases, pa.list_(_SPAN)),
             pa.array(seen, pa.list_(_SEEN))],
            names=["doc_id", "key", "base", "seen"],
        )


def bootstrapped(graph: DataFrame) -> DataFrame:
    """(value, kind) of the instances accepted from a graph of (pattern, value, seed, shapes).

    Each round scores patterns by the share of their distinct values that are known and
    instances by their patterns together, and is a written table. It ends when a round
    accepts nothing new.
    """
    edges = stored(graph.select("pattern", "value", "seed", "shapes").distinct(), "graph")
    seeds = edges.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct()
    known = stored(seeds.withColumn("conf", F.lit(1.0)).withColumn("new", F.lit(False)), "known")
    totals = stored(
        edges.select("pattern", "value").distinct().groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= LEAST_KNOWN),
        "totals",
    )
    while True:
        scored = (
            edges.select("pattern", "value").distinct().join(known, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("conf").alias("sure"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= LEAST_KNOWN)
            .join(totals, "pattern")
            .select("pattern", "kind", (F.col("sure") / F.col("total")).alias("score"))
            .where(F.col("score") >= LEAST_PATTERN)
        )
        best = Window.partitionBy("value").orderBy(F.desc("conf"), "kind")
        fresh = (
            edges.where("seed is null")
            .select("pattern", "value", F.explode("shapes").alias("kind")).distinct()
            .join(scored, ["pattern", "kind"])
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("conf"))
            .where(F.col("conf") >= LEAST_INSTANCE)
            .join(known.select("value"), "value", "left_anti")
            .withColumn("nth", F.row_number().over(best)).where("nth = 1")
            .select("value", "kind", "conf", F.lit(True).alias("new"))
        )
        added = stored(fresh, "fresh")
        if added.isEmpty():
            break
        known = stored(known.unionByName(added), "known")
    return known.where("new").select("value", "kind")


def _joined(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
                s["stop"].cast("string"),
            ),
        ),
        ",",
    )


def _count(kind: int) -> Column:
    # A second parameter of the lambda, a default one too, would be given the index.
    return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The personal data in each row: doc_id, n_email, n_ip, n_card, n_phone, base, spans.

    The numbers and ``base`` are of the fixed patterns, ``spans`` has those and the ones
    the contexts add, both as ``kind:start:end`` in code points by kind, then place. A
    null text is empty, rows without finds have empty strings, repeated rows are judged
    each, an empty table gives no rows. Other columns are not read.
    """
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"),
        F.col(text).alias("text"),
    )
    found = stored(keyed.mapInArrow(_find, _FOUND), "found")
    seen = found.select("doc_id", "key", F.explode("seen").alias("s")).select(
        "doc_id", "key", "s.*"
    )
    accepted = bootstrapped(seen)
    extra = (
        seen.where("seed is null").join(accepted, "value")
        .where(F.array_contains("shapes", F.col("kind")))
        .groupBy(F.struct("doc_id", "key").alias("of"))
        .agg(F.collect_set(F.struct("kind", "start", "stop")).alias("extra"))
    )
    numbers = [_count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(
        "array<struct<kind: int, start: int, stop: int>>"))))
    own = F.struct("doc_id", "key")
    return (
        found.select("doc_id", "key", "base")
        .join(extra, own.eqNullSafe(extra["of"]), "left")
        .withColumn("every", every)
        .select("doc_id", *numbers, _joined("base").alias("base"), _joined("every").alias("spans"))
    )
