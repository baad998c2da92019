"""Fill-in-the-middle reordering by counted quantifiers.

A text is a sequence of tokens, each a word with the white space before it, or white
space at the end. Counting them gives n; two cuts between 0 and n are drawn from a hash of
the document's id. One pattern is then made for each row, with the cuts as counts of
possessive groups, ``unit{a}`` and ``unit{b-a}``, and a single match of it captures prefix,
middle and suffix. Possessive groups never give a token back, so a match is one walk over
the text, without a stack that grows with it. Built-in functions only: one pass, no
shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed by the data contract: white space, the markers, the draws and their shares.
SPACE = r"\x20\x09-\x0D"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE, SUFFIX_FIRST = 50, 80

UNIT = rf"(?:[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++)"
#: psm has the prefix first, spm the suffix; plain is the text as it is.
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _draw(nth: int) -> Column:
    """The nth group of eight hexadecimal digits of ``digest`` as a number."""
    return F.conv(F.substring("digest", 8 * nth + 1, 8), 16, 10).cast("long")


def _form(text: Column, rate: int, suffix_first: int) -> Column:
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    return (
        F.when((text == "") | marked | (_draw(2) % 100 >= rate), PLAIN)
        .when(_draw(3) % 100 < suffix_first, SPM)
        .otherwise(PSM)
    )


def _pattern(first: Column, second: Column) -> Column:
    return F.concat(
        F.lit(rf"(?s)\A({UNIT}{{"), first.cast("string"),
        F.lit(rf"}}+)({UNIT}{{"), second.cast("string"), F.lit(r"}+)(.*)\z"),
    )


def _order(form: Column) -> Column:
    """Where each captured part goes."""
    return F.when(form == SPM, f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(
        f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No marker is part of it but the three."""
    whole = F.regexp_replace(
        output,
        F.when(form == SPM, rf"(?s)\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\z")
        .otherwise(rf"(?s)\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\z"),
        F.when(form == SPM, F.lit("$2$3$1")).otherwise(F.lit("$1$3$2")),
    )
    return F.when(form == PLAIN, output).otherwise(whole)


def _between(output: Column, left: str, right: str | None) -> Column:
    """Code points between two markers, or after the first of them."""
    stop = F.length(output) + 1 if right is None else F.locate(right, output)
    return (stop - F.locate(left, output) - len(left)).cast("long")


def reordered(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Each row of ``docs`` as fill-in-the-middle training text.

    Returns doc_id, n (tokens), form (plain, psm or spm), output, and prefix_chars and
    middle_chars in code points, null if plain. ``rate`` per cent of texts are reordered,
    ``suffix_first`` per cent of them with the suffix first; the draws follow from ``seed``
    and the id alone. A null text is empty; an empty one, and one that holds a marker, is
    plain. A null id draws as the empty word; repeated rows come out alike; an empty table
    gives no rows. Other columns are not read.
    """
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    drawn = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.sha2(F.concat(F.lit(f"{seed}:"), own).cast("binary"), 256).alias("digest"),
    )
    counted = drawn.select(
        "doc_id", "text", "digest",
        F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"),
        _form(F.col("text"), rate, suffix_first).alias("form"),
    )
    one, other = _draw(0) % (F.col("n") + 1), _draw(1) % (F.col("n") + 1)
    cut = counted.select(
        "doc_id", "text", "n", "form",
        F.least(one, other).alias("first"), F.greatest(one, other).alias("last"),
    )
    moved = F.regexp_replace(
        "text", _pattern(F.col("first"), F.col("last") - F.col("first")), _order(F.col("form"))
    )
    written = cut.select(
        "doc_id", "n", "form",
        F.when(F.col("form") == PLAIN, F.col("text")).otherwise(moved).alias("output"),
    )
    form, output = F.col("form"), F.col("output")
    return written.select(
        "doc_id", "n", "form", "output",
        F.when(form == PSM, _between(output, PREFIX, SUFFIX))
        .when(form == SPM, _between(output, PREFIX, MIDDLE)).alias("prefix_chars"),
        F.when(form != PLAIN, _between(output, MIDDLE, None)).alias("middle_chars"),
    )
