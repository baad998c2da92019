"""Mix sources to target weights by hash thresholds.

Each document has a ticket of 60 bits, the head of a digest of its id. A source takes
all its documents some whole number of times and, for the rest of its target, those
whose ticket lies under a threshold. The threshold comes from histograms: words are
added by source and 12 bits of the ticket, a running sum over buckets finds the one
where the budget is passed, and only that bucket is cut up further. No document is
sorted, and a source with a third of all rows is summed in every task before it is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import stored

WEIGHTS = (1, 2, 3)
CAP = 3
BITS, LEVELS = 12, 5
TICKET_BITS = BITS * LEVELS

# Fixed by the data contract.
SIZE_UNIT = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_UNIT)), F.lit(0)).cast("long")


def ticket(doc_id: Column, text: Column) -> Column:
    """60 bits of the digest of the id, or of the text where there is no id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, TICKET_BITS // 4), 16, 10).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of sources, from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at
    ``CAP`` times the source's size and its excess goes to the others by weight. The
    repeated sharing ends where a level L gives each source min(cap, L * weight);
    in ascending order of cap by weight the capped sources come first, so one running
    sum finds L. One row per source is all that meets in one task.
    """
    # Both windows take every source: its place and the running sums.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per_source.select(
        "source",
        "source_size",
        F.element_at(
            F.array(*map(F.lit, weights)),
            ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
        ).alias("weight"),
    ).withColumn("cap", F.col("source_size") * CAP)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    before = F.coalesce(
        F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    left = F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = weighed.withColumn("level", (total - before) / left).withColumn(
        "capped", F.col("cap") <= F.col("level") * F.col("weight")
    )
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return levelled.withColumn("common", level).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise(F.col("common") * F.col("weight"))
        .alias("target"),
    )


def _bucket(level: int) -> Column:
    """The ticket's bits down to a level: buckets of a level nest in those above."""
    return F.shiftright("ticket", TICKET_BITS - BITS * level)


def _boundary(tickets: DataFrame, budgets: DataFrame, level: int) -> DataFrame:
    """Per source the bucket in which its budget is passed, and what lies before it."""
    histogram = tickets.groupBy("source", _bucket(level).alias("bucket")).agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")
    )
    running = Window.partitionBy("source").orderBy("bucket")
    passed = (
        histogram.join(budgets, histogram["source"].eqNullSafe(budgets["of"]))
        .withColumn("upto", F.col("spent") + F.sum("words").over(running))
        .where("upto > budget")
        .withColumn("nth", F.row_number().over(running))
        .where("nth = 1")
    )
    return passed.select(
        "of", "budget", (F.col("upto") - F.col("words")).alias("spent"), "bucket", "words", "docs"
    )


def _within(tickets: DataFrame, bounds: DataFrame, level: int) -> DataFrame:
    edge = bounds.select("of", F.col("bucket").alias("edge"))
    return tickets.join(
        edge, tickets["source"].eqNullSafe(edge["of"]) & (_bucket(level) == F.col("edge"))
    ).select(*tickets.columns)


def thresholds(tickets: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source (of): whole copies of every document, and the ticket below which one more.

    ``tickets`` has source, ticket and size. Refinement ends when no boundary bucket
    holds more than one document, or all bits are used; rows that share a ticket go
    together. The document at the boundary is taken if that brings the sum nearer.
    """
    budgets = goals.select(
        F.col("source").alias("of"),
        F.col("source_size").alias("whole"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).alias("copies"),
        "target",
    ).withColumn("budget", F.col("target") - F.col("copies") * F.col("whole"))
    inside, level = tickets, 1
    bounds = stored(
        _boundary(inside, budgets.select("of", "budget", F.lit(0).alias("spent")), level),
        "mix-bounds",
    )
    while level < LEVELS and not bounds.where("docs > 1").isEmpty():
        inside = stored(_within(inside, bounds, level), "mix-edge")
        level += 1
        bounds = stored(
            _boundary(inside, bounds.select("of", "budget", "spent"), level), "mix-bounds"
        )
    nearer = F.col("words") < 2 * (F.col("budget") - F.col("spent"))
    below = F.shiftleft(
        F.col("bucket") + F.when(nearer, 1).otherwise(0), TICKET_BITS - BITS * level
    )
    return (
        budgets.select("of", "copies")
        .join(bounds.select(F.col("of").alias("at"), below.alias("below")),
              F.col("of").eqNullSafe(F.col("at")), "left")
        .select("of", "copies", F.coalesce("below", F.lit(0)).cast("long").alias("below"))
    )


def _shares(docs: DataFrame, doc_id: str, text: str, source: str,
            weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The narrow table of sizes, and per source (of) its target, copies and threshold."""
    sized = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            size_of(F.col(text)).alias("size"),
            ticket(F.col(doc_id), F.col(text)).alias("ticket"),
        ),
        "mix-sizes",
    )
    tickets = sized.select("source", "ticket", "size")
    goals = stored(
        targets(tickets.groupBy("source").agg(F.sum("size").alias("source_size")), weights),
        "mix-targets",
    )
    cut = thresholds(tickets, goals)
    shares = goals.join(cut, F.col("source").eqNullSafe(F.col("of"))).select(
        "of", "source_size", "target", "copies", "below"
    )
    return sized, stored(shares, "mix-shares")


def _times(its_ticket: Column) -> Column:
    more = F.when(its_ticket < F.col("below"), 1).otherwise(0)
    # Texts without words may lie below a threshold that takes no words.
    return F.least(F.col("copies") + more, F.lit(CAP).cast("long"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """How often the mix takes each row of ``docs``.

    Returns doc_id, size, source, source_size, target, times and taken (words, repeats
    counted). Null text has size 0; a null source is a source; rows alike in id (or,
    without one, in text) are taken alike; an empty table gives no rows. Other columns
    of ``docs`` are not read.
    """
    sized, shares = _shares(docs, doc_id, text, source, weights)
    times = _times(F.col("ticket")).cast("long")
    return sized.join(shares, sized["source"].eqNullSafe(shares["of"])).select(
        "doc_id", "size", "source", "source_size", "target",
        times.alias("times"), (times * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    _, shares = _shares(docs, doc_id, text, source, WEIGHTS)
    times = _times(ticket(docs[doc_id], docs[text]))
    return (
        docs.join(shares, docs[source].eqNullSafe(shares["of"]))
        .where(times > 0)
        .select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("kept"),
                F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("nth"))
        .select("kept.*")
    )
