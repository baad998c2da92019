"""Benchmark decontamination: windows of words that also occur in a test item.

The windows of the benchmark are hashed into a set that is broadcast when it is known
to be small; each window of a document is hashed as it is scanned, and only those in
the set go on to be compared word by word. One pass over the documents, in built-in
functions; what is shuffled is one row per document and one per hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import sent_if_small, stored, text_key, word_array

WINDOW = 13
# Two longs and a pointer each in the broadcast set: about 40 MB. Beyond it the join
# is left to Spark, which shuffles both sides.
BROADCAST_WINDOWS = 1_000_000
#: A document is contaminated from this share of its words on: one in twenty.
SHARE = 20


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, words, hash, length) of each window; a short item is one window."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        word_array(F.col(text)).alias("all"),
    ).where(F.size("all") > 0)
    length = F.least(F.size("all"), F.lit(WINDOW))
    spread = items.select(
        "item", "all", length.alias("length"),
        F.explode(F.sequence(F.lit(1), F.size("all") - length + 1)).alias("at"),
    )
    words = F.slice("all", F.col("at"), F.col("length"))
    return spread.select("item", words.alias("words"), "length").distinct().withColumn(
        "hash", F.xxhash64("words")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """What each row of ``docs`` shares with the benchmark.

    Returns doc_id, key (of the text), n_words, n_hit, n_items, items (sorted ids),
    contaminated, and spans (array of [first, end) word positions of the windows that
    occur). Null or wordless texts have no words and no hits, an empty benchmark hits
    nothing, repeated rows come back as often as they are there, a null item id is an
    empty one. Other columns are not read.
    """
    windows = stored(benchmark_windows(benchmark, item_id, item_text), "test-windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    known = windows.select("hash").distinct()
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    texts = docs.select(
        F.col(doc_id).alias("doc_id"),
        text_key(F.col(text)).alias("key"),
        word_array(F.col(text)).alias("words"),
    )
    scanned = None
    for nth, length in enumerate(lengths or [WINDOW]):
        # Position 0 stands for the document itself, so that one scan gives both.
        last = F.size("words") - length + 1
        places = F.when(last >= 1, F.sequence(F.lit(0 if nth == 0 else 1), last))
        places = F.coalesce(places, F.array(F.lit(0)) if nth == 0 else F.lit(None))
        spread = texts.select("doc_id", "key", "words", F.explode(places).alias("at"))
        window = F.slice("words", F.greatest("at", F.lit(1)), length)
        hashed = spread.withColumn("code", F.when(F.col("at") > 0, F.xxhash64(window)))
        found = hashed.join(known, hashed["code"] == known["hash"], "left").where(
            F.col("hash").isNotNull() | (F.col("at") == 0)
        ).select(
            "doc_id", "key",
            F.when(F.col("at") == 0, F.size("words")).alias("n_words"),
            # Documents' own rows have no window to meet; a code of their own spreads them.
            "at", F.coalesce("code", F.xxhash64("doc_id", "key")).alias("code"),
            F.when(F.col("at") > 0, window).alias("window"),
        )
        scanned = found if scanned is None else scanned.unionByName(found)
    return _summed(scanned, windows)


def _summed(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per document from its own row and its hits."""
    # Stored, so that both sides of the join are shuffled for it alone and Spark can split
    # the rows of a window that occurs very often.
    items = stored(
        windows.groupBy("hash", "words").agg(F.collect_set("item").alias("items")), "test-items"
    )
    verified = scanned.join(
        items, (scanned["code"] == items["hash"]) & (scanned["window"] == items["words"]), "left"
    ).where((F.col("at") == 0) | F.col("words").isNotNull()).select(
        "doc_id", "key", "n_words", "at", (F.col("at") + F.size("words")).alias("end"), "items"
    )
    by_doc = Window.partitionBy("doc_id", "key").orderBy("at", "end")
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    hit = F.col("at") > 0
    fresh = F.col("end") - F.greatest("at", F.coalesce(reach, F.lit(0)))
    covered = verified.withColumn(
        "fresh", F.when(hit, F.greatest(F.lit(0), fresh)).otherwise(0)
    )
    return (
        covered.groupBy("doc_id", "key")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.sum("fresh").cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            F.array_sort(F.collect_set(F.when(hit, F.struct(
                (F.col("at") - 1).alias("first"), (F.col("end") - 1).alias("end"))))
            ).alias("spans"),
            F.count(F.when(~hit, 1)).alias("rows"),
        )
        .select(
            "doc_id", "key", "n_words", "n_hit",
            F.size("items").cast("long").alias("n_items"), "items",
            ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
            .alias("contaminated"),
            "spans",
            F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("nth"),
        )
        .drop("nth")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    judged = contamination(docs, benchmark).where("contaminated")
    bad = stored(judged.select("doc_id", "key").distinct(), "contaminated").select(
        F.struct(F.col("doc_id"), F.col("key")).alias("bad")
    )
    own = F.struct(docs["doc_id"].alias("doc_id"), text_key(docs["text"]).alias("key"))
    return docs.join(sent_if_small(bad), own.eqNullSafe(bad["bad"]), "left_anti")
