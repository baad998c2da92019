"""Similarity join on sets of word shingles, with Bayesian pruning of candidates.

1. Every text becomes its set of five-word shingles, a digest of the set and a MinHash
   signature. Texts with equal sets are copies; one of them stands for all.
2. Sets that agree in all hashes of a band share a bucket. A bucket is compared in
   tiles of bounded size. Pairs compare their signatures a step at a time and leave as
   soon as the posterior probability that they reach the threshold falls under a
   tolerance. What is left only says which sets may belong together: a spanning
   forest of each tile, joined to components.
3. Each component is compared once more in tiles, pruned likewise, and what remains is
   verified on the sets themselves. A tile gives the number of links of each of its
   texts and a spanning forest of the links, never the pairs.

The band hashes miss a pair at the threshold with a chance of (1 - t^4)^32, 5e-8 at
0.8, and the pruning with about the tolerance; every reported link is exact. Comparing
the texts of one near-copy group is quadratic in its different texts, in tiles that
any number of tasks share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import (
    SHINGLE_WORDS,
    SIMILARITY,
    components,
    in_parts,
    runs,
    sent_if_small,
    stored,
    text_key,
)

HASHES, BAND = 128, 4
BANDS = HASHES // BAND
STEP = 32
TOLERANCE = 1e-6
#: Texts on each side of a tile: where only signatures are compared, and where the sets
#: themselves are.
CANDIDATE_BLOCK, BLOCK = 2_048, 256
#: Words whose hashes a worker remembers; a full memory is emptied.
REMEMBERED = 40_000

# Bytes of words as they are, capitals lowered, all others blanks: the word rule of
# ``common.WORD`` on UTF-8.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_MIX = np.random.default_rng(20240229)
_XOR = _MIX.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _MIX.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_WORDS = _WordHashes()


def words_of(text: str) -> list[bytes]:
    """The words of a text: ASCII letters, digits and characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def shingle_set(text: str, length: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit codes of the runs of ``length`` words; of all words if fewer."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    codes = np.array([_WORDS[word] for word in words], np.uint64)
    width = min(length, len(codes))
    out = codes[: len(codes) - width + 1].copy()
    for nth in range(1, width):
        out *= _BASE
        out += codes[nth : len(codes) - width + 1 + nth]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> bytes:
    """The low 16 bits of each of the least hashes."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        hashed = (short[at : at + 512, None] ^ _XOR) * _ODD
        np.minimum(low, hashed.min(axis=0), out=low)
    return (low & np.uint32(0xFFFF)).astype("<u2").tobytes()


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """Per number of compared hashes, the fewest equal ones a pair may stay with.

    With a flat prior the posterior of the similarity after m of n is a beta
    distribution, and its mass from t on is the chance that n + 1 trials at t succeed
    at most m times.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def plausible(x: int, others: np.ndarray, signatures: np.ndarray, least: dict) -> np.ndarray:
    """Those of ``others`` that may reach the threshold with ``x``."""
    matches = np.zeros(len(others), np.int32)
    for n, need in least.items():
        part = slice(n - STEP, n)
        matches += (signatures[others, part] == signatures[x, part]).sum(axis=1, dtype=np.int32)
        stay = matches >= need
        others, matches = others[stay], matches[stay]
        if not len(others):
            break
    return others


_SETS = "doc_id long, key struct<a: long, b: long>, set_key binary, n int, signature binary"


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        keys, sizes, marks = [], [], []
        for text in batch.column(2).to_pylist():
            shingles = shingle_set(text or "")
            empty = not len(shingles)
            keys.append(None if empty else hashlib.blake2b(shingles, digest_size=16).digest())
            sizes.append(len(shingles))
            marks.append(None if empty else signature(shingles))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()),
             pa.array(sizes, pa.int32()), pa.array(marks, pa.binary())],
            names=["doc_id", "key", "set_key", "n", "signature"],
        )


def _tiles(block: Column, blocks: Column) -> Column:
    """The tiles a block takes part in: with itself and with each other block."""
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(
            F.least(block, other).alias("i"), F.greatest(block, other).alias("j")
        ),
    )


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("set_key"), blocks).cast("int")


def _blocks(texts: int) -> Column:
    """How many blocks a group of ``size`` has."""
    return F.ceil(F.col("size") / texts).cast("int")


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ([], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"]
    )


def _forest(threshold: float, tolerance: float):
    """Edges that span what a bucket's tile holds of plausible pairs."""
    least = least_matches(threshold, tolerance)

    def span(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for _, rows in runs(batches, 1):
            keys = [key for key, _ in rows]
            marks = np.frombuffer(b"".join(m for _, m in rows), "<u2").reshape(-1, HASHES)
            left = np.arange(len(keys))
            while len(left):
                root, front, left = left[0], [left[0]], left[1:]
                while front and len(left):
                    near = plausible(front.pop(), left, marks, least)
                    if len(near):
                        left = np.setdiff1d(left, near, assume_unique=True)
                        front.extend(near)
                        out.extend((keys[root], keys[n]) for n in near)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return span


def _candidates(sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Components (node, label) of sets that may be linked."""
    banded = sets.select(
        "set_key", "signature", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    ).select(
        "set_key",
        F.xxhash64(
            "band", F.expr(f"substring(signature, band * {2 * BAND} + 1, {2 * BAND})")
        ).alias("bucket"),
    )
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = _blocks(CANDIDATE_BLOCK)
    tiled = banded.join(sizes, "bucket").select(
        "bucket", "set_key", F.explode(_tiles(_block(blocks), blocks)).alias("t")
    )
    # The same texts meet in many bands; each list of members is compared once.
    groups = (
        tiled.groupBy("bucket", "t").agg(F.array_sort(F.collect_list("set_key")).alias("members"))
        .where(F.size("members") > 1).select("members").distinct()
    )
    members = groups.select(
        F.md5(F.array_join(F.transform("members", F.hex), "")).alias("g"),
        F.explode("members").alias("set_key"),
    )
    edges = (
        members.join(sets.select("set_key", "signature"), "set_key")
        .select("g", "set_key", "signature")
        .repartition("g").sortWithinPartitions("g", "set_key")
        .mapInArrow(_forest(threshold, tolerance), "a binary, b binary")
    )
    return components(edges, "near")


def _linked(threshold: float, tolerance: float):
    """Per text of a tile its number of links there and the least text they lead to."""
    least = least_matches(threshold, tolerance)

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, bytes]] = []
        for (_, tile), rows in runs(batches, 2):
            keys = [row[0] for row in rows]
            side = np.array([row[1] for row in rows])
            marks = np.frombuffer(b"".join(row[2] for row in rows), "<u2").reshape(-1, HASHES)
            sets = [set(shingle_set(row[3]).tolist()) for row in rows]
            links = np.zeros(len(rows), np.int64)
            parent = list(range(len(rows)))

            def top(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            every = np.arange(len(rows))
            for x in range(len(rows)):
                after = every[x + 1 :]
                if tile["i"] != tile["j"]:
                    after = after[side[after] != side[x]]
                for y in plausible(x, after, marks, least):
                    small, large = sorted((sets[x], sets[y]), key=len)
                    if len(small) < threshold * len(large):
                        continue
                    both = len(small & large)
                    if both >= threshold * (len(small) + len(large) - both):
                        links[x] += 1
                        links[y] += 1
                        a, b = sorted((top(x), top(y)))
                        parent[b] = a
            out.extend((keys[x], int(links[x]), keys[top(x)]) for x in range(len(rows)))
            if len(out) > 10_000:
                yield _found(out)
                out = []
        yield _found(out)

    return verify


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.int64(), pa.binary()],
                                        strict=True)],
        names=["node", "links", "root"],
    )


def similarity_join(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = SIMILARITY,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """The class of each row of ``docs`` under links of similar texts.

    Returns doc_id, key (of the text), class_id (the least doc_id of those that links
    and copies join to this one), n_links (the number of other shingle sets, copies not
    counted, with a Jaccard similarity of ``threshold`` or more), set_key (the digest of
    its set) and label (the least set_key of its class). A text of
    fewer than five words is one shingle. A null or wordless text is in no class but
    its own: its class_id is its doc_id and it has no links. Repeated rows are copies,
    rows without an id take part, an empty table gives no rows.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = texts.withColumn("key", text_key(F.col("text")))
    marked = stored(
        keyed.select("doc_id", "key", "text").mapInArrow(_signatures, _SETS), "sets"
    )
    sets = stored(
        marked.where("set_key is not null").groupBy("set_key").agg(
            F.min(F.struct("doc_id", "key")).alias("first"),
            F.min("doc_id").alias("least_id"),
            F.max("signature").alias("signature"),
        ),
        "distinct-sets",
    )
    near = stored(_candidates(sets, threshold, tolerance), "near")
    sizes = near.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    chosen = (
        near.join(sizes, "label").join(sets, near["node"] == sets["set_key"])
        .select("label", "size", "set_key", "signature", "first")
    )
    row = F.struct("doc_id", "key")
    with_text = (
        keyed.select(row.alias("row"), "text")
        .join(chosen, F.col("row").eqNullSafe(F.col("first")))
        .groupBy("label", "size", "set_key", "signature").agg(F.max("text").alias("text"))
    )
    blocks = _blocks(BLOCK)
    tiles = with_text.select(
        "label", F.explode(_tiles(_block(blocks), blocks)).alias("tile"),
        "set_key", _block(blocks).alias("block"), "signature", "text",
    )
    found = stored(
        tiles.repartition("label", "tile").sortWithinPartitions("label", "tile", "set_key")
        .mapInArrow(_linked(threshold, tolerance), "node binary, links long, root binary"),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(
        found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")),
        "linked",
    )
    label = F.coalesce("label", "set_key")
    labelled = sets.join(joined, sets["set_key"] == joined["node"], "left").select(
        "set_key", "least_id", label.alias("label")
    )
    least_ids = labelled.groupBy("label").agg(F.min("least_id").alias("class_id"))
    classes = (
        labelled.join(least_ids, "label")
        .join(links, labelled["set_key"] == links["node"], "left")
        .select(F.col("set_key").alias("of"), "label", "class_id",
                F.coalesce("links", F.lit(0)).alias("n_links"))
    )
    # Wordless texts meet no class; a key of their own, longer than a digest, spreads them.
    alone = F.concat(F.lit("no words "), F.hex(F.xxhash64("doc_id", "key"))).cast("binary")
    lone = marked.withColumn("own", F.coalesce("set_key", alone))
    return lone.join(classes, lone["own"] == classes["of"], "left").select(
        "doc_id", "key",
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
        .alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "set_key", "label",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without all but the first of each class.

    The first has the least doc_id, null last, then the least text key; of rows that
    repeat it one stays. Wordless texts all stay.
    """
    classed = stored(similarity_join(docs), "classes")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    worded = classed.where("label is not null").withColumn("place", place)
    firsts = worded.groupBy("label").agg(F.min("place").alias("first"))
    rows = worded.groupBy("label", "place").agg(F.count(F.lit(1)).alias("rows"))
    dropped = stored(
        rows.join(firsts, "label")
        .where("place != first or rows > 1")
        .select(F.struct("place.doc_id", "place.key").alias("row"),
                (F.col("place") == F.col("first")).alias("once")),
        "dropped",
    )
    own = F.struct(docs["doc_id"].alias("doc_id"), text_key(docs["text"]).alias("key"))
    singles = docs.join(sent_if_small(dropped), own.eqNullSafe(dropped["row"]), "left_anti")
    repeated = (
        docs.join(sent_if_small(dropped.where("once")), own.eqNullSafe(dropped["row"]), "left_semi")
        .select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("kept"), own.alias("row"))
        .groupBy("row").agg(F.first("kept").alias("kept")).select("kept.*")
    )
    return singles.unionByName(repeated)
