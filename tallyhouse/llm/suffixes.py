"""Exact removal of repeated byte strings by suffix sorting in parts.

A window is every run of 200 bytes of a text. Two windows are equal only if the smallest
hash of their 64-byte grams is, so that hash, a window's key, says which windows have to be
ordered together: suffixes of the whole corpus are dealt over the cluster by it and no two
equal ones meet in different tasks. Neighbouring windows mostly share a key; such a run of
them is one piece of text, and one row, for about each 70 bytes. Pieces whose key stands
nowhere else drop out by a count, pieces with equal bytes are counted once, and only the
rest is brought to the tasks with its bytes.

There the suffixes of all pieces are sorted deep-shallow: a multikey quicksort, eight bytes
a step and all groups of a depth at once, to a shallow depth; groups that still agree have
long common prefixes, and a blind trie orders each of them, comparing a suffix with one
other only. Windows that end in one leaf are equal, byte for byte.

A key that very many different pieces share is not given to one task: its pieces are cut
into single windows, which are counted by a hash of all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import stored

#: Bytes of a repeat, fixed by the data contract.
WINDOW = 200
#: Bytes of a gram: a window has WINDOW - GRAM + 1 of them. Longer grams repeat less often
#: by chance, and make more pieces.
GRAM = 64
#: Different pieces of one key that a task may get: about 5 MB.
MOST_PIECES = 20_000
#: Depth of the quicksort; beyond it blind tries take over.
SHALLOW = 32
#: Bytes that a task sorts at a time, whole keys together.
SORTED_BYTES = 4 << 20
#: Windows of a text that are hashed at a time.
BLOCK = 1 << 20
BATCH_ROWS, BATCH_BYTES = 8_192, 8 << 20

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)
# A place is the first window of a piece and its number of windows, 32 bits each.
_WINDOWS = (1 << 32) - 1
_PLACES = "a long, b long, key long, digest long, again boolean, place long"
_BYTES = "key long, digest long, many boolean, a long, b long, place long, piece binary"
_SINGLE = "digest binary, many boolean, a long, b long, at int"
_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed string"
_REPEATED = "a long, b long, froms array<int>, tos array<int>"
_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(),
    "string": pa.string(), "array<int>": pa.list_(pa.int32()),
}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of a schema as Spark names it."""
    fields = [field.strip().split(" ") for field in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    arrays = [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _batched(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded number and bytes."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += sum(len(value) for value in row if isinstance(value, bytes))
        if len(part) == BATCH_ROWS or held > BATCH_BYTES:
            yield _rows(part, schema)
            part, held = [], 0
    if part:
        yield _rows(part, schema)


def _texts(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[tuple]:
    """Rows with their text as bytes."""
    for batch in batches:
        columns = [
            column.cast(pa.binary()) if nth == text else column
            for nth, column in enumerate(batch.columns)
        ]
        for row in range(batch.num_rows):
            yield tuple(column[row].as_py() for column in columns)


# Pieces of a text.


def _words(data: bytes) -> np.ndarray:
    """The eight bytes that begin at each place, as numbers that sort like them."""
    n = max(len(data) - 7, 0)
    return np.ndarray((n,), ">u8", data, strides=(1,)).astype(np.uint64)


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of each gram, made of those of its halves."""
    h, span = _words(data), 8
    while span < GRAM:
        h = h[:-span] * np.uint64(_MIX[0]) + h[span:] * np.uint64(_MIX[1])
        h ^= h >> np.uint64(29)
        h *= np.uint64(_MIX[3])
        h ^= h >> np.uint64(32)
        span *= 2
    return h


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _greatest(h: np.ndarray, width: int) -> np.ndarray:
    return ~_lowest(~h, width)


def _hash(piece: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)


def pieces_of(data: bytes) -> Iterator[tuple[int, bool, int, int]]:
    """Runs of windows of one key: key, again, first window, number of windows.

    ``again`` tells that the gram of the key stands in the piece more than once, without
    which no window of it equals another one.
    """
    width = WINDOW - GRAM + 1
    for first in range(0, len(data) - WINDOW + 1, BLOCK):
        h = gram_hashes(data[first : first + BLOCK + WINDOW - 1])
        keys = _lowest(h, width)
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
        # Grams that are the least of some window; equal ones of a piece are neighbours here.
        edge = np.zeros(width - 1, np.uint64)
        least = np.flatnonzero(h == _greatest(np.concatenate((edge, keys, edge)), width))
        twice = np.concatenate(([0], np.cumsum(h[least[1:]] == h[least[:-1]])))
        low = np.searchsorted(least, starts)
        high = np.searchsorted(least, stops + width - 1) - 1
        yield from zip(
            keys[starts].view(np.int64).tolist(), (twice[high] > twice[low]).tolist(),
            (first + starts).tolist(), (stops - starts).tolist(), strict=True,
        )


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of every piece."""
    found = (piece[:2] for (text,) in _texts(batches, 0) for piece in pieces_of(text))
    return _batched(found, "key long, again boolean")


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, hash of the bytes, and place of every piece."""
    found = (
        (a, b, key, _hash(text[at : at + n + WINDOW - 1]), again, at << 32 | n)
        for a, b, text in _texts(batches, 2)
        for key, again, at, n in pieces_of(text)
    )
    return _batched(found, _PLACES)


# Sorting, inside a task.


def shallow_groups(
    words: np.ndarray, at: np.ndarray, of: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (places ``at`` of key number ``of``) that agree on their first bytes.

    Returns their places, group by group, and where each group begins, with the end last.
    A multikey quicksort that takes eight bytes for a character and sorts the groups of one
    depth together; a suffix that is alone in its group needs no further look.
    """
    group = of
    for depth in range(0, SHALLOW, 8):
        character = words[at + depth]
        order = np.lexsort((character, group))
        at, group, character = at[order], group[order], character[order]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (character[1:] != character[:-1])
        alone = new & np.append(new[1:], True)
        at, group = at[~alone], np.cumsum(new)[~alone]
        if not len(at):
            break
    return at, np.flatnonzero(np.diff(group, prepend=-1, append=-1))


class BlindTrie:
    """Suffixes by the bytes at which they part; those with equal windows share a leaf.

    A node is [depth, {byte: child}], a leaf the list of its places. The trie keeps no
    other bytes: a new suffix goes down by the bytes at the nodes' depths alone, is
    compared with the leaf it comes to, and is hung in where the two part.
    """

    def __init__(self, data: bytes, place: int) -> None:
        self.data = data
        self.root: list = [place]
        self.top = 0  # 0: a leaf

    def leaves(self) -> Iterator[list[int]]:
        stack = [(self.root, self.top)]
        while stack:
            node, inner = stack.pop()
            if inner:
                stack.extend(node[1].values())
            else:
                yield node

    def add(self, place: int) -> None:
        data = self.data
        node, inner = self.root, self.top
        while inner:
            kids = node[1]
            node, inner = kids.get(data[place + node[0]]) or next(iter(kids.values()))
        own, other = data[place : place + WINDOW], data[node[0] : node[0] + WINDOW]
        if own == other:
            node.append(place)
            return
        differ = int.from_bytes(own) ^ int.from_bytes(other)
        depth = WINDOW - (differ.bit_length() + 7) // 8
        above, node, inner = None, self.root, self.top
        while inner and node[0] < depth:
            above = node
            node, inner = node[1][own[node[0]]]
        if inner and node[0] == depth:
            node[1][own[depth]] = ([place], 0)
            return
        parted = [depth, {own[depth]: ([place], 0), other[depth]: (node, inner)}]
        if above is None:
            self.root, self.top = parted, 1
        else:
            above[1][own[above[0]]] = (parted, 1)


def repeated_places(data: bytes, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places whose window also begins at another of the places of the same key number."""
    at, begins = shallow_groups(_words(data), at, of)
    if not len(at):
        return at
    sizes = np.diff(begins)
    # The blind trie of two suffixes is one comparison.
    one = begins[:-1][sizes == 2]
    one, other = at[one], at[one + 1]
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    same = np.ones(len(one), bool)
    for depth in range(SHALLOW, WINDOW, 8):
        same &= words[one + depth] == words[other + depth]
    found = [one[same], other[same]]
    for nth in np.flatnonzero(sizes > 2).tolist():
        first, *others = at[begins[nth] : begins[nth + 1]].tolist()
        trie = BlindTrie(data, first)
        for place in others:
            trie.add(place)
        found.extend(np.array(leaf) for leaf in trie.leaves() if len(leaf) > 1)
    return np.concatenate(found)


def _repeats(part: list[tuple]) -> pa.RecordBatch:
    """Of each piece that stands once, the runs of its windows that begin elsewhere too."""
    data = b"".join(row[-1] for row in part)
    begins = np.cumsum([0, *(len(row[-1]) for row in part)])
    windows = np.diff(begins) - WINDOW + 1
    numbers = {key: nth for nth, key in enumerate(dict.fromkeys(row[0] for row in part))}
    of = np.repeat([numbers[row[0]] for row in part], windows)
    at = np.arange(windows.sum()) + np.repeat(begins[:-1] - np.cumsum(windows) + windows, windows)
    marked = np.zeros(len(data) + 1, bool)
    marked[repeated_places(data, at, of)] = True
    # No run goes on into the next piece: a piece ends with bytes at which no window begins.
    edges = np.flatnonzero(np.diff(marked, prepend=False))
    starts, stops = edges[::2], edges[1::2]
    own = np.searchsorted(starts, begins)
    out = []
    for nth, (_, _, many, a, b, place, _) in enumerate(part):
        low, high = own[nth], own[nth + 1]
        if high > low and not many:
            first = (place >> 32) - begins[nth]
            out.append((a, b, (starts[low:high] + first).tolist(),
                        (stops[low:high] + first).tolist()))
    return _rows(out, _REPEATED)


def _sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces ordered by key and digest; one that comes again is of a repeated row."""
    part: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part and row[:2] == part[-1][:2]:
                continue
            if held >= SORTED_BYTES and row[0] != part[-1][0]:
                yield _repeats(part)
                part, held = [], 0
            part.append(row)
            held += len(row[-1])
    if part:
        yield _repeats(part)


# What is brought to the tasks, and what is cut.


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked pieces of each text."""
    found = (
        (p["key"], p["digest"], p["many"], a, b, p["place"],
         text[(p["place"] >> 32) : (p["place"] >> 32) + (p["place"] & _WINDOWS) + WINDOW - 1])
        for a, b, text, asked in _texts(batches, 2)
        for p in asked
    )
    return _batched(found, _BYTES)


def _singly(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the asked pieces, each with 128 bits that tell it from others."""
    found = (
        (hashlib.blake2b(text[at : at + WINDOW], digest_size=16).digest(), p["many"], a, b, at)
        for a, b, text, asked in _texts(batches, 2)
        for p in asked
        for at in range(p["place"] >> 32, (p["place"] >> 32) + (p["place"] & _WINDOWS))
    )
    return _batched(found, _SINGLE)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that touch or overlap are one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _kept(doc_id: int | None, text: bytes, froms: list | None, tos: list | None) -> tuple:
    windows = zip(_joined(froms), _joined(tos), strict=True)
    spans = merged((start, stop + WINDOW - 1) for start, stop in windows)
    edges = [0, *(edge for span in spans for edge in span), len(text)]
    kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
    removed = ",".join(f"{start}:{stop}" for start, stop in spans)
    return doc_id, len(text), len(text) - len(kept), len(spans), kept, removed


def _joined(lists: list[list[int]] | None) -> list[int]:
    return [value for each in lists or () for value in each]


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched((_kept(*row) for row in _texts(batches, 1)), _KEPT)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs`` without the bytes that a repeated 200-byte string covers.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining
    bytes, which may begin or end inside a character) and removed (``start:end`` in bytes,
    ends exclusive, joined by commas). A string is repeated if it begins at two places of
    the table, in one row or in two; all its places are removed, the first as well. A null
    text is empty, and texts of fewer than 200 bytes have no such string. Copies lose
    everything, repeated rows too, since they are copies. An empty table gives no rows.
    Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = (F.col(doc_id).isNull(), F.col(doc_id), body)
    # Rows are known by 128 bits; alike in both columns, they are alike in the result.
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"),
        F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("other"), *own).alias("b"),
    )
    long_rows = rows.where(F.octet_length("text") >= WINDOW).select("a", "b", "text")

    common = stored(
        long_rows.select("text").mapInArrow(_keys, "key long, again boolean")
        .groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
        .where("n > 1 or again").select("key"),
        "suffix-keys",
    )
    places = stored(
        long_rows.mapInArrow(_places, _PLACES).join(common, "key", "left_semi"), "suffix-places"
    )
    pieces = stored(
        places.groupBy("key", "digest").agg(
            F.count(F.lit(1)).alias("n"), F.max("again").alias("again"),
            F.min(F.struct("a", "b", "place")).alias("at"),
        ),
        "suffix-pieces",
    )
    # Equal pieces are repeated as a whole. Others of one key have to be ordered, with the
    # equal ones among them, and so has a piece that may repeat itself.
    whole = places.join(pieces.where("n > 1").select("key", "digest"), ["key", "digest"]).select(
        "a", "b", *_range("place")
    )
    keys = stored(
        pieces.groupBy("key").agg(
            F.count(F.lit(1)).alias("different"), F.count_if(F.col("n") == 1).alias("once"),
            F.max("again").alias("again"),
        ).where("once > 0 and (different > 1 or again)").select("key", "different"),
        "suffix-orders",
    )
    found = whole.unionByName(
        _asked(long_rows, pieces, keys.where(F.col("different") <= MOST_PIECES))
        .mapInArrow(_extract, _BYTES)
        .repartition("key").sortWithinPartitions("key", "digest")
        .mapInArrow(_sort, _REPEATED)
    )
    hot = keys.where(F.col("different") > MOST_PIECES)
    if not hot.isEmpty():
        found = found.unionByName(_counted(long_rows, pieces, hot))
    ranges = found.groupBy("a", "b").agg(
        F.collect_set(F.struct("froms", "tos")).alias("found")
    )
    return (
        rows.join(ranges, ["a", "b"], "left")
        .select("doc_id", "text", "found.froms", "found.tos")
        .mapInArrow(_cut, _KEPT)
    )


def _range(place: str) -> list[Column]:
    first = F.shiftright(place, 32).cast("int")
    return [F.array(first).alias("froms"),
            F.array(first + F.col(place).bitwiseAND(_WINDOWS).cast("int")).alias("tos")]


def _asked(rows: DataFrame, pieces: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with one place of each different piece of the keys."""
    asked = (
        pieces.join(keys.select("key"), "key")
        .groupBy(F.col("at.a").alias("a"), F.col("at.b").alias("b"))
        .agg(F.collect_list(
            F.struct("key", "digest", (F.col("n") > 1).alias("many"), "at.place")
        ).alias("asked"))
    )
    return rows.join(asked, ["a", "b"]).select("a", "b", "text", "asked")


def _counted(rows: DataFrame, pieces: DataFrame, keys: DataFrame) -> DataFrame:
    """Repeated windows of keys with too many pieces for a task, window by window."""
    windows = stored(
        _asked(rows, pieces, keys).mapInArrow(_singly, _SINGLE).distinct(), "suffix-windows"
    )
    common = stored(
        windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("digest"),
        "suffix-windows",
    )
    return windows.where("not many").join(common, "digest").select(
        "a", "b", F.array("at").alias("froms"), F.array(F.col("at") + 1).alias("tos")
    )
