"""Token ids in bit-plane shuffled, compressed chunks with an index.

Documents are dealt to shards by ranges of their id and encoded in order. A shard's ids
are one stream, cut into chunks of a fixed number; a chunk is split into the four byte
planes of its 32-bit ids and the two low ones further into bit planes, so that alike
bits lie together, and each plane is compressed with zstandard. A chunk is one row: its
place, its planes, and the ends of the documents in it. The index has where each chunk
starts. The rows are written by Spark, whose commit keeps one copy of each however
often a task is tried, in any store Spark can write.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import in_parts
from tallyhouse.workspace import fresh_folder

CHUNK_IDS = 1 << 16
END_ID = 2
LEVEL = 3
#: Pieces between spaces whose ids are remembered, and the longest one that is; a full
#: memory is emptied. Neither changes a result.
REMEMBERED, LONGEST = 150_000, 48

# The rules of a tokenizer file under which texts are encoded by pieces.
PIECEWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
                "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
             "use_regex": False},
        ],
    },
}
WORD_END = "</w>"
#: Texts in which lowering ASCII capitals first could change the ids: marks that compose
#: with small letters alone, and names of special tokens.
_AS_IT_IS = r"\p{M}|<\|"
#: ASCII marks but the apostrophe, which contractions begin with, and the bar of special tokens.
_BEFORE_MARK = "([a-z0-9\u00df-\u00f6\u00f8-\u00ff])([!-&(-/:-@\\[-`{}~])"
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Bytes of plain words in UTF-8 that ByteLevel writes as another character.
_BYTE_LEVEL = {"\x9f": "\u0141", "\xa0": "\u0142", "\xad": "\u0143"}

BIT_PLANES = 16  # of the low half of an id; the high half goes by bytes

CHUNK_SCHEMA = (
    "shard int, chunk long, first long, n_ids int, planes array<binary>,"
    " doc_ids array<long>, doc_ends array<int>, open boolean"
)
_CHUNKS = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()),
    ("planes", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())),
    ("doc_ends", pa.list_(pa.int32())), ("open", pa.bool_()),
])


def pack(ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> list[bytes]:
    """The planes of some ids: 16 of bits, least first, then 2 of bytes."""
    ids = ids.astype("<u4")
    octets = ids.view(np.uint8).reshape(-1, 4)
    bits = np.unpackbits(octets[:, :2], axis=1, bitorder="little")
    planes = [np.packbits(bits[:, k], bitorder="little") for k in range(BIT_PLANES)]
    planes += [np.ascontiguousarray(octets[:, k]) for k in (2, 3)]
    return [compressor.compress(plane.tobytes()) for plane in planes]


def unpack(planes: list[bytes], n_ids: int, decompressor: zstandard.ZstdDecompressor) -> np.ndarray:
    """The ids of ``pack``."""
    raw = [np.frombuffer(decompressor.decompress(plane), np.uint8) for plane in planes]
    octets = np.empty((n_ids, 4), np.uint8)
    bits = np.stack(
        [np.unpackbits(plane, count=n_ids, bitorder="little") for plane in raw[:BIT_PLANES]], axis=1
    )
    octets[:, :2] = np.packbits(bits, axis=1, bitorder="little")
    octets[:, 2], octets[:, 3] = raw[BIT_PLANES], raw[BIT_PLANES + 1]
    return octets.view("<u4").reshape(-1)


class Encoder:
    """Ids of whole texts from a tokenizer file.

    Under the rules of ``PIECEWISE`` a tokenizer looks at no more than what lies between
    two spaces or line ends: its pattern matches within them, white space makes no ids
    and composition of characters does not cross it. So the ids of a text are those of
    its pieces in turn, and a piece that was seen before need not be encoded again. Nor
    does the pattern cross from a letter or digit to a mark of ``_BEFORE_MARK``, and capitals
    are lowered, so a space may stand there and ASCII capitals be lowered first. The rules
    leave plain words as they are but for the characters of their bytes, so these go straight
    to the model. Files with other rules have their texts encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.by_pieces = (
            all(rules[name] == rule for name, rule in PIECEWISE.items())
            and rules["model"].get("end_of_word_suffix") == WORD_END
            and all(" " not in t["content"] and t["content"].startswith("<|")
                    and not re.search(_BEFORE_MARK, t["content"], re.IGNORECASE)
                    for t in rules["added_tokens"])
        )
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        ids = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values(), default=0) + 1, bool)
        self.ends[[i for piece, i in ids.items() if piece.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = texts.fill_null("")
        if not self.by_pieces:
            yield from self._encoded(texts.to_pylist())
        elif len(texts):
            yield from self._joined(pc.split_pattern(self._tidied(texts), " "))

    @staticmethod
    def _tidied(texts: pa.Array) -> pa.Array:
        texts = pc.replace_substring(texts, "\n", " ")
        lowered = pc.if_else(
            pc.match_substring_regex(texts, _AS_IT_IS), texts, pc.ascii_lower(texts)
        )
        return pc.replace_substring_regex(lowered, _BEFORE_MARK, r"\1 \2")

    def _joined(self, split: pa.ListArray) -> Iterator[bytes]:
        """Ids of texts from those of their different pieces."""
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [piece for piece in pieces if piece not in known]
        if new:
            self._learn(new)
        found = [known[piece] for piece in pieces]
        for piece in new:
            if len(piece) > LONGEST:
                del known[piece]
        table = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        # Each id's place in the table: where its piece starts, and how far it is in it.
        at = np.repeat(starts[codes] - ends[:-1], lengths)
        at += np.arange(len(at))
        ids = table[at]
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield ids[start:end].tobytes()

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", one.ids).tobytes()

    def _modelled(self, plain: list[str]) -> bytes:
        """The ids of plain words in turn, by the model alone."""
        text = " ".join(plain).encode().decode("latin-1")
        for byte, written in _BYTE_LEVEL.items():
            text = text.replace(byte, written)
        (one,) = self.model.encode_batch_fast([text], add_special_tokens=False)
        return array("I", one.ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces; plain words are one match each, so encoded in one go."""
        plain = [piece for piece in pieces if _PLAIN.fullmatch(piece)]
        raw = self._modelled(plain)
        bounds = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) * 4 + 4
        if len(bounds) == len(plain):
            start = 0
            for piece, end in zip(plain, bounds.tolist(), strict=True):
                self.known[piece] = raw[start:end]
                start = end
        rest = [piece for piece in pieces if piece not in self.known]
        self.known.update(zip(rest, self._encoded(rest), strict=True))


def _writer(tokenizer: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer)
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        end = np.array([END_ID], "<u4").tobytes()
        held, doc_ids, ends, chunk, first = bytearray(), [], [], 0, 0

        def cut(size: int, is_open: bool) -> pa.RecordBatch:
            nonlocal chunk, first, doc_ids, ends
            ids = np.frombuffer(bytes(held[: 4 * size]), "<u4")
            row = [shard, chunk, first, size, pack(ids, compressor), doc_ids, ends, is_open]
            del held[: 4 * size]
            chunk, first, doc_ids, ends = chunk + 1, first + size, [], []
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, _CHUNKS, strict=True)], schema=_CHUNKS
            )

        for batch in in_parts(batches):
            names = batch.column(0).to_pylist()
            for name, ids in zip(names, encoder(batch.column(1)), strict=True):
                held += ids
                held += end
                while len(held) > 4 * CHUNK_IDS:
                    yield cut(CHUNK_IDS, True)
                doc_ids.append(name)
                ends.append(len(held) // 4)
                if len(held) == 4 * CHUNK_IDS:
                    yield cut(CHUNK_IDS, False)
        if held:
            yield cut(len(held) // 4, False)

    return write


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder a worker process, with what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id",
                 text: str = "text") -> str:
    """Write the ids of all texts, in ascending order of id, under ``folder``.

    ``chunks`` has the planes, ``index`` shard, chunk, first (id of the shard) and
    n_ids. Null text is empty, null ids come first, rows alike in id are ordered by
    text, an empty table writes no chunk. ``tokenizer`` is the path of a tokenizer file
    on every executor. Other columns are not read.
    """
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        chosen.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
        .select("doc_id", "text")
    )
    chunks = ordered.mapInArrow(_writer(tokenizer), CHUNK_SCHEMA)
    chunks.write.option("compression", "uncompressed").parquet(f"{folder}/chunks")
    stored_chunks(docs.sparkSession, folder).select("shard", "chunk", "first", "n_ids").write.parquet(
        f"{folder}/index"
    )
    return folder


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a shard from its chunks in order, one chunk in memory at a time."""
    decompressor = zstandard.ZstdDecompressor()
    shard, begun, crc = None, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["shard"] != shard:
                shard, begun, crc = row["shard"], 0, 0
            octets = unpack(row["planes"], row["n_ids"], decompressor).tobytes()
            at = 0
            for name, end in zip(row["doc_ids"], row["doc_ends"], strict=True):
                crc = zlib.crc32(octets[4 * at : 4 * end], crc)
                place = row["first"] + end
                out.append((shard, name, begun, place - begun, crc))
                at, begun, crc = end, place, 0
            crc = zlib.crc32(octets[4 * at :], crc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(
                zip(*out, strict=True) if out else [[]] * 5,
                [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], strict=True)],
            names=["shard", "doc_id", "within", "n_tokens", "ids_crc32"],
        )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of a token store: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; the checksum is over its ids.
    Where shards start comes from the index, one row for each in the sum.
    """
    index = spark.read.schema("shard int, chunk long, first long, n_ids int").parquet(
        f"{folder}/index"
    )
    total = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = total.select(
        F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    docs = (
        stored_chunks(spark, folder)
        .repartition("shard").sortWithinPartitions("shard", "chunk")
        .mapInArrow(_read, "shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    )
    return docs.join(bases, docs["shard"] == bases["of"]).select(
        "doc_id", (F.col("base") + F.col("within")).cast("long").alias("start"),
        "n_tokens", "ids_crc32",
    )


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of ``docs`` to a new store in the shared folder and read them back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, tokenizer, fresh_folder(spark, "tokens")))
