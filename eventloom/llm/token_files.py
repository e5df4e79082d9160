"""Token-id files in patched frame-of-reference blocks.

Ids are cut into blocks of 512. A block keeps its minimum, the width in bits that covers
nine tenths of its differences to it, the low bits of all differences packed at that
width, and an exception list (position, whole difference) for the outliers. A segment,
the unit of reading, holds the blocks of some whole documents behind an index of block
starts, so that any id can be reached without unpacking its neighbours:

    magic, ids (u64), blocks (u32) | minima u32 | widths u8 | packed starts u32
    | exception starts u32 | packed words u32 | exception positions u16 | exception values u32

Segments are stored as a binary column of a Parquet table: Spark's commit protocol then
covers them, on any file system, and a retried task leaves no half-written file.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import one_helper, rows
from eventloom.operators.running import running_totals

ROWS_IN_BLOCK, LANES = 32, 16
BLOCK = ROWS_IN_BLOCK * LANES
PERCENTILE = 90
MAGIC = b"PFOR"
HEAD = struct.Struct("<4sQI")
END_ID = 1

# --- blocks ---


def pack(ids: np.ndarray) -> bytes:
    """A segment from unsigned 32-bit ids."""
    n = len(ids)
    count = -(-n // BLOCK)
    values = np.zeros(count * BLOCK, np.uint32)
    values[:n] = ids
    values[n:] = ids[-1] if n else 0
    values = values.reshape(count, BLOCK)
    minima = values.min(axis=1) if count else np.zeros(0, np.uint32)
    deltas = values - minima[:, None]
    at = (BLOCK * PERCENTILE) // 100
    usual = np.partition(deltas, at, axis=1)[:, at] if count else minima
    widths = np.frexp(usual.astype(np.float64))[1].astype(np.uint8)
    large = deltas.astype(np.uint64) >> widths[:, None].astype(np.uint64) > 0
    block_at, place = np.nonzero(large)
    exceptions = deltas[block_at, place]
    starts = np.concatenate([[0], np.cumsum(widths.astype(np.int64) * LANES)])
    exception_starts = np.searchsorted(block_at, np.arange(count + 1))
    words = np.zeros(starts[-1], np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        chosen = np.nonzero(widths == width)[0]
        low = deltas[chosen] & np.uint32((1 << width) - 1)
        low = low.reshape(-1, ROWS_IN_BLOCK, LANES)
        out = np.zeros((len(chosen), width, LANES), np.uint32)
        for r in range(ROWS_IN_BLOCK):
            word, shift = divmod(r * width, 32)
            out[:, word] |= low[:, r] << np.uint32(shift)
            if shift + width > 32:
                out[:, word + 1] |= low[:, r] >> np.uint32(32 - shift)
        words[starts[chosen, None] + np.arange(width * LANES)] = out.reshape(len(chosen), -1)
    return b"".join(
        [
            HEAD.pack(MAGIC, n, count),
            minima.astype("<u4").tobytes(),
            widths.tobytes(),
            starts.astype("<u4").tobytes(),
            exception_starts.astype("<u4").tobytes(),
            words.astype("<u4").tobytes(),
            place.astype("<u2").tobytes(),
            exceptions.astype("<u4").tobytes(),
        ]
    )


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a segment; only their blocks are unpacked."""
    magic, n, count = HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = HEAD.size

    def take(kind: str, length: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(segment, kind, length, at)
        at += found.nbytes
        return found

    minima, widths = take("<u4", count), take("u1", count)
    starts, exception_starts = take("<u4", count + 1).astype(np.int64), take("<u4", count + 1)
    words = take("<u4", int(starts[-1]))
    place, exceptions = take("<u2", int(exception_starts[-1])), take("<u4", int(exception_starts[-1]))

    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    low_block, high_block = first // BLOCK, -(-last // BLOCK)
    deltas = np.zeros((high_block - low_block, BLOCK), np.uint32)
    inside = widths[low_block:high_block]
    for width in np.unique(inside[inside > 0]).tolist():
        chosen = np.nonzero(inside == width)[0]
        packed = words[starts[low_block + chosen, None] + np.arange(width * LANES)]
        packed = packed.reshape(-1, width, LANES)
        out = np.empty((len(chosen), ROWS_IN_BLOCK, LANES), np.uint32)
        mask = np.uint32((1 << width) - 1)
        for r in range(ROWS_IN_BLOCK):
            word, shift = divmod(r * width, 32)
            value = packed[:, word] >> np.uint32(shift)
            if shift + width > 32:
                value = value | packed[:, word + 1] << np.uint32(32 - shift)
            out[:, r] = value & mask
        deltas[chosen] = out.reshape(len(chosen), BLOCK)
    for_patch = slice(int(exception_starts[low_block]), int(exception_starts[high_block]))
    sizes = np.diff(exception_starts[low_block : high_block + 1].astype(np.int64))
    deltas[np.repeat(np.arange(high_block - low_block), sizes), place[for_patch]] = exceptions[for_patch]
    ids = (deltas + minima[low_block:high_block, None]).reshape(-1)
    return ids[first - low_block * BLOCK : last - low_block * BLOCK]


# --- encoding ---

# The tokenizer's own word pattern (fixed value), applied to one white-space chunk.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# White space to Python's split() but not to the tokenizer.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Chunks, and words, that are remembered; when there are more, those not used since the last time go.
MOST_CACHED = 400_000
# The letters of the byte level: printable bytes stand for themselves, the others for code points from 256 on.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
#: From here on characters are left to the library, which knows another version of Unicode than Python.
FOREIGN = 0x2000


class WordEncoder(dict):
    """Ids of white-space chunks as bytes, remembered; chunks never share a token here.

    White space ends a word for this tokenizer, so a text's ids are its chunks' ids in a
    row. A chunk seen for the first time is cut into words, and each new word goes through
    the library's model. Texts with white space on which Python and the tokenizer differ, and chunks
    with a special token or with a character on which they may differ, go through the whole
    library pipeline. Those below U+2000 are found by trying each one, as a part of a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.foreign = re.compile(f"[{chr(FOREIGN)}-\U0010ffff]")
        odd = [chr(c) for c in range(FOREIGN) if not chr(c).isspace() and self.differs(f"a{chr(c)}b1{chr(c)}!{chr(c)}")]
        self.foreign = re.compile("[%s%s-\U0010ffff]" % ("".join(map(re.escape, odd)), chr(FOREIGN)))

    def differs(self, chunk: str) -> bool:
        plain = unicodedata.normalize("NFC", chunk)
        return self.encoded(plain) != self.whole(chunk)

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.get(chunk)
        if found is None:
            found = self.whole(chunk) if self.is_special(chunk) else self.encoded(chunk)
        if len(self) >= MOST_CACHED:
            self.before = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def encoded(self, chunk: str) -> bytes:
        lower = chunk.lower() if chunk.isascii() else chunk.replace("Σ", "σ").lower()
        get, word = self.words.get, self.word
        return b"".join([get(w) or word(w) for w in WORDS.findall(lower)])

    def word(self, word: str) -> bytes:
        found = self.words_before.get(word)
        if found is None:
            # Letters and signs of ASCII stand for themselves on the byte level; control characters do not.
            plain = word.isascii() and word.isprintable()
            spelt = word if plain else word.encode().decode("latin-1").translate(BYTE_LETTERS)
            found = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(self.words) >= MOST_CACHED:
            self.words_before, self.words = self.words, {}
        self.words[word] = found
        return found

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in SEPARATORS):
            return self.whole(text)
        if not unicodedata.is_normalized("NFC", text):
            parts = text.split()
            return b"".join([self[p if self.is_special(p) else unicodedata.normalize("NFC", p)] for p in parts])
        return b"".join(map(self.__getitem__, text.split()))

    def is_special(self, chunk: str) -> bool:
        """Whether only the library may cut the chunk."""
        if not (chunk.isascii() and chunk.isprintable()) and self.foreign.search(chunk):
            return True
        return "<|" in chunk and any(s in chunk for s in self.special)


SEGMENT_IDS = 1 << 18
SEGMENTS = (
    "shard int, segment int, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, ids binary"
)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID,
) -> None:
    """Encodes every document, in ascending id order, and writes the segments to ``path``.

    A range of ids goes to one task, which writes its documents in order; the position of
    the range is the shard number. Null text is empty and gives the end id alone. Null ids
    come first; rows with equal ids stand in the order of their text. A document is never
    split, so a segment holds at least one and is closed once it has 2^18 ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        one = one_helper(("words", tokenizer), lambda: WordEncoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        segment, ids, lengths, parts, size = 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            packed = pack(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([size], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([packed], pa.binary()),
                ],
                ["shard", "segment", "n_ids", "doc_ids", "doc_lengths", "ids"],
            )

        for doc_id, text in rows(batches, "doc_id", "text"):
            encoded = one.encode(text or "") + end
            parts.append(encoded)
            ids.append(doc_id)
            lengths.append(len(encoded) // 4)
            size += lengths[-1]
            if size >= SEGMENT_IDS:
                yield closed()
                segment, ids, lengths, parts, size = segment + 1, [], [], [], 0
        if ids:
            yield closed()

    wanted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    in_order = wanted.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    in_order.mapInArrow(encode, SEGMENTS).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, taken from its unpacked ids."""
    segments = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("shard", "segment", "doc_ids", "doc_lengths", "ids")
        for shard, segment, doc_ids, lengths, packed in rows(batches, *columns):
            ids = unpack(packed).astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()),
                    pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
                ],
                ["shard", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )

    schema = "shard int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    # The few totals per segment are summed up over shards; the packed ids are not shuffled.
    sizes = segments.select("shard", "segment", "n_ids")
    before = running_totals(sizes, [], ["segment"], F.col("shard"), {"before": F.col("n_ids")})
    return (
        segments.mapInArrow(decode, schema)
        .join(before.select("shard", "segment", "before"), ["shard", "segment"])
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )
