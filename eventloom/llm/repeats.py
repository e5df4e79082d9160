"""Byte strings of a corpus that were there before, removed wherever they come again.

A string of ``LENGTH`` bytes is a repeat if an equal one starts earlier: in a document with
a smaller id, or earlier in its own. Every byte covered by a repeat goes.

1. Anchors. Of all 32-byte grams inside a string the one with the least hash is its anchor,
   the first of equals. Equal strings have equal anchors, and the strings of one anchor in
   one document start in one run: a piece of text of 100 to 168 bytes holds them all. Each
   anchor is one row: hash of the gram, hash of the piece, document, place.
2. Rows of an anchor stand together in order. If the whole piece was there before, all its
   strings are repeats. Anchors seen with more than one piece are left: there pieces may
   share some strings, at the edges of a repeated passage.
3. Those pieces, each once, are fetched from the texts and meet again by anchor. Pieces
   without a partner that also agrees on one side of the anchor are done. Of the rest, shards
   get a Burrows-Wheeler transform each, the transforms are merged by refining their
   interleave, and the common prefixes that come out give the intervals of equal strings.
4. Per document the runs of repeats are put together and cut out.

Anchors that many different pieces share (``CROWD``) would fill one task in step 3: their
strings are counted one by one instead, by hash, in an ordinary aggregate, which Spark
combines before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm import bwt_merge
from eventloom.llm.common import no_helper, rows, written

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
SIDE = 34
CROWD = 20_000
BATCH_BYTES = 1 << 20
SHARD_BYTES = 1 << 17
LOWEST = -(1 << 63)
PLACE_BITS = 24
TOGETHER = 1 << 20
FACTOR = np.int64(0x2545F4914F6CDD1D)
#: A run is packed as first start << 32, 25 bits of the text's hash << 7, count of starts.
OWN, COUNT = (1 << 25) - 1, (1 << 7) - 1


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


# --- anchors ---

MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place on."""
    eights = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    if len(eights) <= 24:
        return np.zeros(0, np.uint64)
    x = eights * MIX[0]
    x ^= x >> np.uint64(32)
    x = x[:-8] + eights[8:] * MIX[1]
    x ^= x >> np.uint64(29)
    x *= MIX[2]
    x = x[:-16] + x[16:] * MIX[3]
    x ^= x >> np.uint64(32)
    x *= MIX[0]
    x ^= x >> np.uint64(31)
    return x


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` neighbours: of a block's tail and the next one's head."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[: n - width + 1], heads[width - 1 : n])


def anchor_runs(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents put end to end: document, anchor hash, anchor's place, first and last start.

    Places are inside ``data``. Strings across two documents do not exist.
    """
    none = np.zeros(0, np.int64)
    hashes = gram_hashes(data)
    if len(hashes) < SPAN:
        return none, none, none, none, none
    places = np.arange(len(hashes), dtype=np.uint64)
    # The place below the hash makes the first of equal hashes the least.
    keys = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
    anchor = (sliding_least(keys, SPAN) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    start = np.nonzero(np.arange(len(anchor)) + LENGTH <= ends[doc])[0]
    if not len(start):
        return none, none, none, none, none
    own, at = doc[start], anchor[start]
    begins = np.nonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))[0]
    stops = np.append(begins[1:], len(start)) - 1
    return own[begins], hashes[at[begins]].view(np.int64), at[begins], start[begins], start[stops]


def document_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(ids: list, owns: list, parts: list[bytes], moved: int = 0) -> pa.RecordBatch:
        data = b"".join(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(sizes) - sizes
        doc, anchor, at, first, last = anchor_runs(data, sizes)
        digest = xxhash.xxh64_intdigest
        spans = zip(first.tolist(), (last + LENGTH).tolist(), (at - first).tolist())
        pieces = np.array([digest(data[a:b], o) for a, b, o in spans], np.uint64).view(np.int64)
        ids_, first_ = np.array(ids, np.int64)[doc], first - begin[doc] + moved
        run = first_ << 32 | np.array(owns, np.int64)[doc] << 7 | last - first + 1
        # Of equal pieces at hand only the earliest can be the first of all.
        order = np.lexsort((first_, ids_, pieces, anchor))
        head = np.ones(len(order), bool)
        head[1:] = (anchor[order][1:] != anchor[order][:-1]) | (pieces[order][1:] != pieces[order][:-1])
        leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        late = np.empty(len(order), bool)
        late[order] = (ids_[order] != ids_[leader]) | (first_[order] != first_[leader])
        # Late rows only pass through: they are not dealt out by anchor, and their run is negative.
        own_key = ((ids_ * FACTOR) ^ run) * FACTOR
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.where(late, own_key, anchor)), pa.array(pieces), pa.array(ids_),
                pa.array(np.where(late, -run, run)),
            ],
            ["anchor", "piece", "doc", "run"],
        )

    no_helper()
    ids, owns, parts, size = [], [], [], 0
    for doc, own, text in rows(batches, "doc", "own", "text"):
        data = encoded(text)
        if len(data) < LENGTH:
            continue
        if parts and size + len(data) > TOGETHER:
            yield flush(ids, owns, parts)
            ids, owns, parts, size = [], [], [], 0
        if len(data) > TOGETHER:
            # Stretches of a long document; every string lies whole in one of them.
            for start in range(0, len(data) - LENGTH + 1, TOGETHER):
                yield flush([doc], [own], [data[start : start + TOGETHER + LENGTH - 1]], start)
            continue
        ids.append(doc)
        owns.append(own)
        parts.append(data)
        size += len(data)
    if parts:
        yield flush(ids, owns, parts)


# --- pieces that share an anchor ---


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked runs of each text."""
    for text, anchor_list, doc, own in rows(batches, "text", "asked", "doc", "own"):
        data = encoded(text)
        n = len(anchor_list)
        runs = np.array([a["run"] for a in anchor_list], np.int64)
        first, count = runs >> 32, runs & COUNT
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a["anchor"] for a in anchor_list], pa.int64()), pa.array([doc] * n, pa.int64()),
                pa.array([own] * n, pa.int64()), pa.array(first),
                pa.array([data[a : a + c + LENGTH - 1] for a, c in zip(first.tolist(), count.tolist())], pa.binary()),
            ],
            ["anchor", "doc", "own", "first", "bytes"],
        )


def partnered(anchors: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Whether a piece may share a string: another of its anchor agrees on the bytes on one side.

    A string holds its anchor gram and 68 bytes more, so 34 or more on one side of it.
    """
    found = np.zeros(len(pieces), bool)
    data = b"".join(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(sizes) - sizes
    keys = gram_hashes(data)
    local = np.full(len(pieces), -1)
    # Of all grams of a piece, its anchor is the first with the anchor's hash.
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(keys)]
    at = np.nonzero(keys.view(np.int64) == anchors[owner])[0][::-1]
    local[owner[at]] = at - begin[owner[at]]
    for left in (True, False):
        place = begin + local + (-SIDE if left else GRAM)
        enough = (local >= SIDE) if left else (local >= 0) & (local + GRAM + SIDE <= sizes)
        rows_ = np.nonzero(enough)[0]
        if len(rows_) < 2:
            continue
        # 34 bytes as two overlapping grams.
        pair = keys[place[rows_]] * MIX[1] ^ keys[place[rows_] + SIDE - GRAM] if left else _right(data, place[rows_])
        group = (pair ^ anchors[rows_].view(np.uint64) * MIX[3]).view(np.int64)
        _, inverse, counts = np.unique(group, return_inverse=True, return_counts=True)
        found[rows_[counts[inverse] > 1]] = True
    return found


def _right(data: bytes, place: np.ndarray) -> np.ndarray:
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    mixed = np.zeros(len(place), np.uint64)
    for offset in (0, 8, 16, 24, SIDE - 8):
        mixed = (mixed ^ eights[place + offset]) * MIX[0]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def shared_strings(docs: np.ndarray, owns: np.ndarray, firsts: np.ndarray, pieces: list[bytes]) -> list[tuple]:
    """(doc, own, first, last): runs of starts whose string stands in an earlier place among the pieces."""
    order = np.lexsort((firsts, docs))
    data = np.frombuffer(b"".join([pieces[i] + b"\xff" for i in order]), np.uint8)
    # UTF-8 never holds 0xFF; with it as 0 and all else moved up by one, symbols fit a byte.
    data = data + np.uint8(1)
    sizes = np.array([len(pieces[i]) + 1 for i in order], np.int64)
    begin = np.cumsum(sizes) - sizes
    shard_of = begin // SHARD_BYTES
    cuts = np.append(begin[np.concatenate([[True], shard_of[1:] != shard_of[:-1]])], len(data))
    shards = [bwt_merge.transform(data[a:b]) for a, b in zip(cuts, cuts[1:])]
    at, interval = bwt_merge.repeated_intervals(shards, LENGTH)
    if not len(at):
        return []
    piece = np.searchsorted(begin, at, side="right") - 1
    doc, first = docs[order][piece], firsts[order][piece] + at - begin[piece]
    in_order = np.lexsort((first, doc))
    changes = (np.diff(doc[in_order]) != 0) | (np.diff(first[in_order]) != 0)
    place = np.empty(len(at), np.int64)
    place[in_order] = np.concatenate([[0], np.cumsum(changes)])
    earliest = np.full(interval[-1] + 1, len(at))
    np.minimum.at(earliest, interval, place)
    repeat = place > earliest[interval]
    by_piece = np.lexsort((first[repeat], piece[repeat]))
    piece, first = piece[repeat][by_piece], first[repeat][by_piece]
    if not len(piece):
        return []
    begins = np.nonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (first[1:] != first[:-1] + 1)]))[0]
    ends = np.append(begins[1:], len(piece)) - 1
    source = order[piece[begins]]
    return list(zip(docs[source].tolist(), owns[source].tolist(), first[begins].tolist(), first[ends].tolist()))


def merge_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole anchors; no anchor has more pieces than ``CROWD``."""

    def flush(chunk: pa.Table) -> pa.RecordBatch:
        anchors = chunk.column("anchor").to_numpy()
        pieces = chunk.column("bytes").to_pylist()
        kept = np.nonzero(partnered(anchors, pieces))[0] if pieces else np.zeros(0, np.int64)
        docs, owns, firsts = (chunk.column(c).to_numpy()[kept] for c in ("doc", "own", "first"))
        found = shared_strings(docs, owns, firsts, [pieces[i] for i in kept]) if len(kept) > 1 else []
        columns = list(zip(*found)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["doc", "own", "first", "last"]
        )

    waiting: list[pa.RecordBatch] = []
    size = 0
    for whole_batch in batches:
        for start in range(0, whole_batch.num_rows, 4096):
            batch = whole_batch.slice(start, 4096)
            waiting.append(batch)
            size += batch.num_rows * (LENGTH + SPAN // 2)
            if size < BATCH_BYTES:
                continue
            table = pa.Table.from_batches(waiting)
            keys = table.column("anchor").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield flush(table.slice(0, whole))
                waiting = table.slice(whole).to_batches()
                size = (table.num_rows - whole) * (LENGTH + SPAN // 2)
    if waiting:
        yield flush(pa.Table.from_batches(waiting))


def string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two 64-bit hashes of each string of each piece."""
    digest = xxhash.xxh3_128_intdigest
    for doc, own, first, data in rows(batches, "doc", "own", "first", "bytes"):
        n = len(data) - LENGTH + 1
        found = [digest(data[i : i + LENGTH]) for i in range(n)]
        halves = np.array([(h >> 64, h & 0xFFFFFFFFFFFFFFFF) for h in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([doc] * n, pa.int64()),
                pa.array([own] * n, pa.int64()), pa.array(np.arange(first, first + n)),
            ],
            ["high", "low", "doc", "own", "first"],
        )


PIECES = "anchor bigint, doc bigint, own bigint, first bigint, bytes binary"
RUNS = "doc bigint, own bigint, first bigint, last bigint"


def repeated_starts(docs: DataFrame) -> DataFrame:
    """doc, own, first, last: runs of starts of repeats. ``docs`` has doc, own and text."""
    anchors = docs.mapInArrow(document_anchors, "anchor bigint, piece bigint, doc bigint, run bigint")
    late, run = F.col("run") < 0, F.abs("run")
    by_piece = Window.partitionBy("anchor", "piece").orderBy(late, "doc", F.shiftright("run", 32))
    by_anchor = Window.partitionBy("anchor")
    is_first = (F.col("place") == 1) & ~late
    marked = (
        anchors.repartition("anchor")
        .withColumn("place", F.rank().over(by_piece))
        .withColumn("pieces", F.sum(F.when(is_first, 1).otherwise(0)).over(by_anchor))
        .where(~is_first | (F.col("pieces") > 1))
    )
    # What stays: repeats of whole pieces, and first pieces of anchors that have several.
    own = F.shiftright(run, 7).bitwiseAND(F.lit(OWN))
    marks = written(
        marked.select("anchor", "doc", own.alias("own"), run.alias("run"), is_first.alias("first"), "pieces"), "marks"
    )
    whole = marks.where("NOT first").select(
        "doc", "own", F.shiftright("run", 32).alias("first"),
        (F.shiftright("run", 32) + F.col("run").bitwiseAND(F.lit(COUNT)) - 1).alias("last"),
    )

    def pieces_of(asked: DataFrame) -> DataFrame:
        wanted = asked.groupBy("doc", "own").agg(F.collect_list(F.struct("anchor", "run")).alias("asked"))
        return docs.join(wanted, ["doc", "own"]).mapInArrow(piece_rows, PIECES)

    open_ = marks.where("first AND pieces > 1")
    few = pieces_of(open_.where(F.col("pieces") <= CROWD))
    merged = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(merge_pieces, RUNS)
    found = whole.unionByName(written(merged, "repeats"))
    crowd = open_.where(F.col("pieces") > CROWD)
    if crowd.isEmpty():
        return found
    strings = "high bigint, low bigint, doc bigint, own bigint, first bigint"
    hashed = written(pieces_of(crowd).mapInArrow(string_hashes, strings), "strings")
    earliest = hashed.groupBy("high", "low").agg(F.min(F.struct("doc", "first")).alias("earliest"))
    late = hashed.join(earliest, ["high", "low"]).where(F.struct("doc", "first") > F.col("earliest"))
    return found.unionByName(late.select("doc", "own", "first", F.col("first").alias("last")))


def kept_parts(size: int, runs: list) -> list[tuple[int, int]]:
    """[start, stop) of what remains of ``size`` bytes behind the repeats that start in the runs."""
    if not runs:
        return [(0, size)]
    spans = np.array(sorted((r["first"], r["last"] + LENGTH) for r in runs), np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    opens = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    starts = spans[opens, 0]
    stops = reach[np.append(np.nonzero(opens)[0][1:] - 1, len(spans) - 1)]
    return [(a, b) for a, b in zip([0, *stops.tolist()], [*starts.tolist(), size])]


def own_of(text: Column) -> Column:
    """Tells rows with the same id apart."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(OWN))


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_runs``: array of the runs [first, last] of starts of repeats, null if none.

    Null text is empty. A null id counts as the smallest. Rows that share an id are one
    document to the order of places: of equal strings in them only a later start is a
    repeat. Extra columns stay.
    """
    keyed = docs.withColumns(
        {
            "_doc": F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)),
            "_own": own_of(F.col(text_col)),
        }
    )
    # Equal rows have equal repeats: one of them is enough.
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("doc"),
        own_of(F.col(text_col)).alias("own"), F.col(text_col).alias("text"),
    )
    runs = repeated_starts(texts).select(F.col("doc").alias("_doc"), F.col("own").alias("_own"), "first", "last")
    by_doc = runs.groupBy("_doc", "_own").agg(F.collect_set(F.struct("first", "last")).alias("_runs"))
    return keyed.join(by_doc, ["_doc", "_own"], "left").drop("_doc", "_own")


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in rows([batch], "text", "_runs"):
                data = encoded(text)
                parts = kept_parts(len(data), runs)
                kept = b"".join([data[a:b] for a, b in parts])
                out.append((len(data), len(data) - len(kept), len(parts) - 1, hashlib.sha256(kept).hexdigest()))
            n_bytes, removed, spans, digests = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_bytes, removed, spans)),
                    pa.array(digests, pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    wanted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return with_repeats(wanted).mapInArrow(report, schema)


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the text and n_chars, if there, brought up to date.

    A cut through a character takes the rest of that character with it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = [], []
            counts = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows
            for (text, runs), n in zip(rows([batch], text_col, "_runs"), counts):
                if runs:
                    data = encoded(text)
                    parts = kept_parts(len(data), runs)
                    text = "".join([data[a:b].decode("utf-8", "ignore") for a, b in parts])
                    n = len(text)
                texts.append(text)
                lengths.append(n)
            new = {text_col: pa.array(texts, pa.string())}
            if "n_chars" in batch.schema.names:
                new["n_chars"] = pa.array(lengths, batch.schema.field("n_chars").type)
            names = [n for n in batch.schema.names if n != "_runs"]
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    marked = with_repeats(docs, text_col=text_col).select(*docs.columns, "_runs")
    return marked.mapInArrow(cut, docs.schema)
