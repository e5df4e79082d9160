"""Benchmark passages in training text, found in an FM-index of each shard.

Test items give windows of ten words (shorter items: the whole item). Each training
shard is indexed once and every distinct window is searched in it backwards; the places
found are located by sampled suffix positions and merged to removal spans.

A window can only stand where each pair of neighbours is a pair of neighbours of some item.
The index of a shard therefore holds just the stretches of its text that are made of such
pairs and are long enough for the shortest window: the searches find the same places as in
the whole text, in a far smaller index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import no_helper, rows
from eventloom.llm.fm_index import FMIndex

WINDOW = 10
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHARD_WORDS = 1 << 22
MOST_CACHED = 200_000
#: Words of items in one broadcast; more items are searched in several passes.
PACK_WORDS = 4_000_000
SPANS = "array<struct<first_word:bigint,last_word:bigint,first_char:bigint,last_char:bigint>>"


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of ASCII digits and letters and of all non-ASCII bytes."""
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Pack:
    """Words, neighbours and windows of some items, as numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            found = [self.words.setdefault(w, len(self.words) + 2) for w in words_of(text)]
            for start in range(max(1, len(found) - window + 1) if found else 0):
                owners.setdefault(tuple(found[start : start + window]), set()).add(item)
        self.items = sorted({i for o in owners.values() for i in o})
        place = {item: i for i, item in enumerate(self.items)}
        self.phrases: dict[int, np.ndarray] = {}
        self.owners: dict[int, list[np.ndarray]] = {}
        for length in {len(w) for w in owners}:
            here = [w for w in owners if len(w) == length]
            self.phrases[length] = np.array(here, np.int64)
            self.owners[length] = [np.array(sorted(place[i] for i in owners[w])) for w in here]
        self.shortest = min(self.phrases, default=0)
        self.scale = len(self.words) + 2
        pairs = [p[:, :-1].ravel() * self.scale + p[:, 1:].ravel() for p in self.phrases.values()]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)


class ChunkNumbers(dict):
    """Word numbers of white-space chunks as bytes, remembered; 1 is any word of no item."""

    def __init__(self, words: dict[bytes, int]):
        self.words = words

    def __missing__(self, chunk: bytes) -> bytes:
        found = np.array([self.words.get(w, 1) for w in WORDS.findall(chunk.lower())], "<u4").tobytes()
        if len(self) >= MOST_CACHED:
            self.clear()
        self[chunk] = found
        return found

    def number(self, text: str | None) -> bytes:
        # Bytes are split at ASCII white space only, which no word holds.
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "surrogatepass").split()))


def stretches(numbers: np.ndarray, ends: np.ndarray, pack: Pack) -> tuple[np.ndarray, np.ndarray]:
    """[start, stop) of the maximal runs that may hold a window; ``ends`` closes each document."""
    known = numbers > 1
    linked = np.zeros(len(numbers), bool)
    at = np.nonzero(known[:-1] & known[1:])[0] if len(numbers) else np.zeros(0, np.int64)
    pair = numbers[at] * pack.scale + numbers[at + 1]
    if len(pack.pairs):
        place = np.minimum(np.searchsorted(pack.pairs, pair), len(pack.pairs) - 1)
        linked[at[pack.pairs[place] == pair]] = True
    linked[ends[ends > 0] - 1] = False
    opens = known & ~np.concatenate([[False], linked[:-1]])
    starts = np.nonzero(opens)[0]
    stops = np.nonzero(known & ~linked)[0] + 1
    long_enough = stops - starts >= pack.shortest
    return starts[long_enough], stops[long_enough]


def occurrences(numbers: np.ndarray, ends: np.ndarray, pack: Pack) -> Iterator[tuple[int, np.ndarray, list]]:
    """Per window length: length, places in the shard, and the items of each place."""
    if not pack.shortest:
        return
    starts, stops = stretches(numbers, ends, pack)
    if not len(starts):
        return
    sizes = stops - starts + 1
    offsets = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    origin = np.arange(total) - np.repeat(offsets - starts, sizes)
    closed = np.repeat(stops, sizes) == origin
    text = np.where(closed, 1, numbers[np.minimum(origin, len(numbers) - 1)])
    present, dense = np.unique(text, return_inverse=True)
    index = FMIndex(dense + 1)
    for length, phrases in pack.phrases.items():
        at = np.searchsorted(present, phrases)
        here = (at < len(present)) & (present[np.minimum(at, len(present) - 1)] == phrases)
        whole = np.nonzero(here.all(axis=1))[0]
        low, high = index.search(at[whole] + 1)
        hits = high - low
        found = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
        owner = np.repeat(whole, hits)
        yield length, origin[index.locate(found)], [pack.owners[length][o] for o in owner]


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where spans of words begin and end in the text, in code points."""
    data = text.encode("utf-8", "surrogatepass")
    found = [(m.start(), m.end()) for m in WORDS.finditer(data.lower())]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[found[a][0]]), int(chars[found[b - 1][1]])) for a, b in spans]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order; touching spans stay apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(held: Broadcast, text_col: str):
    def shard(batches: list[pa.RecordBatch], encoded: list[bytes], pack: Pack) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(e) // 4 for e in encoded], np.int64)
        ends = np.cumsum(lengths)
        numbers = np.frombuffer(b"".join(encoded), "<u4").astype(np.int64)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for length, places, owners in occurrences(numbers, ends, pack):
            docs = np.searchsorted(ends, places, side="right")
            begins = (ends - lengths)[docs]
            for doc, first, owner in zip(docs.tolist(), (places - begins).tolist(), owners):
                spans.setdefault(doc, []).append((first, first + length))
                items.setdefault(doc, set()).update(owner.tolist())
        at = 0
        for batch in batches:
            own_spans, own_items, n_words = [], [], []
            before = list(rows([batch], "_spans", "_items"))
            for i in range(batch.num_rows):
                old_spans, old_items = before[i]
                n_words.append(int(lengths[at]))
                if at in spans:
                    text = batch.column(text_col)[i].as_py()
                    old = [(s["first_word"], s["last_word"] + 1) for s in old_spans]
                    union = merged(spans[at] + old)
                    own_spans.append(
                        [
                            {"first_word": a, "last_word": b - 1, "first_char": x, "last_char": y - 1}
                            for (a, b), (x, y) in zip(union, char_spans(text, union))
                        ]
                    )
                    own_items.append(sorted(set(old_items) | {pack.items[i] for i in items[at]}))
                else:
                    own_spans.append(old_spans)
                    own_items.append(old_items)
                at += 1
            kept = batch.drop_columns(["_n_words", "_spans", "_items"])
            kinds = {name: batch.schema.field(name).type for name in ("_n_words", "_spans", "_items")}
            found = [pa.array(v, kinds[k]) for k, v in (("_n_words", n_words), ("_spans", own_spans), ("_items", own_items))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *found], [*kept.schema.names, *kinds])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_helper()
        pack = held.value
        numbers = ChunkNumbers(pack.words)
        waiting: list[pa.RecordBatch] = []
        encoded: list[bytes] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                waiting.append(part)
                encoded += [numbers.number(t) for (t,) in rows([part], text_col)]
                size += sum(map(len, encoded[-part.num_rows :])) // 4
                if size >= SHARD_WORDS:
                    yield from shard(waiting, encoded, pack)
                    waiting, encoded, size = [], [], 0
        if waiting:
            yield from shard(waiting, encoded, pack)

    return search


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", pack_words: int = PACK_WORDS,
) -> DataFrame:
    """All columns of ``docs`` with _n_words, _spans and _items.

    ``_spans`` are the merged stretches of words hit by an occurrence of a window, as
    inclusive word and character positions; ``_items`` the distinct ids, as text, whose
    windows occur. Null or wordless text has no words and no hit. Items without an id or
    words take no part, and of items with the same id all texts count as that one's.

    Items are broadcast in packs of about ``pack_words`` words, each searched in a pass of
    its own, so that a broadcast has a bound however many items there are. No pass shuffles.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    items = items.where("id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    packs = -(-total // pack_words)
    found = docs.withColumns(
        {
            "_n_words": F.lit(0).cast("bigint"),
            "_spans": F.array().cast(SPANS),
            "_items": F.array().cast("array<string>"),
        }
    )
    for pack in range(max(1, packs)):
        chosen = items.where(F.pmod(F.xxhash64("id"), F.lit(max(1, packs))) == pack)
        held = spark.sparkContext.broadcast(Pack([tuple(r) for r in chosen.collect()], window))
        found = found.mapInArrow(_search(held, text_col), found.schema)
    return found


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pack_words: int = PACK_WORDS
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found = find_passages(docs.select("doc_id", "text"), benchmark, window, pack_words=pack_words)
    hit = F.aggregate(
        "_spans", F.lit(0).cast("bigint"), lambda s, x: s + x["last_word"] - x["first_word"] + F.lit(1).cast("bigint")
    )
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")).cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def cut_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the characters of the spans, with n_chars brought up to date."""
    found = find_passages(docs, benchmark, window)
    count = F.size("_spans")
    begin = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("_spans", i - 1)["last_char"] + 1)
    stop = lambda i: F.when(i == count, F.length("text").cast("bigint")).otherwise(F.get("_spans", i)["first_char"])
    piece = lambda i: F.substring(F.col("text"), (begin(i) + 1).cast("int"), (stop(i) - begin(i)).cast("int"))
    clean = F.array_join(F.transform(F.sequence(F.lit(0), count), piece), "")
    cleaned = found.withColumn("_clean", F.when(count > 0, clean))
    new = {"text": F.coalesce("_clean", "text")}
    if "n_chars" in docs.columns:
        length = F.length("_clean").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("_clean").isNull(), F.col("n_chars")).otherwise(length)
    return cleaned.select(*[new[c].alias(c) if c in new else c for c in docs.columns])
