"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut into chunks that no piece crosses: a run of spaces with what follows it, or a
line break. In a chunk, pairs of neighbouring symbols that make a piece are candidates on
an agenda, best score first, then from the left. A candidate is skipped for good if a
hash of the seed, the document, the chunk's place in it, the candidate's place and its two
symbols falls below the dropout; else it is merged and its new neighbours become candidates.
The hash alone decides, so a retried task gives the same ids, and a skip can be known when a
candidate first appears. Every occurrence of a word draws all of its candidates anew.

What a short chunk becomes is remembered by the candidates that were skipped: until the first
skip all occurrences run alike, and from there on those with the same skip do. So only draws are
made per occurrence, for many at once, and each way to cut a chunk is worked out once. Longer chunks
are worked off together, one merge of each at a time; the longest by a heap.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from eventloom.llm.common import one_helper

SPACE = "▁"
CHUNKS = re.compile(r" *[^ \n]+| +|\n")
NEVER = np.int32(2**31 - 1)
WIDTHS = [4, 6, 8, 10, 12, 16, 24, 48]
MOST_CACHED = 300_000
#: Longest chunk that is remembered by its skips, and the largest dropout for which that pays.
REMEMBERED = 16
RARE = 0.2
#: What occurs less often in a batch is worked off for its occurrence alone.
OFTEN = 4
AT_ONCE = 1 << 18
#: Occurrences whose candidates are drawn together.
DRAWN = 1 << 12
SYMBOL_BITS = 22
SLOT_BITS = 21
FACTORS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@dataclass(frozen=True)
class Dropout:
    share: float = 0.1
    seed: int = 0


def mixed(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= FACTORS[1]
    y ^= y >> np.uint64(27)
    y *= FACTORS[2]
    y ^= y >> np.uint64(31)
    return y


class Pieces:
    """The model's pieces as tables: symbols of characters, ranks of pairs, bytes of ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [
            i for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        text = {i: model.id_to_piece(i) for i in normal}
        self.ids = {piece: i for i, piece in text.items()}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # Symbols below ``size`` are piece ids; a character that is no piece is size + its code.
        self.size = size
        by_score = sorted({model.get_score(i) for i in normal}, reverse=True)
        rank_of = {score: r for r, score in enumerate(by_score)}
        pairs: dict[int, tuple[int, int]] = {}
        for i, piece in text.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol(piece[:cut]), self.symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << SYMBOL_BITS | right] = (rank_of[model.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.taken = np.zeros(1 << SLOT_BITS, bool)
        self.taken[self.slot(self.keys)] = True
        # Symbol of each character; one that looks like the space mark stays a character of its own.
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + size
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.symbol_of[ord(piece)] = i
        self.symbol_of[ord(" ")] = self.ids.get(SPACE, size + ord(SPACE))

    def symbol(self, text: str) -> int | None:
        found = self.ids.get(text)
        return found if found is not None else self.size + ord(text) if len(text) == 1 else None

    def symbols(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all chunks end to end, and their counts."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        return self.symbol_of[codes], np.fromiter(map(len, chunks), np.int64, len(chunks))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs; NEVER where there is none."""
        wanted = np.where((left >= 0) & (right >= 0), left.astype(np.int64) << SYMBOL_BITS | right, -1)
        rank, merged = np.full(wanted.shape, NEVER), np.zeros(wanted.shape, np.int32)
        # Most pairs make no piece; nearly all of these are told by their slot alone.
        maybe = np.nonzero(self.taken[self.slot(wanted)])
        wanted = wanted[maybe]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        rank[maybe], merged[maybe] = np.where(self.keys[at] == wanted, self.ranks[at], NEVER), self.merged[at]
        return rank, merged

    @staticmethod
    def slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * FACTORS[0]) >> np.uint64(64 - SLOT_BITS)

    def spelt(self, symbols: list[int]) -> list[int]:
        """Ids; characters that are no piece become their bytes."""
        if max(symbols, default=0) < self.size:
            return symbols
        out: list[int] = []
        for s in symbols:
            out += [s] if s < self.size else [self.byte_ids[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass")]
        return out


@functools.lru_cache(maxsize=1)
def piece_bytes(path: str) -> list[bytes]:
    """What each id stands for in a text; nothing for control pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [
        bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i)
        else b"" if model.is_control(i) or model.is_unknown(i)
        else model.id_to_piece(i).replace(SPACE, " ").encode()
        for i in range(model.get_piece_size())
    ]


def decoded(ids: np.ndarray, table: list[bytes]) -> str:
    """The text of ids, without the leading space."""
    return b"".join(map(table.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def skipped(key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    """Whether the hash of a candidate falls below the dropout."""
    if share <= 0:
        return np.zeros(np.shape(left), bool)
    if share >= 1:
        return np.ones(np.shape(left), bool)
    pair = (left.astype(np.int64) << SYMBOL_BITS | right).astype(np.uint64)
    chance = mixed(mixed(pair * FACTORS[0] + place.astype(np.uint64)) ^ key)
    return chance < np.uint64(int(share * 2**64))


def merge_short(pieces: Pieces, symbols: np.ndarray, keys: np.ndarray, share: float) -> np.ndarray:
    """Agenda processing of many chunks side by side: each takes its best candidate a round.

    A row holds a chunk's symbols, then -1, at least once; so do the rows that come back.
    """
    width = symbols.shape[1]
    places = np.broadcast_to(np.arange(width, dtype=np.int32), symbols.shape).copy()

    def candidates(left, right, place, key):
        rank, merged = pieces.look_up(left, right)
        live = rank < NEVER
        rank[live] = np.where(
            skipped(np.broadcast_to(key, rank.shape)[live], place[live], left[live], right[live], share), NEVER, rank[live]
        )
        return rank, merged

    ranks = np.full(symbols.shape, NEVER, np.int32)
    merged = np.zeros(symbols.shape, np.int32)
    ranks[:, :-1], merged[:, :-1] = candidates(symbols[:, :-1], symbols[:, 1:], places[:, :-1], keys[:, None])
    alive = np.arange(len(symbols))
    out = symbols.copy()
    columns = np.arange(width)
    while len(alive):
        best = ranks.argmin(axis=1)
        row = np.arange(len(alive))
        goes_on = ranks[row, best] < NEVER
        out[alive[~goes_on]] = symbols[~goes_on]
        alive, best = alive[goes_on], best[goes_on]
        if not len(alive):
            break
        symbols, places, ranks, merged = (a[goes_on] for a in (symbols, places, ranks, merged))
        row = np.arange(len(alive))
        symbols[row, best] = merged[row, best]
        # The symbol behind the merged one goes; all after it move up.
        source = np.minimum(columns + (columns > best[:, None]), width - 1)
        symbols, places = np.take_along_axis(symbols, source, 1), np.take_along_axis(places, source, 1)
        ranks, merged = np.take_along_axis(ranks, source, 1), np.take_along_axis(merged, source, 1)
        for at, rows_ in ((best, row), (best - 1, row[best > 0])):
            at = at[rows_]
            ranks[rows_, at], merged[rows_, at] = candidates(
                symbols[rows_, at], symbols[rows_, at + 1], places[rows_, at], keys[alive[rows_]]
            )
    return out


def worked_off(pieces: Pieces, symbols: list[int], is_skipped: Callable[[int, int], bool]) -> list[int]:
    """Agenda processing of one chunk with a heap and links between neighbours.

    ``is_skipped`` is asked once for every candidate, by place and pair, when it appears.
    """
    n = len(symbols)
    symbols = list(symbols)
    behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def add(left: int, right: int) -> None:
        if left < 0 or right >= n:
            return
        pair = symbols[left] << SYMBOL_BITS | symbols[right]
        found = pieces.pairs.get(pair)
        if found is not None and not is_skipped(left, pair):
            heapq.heappush(agenda, (found[0], left, symbols[left], symbols[right], found[1]))

    for i in range(n - 1):
        add(i, i + 1)
    while agenda:
        _, left, first, second, merged = heapq.heappop(agenda)
        right = behind[left] if symbols[left] >= 0 else n
        if right >= n or symbols[left] != first or symbols[right] != second:
            continue
        symbols[left], symbols[right] = merged, -1
        behind[left] = behind[right]
        if behind[left] < n:
            before[behind[left]] = left
        add(before[left], left)
        add(left, behind[left])
    return [s for s in symbols if s >= 0]


def merge_long(pieces: Pieces, symbols: list[int], key: int, share: float) -> list[int]:
    """Agenda processing of one chunk whose candidates are drawn with ``key``."""
    if share <= 0 or share >= 1:
        return worked_off(pieces, symbols, lambda place, pair: share >= 1)
    below, all_bits = int(share * 2**64), 2**64 - 1
    first, second, third = map(int, FACTORS)

    def mixed_number(x: int) -> int:
        x = (x ^ (x >> 30)) * second & all_bits
        x = (x ^ (x >> 27)) * third & all_bits
        return x ^ (x >> 31)

    return worked_off(
        pieces, symbols, lambda place, pair: mixed_number(mixed_number(pair * first + place & all_bits) ^ key) < below
    )


class Encoder:
    """Remembers what chunks become after each order of skips; ways that are new in a batch are added."""

    def __init__(self, path: str, dropout: Dropout):
        self.pieces = Pieces(path)
        self.dropout = dropout
        self.longest = REMEMBERED if dropout.share <= RARE else 0
        self.forget()

    def forget(self) -> None:
        # A way is a chunk with the candidates skipped in it so far; its own candidates are those that
        # appear behind the last skip if no other follows, each with the way that its skip leads to.
        self.roots: dict[str, int] = {}
        self.found: list[bytes] = []
        self.ways: list[tuple[str, tuple[int, ...], int]] = []
        self.begin, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.used = 0
        self.candidate, self.draw = np.zeros(4096, np.int64), np.zeros(4096, np.uint64)
        self.next = np.full(4096, -1, np.int64)

    def add(self, ways: list[tuple[str, tuple[int, ...], int]]) -> None:
        """Works out ways: chunk, skipped candidates, and how many candidates are behind the last skip's end."""
        flat, sizes = self.pieces.symbols([w[0] for w in ways])
        ends = np.cumsum(sizes).tolist()
        flat = flat.tolist()
        appeared: list[int] = []
        counts = []
        at = 0
        for (chunk, skips, drawn), end in zip(ways, ends):
            seen: list[int] = []

            def is_skipped(place: int, pair: int) -> bool:
                seen.append(place << 2 * SYMBOL_BITS | pair)
                return seen[-1] in skips

            self.found.append(self.spelt(worked_off(self.pieces, flat[at:end], is_skipped)))
            appeared += seen[drawn:]
            counts.append(len(seen) - drawn)
            at = end
        n, total = len(self.ways), self.used + len(appeared)
        self.ways += ways
        while len(self.ways) > len(self.begin):
            self.begin, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.count))
        while total > len(self.next):
            self.candidate, self.draw = (np.concatenate([a, np.zeros_like(a)]) for a in (self.candidate, self.draw))
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
        self.count[n : len(self.ways)] = counts
        self.begin[n : len(self.ways)] = self.used + np.cumsum([0, *counts[:-1]])
        new = np.array(appeared, np.int64)
        pair, place = new & ((1 << 2 * SYMBOL_BITS) - 1), new >> 2 * SYMBOL_BITS
        self.candidate[self.used : total] = new
        self.draw[self.used : total] = mixed(pair.astype(np.uint64) * FACTORS[0] + place.astype(np.uint64))
        self.used = total

    def first_hits(self, way: np.ndarray, keys: np.ndarray, below: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Which occurrences have a skipped candidate on their way, and where their first one stands."""
        counts = self.count[way]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) - np.repeat(ends - counts - self.begin[way], counts)
        hit = np.nonzero(mixed(self.draw[at] ^ np.repeat(keys, counts)) < below)[0]
        owner = np.searchsorted(ends, hit, side="right")
        first = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(hit)]
        return owner[first], at[hit[first]]

    def drawn(self, way: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The last way of each occurrence that starts on ``way``; -1 if that is too rare to be remembered."""
        below = np.uint64(int(min(self.dropout.share, RARE) * 2**64))
        open_ = np.arange(len(way)) if below else np.arange(0)
        while len(open_ := open_[self.count[way[open_]] > 0]):
            # Some occurrences at a time, so that what is drawn for them stays in the processor's cache.
            hits = [self.first_hits(way[some], keys[some], below) for some in np.split(open_, range(DRAWN, len(open_), DRAWN))]
            at = np.concatenate([place for _, place in hits])
            open_ = open_[np.concatenate([owner + i * DRAWN for i, (owner, _) in enumerate(hits)])]
            lacks = open_[self.next[at] < 0]
            missing, one, times = np.unique(at[self.next[at] < 0], return_index=True, return_counts=True)
            missing, one = missing[times >= OFTEN], one[times >= OFTEN]
            if len(missing):
                origin = way[lacks[one]].tolist()
                ways = []
                for a, w in zip(missing.tolist(), origin):
                    chunk, skips, before = self.ways[w]
                    ways.append((chunk, (*skips, int(self.candidate[a])), before + a - int(self.begin[w]) + 1))
                names = np.arange(len(self.ways), len(self.ways) + len(ways))
                self.add(ways)
                self.next[missing] = names
            way[open_] = self.next[at]
            open_ = open_[way[open_] >= 0]
        return way

    def merged(self, chunks: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of chunks that are not remembered."""
        share = self.dropout.share
        symbols, sizes = self.pieces.symbols(chunks)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        out: list[bytes] = [b""] * len(chunks)
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[order], [0, *WIDTHS], side="right")
        for low, high, width in zip(cuts, cuts[1:], WIDTHS):
            for start in range(low, high, 8192):
                rows_ = order[start : min(high, start + 8192)]
                at = begins[rows_, None] + np.arange(width + 1)
                there = np.arange(width + 1) < sizes[rows_, None]
                matrix = np.where(there, symbols[np.minimum(at, len(symbols) - 1)], -1).astype(np.int32)
                found = merge_short(self.pieces, matrix, keys[rows_], share)
                used = found >= 0
                data = found[used].astype("<i4").tobytes()
                stops = np.cumsum(used.sum(axis=1)) * 4
                spans = zip(rows_.tolist(), np.concatenate([[0], stops[:-1]]).tolist(), stops.tolist())
                odd = (found >= self.pieces.size).any(axis=1)
                for (i, a, b), is_odd in zip(spans, odd.tolist()):
                    out[i] = self.spelt(np.frombuffer(data[a:b], "<i4").tolist()) if is_odd else data[a:b]
        for i in order[cuts[-1] :].tolist():
            out[i] = self.spelt(merge_long(self.pieces, symbols[begins[i] : ends[i]].tolist(), int(keys[i]), share))
        return out

    def spelt(self, symbols: list[int]) -> bytes:
        return np.array(self.pieces.spelt(symbols), "<i4").tobytes()

    def encode(self, texts: list[str | None], keys: list[int]) -> list[bytes | None]:
        """Ids of each text as bytes; ``keys`` tell documents apart."""
        # A leading space, as the model was trained with; an empty text has none.
        split = [CHUNKS.findall(" " + text) if text else [] for text in texts]
        out: list[bytes | None] = []
        held: list[list[str]] = []
        first = size = 0
        for i, chunks in enumerate(split):
            held.append(chunks)
            size += len(chunks)
            if size >= AT_ONCE or i + 1 == len(split):
                out += self.joined(held, keys[first : i + 1])
                held, first, size = [], i + 1, 0
        return [None if text is None else found for text, found in zip(texts, out)]

    def joined(self, split: list[list[str]], keys: list[int]) -> list[bytes]:
        if len(self.ways) > MOST_CACHED:
            self.forget()
        seed = mixed(np.array([self.dropout.seed % 2**64], np.uint64) + FACTORS[0])[0]
        chunks = [c for line in split for c in line]
        if not chunks:
            return [b""] * len(split)
        documents = mixed(np.array([k % 2**64 for k in keys], np.uint64) * FACTORS[2] + seed)
        counts = np.array([len(line) for line in split])
        place = np.arange(len(chunks)) - np.repeat(np.cumsum(counts) - counts, counts)
        drawn_by = mixed(np.repeat(documents, counts) + place.astype(np.uint64) * FACTORS[0])
        often = OFTEN if self.dropout.share > 0 else 1
        new = [c for c, n in Counter(chunks).items() if n >= often and len(c) <= self.longest and c not in self.roots]
        if new:
            self.roots.update(zip(new, range(len(self.ways), len(self.ways) + len(new))))
            self.add([(c, (), 0) for c in new])
        get = self.roots.get
        way = np.array([get(c, -1) for c in chunks], np.int64)
        known = np.nonzero(way >= 0)[0]
        way[known] = self.drawn(way[known], drawn_by[known])
        other = np.nonzero(way < 0)[0]
        found = self.found
        ids = [found[w] for w in way.tolist()] if len(known) else [b""] * len(chunks)
        if len(other):
            for i, line in zip(other.tolist(), self.merged([chunks[i] for i in other.tolist()], drawn_by[other])):
                ids[i] = line
        ends = np.cumsum(counts).tolist()
        return [b"".join(ids[end - n : end]) for n, end in zip(counts.tolist(), ends)]


def segment(
    docs: DataFrame, model: str, dropout: Dropout = Dropout(), id_col: str = "doc_id", text_col: str = "text",
    restored: str | None = None,
) -> DataFrame:
    """``docs`` with ``ids``: array<int>, the pieces of the whole text (in place of a column of that name).

    Null text has null ids, an empty one none. Without dropout the ids are the library's own,
    but for texts with the character U+2581, which stands for a space there and is kept
    here as its bytes. Rows with equal id and text get equal ids; a null id counts as 0.
    ``restored`` names a column for the text that the ids decode to, in the same pass.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = one_helper(("pieces", model, dropout), lambda: Encoder(model, dropout))
        table = piece_bytes(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                keys = [k or 0 for k in batch.column("_key").to_pylist()]
                found = one.encode(batch.column(text_col).to_pylist(), keys)
                values = [None if f is None else np.frombuffer(f, "<i4") for f in found]
                offsets = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in values])])
                ids = pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(f or b"" for f in found), "<i4")),
                    mask=pa.array([f is None for f in found], pa.bool_()),
                )
                columns, names = [*batch.drop_columns(["_key"]).columns, ids], [*batch.schema.names[:-1], "ids"]
                if restored:
                    columns.append(pa.array([None if v is None else decoded(v, table) for v in values], pa.string()))
                    names.append(restored)
                yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.drop("ids", *([restored] if restored else []))
    fields = [*plain.schema.fields, StructField("ids", ArrayType(IntegerType()))]
    fields += [StructField(restored, StringType())] if restored else []
    return plain.withColumn("_key", F.col(id_col).cast("bigint")).mapInArrow(encode, StructType(fields))


def restore(segmented: DataFrame, model: str, text_col: str = "decoded") -> DataFrame:
    """``segmented`` with the text its ``ids`` decode to in ``text_col``; null ids give null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_bytes(model)
        for batch in batches:
            column = batch.column("ids")
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            missing = column.is_null().to_pylist()
            texts = [
                None if none else decoded(values[a:b], table) for none, a, b in zip(missing, offsets[:-1], offsets[1:])
            ]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text_col])

    plain = segmented.drop(text_col)
    return plain.mapInArrow(decode, StructType([*plain.schema.fields, StructField(text_col, StringType())]))
