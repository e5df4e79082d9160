"""Phrase collocations by prefix-free parsing.

Text is cut into chunks wherever two neighbouring words hash to a trigger, so equal
passages are cut alike wherever they stand. A chunk runs to the end of the next
trigger, and the following one starts with that trigger: neighbours overlap by its
two words. Equal chunks are counted once for all occurrences (the dictionary with
its parse frequencies), and n-grams are counted inside distinct chunks only,
weighted by that frequency. An n-gram belongs to the chunk it starts in, and
the trailing overlap starts nothing, so each occurrence counts once. The distinct
chunks are gone through twice: once for sums by hashed slots, and once for the exact
counts of the phrases whose slot is frequent enough.

Python tasks cut and count on Arrow batches, a few million words at a time; Spark
adds up chunks, then phrases, by partial sums, so a chunk or word of any frequency
loads no task. Scores are DECIMAL(38) arithmetic inside the JVM.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import discard, rows, written
from eventloom.operators.topk import first_per_group

# Characters that end a piece, and those between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: A byte that no UTF-8 text holds stands for a break.
BREAK = b"\xff"
CODES = bytes(
    BREAK[0] if b in BREAKS else 32 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
LONGEST = 3
OVERLAP = LONGEST - 1
BREAK_PLACE = re.compile(b"[" + BREAKS + b"]")
# Odd multipliers that mix the hashes of two words.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)
#: One pair of words in so many is a trigger.
SPACING = 16
#: Bytes of text that a task holds as separate words.
HELD = 1 << 22
NO_LANGUAGE = "und"
#: Slots that may be frequent are marked in a table of 2^27 bits, whatever the corpus.
TABLE_BITS = 27
#: Entries that a task sums up before it makes room.
SUMMED = 1 << 22


class Numbers(dict):
    """Numbers for words in the order they come, with a hash that depends on the word alone."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.hashes.append(zlib.crc32(word))
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def split_words(texts: list[bytes]) -> list[bytes]:
    """The words of all texts in order, with a break after each piece."""
    joined = BREAK.join(texts).translate(CODES) + BREAK
    return joined.replace(BREAK, b" " + BREAK + b" ").split()


def stretches(text: bytes, size: int = HELD) -> Iterator[bytes]:
    """A text cut at breaks into stretches of about ``size`` bytes; a longer piece stays whole."""
    start = 0
    while len(text) - start > size:
        found = BREAK_PLACE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def triggers(ids: np.ndarray, hashes: np.ndarray, spacing: int) -> np.ndarray:
    """Places whose word, not the first of its piece, hashes to a trigger with the next one of the piece."""
    one, two, three = (np.uint64(f) for f in FACTORS)
    mixed = hashes[ids[1:-1]] * one + hashes[ids[2:]] * two
    mixed = (mixed ^ (mixed >> np.uint64(29))) * three >> np.uint64(33)
    inside = (ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0)
    return np.flatnonzero((mixed % np.uint64(spacing) == 0) & inside) + 1


def chunks_of(texts: list[bytes], spacing: int = SPACING) -> Counter:
    """How often each (chunk, whether its last two words start the next one) occurs in the texts."""
    words = split_words(texts)
    numbers = Numbers()
    ids = numbers.of(words)
    cuts = triggers(ids, np.array(numbers.hashes, np.uint64), spacing) if len(ids) > 2 else np.zeros(0, np.int64)
    breaks = np.flatnonzero(ids == 0)
    starts = np.sort(np.concatenate([[0], breaks[:-1] + 1, cuts])).astype(np.int64)
    # The end of a chunk that shares its overlap goes before the end of a piece at the same place.
    ends = np.sort(np.concatenate([(cuts + OVERLAP) * 2, breaks * 2 + 1]))
    found: Counter = Counter()
    for start, end in zip(starts.tolist(), ends.tolist()):
        if start < end >> 1:
            found[b" ".join(words[start : end >> 1]), end & 1 == 0] += 1
    return found


def summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes with the sum of their weights, and the place of every code among them.

    Sums pass through floats, which hold integers below 2^53 exactly.
    """
    distinct, place = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(place, weights, len(distinct)).astype(np.int64), place


def phrases_of(chunks: list[tuple[bytes, bool, int]]) -> tuple[Numbers, list[tuple[list[np.ndarray], np.ndarray]]]:
    """The words of the chunks and, for 1, 2 and 3 words, the distinct phrases that start in them.

    Phrases come as one array of word numbers for each place, with their weighted counts.
    """
    words = split_words([chunk for chunk, _, _ in chunks])
    numbers = Numbers()
    ids = numbers.of(words)
    word = ids > 0
    # Room behind the last break, so that every place has two more to look at.
    ids, word = np.append(ids, [0, 0]), np.append(word, [False, False])
    chunk = np.cumsum(~word[:-2]) - ~word[:-2]
    weight = np.array([n for _, _, n in chunks], np.int64)[chunk]
    shared = np.array([s for _, s, _ in chunks], bool)[chunk]
    begins = word[:-2] & ~(shared & ~(word[1:-1] & word[2:]))
    size = len(numbers)

    one, n_one, _ = summed(ids[:-2], np.where(begins, weight, 0))
    two, n_two, place = summed(ids[:-2] * size + ids[1:-1], np.where(begins & word[1:-1], weight, 0))
    three, n_three, _ = summed(place * size + ids[2:], np.where(begins & word[1:-1] & word[2:], weight, 0))
    first = two[three // size]
    found = [([one], n_one), ([two // size, two % size], n_two), ([first // size, first % size, three % size], n_three)]
    return numbers, [([p[n > 0] for p in parts], n[n > 0]) for parts, n in found]


def slots(parts: list[np.ndarray], hashes: np.ndarray, lang: str) -> np.ndarray:
    """A slot of 64 bits for each phrase, by its words and language alone."""
    mixed = np.full(len(parts[0]), zlib.crc32(lang.encode()) + (len(parts) << 32), np.uint64)
    for part in parts:
        mixed = (mixed ^ hashes[part]) * np.uint64(FACTORS[0])
        mixed ^= mixed >> np.uint64(31)
    return mixed * np.uint64(FACTORS[2])


def table_place(slot: np.ndarray, table_bits: int) -> np.ndarray:
    """The bit of a slot in the table that tasks get."""
    return (slot >> np.uint64(64 - table_bits)).astype(np.int64)


CHUNKS = "lang string, shared boolean, chunk string, n bigint"
PHRASES = "lang string, n_words int, phrase string, f bigint"


def parse_dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", spacing: int = SPACING) -> DataFrame:
    """The distinct chunks of every language (``und`` where null) with their parse frequency ``n``.

    ``shared`` tells that the last two words of the chunk start the next one too. Null, empty and
    wordless texts have no chunk; equal rows count each; other columns play no part.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for body, name in rows(batches, "text", "lang"):
            for part in stretches(body.encode()):
                held.setdefault(name, []).append(part)
                size += len(part)
                if size > HELD:
                    yield from counted(held)
                    held, size = {}, 0
        yield from counted(held)

    def counted(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for name, texts in held.items():
            found = chunks_of(texts, spacing)
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(keys), pa.string()),
                    pa.array([shared for _, shared in keys], pa.bool_()),
                    pa.array([chunk for chunk, _ in keys], pa.binary()).cast(pa.string()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                ["lang", "shared", "chunk", "n"],
            )

    chosen = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"))
    parsed = chosen.where("text IS NOT NULL").mapInArrow(task, CHUNKS)
    return parsed.groupBy("lang", "shared", "chunk").agg(F.sum("n").alias("n"))


def _over_chunks(dictionary: DataFrame, counted, schema: str) -> DataFrame:
    """``counted`` (a function of a language and its chunks) over the dictionary, some megabytes at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[bytes, bool, int]]] = {}
        size = 0
        for name, chunk, shared, n in rows(batches, "lang", "chunk", "shared", "n"):
            held.setdefault(name, []).append((chunk.encode(), shared, n))
            size += len(chunk)
            if size > HELD:
                for lang, chunks in held.items():
                    yield from counted(lang, chunks)
                held, size = {}, 0
        for lang, chunks in held.items():
            yield from counted(lang, chunks)

    return dictionary.select("lang", "chunk", "shared", "n").mapInArrow(task, schema)


def frequent_slots(dictionary: DataFrame, least: int, table_bits: int = TABLE_BITS) -> np.ndarray:
    """One byte for eight bits of the table: set for slots whose phrases occur ``least`` times together.

    A frequent phrase always sets its bit. Phrases share a slot only if 32 bits and those of the
    part agree, so rare ones seldom set one. A part is a range of slots; there are more parts than
    shuffle partitions, and what a task found of a part travels as one row of numbers. The driver gets
    16 MB of bits whatever the corpus.
    """
    spark = dictionary.sparkSession
    bits = max(8, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def counted(lang: str, chunks: list) -> Iterator[pa.RecordBatch]:
        numbers, found = phrases_of(chunks)
        hashes = np.array(numbers.hashes, np.uint64)
        slot = np.concatenate([slots(parts, hashes, lang) for parts, _ in found])
        # Only whether a sum reaches ``least`` matters.
        count = np.minimum(np.concatenate([n for _, n in found]), (1 << 31) - 1).astype("<u4")
        order = np.argsort(slot)
        slot, count = slot[order], count[order]
        part = (slot >> np.uint64(64 - bits)).astype(np.int64)
        rest = (slot >> np.uint64(32 - bits)).astype("<u4")
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        spans = [(a, b) for a, b in zip(edges, edges[1:]) if a < b]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(part[a]) for a, _ in spans], pa.int32()),
                pa.array([rest[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([count[a:b].tobytes() for a, b in spans], pa.binary()),
            ],
            ["part", "rest", "n"],
        )

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        distinct, sums, _ = summed(np.concatenate([r for r, _ in held]), np.concatenate([n for _, n in held]))
        return distinct, sums

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: Counter = Counter()
        for part, rest, n in rows(batches, "part", "rest", "n"):
            held.setdefault(part, []).append((np.frombuffer(rest, "<u4"), np.frombuffer(n, "<u4")))
            waiting[part] += len(rest) // 4
            if waiting[part] > SUMMED:
                held[part], waiting[part] = [added(held[part])], 0
        for part, lines in held.items():
            rest, sums = added(lines)
            often = rest[sums >= least].astype(np.uint64)
            slot = np.uint64(part) << np.uint64(64 - bits) | often << np.uint64(32 - bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(table_place(slot, table_bits)))], ["bit"])

    sums = _over_chunks(dictionary, counted, "part int, rest binary, n binary").repartition("part")
    place = F.col("bit") + 1
    marked = (
        sums.mapInArrow(reached, "bit bigint")
        .groupBy(F.bitmap_bucket_number(place).alias("stretch"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    )
    table = np.zeros(max(1 << table_bits - 3, 4096), np.uint8)
    for row in marked.collect():
        start = (row.stretch - 1) * len(row.bits)
        table[start : start + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return table


def phrase_counts(dictionary: DataFrame, least: int, table_bits: int = TABLE_BITS) -> DataFrame:
    """Occurrences ``f`` of every phrase of up to three words that has at least ``least``, from distinct chunks alone.

    The row with no words holds the occurrences of all words of the language. A first pass finds
    out which phrases may be frequent, so that only those are spelt out, shuffled and counted.
    """
    frequent = dictionary.sparkSession.sparkContext.broadcast(frequent_slots(dictionary, least, table_bits))

    def counted(lang: str, chunks: list) -> Iterator[pa.RecordBatch]:
        numbers, found = phrases_of(chunks)
        hashes = np.array(numbers.hashes, np.uint64)
        vocabulary = pa.array(list(numbers), pa.binary())
        yield batch(lang, 0, pa.array([""]), found[0][1].sum(keepdims=True))
        for length, (parts, counts) in enumerate(found, 1):
            place = table_place(slots(parts, hashes, lang), table_bits)
            used = frequent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
            spelt = [vocabulary.take(pa.array(p[used])).cast(pa.string()) for p in parts]
            phrases = pc.binary_join_element_wise(*spelt, " ") if length > 1 else spelt[0]
            yield batch(lang, length, phrases, counts[used])

    def batch(lang: str, length: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        size = len(counts)
        columns = [pa.array([lang] * size, pa.string()), pa.array(np.full(size, length, np.int32)), phrases, pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "n_words", "phrase", "f"])

    summed_up = _over_chunks(dictionary, counted, PHRASES).groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))
    return summed_up.where((F.col("f") >= least) | (F.col("n_words") == 0))


def _known(counts: DataFrame, phrase: str, count: str) -> DataFrame:
    return counts.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(count))


def scored(counts: DataFrame) -> DataFrame:
    """Every phrase of two or three words with ``l``, ``r`` and ``score`` of its lowest-scoring cut.

    ``counts`` holds the phrases frequent enough; the parts of one are at least as frequent. The
    products are exact for counts below 10^15; of equal cuts the earliest counts.
    """
    cut = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    cuts = counts.where("n_words > 1").select("lang", "n_words", "phrase", F.col("f").alias("a"), cut)
    parts = cuts.withColumns(
        {
            "left": F.expr("substring_index(phrase, ' ', k)"),
            "right": F.expr("substring_index(phrase, ' ', k - n_words)"),
        }
    )
    parts = parts.join(_known(counts, "left", "l"), ["lang", "left"]).join(_known(counts, "right", "r"), ["lang", "right"])
    wide = {c: f"CAST({c} AS DECIMAL(15,0))" for c in "alr"}
    score = F.expr(f"({wide['a']} * {wide['a']} * CAST(1000000 AS DECIMAL(7,0))) div ({wide['l']} * {wide['r']})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    best = parts.groupBy("lang", "n_words", "phrase").agg(F.first("a").alias("a"), lowest)
    return best.select("lang", "n_words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def swallowed(counts: DataFrame, percent: int) -> DataFrame:
    """Two-word phrases that stand in a longer one of at least ``percent`` per cent of their occurrences."""
    pairs = F.array(F.substring_index("phrase", " ", OVERLAP), F.substring_index("phrase", " ", -OVERLAP))
    inside = (
        counts.where(F.col("n_words") == LONGEST)
        .select("lang", F.explode(pairs).alias("phrase"), F.col("f").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    own = counts.where(F.col("n_words") == OVERLAP)
    return own.join(inside, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("f") * percent).select("lang", "phrase")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, percent: int = 50, best: int = 2000,
    spacing: int = SPACING, table_bits: int = TABLE_BITS,
) -> DataFrame:
    """The ``best`` phrases of two and three words of every language, by how much their parts belong together.

    Phrases need ``least`` occurrences; one that mostly stands inside a longer candidate is left
    out. Languages come from ``lang``, ``und`` where it is null; null, empty and wordless texts add
    nothing, equal rows count each, and an empty table gives no rows. A language of few words has
    fewer than ``best`` phrases. ``n`` counts all words of the language.
    """
    dictionary = written(parse_dictionary(docs, text, lang, spacing), "chunks")
    counts = written(phrase_counts(dictionary, least, table_bits), "phrases")
    discard(dictionary)
    phrases = counts.where("n_words > 0")
    wanted = scored(phrases).join(swallowed(phrases, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = first_per_group(wanted, ["lang"], order, best)
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return ranked.withColumn("rank", rank).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
