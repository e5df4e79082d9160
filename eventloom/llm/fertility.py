"""Quality rules by tokeniser fertility.

A public vocabulary says how well a text fits the language it claims: characters
per token, share of tokens that are single bytes, and entropy of the tokens.
Every language (script, where a text names none) and length class gets rejection
bands from the quartiles over all its documents. Plain word and line counts of
the same pass make the base rules.

Words are ``[^\\x20\\x09-\\x0D]+``; each is encoded by itself, the way the
vocabulary sees a word after a space, and remembered, so a frequent word is
encoded once per worker. Whole texts are measured; no text is shuffled. Exact
quartiles come from histograms of the rounded measures, whose size does not grow
with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import one_helper, written

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Words that a worker remembers between texts, and bytes of a text that are split into words at once.
REMEMBERED = 1 << 19
STRETCH = 1 << 22
#: Texts that a task looks at together.
ROWS = 256
MEASURES = ("chars_per_token", "byte_share", "entropy")
#: Measures are whole thousandths.
UNIT = 1000

# First and last code point of the letters of some scripts.
SCRIPTS = {
    "latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF),
    "arabic": (0x600, 0x77F), "devanagari": (0x900, 0x97F), "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF),
    "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7A3),
}


@dataclass(frozen=True)
class Bands:
    """How far outside of the quartiles of its group a document may lie.

    ``reach`` counts spreads; a spread is the distance of the quartiles, or ``least_spread``
    (in thousandths, by measure) where that is larger. A group of fewer than ``least_documents``
    documents says too little about its language and rejects nothing.
    """

    reach: float = 3.0
    least_spread: tuple[int, int, int] = (100, 10, 20)
    least_documents: int = 100


class Words:
    """Token ids of every word met so far, one after another in one array."""

    def __init__(self, model: str) -> None:
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        count = self.encoder.get_piece_size()
        self.is_byte = np.array([self.encoder.is_byte(i) for i in range(count)])
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.tokens = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.index))
        if not new:
            return
        coded = self.encoder.encode([w.decode() for w in new], num_threads=1)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, lengths.sum())
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.tokens = np.concatenate([self.tokens, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def token_counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the words, and how often each occurs."""
        starts = self.ends[ids]
        lengths = self.ends[ids + 1] - starts
        places = np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
        return np.unique(self.tokens[places + np.arange(len(places))], return_counts=True)


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """A text cut at white space into stretches of about ``size`` bytes, so that few words are apart at once."""
    start = 0
    while len(text) - start > size:
        stop = start + size
        while stop < len(text) and text[stop] not in WHITE:
            stop += 1
        yield text[start:stop]
        start = stop
    yield text[start:]


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in some three-word window found at least twice."""
    if len(ids) < 4:
        return 0
    base = int(ids.max()) + 1
    pairs = ids[:-1] * base + ids[1:]
    if base >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    equal = np.diff(windows[order]) == 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= twice
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script with most letters; ``none`` without any letter of the table."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = {name: int(((points >= a) & (points <= b)).sum()) for name, (a, b) in SCRIPTS.items()}
    name = max(counts, key=counts.__getitem__)
    return name if counts[name] else "none"


def thousandths(part: float, whole: float) -> int:
    return int(part * UNIT // whole) if whole else 0


def word_ids(texts: list[bytes], known: Words) -> list[np.ndarray]:
    """The words of each text by number, valid until the next call."""
    if len(known.index) > REMEMBERED:
        known.forget()
    if sum(map(len, texts)) <= STRETCH:
        split = [t.split() for t in texts]
        known.learn(set(chain.from_iterable(split)))
        return [known.ids(words) for words in split]
    found = []
    for text in texts:
        parts = []
        for part in stretches(text):
            words = part.split()
            known.learn(set(words))
            parts.append(known.ids(words))
        found.append(np.concatenate(parts))
    return found


def measured(text: str, raw: bytes, lang: str | None, ids: np.ndarray, known: Words) -> tuple:
    tokens, counts = known.token_counts(ids)
    total = int(counts.sum())
    bits = float(np.log2(total) - (counts * np.log2(counts)).sum() / total) if total else 0.0
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    return (
        len(ids),
        chars,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        repeated_lines(raw),
        repeated_words(ids),
        total,
        thousandths(chars, total),
        thousandths(int(counts[known.is_byte[tokens]].sum()), total),
        thousandths(round(bits, 9), np.log2(total)) if total > 1 else UNIT,
        lang or "script:" + script_of(text),
        total.bit_length(),
    )


RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, "
    "chars_per_token bigint, byte_share bigint, entropy bigint, band_group string, length_class int"
)
ARROW = [pa.int64()] * 9 + [pa.string(), pa.int32()]


def measure(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document the word and line counts and the three measures, as whole thousandths.

    ``chars_per_token`` counts word characters, ``byte_share`` tokens that stand for one byte,
    ``entropy`` is that of the tokens divided by its largest value for so many tokens (1000 for fewer
    than two). ``band_group`` is the language, or the script where it is null or empty; ``length_class``
    the binary digits of the token count. Null and empty texts count nothing. Equal rows each give
    a row, an empty table none; other columns are left out, whatever their names.
    """
    kind = docs.schema[key].dataType
    names = [part.split()[0] for part in RESULT.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = one_helper(("fertility", model), lambda: Words(model))
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                raws = [t.encode() for t in texts]
                lines = zip(texts, raws, batch.column("lang").to_pylist(), word_ids(raws, known))
                found = zip(*[measured(*line, known) for line in lines])
                columns = [pa.array(list(c), t) for c, t in zip(found, ARROW)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", *names])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return chosen.mapInArrow(task, f"key {kind.simpleString()}, {RESULT}").withColumnRenamed("key", key)


def quartiles(measures: DataFrame) -> DataFrame:
    """Exact lower and upper quartile of every measure over all documents of a group and length class."""
    stacked = ", ".join(f"'{m}', {m}" for m in MEASURES)
    histogram = (
        measures.where("n_tokens > 0")
        .select("band_group", "length_class", F.expr(f"stack({len(MEASURES)}, {stacked}) AS (measure, value)"))
        .groupBy("band_group", "length_class", "measure", "value")
        .agg(F.count("*").alias("n"))
    )
    group = Window.partitionBy("band_group", "length_class", "measure")
    running = histogram.select(
        "*",
        F.sum("n").over(group.orderBy("value")).alias("reached"),
        F.sum("n").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("documents"),
    )
    at = {q: F.min(F.when(F.col("reached") * 4 >= F.col("documents") * q, F.col("value"))) for q in (1, 3)}
    return running.groupBy("band_group", "length_class", "measure").agg(
        at[1].alias("q1"), at[3].alias("q3"), F.max("documents").alias("documents")
    )


def rejection_bands(measures: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Lowest and highest value that a group accepts, per measure; groups of few documents have none.

    A small share of single-byte tokens is never wrong, so that measure has no lowest value.
    """
    least = F.create_map(*[F.lit(x) for pair in zip(MEASURES, bands.least_spread) for x in pair])
    spread = F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")]) * bands.reach
    low = F.when(F.col("measure") == "byte_share", F.lit(0.0)).otherwise(F.col("q1") - spread)
    fences = quartiles(measures).where(F.col("documents") >= bands.least_documents)
    fences = fences.select("band_group", "length_class", "measure", low.alias("low"), (F.col("q3") + spread).alias("high"))
    wide = [F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for m in MEASURES for c in ("low", "high")]
    return fences.groupBy("band_group", "length_class").agg(*wide)


#: Rows of a table of bands that may be broadcast.
BROADCAST_BANDS = 20_000


def judge(
    docs: DataFrame, model: str, bands: Bands = Bands(), key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Every document with its counts and measures, ``base_failed``, ``rejected_by`` and ``kept``.

    The base rules want 50 words, and at most half of them in repeated three-word windows.
    ``rejected_by`` lists the measures outside of the bands of the document's group; a document is
    kept if it passes the base rules and that list is empty. Null and empty texts fail the base
    rules; equal rows are judged alike; an empty table gives no rows.
    """
    measures = written(measure(docs, model, key, text, lang), "fertility")
    fences = written(rejection_bands(measures, bands), "fertility-bands")
    side = F.broadcast(fences) if fences.count() <= BROADCAST_BANDS else fences

    def outside(m: str) -> Column:
        return (F.col(m) < F.col(f"low_{m}")) | (F.col(m) > F.col(f"high_{m}"))

    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rejected = F.array_compact(F.array(*[F.when(outside(m), F.lit(m)) for m in MEASURES]))
    return (
        measures.join(side, ["band_group", "length_class"], "left")
        .select(*measures.columns, failed.alias("base_failed"), rejected.alias("rejected_by"))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    )
