"""Language of a text by words, backing off to character n-grams for words never seen.

A known word is scored by its smoothed log frequency in each language. An unseen word is
cut into n-grams of four characters, word ends included; the mean score of those that are
known counts. If none is, its trigrams are tried, then bigrams, then single characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import one_helper, rows

LONGEST = 4
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
SMOOTHING = 0.1
MOST_CACHED = 150_000


@dataclass(frozen=True)
class LanguageModel:
    """Scores, a row per word or n-gram and a column per language; row 0 is all zero."""

    key: int
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray


def held_out(id_col: str) -> F.Column:
    """Whether crc32 of the id as text leaves the remainder 1 by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def learn(
    labelled: DataFrame, docs_per_language: int = 4000, words_per_language: int = 20_000,
    grams_per_language: int = 20_000, most_languages: int = 200, text_col: str = "text", lang_col: str = "lang",
) -> LanguageModel:
    """Fits on a bounded sample: about ``docs_per_language`` whole documents of each language.

    At most ``most_languages`` languages are learned, those with the most documents. A
    document is taken if the hash of its text falls below the share its language
    needs, so the sample does not depend on partitions or order. Only the most frequent words and
    n-grams of the sample reach the driver: at most the two bounds for each language.
    Rows with a null text or language teach nothing; without any row nothing is learned.
    """
    usable = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = usable.where("text IS NOT NULL AND lang IS NOT NULL")
    most = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    # The few shares go into the filter itself, so that no text moves.
    shares = F.create_map(*[F.lit(v) for r in most for v in (r.lang, docs_per_language / r.n)]) if most else None
    chance = (F.xxhash64("text", F.lit("sample")) % 1_000_000 + 1_000_000) / 2_000_000
    sample = usable.where(chance < shares[F.col("lang")] if most else F.lit(False)).select("lang", "text")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    words = sample.select("lang", word.alias("entry")).groupBy("lang", "entry").agg(F.count("*").alias("n"))
    words = words.persist()
    ended = F.concat(F.lit(" "), "entry", F.lit(" "))
    spans = F.flatten(
        F.array(
            *[
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length("entry") + 3 - k, F.lit(1))),
                    lambda i, k=k: F.substring(ended, i, F.lit(k)),
                )
                for k in range(1, LONGEST + 1)
            ]
        )
    )
    grams = words.select("lang", "n", F.explode(spans).alias("entry"))
    # A short word's window of k characters can come out shorter: those are the shorter n-grams again.
    grams = grams.groupBy("lang", "entry").agg(F.sum("n").alias("n"))

    def most_frequent(counts: DataFrame, limit: int) -> list:
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "entry")
        ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
        return ranked.select("lang", "entry", "n").collect()

    word_rows, gram_rows = most_frequent(words, words_per_language), most_frequent(grams, grams_per_language)
    words.unpersist()
    languages = sorted({r.lang for r in word_rows})
    word_at = {w: i + 1 for i, w in enumerate(sorted({r.entry for r in word_rows}))}
    gram_at = {g: i + 1 + len(word_at) for i, g in enumerate(sorted({r.entry for r in gram_rows}))}
    counts = np.zeros((1 + len(word_at) + len(gram_at), len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    for places, found in ((word_at, word_rows), (gram_at, gram_rows)):
        for r in found:
            counts[places[r.entry], column[r.lang]] = r.n
    scores = np.zeros_like(counts)
    orders = np.array([0] * (1 + len(word_at)) + [len(g) for g in gram_at])
    orders[0] = -1
    for order in range(LONGEST + 1):
        here = orders == order
        seen = counts[here] + SMOOTHING
        scores[here] = np.log(seen / seen.sum(axis=0))
    key = hash((tuple(languages), len(word_at), len(gram_at), float(scores.sum())))
    return LanguageModel(key, languages, word_at, gram_at, scores)


class Scorer(dict):
    """Score rows of white-space chunks, as bytes, remembered; unseen words get rows of their own."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.unseen: dict[str, int] = {}
        self.used = len(self.model.scores)
        self.table = np.concatenate([self.model.scores, np.zeros((1024, self.model.scores.shape[1]))])

    def __missing__(self, chunk: str) -> bytes:
        words, unseen = self.model.words, self.unseen
        at = [words.get(w) or unseen.get(w) or self.back_off(w) for w in LETTERS.findall(chunk.lower())]
        found = np.array(at, "<u4").tobytes()
        self[chunk] = found
        return found

    def back_off(self, word: str) -> int:
        grams, ended = self.model.grams, f" {word} "
        known: list[int] = []
        for k in range(LONGEST, 0, -1):
            known = [g for i in range(len(ended) - k + 1) if (g := grams.get(ended[i : i + k]))]
            if known:
                break
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if known:
            self.table[self.used] = np.add.reduce(self.model.scores.take(known, axis=0)) / len(known)
        self.unseen[word] = self.used
        self.used += 1
        return self.unseen[word]

    def predict(self, text: str | None) -> tuple[str, float]:
        if len(self) > MOST_CACHED:
            self.forget()
        found = np.frombuffer(b"".join(map(self.__getitem__, (text or "").split())), "<u4")
        if not len(found) or not self.model.languages:
            return UNKNOWN, 0.0
        # The square root tempers what repeated words claim.
        total = self.table[found].sum(axis=0) / np.sqrt(len(found))
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


def keep_known(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3
) -> DataFrame:
    """``docs`` whose language is told with a score of ``least`` or more, with that language.

    Learned from the documents that are not held out. Texts without a letter go.
    """
    model = learn(docs.where(~held_out(id_col)), text_col=text_col, lang_col=lang_col)
    marked = predict(docs, model, text_col, tuple(docs.columns), ("_lang_pred", "_score"))
    told = marked.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= least))
    return told.select(*[F.col("_lang_pred").alias(c) if c == lang_col else c for c in docs.columns])


def predict(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", columns: tuple[str, ...] = (),
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``columns`` of every row with lang_pred and score (as ``names``), from the whole text alone.

    A null text or one without a letter gives ``und`` and 0; so does every text if the
    model has learned nothing. Equal scores go to the first language in order of name. The
    score is the best language's share of the tempered likelihoods; a text whose words and
    characters were all unseen gets the first language with the share 1/languages.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    key = model.key

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = one_helper(("language", key), lambda: Scorer(held.value))
        for batch in batches:
            found = [scorer.predict(t) for (t,) in rows([batch], scored)]
            kept = batch if scored in columns else batch.drop_columns([scored])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*kept.schema.names, *names],
            )

    scored = text_col if text_col in columns else "_text"
    wanted = docs.select(*columns) if scored in columns else docs.select(*columns, F.col(text_col).alias(scored))
    schema = docs.select(*columns).schema.add(names[0], "string").add(names[1], "double")
    return wanted.mapInArrow(score, schema)
