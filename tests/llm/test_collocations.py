"""Collocations by prefix-free parsing against plain counting."""

import os
import random
import re
from collections import Counter

import pytest

from eventloom.llm import collocations, queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
DOCS = "doc_id bigint, text string, lang string, a string, n int, rank string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_counts(docs):
    f, n = {k: Counter() for k in (1, 2, 3)}, Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in f:
                for i in range(len(words) - k + 1):
                    f[k][lang or "und", " ".join(words[i : i + k])] += 1
    return f, n


def plain_collocations(docs, least=10, best=2000):
    f, n = plain_counts(docs)
    f_of = {**f[1], **f[2], **f[3]}
    lines = []
    for k in (2, 3):
        for (lang, phrase), a in f[k].items():
            if a < least:
                continue
            words = phrase.split(" ")
            cuts = []
            for c in range(1, k):
                left, right = f_of[lang, " ".join(words[:c])], f_of[lang, " ".join(words[c:])]
                cuts.append((10**6 * a * a // (left * right), c, left, right))
            longer = [b for (g, p), b in f[3].items() if k == 2 and g == lang and b >= least and f" {phrase} " in f" {p} "]
            if not any(100 * b >= 50 * a for b in longer):
                score, _, left, right = min(cuts)
                lines.append((lang, phrase, a, left, right, n[lang], score))
    found = []
    for lang in n:
        mine = sorted((x for x in lines if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        found += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine[:best])]
    return sorted(found)


def spark_collocations(spark, docs, **options):
    table = spark.createDataFrame([(i, t, g, "x", 1, "y") for i, (t, g) in enumerate(docs)], DOCS)
    return sorted(tuple(r) for r in collocations.collocations(table, **options).select(*COLUMNS).collect())


def test_small_table(spark):
    docs = [tuple(r) for r in queries.read_table(spark, SMALL, "documents").select("text", "lang").collect()]
    found = sorted(tuple(r) for r in queries.op13_collocations(spark, SMALL).select(*COLUMNS).collect())
    assert found == plain_collocations(docs)


@pytest.mark.parametrize("spacing", [1, 2, 5, 10**9])
def test_any_spacing_of_triggers_counts_the_same(spacing):
    pick = random.Random(spacing)
    words = ["a", "B", "cc", "é", "x\x00", "d", "ß\x85"]
    texts = ["".join(pick.choice(words) + pick.choice([" ", " ", "\t ", ". ", "\n", ",", "  "]) for _ in range(80)) for _ in range(40)]
    chunks = collocations.chunks_of([t.encode() for t in texts], spacing)
    found = {k: Counter() for k in (1, 2, 3)}
    numbers, phrases = collocations.phrases_of([(c, s, n) for (c, s), n in chunks.items()])
    known = list(numbers)
    for k, (parts, counts) in enumerate(phrases, 1):
        spelt = [" ".join(known[i].decode() for i in line) for line in zip(*parts)]
        found[k].update(dict(zip(spelt, counts.tolist())))
    expected, _ = plain_counts([(t, "z") for t in texts])
    assert found == {k: Counter({p: c for (_, p), c in expected[k].items()}) for k in found}


def test_texts_cut_into_stretches(monkeypatch):
    text = ("one two three. four, five six\n" * 50).encode()
    parts = list(collocations.stretches(text, 40))
    assert len(parts) > 20 and sum(collocations.chunks_of(parts, 3).values()) == sum(collocations.chunks_of([text], 3).values())
    assert list(collocations.stretches(b"no break at all " * 9, 10)) == [b"no break at all " * 9]


def test_crowded_slots_change_nothing(spark):
    """With a table of 16 bits every phrase may be frequent, and only the exact counts decide."""
    docs = [tuple(r) for r in queries.read_table(spark, SMALL, "documents").select("text", "lang").collect()][:60]
    expected = spark_collocations(spark, docs)
    assert expected and spark_collocations(spark, docs, table_bits=4) == expected


def test_hard_rows(spark):
    hot = " ".join(["very common pair"] * 400)
    docs = [(hot, "en"), (hot, "en"), (None, "en"), ("", None), (" \t\n.,", None), ("Tie one. " * 10 + "tie two. " * 10, None)]
    docs += [("long " * 200_000, "de"), ("A B C; " * 25 + "B C; " * 25, "fr"), ("ünï cödé " * 12, "é")]
    assert spark_collocations(spark, docs) == plain_collocations(docs)
    assert spark_collocations(spark, docs, best=2) == plain_collocations(docs, best=2)
    assert spark_collocations(spark, []) == []


def test_scores_past_64_bits(spark):
    a, left, right = 2 * 10**14, 3 * 10**14, 25 * 10**13 + 7
    counts = [("en", 1, "p", left), ("en", 1, "q", right), ("en", 2, "p q", a)]
    row = collocations.scored(spark.createDataFrame(counts, collocations.PHRASES)).first()
    assert row.score == 10**6 * a * a // (left * right)
