"""Quality rules by fertility against plain counting, and bands on made groups."""

import math
import os
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from eventloom.llm import fertility, queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, n_words string, key string, kept int"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain_base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeated, len(hit)


def plain_measures(text, encoder):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    tokens = [t for w in words for t in encoder.encode(w)]
    if not tokens:
        return 0, 0, 0, 1000
    entropy = -sum(n / len(tokens) * math.log2(n / len(tokens)) for n in Counter(tokens).values())
    single = sum(encoder.is_byte(t) for t in tokens)
    share = entropy / math.log2(len(tokens)) * 1000 if len(tokens) > 1 else 1000
    return len(tokens), sum(map(len, words)) * 1000 // len(tokens), single * 1000 // len(tokens), share


def check(rows, texts):
    encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in rows:
        text = texts[r.doc_id]
        assert tuple(r[c] for c in BASE) == plain_base(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        tokens, chars, single, entropy = plain_measures(text, encoder)
        assert (r.n_tokens, r.chars_per_token, r.byte_share) == (tokens, chars, single)
        assert abs(r.entropy - entropy) <= 1.001
        assert r.kept == (not r.base_failed and not r.rejected_by)


def test_small_table(spark):
    docs = queries.read_table(spark, SMALL, "documents").select("doc_id", "text").collect()
    found = queries.op12_fertility(spark, SMALL).collect()
    assert sorted(r.doc_id for r in found) == sorted(d.doc_id for d in docs)
    check(found, {d.doc_id: d.text for d in docs})


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(fertility, "STRETCH", 1000)
    monkeypatch.setattr(fertility, "REMEMBERED", 50)
    long = " ".join(f"w{i % 1009} and" for i in range(30_000))
    texts = [None, "", " \t\x0b\n", "one", "a b c a b c", "<a> #1\n<a> #1\n \n \n", "\x1c\x85  x y", "日本 語 ▁ 🙂", long, "a b c a b c"]
    table = spark.createDataFrame([(i, t, None, "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    found = fertility.judge(table, MODEL).collect()
    check(found, texts)
    assert {r.doc_id: r.band_group for r in found if r.doc_id in (0, 3, 7)} == {0: "script:none", 3: "script:latin", 7: "script:han"}
    assert fertility.judge(spark.createDataFrame([], DOCS), MODEL).collect() == []


def test_large_numbers_of_words():
    """Ids too large for three to a number go through ranks of pairs."""
    ids = fertility.np.array([1 << 22, 5, 7, 9, 1 << 22, 5, 7, 8])
    small = fertility.np.array([1, 5, 7, 9, 1, 5, 7, 8])
    assert fertility.repeated_words(ids) == fertility.repeated_words(small) == 6


def test_bands_reject_what_lies_apart(spark):
    """One group of ordinary prose with a few texts of noise: the noise goes, every ordinary text stays."""
    pick = random.Random(4)
    common = "the of and to in is that for it as was with be by on not he his but at are this have from".split()
    prose = [" ".join(pick.choices(common, k=90)) for _ in range(300)]
    noise = [" ".join("".join(pick.choices("qxzjkvwyQXZ0123456789$%", k=12)) for _ in range(60)) for _ in range(5)]
    noise += [" ".join("௵๏᠉"[i % 3] * 3 + str(pick.random()) for i in range(60)) for _ in range(5)]
    lines = [(i, t, "en", "", "", 0) for i, t in enumerate(prose + noise)]
    # Equal length classes: every text falls into the class of its own token count.
    found = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(lines, DOCS), MODEL, fertility.Bands(least_documents=5)).collect()}
    assert all(found[i].kept for i in range(300))
    few = fertility.judge(spark.createDataFrame(lines, DOCS), MODEL, fertility.Bands(least_documents=1000)).collect()
    assert not any(r.rejected_by for r in few)


def test_quartiles_are_exact(spark):
    pick = random.Random(9)
    values = [pick.randint(0, 40) for _ in range(501)]
    lines = [("en", 7, 10, v, 0, 1000 - v) for v in values]
    table = spark.createDataFrame(lines, "band_group string, length_class int, n_tokens bigint, chars_per_token bigint, byte_share bigint, entropy bigint")
    found = {r.measure: (r.q1, r.q3, r.documents) for r in fertility.quartiles(table).collect()}
    ranked = sorted(values)
    quarter = [ranked[-(-len(values) * q // 4) - 1] for q in (1, 3)]
    assert found["chars_per_token"] == (*quarter, 501) and found["byte_share"] == (0, 0, 501)
