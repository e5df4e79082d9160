"""The array kernels against plain loops."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from eventloom.llm import bwt_merge, merge_dropout, page_text, repeats, simhash, token_files
from eventloom.llm.fm_index import FMIndex


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
@pytest.mark.parametrize("high", [1, 2, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[::97] = 2**32 - 1
    segment = token_files.pack(ids)
    assert (token_files.unpack(segment) == ids).all()
    assert (token_files.unpack(segment, 100, 700) == ids[100:700]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.random.default_rng(0).integers(0, 256, 51_200).astype(np.uint32)
    plain = len(token_files.pack(ids))
    ids[::100] = 2**31
    assert len(token_files.pack(ids)) < plain * 1.2


def test_fm_index_finds_every_place():
    random_ = np.random.default_rng(2)
    for _ in range(20):
        text = random_.integers(1, 4, random_.integers(1, 300))
        index = FMIndex(text)
        for length in (1, 2, 5):
            phrases = random_.integers(1, 5, (15, length))
            for phrase, low, high in zip(phrases, *index.search(phrases)):
                found = sorted(index.locate(np.arange(low, high)).tolist())
                assert found == [i for i in range(len(text) - length + 1) if (text[i : i + length] == phrase).all()]


def test_merged_transforms_give_the_repeated_strings():
    random_ = np.random.default_rng(0)
    for _ in range(150):
        depth = int(random_.integers(1, 8))
        texts = [
            np.concatenate([np.append(random_.integers(1, 3, random_.integers(0, 12)), 0) for _ in range(random_.integers(1, 5))])
            for _ in range(random_.integers(1, 5))
        ]
        texts = [t.astype(np.uint8) for t in texts]
        positions, intervals = bwt_merge.repeated_intervals([bwt_merge.transform(t) for t in texts], depth)
        whole = np.concatenate(texts)
        strings = {}
        for p in range(len(whole) - depth + 1):
            if whole[p : p + depth].all():
                strings.setdefault(whole[p : p + depth].tobytes(), []).append(p)
        expected = sorted(v for v in strings.values() if len(v) > 1)
        found = {}
        for p, i in zip(positions.tolist(), intervals.tolist()):
            found.setdefault(i, []).append(p)
        assert sorted(sorted(v) for v in found.values()) == expected


def test_pieces_share_strings_across_small_shards(monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 300)
    random_ = random.Random(5)
    common = bytes(random_.choice(b"abcd") for _ in range(140))
    pieces = [bytes(random_.choice(b"abcd") for _ in range(20)) + common[i : i + 110] for i in range(0, 30, 3)]
    docs, firsts = np.arange(10) // 2, np.array([0, 500] * 5)
    found = set()
    for doc, own, first, last in repeats.shared_strings(docs, docs * 0, firsts, pieces):
        found |= {(doc, s) for s in range(first, last + 1)}
    expected = set()
    places = sorted((int(d), int(f) + o, p[o : o + 100]) for d, f, p in zip(docs, firsts, pieces) for o in range(31))
    seen = set()
    for doc, start, string in places:
        if string in seen:
            expected.add((doc, start))
        seen.add(string)
    assert found == expected and expected


def test_anchor_runs_cover_every_string_once():
    random_ = random.Random(1)
    texts = [bytes(random_.choice(b"ab ") for _ in range(n)) for n in (0, 99, 100, 101, 350)] + [b"z" * 300]
    doc, _, at, first, last = repeats.anchor_runs(b"".join(texts), np.array([len(t) for t in texts]))
    begin = np.cumsum([0, *[len(t) for t in texts]])
    covered = [(d, s) for d, f, l in zip(doc.tolist(), first.tolist(), last.tolist()) for s in range(f, l + 1)]
    expected = [(d, int(begin[d]) + s) for d, t in enumerate(texts) for s in range(len(t) - 99)]
    assert sorted(covered) == expected
    assert all(f <= a <= f + 68 for a, f in zip(at, last)) and (last - first < 69).all()


def components(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(x)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("flips", [1, 3, 6])
def test_index_links_all_near_fingerprints_and_no_others(flips):
    random_ = np.random.default_rng(flips)
    group = np.sort(random_.integers(0, 3, 500))
    bits = random_.integers(0, 2**63, 6, dtype=np.uint64)[random_.integers(0, 6, 500)]
    for _ in range(flips):
        bits = bits ^ (np.uint64(1) << random_.integers(0, 64, 500).astype(np.uint64))
    wide = random_.integers(0, 2, (500, 1)).astype(np.uint64)
    near = [
        (i, j) for i, j in itertools.combinations(range(500), 2)
        if group[i] == group[j] and int(bits[i] ^ bits[j]).bit_count() <= 4
    ]
    a, b = simhash.spanning_links(group, bits, 4)
    assert components(near) == components(zip(a.tolist(), b.tolist()))
    assert len(a) < 500 and set(map(frozenset, zip(a.tolist(), b.tolist()))) <= set(map(frozenset, near))
    a, b = simhash.spanning_links(group, bits, 4, wide, 0)
    assert components([(i, j) for i, j in near if wide[i] == wide[j]]) == components(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "a b c d e a b c d e \x0bX", None, "é b C d"])
def test_fingerprint_is_the_majority_of_shingles(text):
    found = (text or "").encode().lower().split()
    size = min(4, len(found))
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + size]), 42) for i in range(len(found) - size + 1) if found]
    expected = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text, 4) == expected


@pytest.mark.parametrize("most_bits", [1 << 30, 20])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, most_bits):
    monkeypatch.setattr(page_text, "MOST_BITS", most_bits)
    random_ = random.Random(1)
    for _ in range(500):
        a, b = ([random_.choice("abcd") for _ in range(random_.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        places = page_text.shared_lines(a, b)
        rest = iter(b)
        assert len(set(places)) == len(places) == best[-1][-1] and all(a[p] in rest for p in places)


MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a", " ", "  a  b \n\n c\t\x00", "x" * 300, "abc" * 100 + " the " + "e" * 70, "日本語🙂 é", "</s><s><unk><0x41>", "\r\n a", " " * 40 + "z"]


def test_without_dropout_ids_are_the_librarys():
    encoder = merge_dropout.Encoder(MODEL, merge_dropout.Dropout(0.0))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = encoder.encode(TEXTS, list(range(len(TEXTS))))
    assert [np.frombuffer(f, "<i4").tolist() for f in found] == library.encode(TEXTS)


@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
def test_dropout_varies_and_decodes_to_the_text(share):
    encoder = merge_dropout.Encoder(MODEL, merge_dropout.Dropout(share, seed=3))
    texts = [*TEXTS, "▁▁ a▁b", "the house of the people " * 30]
    found = [np.frombuffer(f, "<i4") for f in encoder.encode(texts, list(range(len(texts))))]
    assert [merge_dropout.decoded(f, merge_dropout.piece_bytes(MODEL)) for f in found] == texts
    again = merge_dropout.Encoder(MODEL, merge_dropout.Dropout(share, seed=3)).encode(texts, list(range(len(texts))))
    assert [f.tobytes() for f in found] == again
    other = merge_dropout.Encoder(MODEL, merge_dropout.Dropout(share, seed=4)).encode(texts, list(range(len(texts))))
    assert share == 1.0 or other != again


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_heap_and_side_by_side_agendas_agree(share):
    pieces = merge_dropout.Pieces(MODEL)
    chunks = [" there", " internationally", "a", "   then", " été", " xyzzyxyz"] * 5
    flat, sizes = pieces.symbols(chunks)
    ends = np.cumsum(sizes)
    lists = [flat[b - n : b].tolist() for b, n in zip(ends, sizes)]
    matrix = np.full((len(lists), max(sizes) + 1), -1, np.int32)
    for i, line in enumerate(lists):
        matrix[i, : len(line)] = line
    keys = np.arange(1, len(lists) + 1, dtype=np.uint64) * np.uint64(7919)
    together = [[s for s in row if s >= 0] for row in merge_dropout.merge_short(pieces, matrix, keys, share).tolist()]
    assert together == [merge_dropout.merge_long(pieces, line, int(k), share) for line, k in zip(lists, keys)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="has-sidebar"><nav><ul><li>Menu</ul></nav><header>Top</header><div class="cookie-notice">Cookies</div>
<aside>Side</aside><form>Mail <input></form><article><h1>Big  &amp;\n title</h1><p>One<br>two <b>th</b>ree&nbsp;4
<p>Next <!-- <p>gone</p> --> part<footer>by</footer><div id="comments"><p>Reader</p></div></article><footer>&copy; X"""


def test_lines_of_a_page():
    assert page_text.lines_of(PAGE) == [("Big & title", True), ("One two three 4", True), ("Next part", True)]
    assert page_text.lines_of(None) == page_text.lines_of("") == page_text.lines_of("<p> <br>") == []
    assert page_text.lines_of("a < b <p title='>'>c</p") == [("a < b", False), ("c", False)]


def test_neighbours_template_goes_where_there_is_no_article():
    page = lambda body: [{"text": t, "article": a} for t, a in page_text.lines_of(body)]
    one = page("<div>Welcome</div><p>First story</p><div>Imprint</div>")
    two = page("<div>Welcome</div><p>Other story</p><p>More</p><div>Imprint</div>")
    assert page_text.main_text(one, two) == "First story"
    assert page_text.main_text(two, one) == "Other story\n\nMore"
    assert page_text.main_text(one, None) == "Welcome\n\nFirst story\n\nImprint"
    story = page("<article><p>Same</p></article>")
    assert page_text.main_text(story, story) == "Same"


@pytest.mark.parametrize("share", [0.1, 0.5])
def test_every_occurrence_draws_its_own_skips(share):
    encoder = merge_dropout.Encoder(MODEL, merge_dropout.Dropout(share, seed=1))
    texts = ["the international " * 400, "the international " * 400, " thereafter" * 20, "understanding" * 5]
    found = encoder.encode(texts, [7, 8, 9, 10])
    assert found[0] != found[1]
    seed = merge_dropout.mixed(np.array([1], np.uint64) + merge_dropout.FACTORS[0])[0]
    ways = set()
    for text, key, ids in zip(texts, [7, 8, 9, 10], found):
        document = merge_dropout.mixed(np.array([key], np.uint64) * merge_dropout.FACTORS[2] + seed)
        parts = []
        for i, chunk in enumerate(merge_dropout.CHUNKS.findall(" " + text)):
            own = int(merge_dropout.mixed(document + np.array([i], np.uint64) * merge_dropout.FACTORS[0])[0])
            symbols = encoder.pieces.symbols([chunk])[0].tolist()
            parts.append(encoder.spelt(merge_dropout.merge_long(encoder.pieces, symbols, own, share)))
            ways |= {parts[-1]} if chunk == " international" else set()
        assert b"".join(parts) == ids
    assert len(ways) > 4


def test_lines_decide_inside_and_outside_of_articles():
    page = lambda body: [{"text": t, "article": a} for t, a in page_text.lines_of(body)]
    shell = "<main><div>Welcome</div><p>{}</p><p>{}</p><div>Imprint</div></main>"
    one, two, three = (page(shell.format(f"Story {i}", s)) for i, s in enumerate(("Quoted", "Quoted", "Other")))
    assert page_text.main_text(one, two, three) == "Story 0\n\nQuoted"
    assert page_text.main_text(one, one, two) == "Welcome\n\nStory 0\n\nQuoted\n\nImprint"
    cards = "<div>Site</div><h1>Title {0}</h1><div>Body {0}</div><article>Card {0}</article><article>Second card {0}</article>"
    left, right = page(cards.format(1)), page(cards.format(2))
    assert page_text.main_text(left, right) == "Title 1\n\nBody 1\n\nCard 1\n\nSecond card 1"


def test_token_ids_of_random_text_are_the_librarys():
    """Control characters, combining marks, unassigned and new characters, special tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, one = Tokenizer.from_file(path), token_files.WordEncoder(path)
    pick = random.Random(8)
    kinds = [lambda: chr(pick.randrange(0x80)), lambda: chr(pick.randrange(0x80, 0x2000)), lambda: pick.choice("aeiou 's\t"),
             lambda: chr(pick.choice([0x208F, 0x1C89, 0xA7CE, 0x378, 0x1F9FF, 0x10FFFF, 0x301, 0x327, 0x3A3, 0x3000, 0x85, 0xA0]))]
    kinds += [lambda: pick.choice(["<|endoftext|>", "don't", "1st", "Ⅷ", "ǆ", "İ"]), lambda: chr(pick.randrange(0x2000, 0xD800))]
    for _ in range(3000):
        text = "".join(pick.choice(kinds)() for _ in range(pick.randrange(30)))
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(one.encode(text), "<u4").tolist() == expected, repr(text)
    assert np.frombuffer(one.encode("a\x01b"), "<u4").tolist() == [320, 445, 321]


def test_token_ids_survive_full_caches(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_CACHED", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, one = Tokenizer.from_file(path), token_files.WordEncoder(path)
    for text in ("a few words, a few more words and a few again", "words again", "don't don't"):
        assert np.frombuffer(one.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout sidebar-left"><article><p>Body</p></article><div class="sidebar">x</div></div>',
        '<form id="aspnetForm"><div class="menu">x</div><article><p>Body</p></article></form>',
        '<article class="social-policy"><p>Body</p><div class="share">x</div></article>',
        '<div id="search-results"><main><p>Body</p><form>x</form></main></div>',
        '<div class="comments"><article>x</article></div><aside><article>x</article></aside><p>Body</p>',
        '<div class="related"><article>x</article></div><article class="comment">x</article><article>Body</article>',
    ],
)
def test_wrappers_around_an_article_do_not_hide_it(page):
    assert [text for text, _ in page_text.lines_of(page)] == ["Body"]


def test_pairs_that_make_no_piece_are_looked_up_by_slot():
    """Every pair of symbols was sought among all pairs of pieces, though most make none."""
    pieces = merge_dropout.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    pairs = np.concatenate([pieces.keys[::7], pieces.keys[::7] + 1])
    left, right = pairs >> merge_dropout.SYMBOL_BITS, pairs & ((1 << merge_dropout.SYMBOL_BITS) - 1)
    rank, merged = pieces.look_up(np.append(left, -1), np.append(right, 3))
    for pair, r, m in zip(pairs.tolist(), rank.tolist(), merged.tolist()):
        assert (r, m) == pieces.pairs[pair] if pair in pieces.pairs else r == merge_dropout.NEVER
    assert rank[-1] == merge_dropout.NEVER
    others = np.random.default_rng(1).integers(0, 1 << 40, 10_000)
    assert pieces.taken[pieces.slot(others)].mean() < 0.2
