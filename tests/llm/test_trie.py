"""The conversation trie against plain loops over whole paths."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest

from eventloom.llm import conversation_trie, queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
TURNS = "conv_id bigint, turn bigint, role string, text string, place string, bytes string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_rebuilt(lines):
    original = defaultdict(list)
    for conv, turn, role, text in lines:
        if conv is not None:
            original[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(role, text) for _, role, text in sorted(t, key=lambda x: x[0])] for c, t in original.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return rebuilt


def plain_nodes(rebuilt):
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[b] for b in below) or 1
        size = len(path[-1][1].encode()) if path else 0
        saved[path] = (len(members[path]) - 1) * size + sum(saved[b] for b in below)
    found = []
    for path, convs in members.items():
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(path))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        found.append((min(convs), len(path), parent, len(convs), len(children[path]), leaves[path], saved[path], digest))
    return sorted(found, key=str)


def spark_nodes(spark, lines):
    table = spark.createDataFrame([(*line, "x", "y", 1) for line in lines], TURNS)
    turns = conversation_trie.with_shared_heads(conversation_trie.numbered_turns(table))
    return sorted((tuple(r) for r in conversation_trie.prefix_trie(turns).select(*COLUMNS).collect()), key=str)


def made_conversations(seed, count):
    """Conversations over few different turns, so that many share beginnings; some are copies."""
    pick = random.Random(seed)
    lines = []
    for c in range(count):
        turns = [(pick.choice(["user", "bot", None]), pick.choice(["a", "bé", "ccc", "", None])) for _ in range(pick.randint(1, 6))]
        lines += [(c, t, *turn) for t, turn in enumerate(turns)]
    pick.shuffle(lines)
    return lines


def test_small_table(spark):
    found = sorted((tuple(r) for r in queries.op11_prefix_trie(spark, SMALL).select(*COLUMNS).collect()), key=str)
    table = queries.read_table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()
    assert found == plain_nodes(plain_rebuilt([tuple(r) for r in table]))


@pytest.mark.parametrize("seed", [1, 2])
def test_many_shards(spark, monkeypatch, seed):
    """Shards of a few classes: nodes at every depth lie on the skeleton."""
    monkeypatch.setattr(conversation_trie, "SHARD", 5)
    lines = made_conversations(seed, 300)
    assert spark_nodes(spark, lines) == plain_nodes(plain_rebuilt(lines))


def test_cut_splitters_and_chunks(spark, monkeypatch):
    """Splitters of one turn, chunks of two turns and lists in pieces give the same nodes."""
    monkeypatch.setattr(conversation_trie, "SHARD", 5)
    monkeypatch.setattr(conversation_trie, "SKELETON", 1)
    monkeypatch.setattr(conversation_trie, "CHUNK", 2)
    monkeypatch.setattr(conversation_trie, "STRETCH", 16)
    lines = made_conversations(3, 250)
    assert spark_nodes(spark, lines) == plain_nodes(plain_rebuilt(lines))


def test_a_long_conversation_and_a_crowd_of_copies(spark):
    """Two long conversations part late, others are copies; one has no turns left."""
    lines = [(c, t, "user", f"turn {t}") for c in (0, 10) for t in range(700)]
    lines += [(10, 700, "user", "end")] + [(20, t, "user", f"turn {t}" if t < 300 else f"other {t}") for t in range(900)]
    lines += [(c, t, "user", f"hot {t}") for c in range(1000, 1600, 5) for t in range(3)]
    lines += [(c, 0, "user", "only") for c in range(2001, 2300, 5)]
    lines += [(30, None, "user", "null first"), (30, 0, None, None), (31, 5, "user", "x"), (31, 5, "user", "x")]
    assert spark_nodes(spark, lines) == plain_nodes(plain_rebuilt(lines))


def test_hard_rows(spark):
    lines = [(None, 0, "user", "lost"), (-3, 1, "u", "negative"), (-3, None, None, "first"), (-5, 0, "u", "base")]
    lines += [(7, 0, "user", "x" * 3_000_000), (5, 0, "user", "x" * 3_000_000), (6, None, None, None)]
    expected = plain_nodes(
        {c: t for c, t in _truncated_families(lines).items()}
    )
    assert spark_nodes(spark, lines) == expected
    assert spark_nodes(spark, []) == []


def _truncated_families(lines):
    """As Spark and SQL take the remainder: its sign is that of the id."""
    rebuilt = plain_rebuilt([line for line in lines if line[0] is None or line[0] >= 0])
    own = {-3: [("", "first"), ("u", "negative")], -5: [("u", "base")]}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c + (-c % 5) if c % 5 else c
        rebuilt[c] = own.get(first, [])[:h] + turns[h:]
    return rebuilt
