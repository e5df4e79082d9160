"""Prefix trie of conversations, by shards between splitters and a skeleton of the splitters' paths.

A turn becomes a 128-bit id of role and text, a conversation the path of its turns'
ids. Equal paths are one class with a count. A bounded sample of paths gives
splitters; they cut the sorted classes into shards. A node with members in two
shards lies on the path of a splitter between them, so the trie of splitter paths, the
skeleton, holds every node that no shard can finish. Its size is bounded
(``SKELETON`` nodes) and it is broadcast. Each shard walks its sorted paths once,
finishes the nodes off the skeleton, and gives one partial aggregate for each
skeleton node it touches; these are reduced by node and summed up the skeleton.

Long conversations are kept in chunks of 256 turns. A path goes into the trie only
down to the first chunk that no other class shares; below it a class is a chain
whose nodes follow from running sums over its chunks. So no row grows with a
conversation, only with what two different ones have in common.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import discard, rows, written
from eventloom.operators.running import running_totals

#: Hex digits of a turn's id, and turns of a chunk.
ID = 32
CHUNK = 256
#: Conversation ids whose texts make one piece of the list that is hashed.
STRETCH = 4096
#: Classes of a shard, bounds of the number of shards and of the nodes on splitter paths, sampled classes a shard.
SHARD = 20_000
MOST_SHARDS = 1 << 14
SKELETON = 1 << 18
SAMPLED = 20
LONGEST_SPLITTER = 512
NO_ENDS = sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0, by turn, null first), turn_id and bytes of every turn.

    Null role or text counts as empty. Turns of one number are ordered by their id, so equal rows
    need no order. Rows without a conv_id belong to no conversation and are left out; other
    columns are not read. The turns are sorted in runs of about equal size, so that a conversation of any
    length is numbered by many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.substring(F.sha2(whole, 256), 1, ID).alias("turn_id"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("turn_id")]
    parted = turns.withColumn("copy", F.monotonically_increasing_id())
    runs = written(
        parted.repartitionByRange(*order, "copy").select(*turns.columns, F.spark_partition_id().alias("run")), "turn-runs"
    )
    placed = running_totals(runs, ["conv_id"], order[1:], F.col("run"), {"place": F.lit(1)})
    return placed.select("conv_id", "place", "turn_id", "bytes")


def with_shared_heads(turns: DataFrame, family: int = 5, longest: int = 8) -> DataFrame:
    """Conversations rebuilt on the first turns of the first one of their family of ids.

    Conversation c takes the first h turns of c - c % family (all if fewer), then its own after its
    first h; h is the unsigned crc32 of c in decimals, modulo ``longest`` + 1. One that is left
    without turns keeps a row with a null place.
    """
    turns = written(turns, "turns")
    first = F.col("conv_id") - F.col("conv_id") % family
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)
    turn = F.struct("place", "turn_id", "bytes")
    heads = (
        turns.where((F.col("place") < longest) & (F.col("conv_id") == first))
        .groupBy(F.col("conv_id").alias("first"))
        .agg(F.array_sort(F.collect_list(turn)).alias("head"))
    )
    ids = turns.select("conv_id").distinct().select("conv_id", first.alias("first"), taken.cast("int").alias("h"))
    shared = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    begun = ids.join(heads, "first", "left").select("conv_id", "h", shared.alias("shared"))
    begun = written(begun, "heads")
    own = (
        turns.join(begun.select("conv_id", "h", F.size("shared").alias("kept")), "conv_id")
        .where("place >= h")
        .select("conv_id", (F.col("place") - F.col("h") + F.col("kept")).alias("place"), "turn_id", "bytes")
    )
    head = begun.select("conv_id", F.explode_outer("shared").alias("turn")).select("conv_id", "turn.*")
    return head.unionByName(own)


def path_chunks(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, key (the ids of its turns, joined) and the byte counts of every chunk of a conversation."""
    turn = F.when(F.col("place").isNotNull(), F.struct("place", "turn_id", "bytes"))
    number = F.coalesce(F.floor(F.col("place") / CHUNK), F.lit(0).cast("bigint"))
    gathered = turns.groupBy("conv_id", number.alias("chunk")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.select(
        "conv_id",
        "chunk",
        F.array_join(F.col("turns.turn_id"), "").alias("key"),
        F.col("turns.bytes").alias("bytes"),
    )


def path_classes(chunks: DataFrame) -> DataFrame:
    """Equal paths as one row: path id, smallest conv_id, number ``n``, its chain of chunks, hash of all its conv_ids.

    ``full`` counts the chunks that have all their turns.

    The ids are sorted and spelt out in pieces by many tasks; only the hash itself, which has to
    be taken in order, runs through one task a class, piece after piece.
    """
    one = F.struct("chunk", F.substring(F.sha2(F.col("key"), 256), 1, ID).alias("id"))
    whole = (F.size("bytes") == CHUNK).cast("bigint")
    chain = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("chain"), F.sum(whole).alias("full"))
    chain = chain.select("conv_id", F.col("chain.id").alias("chain"), "full")
    path = F.sha2(F.array_join("chain", ""), 256)
    stretch = F.floor(F.col("conv_id") / STRETCH)
    pieces = (
        chain.groupBy(path.alias("path"), stretch.alias("stretch"))
        .agg(F.array_sort(F.collect_list("conv_id")).alias("ids"), F.first("chain").alias("chain"), F.first("full").alias("full"))
        .select(
            "path", "stretch", "chain", "full", F.get("ids", F.lit(0)).alias("conv_id"), F.size("ids").cast("bigint").alias("n"),
            F.array_join(F.col("ids").cast("array<string>"), ",").alias("listed"),
        )
    )
    return pieces.repartition("path").sortWithinPartitions("path", "stretch").mapInArrow(_hash_lists, CLASSES)


CLASSES = "path string, conv_id bigint, n bigint, chain array<string>, full bigint, ends string"


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one path follow each other: joins their lists under one hash."""
    schema = pa.schema(
        [
            ("path", pa.string()), ("conv_id", pa.int64()), ("n", pa.int64()), ("chain", pa.list_(pa.string())),
            ("full", pa.int64()), ("ends", pa.string()),
        ]
    )
    done: list[tuple] = []
    current, digest = None, sha256()
    for path, chain, full, conv_id, n, listed in rows(batches, "path", "chain", "full", "conv_id", "n", "listed"):
        if current and current[0] == path:
            digest.update(b"," + listed.encode())
            current[2] += n
            continue
        if current:
            done.append((*current, digest.hexdigest()))
        if len(done) >= 10_000:
            yield _batch(done, schema)
            done = []
        current, digest = [path, conv_id, n, chain, full], sha256(listed.encode())
    if current:
        done.append((*current, digest.hexdigest()))
    if done:
        yield _batch(done, schema)


def _batch(lines: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*lines), schema.types)], schema=schema)


def trunk_ends(classes: DataFrame) -> DataFrame:
    """For classes with a full chunk: the last chunk that goes into the trie, one below the last shared one.

    Only full chunks can be shared by different classes; a turn in the next one shared by two of
    them still lies in the trie of both.
    """
    linked = """aggregate(slice(chain, 1, CAST(full AS INT)), named_struct('id', '', 'out', CAST(array() AS ARRAY<STRING>)), (s, x) -> named_struct(
        'id', sha2(concat(s.id, x), 256), 'out', concat(s.out, array(sha2(concat(s.id, x), 256)))), s -> s.out)"""
    prefixes = classes.where("full > 0").select("path", F.posexplode(F.expr(linked)).alias("chunk", "prefix"))
    shared = prefixes.groupBy("prefix").agg(F.count("*").alias("paths")).where("paths > 1")
    deepest = prefixes.join(shared, "prefix", "left").groupBy("path")
    return deepest.agg((F.coalesce(F.max(F.when(F.col("paths") > 1, F.col("chunk"))), F.lit(-1)) + 1).alias("last_chunk"))


def choose_splitters(paths: DataFrame, classes: int) -> list[str]:
    """Keys that cut the classes into shards of about equal size, from a bounded sample.

    A splitter may be cut off anywhere: any string parts the sorted keys in two.
    """
    spark = paths.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes // SHARD))
    shards = max(1, min(shards, MOST_SHARDS, classes))
    turns = max(1, min(LONGEST_SPLITTER, SKELETON // shards))
    share = min(1.0, SAMPLED * shards / max(classes, 1))
    sample = paths.select(F.substring("key", 1, ID * turns).alias("key"))
    sample = sample if share == 1.0 else sample.sample(share, seed=11)
    place = F.row_number().over(Window.orderBy("key")) - 1
    size = F.count("*").over(Window.partitionBy())
    cut = F.floor(F.col("place") * shards / F.col("size")) > F.floor((F.col("place") - 1) * shards / F.col("size"))
    numbered = sample.select("key", place.alias("place"), size.alias("size")).where(F.col("place") > 0).where(cut)
    return sorted({r["key"] for r in numbered.select("key").collect()} - {""})


def shared_turns(a: str, b: str) -> int:
    """Turns that two keys have in common at their beginning."""
    limit = min(len(a), len(b))
    depth = 0
    while depth < limit and a[depth : depth + ID] == b[depth : depth + ID]:
        depth += ID
    return depth // ID


def node_id(prefix: str) -> str:
    return sha256(prefix.encode()).hexdigest()[:ID]


NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, parent string, node string, bytes bigint"
)
NODE_SCHEMA = pa.schema(
    [(n.split()[0], pa.int64() if n.endswith("bigint") else pa.string()) for n in NODES.split(", ")]
)
PLAIN = [n.split()[0] for n in NODES.split(", ")][:8]


class Node:
    __slots__ = ("conv_id", "members", "children", "leaves", "saved", "bytes", "ends", "waiting", "known")

    def __init__(self, size: int, on_skeleton: bool) -> None:
        self.conv_id, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.bytes, self.ends, self.waiting, self.known = size, None, [], on_skeleton


def walk_shard(paths: Iterator[tuple], left: str | None, right: str | None) -> Iterator[tuple]:
    """The nodes of the sorted paths between two splitters.

    Paths are (key, conv_id, n, byte counts, ends, whether a tail follows, its bytes). Nodes on the
    path of a splitter come as partial aggregates under their id; the others are final, with the
    smallest member of their parent, or its id if the parent is on the skeleton.
    """

    def skeleton_depth(key: str) -> int:
        return max(shared_turns(key, s) for s in (left or "", right or ""))

    stack = [Node(0, True)]
    before = ""

    def close(key: str) -> Iterator[tuple]:
        """Takes the deepest node, the one at the end of ``key``, off the stack."""
        node, depth = stack.pop(), len(stack)
        prefix = key[: depth * ID]
        parent = stack[-1] if stack else None
        for child in node.waiting:
            yield (*child[:2], node.conv_id, *child[3:])
        if node.known:
            above = node_id(prefix[:-ID]) if stack else None
            yield (
                node.conv_id, depth, None, node.members, node.children, node.leaves, node.saved, node.ends, above,
                node_id(prefix), node.bytes,
            )
        else:
            leaves = node.leaves or 1
            saved = node.saved + (node.members - 1) * node.bytes
            row = (node.conv_id, depth, None, node.members, node.children, leaves, saved, node.ends or NO_ENDS)
            if parent.known:
                yield (*row, node_id(prefix[:-ID]), None, None)
            else:
                parent.waiting.append((*row, None, None, None))
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
        if parent:
            parent.members += node.members
            parent.conv_id = node.conv_id if parent.conv_id is None else min(parent.conv_id, node.conv_id)

    for key, conv_id, n, sizes, ends, tail, tail_bytes in paths:
        common = shared_turns(before, key)
        while len(stack) > common + 1:
            yield from close(before)
        known = skeleton_depth(key)
        for depth in range(common, len(key) // ID):
            stack.append(Node(sizes[depth], depth < known))
        last = stack[-1]
        last.members += n
        last.conv_id = conv_id if last.conv_id is None else min(last.conv_id, conv_id)
        if tail:
            last.children, last.leaves, last.saved = last.children + 1, last.leaves + 1, last.saved + (n - 1) * tail_bytes
        else:
            last.ends = ends
        before = key
    while stack:
        yield from close(before)


def shard_nodes(paths: DataFrame, splitters: list[str]) -> DataFrame:
    """All shards' nodes, finished ones and partial aggregates of the skeleton (those with a ``node``)."""
    spark = paths.sparkSession
    known = spark.sparkContext.broadcast(splitters)

    @F.arrow_udf("int")
    def shard_of(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(known.value, k) for k in keys.to_pylist()], pa.int32())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for row in walk(rows(batches, "shard", "key", "conv_id", "n", "sizes", "ends", "tail", "tail_bytes")):
            done.append(row)
            if len(done) >= 10_000:
                yield _batch(done, NODE_SCHEMA)
                done = []
        if done:
            yield _batch(done, NODE_SCHEMA)

    def walk(lines: Iterator[tuple]) -> Iterator[tuple]:
        line = next(lines, None)
        while line:
            shard = line[0]

            def mine() -> Iterator[tuple]:
                nonlocal line
                while line and line[0] == shard:
                    yield line[1:]
                    line = next(lines, None)

            cuts = known.value
            yield from walk_shard(mine(), cuts[shard - 1] if shard else None, cuts[shard] if shard < len(cuts) else None)

    sharded = paths.withColumn("shard", shard_of("key")).repartition("shard").sortWithinPartitions("shard", "key")
    return sharded.mapInArrow(task, NODES)


def sum_up(parts: list) -> list[tuple]:
    """The skeleton's nodes with what their subtrees on the skeleton add; parts come one row a node."""
    total = {p["node"]: [p["n_children"], p["n_leaves"], p["saved_tokens"]] for p in parts}
    smallest = {p["node"]: p["conv_id"] for p in parts}
    lines = []
    for p in sorted(parts, key=lambda p: -p["depth"]):
        children, leaves, saved = total[p["node"]]
        leaves, saved = leaves or 1, saved + (p["n_convs"] - 1) * p["bytes"]
        if p["parent"] is not None:
            above = total[p["parent"]]
            above[0], above[1], above[2] = above[0] + 1, above[1] + leaves, above[2] + saved
        lines.append(
            (
                p["conv_id"], p["depth"], smallest.get(p["parent"]), p["n_convs"], children, leaves, saved,
                p["ends_sha256"] or NO_ENDS, p["node"],
            )
        )
    return lines


def skeleton(spark: SparkSession, partial: DataFrame) -> DataFrame:
    """Partial aggregates reduced by node, then summed up the skeleton, whose size is bounded."""
    reduced = partial.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
        F.max("bytes").alias("bytes"),
    )
    schema = ", ".join(NODES.split(", ")[:8]) + ", node string"
    return spark.createDataFrame(sum_up(reduced.collect()), schema)


def tail_nodes(tails: DataFrame) -> DataFrame:
    """The nodes below the trie: chains of one class each."""
    sums = tails.select("path", "chunk", F.aggregate("bytes", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("sum"))
    below = Window.partitionBy("path").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select("path", "chunk", F.coalesce(F.sum("sum").over(below), F.lit(0)).alias("later"))
    inside = Window.partitionBy("path", "chunk").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    last = (F.col("chunk") == F.size("chain") - 1) & (F.col("pos") == F.col("turns") - 1)
    spread = tails.join(later, ["path", "chunk"]).select("*", F.size("bytes").alias("turns"), F.posexplode("bytes"))
    return spread.withColumn("below", F.sum("col").over(inside) + F.col("later")).select(
        "conv_id",
        (F.col("chunk") * CHUNK + F.col("pos") + 1).alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("below")).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie of the conversations in ``turns`` (conv_id, place, turn_id, bytes).

    A node is a distinct sequence of the first ``depth`` turns. ``conv_id`` is its smallest member,
    ``parent_conv_id`` that of its parent (null for the root), ``n_convs`` its members;
    ``n_leaves`` and ``saved_tokens`` sum over its subtree, ``ends_sha256`` hashes the ids of the
    members that end there. A conversation without turns has a row with a null place and is a member of
    the root. An empty table gives no nodes; repeated turns are turns of their own.
    """
    spark = turns.sparkSession
    chunks = written(path_chunks(turns), "path-chunks")
    classes = written(path_classes(chunks), "path-classes")
    first = F.coalesce("last_chunk", F.lit(0)).alias("last_chunk")
    listed = classes.join(trunk_ends(classes), "path", "left").select(*classes.columns, first)
    placed = written(chunks.join(listed, "conv_id"), "class-chunks")

    in_trunk = F.col("chunk") <= F.col("last_chunk")
    part = F.when(in_trunk, F.struct("chunk", "key", "bytes"))
    length = F.aggregate("bytes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    trunks = placed.groupBy("path", "conv_id", "n", "ends").agg(
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.max(~in_trunk).alias("tail"),
        F.sum(F.when(in_trunk, 0).otherwise(length)).alias("tail_bytes"),
    )
    paths = written(
        trunks.select(
            F.array_join(F.col("parts.key"), "").alias("key"), "conv_id", "n", F.flatten(F.col("parts.bytes")).alias("sizes"),
            "ends", "tail", "tail_bytes",
        ), "paths",
    )
    splitters = choose_splitters(paths, paths.count())
    nodes = written(shard_nodes(paths, splitters), "trie-nodes")
    discard(chunks, classes, paths)
    known = skeleton(spark, nodes.where("node IS NOT NULL"))
    above = F.broadcast(known.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    finished = nodes.where("node IS NULL").join(above, "parent", "left")
    finished = finished.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    columns = [F.col(c) for c in PLAIN]
    return (
        known.select(*columns)
        .unionByName(finished.select(*columns))
        .unionByName(tail_nodes(placed.where(~in_trunk)).select(*columns))
    )
