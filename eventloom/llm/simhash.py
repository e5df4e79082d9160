"""SimHash fingerprints and their links, found in a hierarchical index over Gray order.

Two fingerprints of 64 bits that differ in at most ``distance`` bits agree on at least two
of ``distance + 2`` blocks of bits. Distinct fingerprints are therefore dealt out by every pair
of blocks, as rows of one ordinary shuffle. Within such a group they stand in Gray order,
where neighbours share most bits; runs of 16 make a node, runs of 16 nodes the next level.
A node keeps the bits that all below it share, less those its parents hold already. A
search goes down from the root, adds up the differing bits of each node on its way, and
leaves a whole group as soon as the sum is too large, or if all of it is already linked to
the one that searches.

Only as many links of a group are put out as hold it together. Groups of more than ``GROUP``
fingerprints are cut into shares, and every pair of shares is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import discard, no_helper, rows, written
from eventloom.llm.components import connected_components

SEED = 42
GROUP = 2048
FANOUT = 16
FRONTIER = 1 << 19
WIDENING = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]

# --- fingerprints ---


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    """XXH64 of every shingle in order, repeats included; of fewer words, the whole sequence."""
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = min(words, len(found)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(starts) - last].tolist(), ends[last:].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bit by bit, whether over half of the hashes (rows of 64-bit numbers) have it set, as 64-bit numbers."""
    hashes = hashes.reshape(len(hashes), -1)
    set_bits = np.zeros(64 * hashes.shape[1], np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[start : start + (1 << 14)]).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return np.packbits((set_bits * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int) -> int:
    """The majority of all shingles' hashes; 0 without a word."""
    hashes = shingle_hashes(words_of(text), words)
    return int(majority(hashes)[0]) if len(hashes) else 0


def with_fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and bits (64 bits as a signed long) of every whole text.

    A-Z are lower-cased, words are split at ASCII white space and shingles of ``words``
    words hashed by XXH64. A text of fewer words is one shingle; null, empty or blank: 0.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_helper()
        for batch in batches:
            found = [fingerprint(t, words) for (t,) in rows([batch], "text")]
            bits = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bits], ["doc_id", "bits"])

    wanted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(hashed, "doc_id bigint, bits bigint")


# --- the index ---


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray order."""
    rank = bits.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (smallest row of each component) after the links a-b, and the places of the links that were needed.

    In each round every label hangs itself on a smaller one by a single link, so the links
    taken never close a ring.
    """
    taken, at = [], np.arange(len(a))
    while True:
        x, y = labels[a[at]], labels[b[at]]
        apart = x != y
        if not apart.any():
            return labels, np.concatenate([*taken, at[:0]])
        at, x, y = at[apart], x[apart], y[apart]
        larger, first = np.unique(np.maximum(x, y), return_index=True)
        labels[larger] = np.minimum(x, y)[first]
        taken.append(at[first])
        while True:
            next_labels = labels[labels]
            if (next_labels == labels).all():
                break
            labels = next_labels


def spanning_links(
    group: np.ndarray, bits: np.ndarray, distance: int, wide: np.ndarray | None = None, wide_distance: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, transitively, all rows of each group that are near each other.

    Near means at most ``distance`` differing bits and, if there are ``wide`` fingerprints too
    (rows of 64-bit numbers), at most ``wide_distance`` in those. Returns pairs of row numbers,
    fewer than there are rows.
    """
    bits = bits.astype(np.uint64)
    order = np.lexsort((gray_rank(bits), group))
    group, bits = group[order], bits[order]
    wide = None if wide is None else wide[order]
    n = len(bits)
    labels = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def link(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if wide is not None:
            near = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1) <= wide_distance
            a, b = a[near], b[near]
        labels, taken = merge_labels(labels, a, b)
        found.append((a[taken], b[taken]))
        return labels

    near = np.nonzero((group[1:] == group[:-1]) & (np.bitwise_count(bits[1:] ^ bits[:-1]) <= distance))[0]
    labels = link(labels, near, near + 1)

    # Levels from the rows up to one root a group: first row, last row, shared bits, pattern.
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    first, stop = np.arange(n), np.arange(1, n + 1)
    levels = [(first, stop, np.full(n, full), bits, group)]
    children: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        _, _, mask, pattern, owner = levels[-1]
        begins = np.concatenate([[True], owner[1:] != owner[:-1]])
        start_of = np.maximum.accumulate(np.where(begins, np.arange(len(owner)), 0))
        heads = np.nonzero((np.arange(len(owner)) - start_of) % FANOUT == 0)[0]
        if len(heads) == len(owner):
            break
        ends = np.append(heads[1:], len(owner))
        spread = np.repeat(heads, ends - heads)
        shared = np.bitwise_and.reduceat(mask & ~(pattern ^ pattern[spread]), heads)
        children.append((heads, ends))
        levels.append((levels[-1][0][heads], levels[-1][1][ends - 1], shared, pattern[heads] & shared, owner[heads]))
    root_of = np.searchsorted(levels[-1][4], group)
    searched = np.arange(n)
    # A search starts at the root of its group; only rows behind it are wanted.
    step = max(1, FRONTIER // FANOUT)
    for start in range(0, n, step):
        row = searched[start : start + step]
        node = root_of[row]
        stack = [(len(levels) - 1, row, node, np.zeros(len(row), np.int64), np.zeros(len(row), np.uint64))]
        while stack:
            level, row, node, sum_, known = stack.pop()
            low, high, mask, pattern, _ = levels[level]
            own = mask[node] & ~known
            sum_ = sum_ + np.bitwise_count((bits[row] ^ pattern[node]) & own)
            keep = (sum_ <= distance) & (high[node] > row + 1)
            # Rows of a node that all carry the searcher's label need no further link.
            row, node, sum_, known = row[keep], node[keep], sum_[keep], mask[node[keep]]
            if level == 0:
                labels = link(labels, row, node)
                continue
            uniform_from = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
            same = (uniform_from[low[node]] == uniform_from[high[node] - 1]) & (labels[low[node]] == labels[row])
            row, node, sum_, known = row[~same], node[~same], sum_[~same], known[~same]
            heads, ends = children[level - 1]
            sizes = ends[node] - heads[node]
            # Cut a wide frontier in two, so that memory stays bounded.
            cuts = [slice(None)] if sizes.sum() <= FRONTIER else [slice(0, len(row) // 2), slice(len(row) // 2, None)]
            if len(cuts) == 2 and len(row) > 1:
                for cut in cuts:
                    stack.append((level, row[cut], node[cut], sum_[cut], known[cut]))
                    # Its own bits are counted already: known holds them.
                continue
            below = np.repeat(heads[node] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            stack.append((level - 1, np.repeat(row, sizes), below, np.repeat(sum_, sizes), np.repeat(known, sizes)))
    a, b = (np.concatenate(side) for side in zip(*found))
    return order[a], order[b]


# --- links over Spark ---


def block_masks(distance: int) -> list[int]:
    """The bits of every pair of blocks: two of ``distance + 2`` blocks must agree."""
    edges = [round(64 * i / (distance + 2)) for i in range(distance + 3)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def fingerprint_links(prints: DataFrame, distance: int = 4, wide_distance: int | None = None) -> DataFrame:
    """a and b: links between the distinct ``node`` s that leave none that are near unconnected.

    ``prints`` has node, bits and, if ``wide_distance`` is given, wide: a second, longer
    fingerprint as bytes, in which linked nodes must be near as well.
    """
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in block_masks(distance)]
    payload = ["node", "bits"] if wide_distance is None else ["node", "bits", "wide"]
    pairs = F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m)) for m in signed])).alias("pair", "shared")
    keyed = prints.select(*payload, pairs)
    # Written down, these few rows tell their size, and the fingerprints are not shuffled to meet them.
    crowded = written(
        prints.select("bits", pairs).groupBy("pair", "shared").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
        .select("pair", "shared", F.ceil(F.col("n") * 2 / GROUP).cast("int").alias("shares")),
        "crowded-blocks",
    )
    shares = F.coalesce("shares", F.lit(1))
    share = F.pmod(F.xxhash64("node", F.lit("share")), shares).cast("int")
    dealt = (
        keyed.join(crowded, ["pair", "shared"], "left")
        .select(*payload, "pair", "shared", share.alias("own"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("other"))
        .select(
            F.xxhash64("pair", "shared", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *payload,
        )
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(chunk: pa.Table) -> pa.RecordBatch:
            keys = chunk.column("key").to_numpy()
            differs = keys[1:] != keys[:-1]
            met = np.nonzero(~(np.concatenate([[True], differs]) & np.concatenate([differs, [True]])))[0]
            chunk = chunk.take(pa.array(met))
            nodes, bits = chunk.column("node").to_numpy(), chunk.column("bits").to_numpy()
            wide = None
            if wide_distance is not None:
                wide = np.frombuffer(b"".join(chunk.column("wide").to_pylist()), "<u8").reshape(len(met), WIDE)
            a, b = spanning_links(keys[met], bits, distance, wide, wide_distance or 0) if len(met) else (met, met)
            pairs = np.unique(np.stack([np.maximum(nodes[a], nodes[b]), np.minimum(nodes[a], nodes[b])], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size < 1 << 16:
                continue
            table = pa.Table.from_batches(waiting)
            keys = table.column("key").to_numpy()
            # The last group may go on in the next batch.
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield flush(table.slice(0, whole))
                waiting, size = table.slice(whole).to_batches(), table.num_rows - whole
        if waiting:
            yield flush(pa.Table.from_batches(waiting))

    # Two groups whose keys collide are searched together, which adds no wrong link.
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Equal fingerprints are folded to one before links are sought. component_id is the
    smallest non-null doc_id that can be reached over links of at most ``distance`` bits,
    the row's own included; a null doc_id is never a component's id unless there is no
    other. Texts without a word have the fingerprint zero and link like any other. Repeated
    rows each get a row. An empty table gives an empty result.
    """
    hashed = written(with_fingerprints(docs, words, id_col, text_col), "fingerprints")
    prints = written(hashed.groupBy("bits").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    links = fingerprint_links(prints.select(F.col("bits").alias("node"), "bits"), distance)
    labels = connected_components(links)
    labelled = prints.join(labels, prints.bits == labels.node, "left").select(
        "bits", "least_id", F.coalesce("label", "bits").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    answers = labelled.join(least, "label").select("bits", "component_id")
    return hashed.join(answers, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- one document of each group of near copies ---

WORD_DISTANCE = 8
WIDE = 4


def wide_distance_of(similarity: float) -> int:
    """Bits in which fingerprints of sets of that Jaccard similarity differ, two standard deviations included."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE
    return math.ceil(bits * share + 2 * math.sqrt(bits * share * (1 - share)))


def set_fingerprints(text: str | None, words: int) -> tuple[int, bytes, np.ndarray]:
    """Of the distinct words (64 bits), and of the distinct shingles (256 bits); and these in order."""
    found = words_of(text)
    if not found:
        return 0, bytes(8 * WIDE), np.zeros(0, np.uint64)
    single = majority(np.unique(shingle_hashes(found, 1)))
    shingles = np.unique(shingle_hashes(found, words))
    spread = np.stack([shingles * np.uint64(m) for m in WIDENING], axis=1)
    spread = (spread ^ (spread >> np.uint64(32))) * np.uint64(WIDENING[0])
    spread ^= spread >> np.uint64(29)
    return int(single[0]), majority(spread).tobytes(), shingles


# --- the exact way for what the fingerprints miss ---

PARITY_BITS = 1024
MOST_COMMON = 100_000
PAIRS_AT_ONCE = 1 << 17


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a share of the texts, and their counts there.

    They only set the order in which shingles are looked at, rare ones first. Any order finds
    the same copies; this one keeps most shingles of a common passage out of the search.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(shingles[often].view(np.int64)), pa.array(counts[often])], ["shingle", "n"]
            )

        held, size = [], 0
        for (text,) in rows(batches, "text"):
            held.append(np.unique(shingle_hashes(words_of(text), words)))
            size += len(held[-1])
            if size > 1 << 20:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    some = texts.where(F.pmod("node", F.lit(8)) == 0).select("text")
    often = some.mapInArrow(counted, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    most = often.where("n > 2").orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow().sort_by("shingle")
    return most.column("shingle").to_numpy(), most.column("n").to_numpy()


def prefix_of(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles in the common order, as signed numbers; two sets that are similar share one of these.

    At least ``similarity`` of either set lies in the other, so both cannot lack all of
    what comes first. The set without a shingle has one of its own.
    """
    if not len(shingles):
        return np.zeros(1, np.int64)
    signed = shingles.view(np.int64)
    known, counts = common
    times = np.zeros(len(signed), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, signed), len(known) - 1)
        times = np.where(known[at] == signed, counts[at], 0)
    n = len(signed)
    return signed[np.lexsort((signed, times))[: n - math.ceil(similarity * n - 1e-9) + 1]]


def parity_of(shingles: np.ndarray) -> bytes:
    """Per bit, whether an odd number of shingles falls on it: two sets differ in no fewer shingles than bits."""
    falls = np.bincount((shingles & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((falls & 1).astype(np.uint8), bitorder="little").tobytes()


def bucket_pairs(
    label: np.ndarray, size: np.ndarray, place: np.ndarray, parity: np.ndarray, similarity: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket that can be similar and differ in their label, with the share of bits that differ.

    A row is a set with its size, the place of the bucket's shingle in its order, and its parity
    bits. No pair of similar sets is left out at the first shingle that they share.
    """
    _, code, counts = np.unique(label, return_inverse=True, return_counts=True)
    # The largest label first: its own pairs are never looked at.
    order = np.lexsort((code, -counts[code]))
    label, size, place, parity = label[order], size[order], place[order], parity[order]
    begin = np.concatenate([[0], np.nonzero(label[1:] != label[:-1])[0] + 1])
    before = begin[np.searchsorted(begin, np.arange(len(label)), side="right") - 1]
    at = int(before.searchsorted(1))
    while at < len(label):
        stop = at + 1
        # ``before`` grows, so the pairs of a stretch of rows are at most its length times its last.
        while stop < len(label) and (stop + 1 - at) * int(before[stop]) <= PAIRS_AT_ONCE:
            stop += 1
        reach = before[at:stop]
        row = np.repeat(np.arange(at, stop), reach)
        other = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)
        total = size[row] + size[other]
        behind = np.minimum(size[row] - place[row], size[other] - place[other])
        fits = (behind * (1 + similarity) >= similarity * total - 1e-6) & (
            np.minimum(size[row], size[other]) >= similarity * np.maximum(size[row], size[other]) - 1e-6
        )
        row, other, total = row[fits], other[fits], total[fits]
        differ = np.bitwise_count(parity[row] ^ parity[other]).sum(axis=1, dtype=np.int64)
        near = differ * (1 + similarity) <= (1 - similarity) * total + 1e-6
        yield order[row[near]], order[other[near]], differ[near] / total[near]
        at = stop


def shared_prefixes(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """node, place, size, parity and key of every place where a shingle joins sets of different labels.

    ``sets`` has node, size, prefix and parity. Every two sets of different labels with a common
    shingle in their prefixes meet under a key; shingles of more than ``GROUP`` sets are
    cut into shares, and every pair of shares meets.
    """
    placed = with_labels(sets, labels).select("node", "label", F.posexplode("prefix").alias("place", "shingle"))
    shared = written(
        placed.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
        .where("low <> high").select("shingle", F.ceil(F.col("n") * 2 / GROUP).cast("int").alias("shares"), "n"),
        "shared-shingles",
    )
    shares = F.when(F.col("n") > GROUP, F.col("shares")).otherwise(1)
    share = F.pmod(F.xxhash64("node", F.lit("share")), F.col("shares")).cast("int")
    dealt = (
        placed.select("node", "place", "shingle").join(shared, "shingle").withColumn("shares", shares)
        .select("node", "place", "shingle", share.alias("own"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("other"))
        .select("node", "place", F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    )
    met = written(dealt, "shared-prefixes")
    discard(shared)
    return met


def with_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def prefix_links(met: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float, pruned: bool) -> DataFrame:
    """a and b: pairs of different labels that can be similar; ``pruned``: the nearest that hold them together."""
    named = with_labels(sets.select("node", "size", "parity"), labels)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, nodes, label, size, place = (
                chunk.column(c).to_numpy() for c in ("key", "node", "label", "size", "place")
            )
            parity = np.frombuffer(b"".join(chunk.column("parity").to_pylist()), "<u8").reshape(len(keys), -1)
            heads = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
            lasts = heads[1:] - 1
            mixed = np.add.reduceat(np.concatenate([[False], label[1:] != label[:-1]]), heads[:-1]) > 0
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for first, last in zip(heads[:-1][mixed].tolist(), lasts[mixed].tolist()):
                part = slice(first, last + 1)
                for a, b, apart in bucket_pairs(label[part], size[part], place[part], parity[part], similarity):
                    if len(a):
                        held.append((a + first, b + first, apart))
                        if sum(len(x[0]) for x in held[-64:]) > PAIRS_AT_ONCE:
                            yield linked(held, nodes, label)
                            held.clear()
            if held:
                yield linked(held, nodes, label)

        def linked(held: list, nodes: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
            a, b, apart = (np.concatenate(side) for side in zip(*held))
            if pruned:
                order = np.argsort(apart, kind="stable")
                a, b = a[order], b[order]
                names, code = np.unique(label[np.concatenate([a, b])], return_inverse=True)
                kept = nearest_forest(len(names), code[: len(a)], code[len(a) :])
                a, b = a[kept], b[kept]
            pairs = np.unique(np.stack([np.maximum(nodes[a], nodes[b]), np.minimum(nodes[a], nodes[b])], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for chunk in whole_groups(batches):
            yield from flush(chunk)

    # Two shingles whose keys collide are searched together, which adds candidates and loses none.
    joined = met.join(named, "node").select("key", "node", "label", "size", "place", "parity")
    return joined.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a bigint, b bigint").distinct()


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the links, in their order, that join what was apart."""
    parent = list(range(n))
    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            kept.append(i)
    return kept


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows sorted by key in which each key is whole."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size < 1 << 14:
            continue
        table = pa.Table.from_batches(waiting)
        keys = table.column("key").to_numpy()
        # The last group may go on in the next batch.
        whole = int(np.searchsorted(keys, keys[-1]))
        if whole:
            yield table.slice(0, whole)
        waiting, size = table.slice(whole).to_batches(), table.num_rows - whole
    if size:
        yield pa.Table.from_batches(waiting)


def drop_near_copies(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without all but one row, that of the smallest id, of each group of exact and near copies.

    Near copies share at least ``similarity`` of their shingles of five words; groups are what
    their links connect. Most links are found by the fingerprint of the distinct words and a
    longer one of the shingles. What these miss is found exactly: the first shingles of a
    text in a common order, rare ones first, must hold one of each near copy's. Every pair
    that shares one, and that neither sizes nor parity bits rule out, is checked against the texts unless
    its texts are already in one group. Only checked links make groups: of the candidates,
    first those that hold them together are checked, at last all that are still apart.
    Null texts count as empty; null ids as the smallest; of fully equal rows one stays.
    """
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumn("_own", own)

    slim = keyed.select(F.col("_own").alias("node"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    common = common_shingles(slim, words)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_helper()
        for batch in batches:
            prints, wides, sizes, prefixes, parities = [], [], [], [], []
            for (text,) in rows([batch], "text"):
                single, wide, shingles = set_fingerprints(text, words)
                prints.append(single)
                wides.append(wide)
                sizes.append(max(1, len(shingles)))
                prefixes.append(prefix_of(shingles, common, similarity))
                parities.append(parity_of(shingles))
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"), batch.column("id"), pa.array(np.array(prints, np.uint64).view(np.int64)),
                    pa.array(wides, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)]))),
                    pa.array(parities, pa.binary()),
                ],
                ["node", "id", "bits", "wide", "size", "prefix", "parity"],
            )

    schema = "node bigint, id bigint, bits bigint, wide binary, size bigint, prefix array<bigint>, parity binary"
    marked = written(slim.mapInArrow(hashed, schema), "set-fingerprints")
    prints = written(
        marked.groupBy("node").agg(*[F.first(c).alias(c) for c in ("bits", "wide", "size", "prefix", "parity")]), "texts"
    )
    ids = written(marked.select("node", "id"), "ids")
    discard(marked)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A text of several links is hashed once while its links follow each other.
        shingles = lru_cache(64)(lambda text: np.unique(shingle_hashes(words_of(text), words)))
        for batch in batches:
            near = []
            for left, right in rows([batch], "left", "right"):
                a, b = shingles(left), shingles(right)
                common = len(np.intersect1d(a, b, assume_unique=True))
                whole = len(a) + len(b) - common
                near.append(whole == 0 or common / whole >= similarity)
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    def checked(links: DataFrame) -> DataFrame:
        """Those whose texts are similar. A text with many links is a skewed join, which Spark splits."""
        asked = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = written(
            slim.join(asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "linked-texts"
        )
        both = (
            links.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
        )
        near = written(both.select("a", "b", "left", "right").mapInArrow(confirm, "a bigint, b bigint"), "checked-links")
        discard(texts)
        return near

    asked = written(fingerprint_links(prints, WORD_DISTANCE, wide_distance_of(similarity)), "candidate-links")
    found = checked(asked)
    labels = connected_components(found)
    met = shared_prefixes(prints, labels)
    for pruned in (True, False):
        links = written(
            prefix_links(met, prints, labels, similarity, pruned).join(asked, ["a", "b"], "left_anti"), "candidate-links"
        )
        if links.isEmpty():
            # Without a new candidate a later round may still have some: those a pruned one stands for.
            continue
        asked, found = asked.unionByName(links), found.unionByName(checked(links))
        discard(labels)
        labels = connected_components(found)
    discard(met, prints)
    members = (
        ids.join(labels, "node", "left")
        .select("node", "id", F.coalesce("label", "node").alias("label"))
    )
    stays = members.groupBy("label").agg(F.min(F.struct("id", "node")).alias("stays"))
    rows_of = members.groupBy("label", "id", "node").agg(F.count("*").alias("n"))
    judged = rows_of.join(stays, "label").select(
        F.col("id").alias("_id"), F.col("node").alias("_node"), F.col("n").alias("_n"),
        (F.struct("id", "node") == F.col("stays")).alias("_stays"),
    )
    odd = written(judged.where("NOT _stays OR _n > 1"), "copies")
    discard(ids, labels)
    same = keyed[id_col].cast("bigint").eqNullSafe(F.col("_id")) & (keyed["_own"] == F.col("_node"))
    kept = keyed.join(odd, same, "left").where("_stays IS NULL OR _stays")
    once = kept.where("_n IS NULL").select(*docs.columns)
    again = kept.where("_n > 1").dropDuplicates(["_id", "_node"]).select(*docs.columns)
    return once.unionByName(again)
