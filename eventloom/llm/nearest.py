"""Approximate nearest neighbours by cosine: an inverted list index searched dimension by dimension.

Vectors are scaled to length one and rotated at random, so that a distance over the first d of
D dimensions, times D/d, estimates the whole one. Rows are dealt to the list of their nearest
centre. In each probed list the vectors lie in blocks of columns. A search adds up squared
differences block by block; after each, a candidate is given up if the estimate lies so far
above the distance of the k-th nearest so far that, at the test's level, it cannot belong to
the nearest (``SLACK`` standard deviations). What is left at the end is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import written

SLACK = 2.1
BLOCK_DIMS = 8
SEED = 20240607
ROUNDING = 1e-5
#: Pairs of a query and a vector that are looked at together, and numbers of vectors that are multiplied together.
PAIRS, VALUES = 1 << 18, 1 << 20
#: Vectors of either side, in double precision, that a group holds.
GROUP_BYTES = 16 << 20
#: Rows that a task hands on together.
BATCH_ROWS = 4096


@dataclass(frozen=True)
class Index:
    """Fitted on a bounded sample: centres (unit length) and a random rotation; lists to probe."""

    centres: np.ndarray
    rotation: np.ndarray
    probes: int

    @property
    def dims(self) -> int:
        return self.rotation.shape[0]


def usable(vector: Column) -> Column:
    """Not null, every component finite, some component not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first: squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, rows: int, k: int, recall: float, most_lists: int) -> Index:
    """Spherical k-means on the sample; probes are the fewest lists that give its own queries ``recall``."""
    random = np.random.default_rng(SEED)
    dims = sample.shape[1]
    rotation = np.linalg.qr(random.normal(size=(dims, dims)))[0]
    vectors = unit(sample)
    lists = int(np.clip(np.sqrt(rows) / 2, 1, min(most_lists, max(1, len(sample) // 20))))
    centres = vectors[random.choice(len(vectors), lists, replace=False)]
    for _ in range(12):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    own = (vectors @ centres.T).argmax(axis=1)
    asked = vectors[random.choice(len(vectors), min(400, len(vectors)), replace=False)]
    nearest = np.argsort(-(asked @ vectors.T), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, own[nearest], axis=1) + 1
    probes = int(np.quantile(needed, recall, method="higher")) if needed.size else lists
    return Index(centres, rotation, min(lists, probes))


def search_list(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, cut: bool = True
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, vector rows) of pairs that no test rejects, some queries at a time. Rows are rotated unit vectors.

    ``cut`` leaves out pairs that lie farther than a query's k nearest by more than rounding can explain.
    """
    dims = vectors.shape[1]
    # Column blocks: all vectors' first dimensions lie together, then the next ones.
    blocks = [np.ascontiguousarray(vectors[:, d : d + BLOCK_DIMS]) for d in range(0, dims, BLOCK_DIMS)]
    turned = [np.vstack([b.T, np.ones(len(b), np.float32), (b * b).sum(axis=1)]).astype(np.float32) for b in blocks]
    # The k-th distance to a few vectors of the list is the first bound.
    few = min(len(vectors), 4 * k + 1)
    together = int(np.clip(PAIRS // max(1, len(vectors)), 1, 256))
    for start in range(0, len(queries), together):
        asked, asked_ids = queries[start : start + together], query_ids[start : start + together]
        own = asked_ids[:, None] == ids[None]
        first = ((asked[:, None, :] - vectors[None, :few, :]) ** 2).sum(axis=2)
        first[own[:, :few]] = np.inf
        bound = np.sort(first, axis=1)[:, k - 1] if few >= k else np.full(len(asked), np.inf)
        sums, left, row, at, done = np.zeros(own.shape, np.float32), ~own, None, None, 0
        for b, block in enumerate(blocks):
            part = asked[:, done : done + block.shape[1]]
            done += block.shape[1]
            limit = bound * (done / dims) * (1 + SLACK / np.sqrt(done)) ** 2 if done < dims else bound
            limit = limit + ROUNDING
            if row is None:
                # While many candidates are left, all pairs are summed up as one product of matrices:
                # |q|^2 - 2 q v + |v|^2, each term with a column of its own.
                ones = np.ones((len(part), 1), np.float32)
                sums += np.hstack([-2 * part, (part * part).sum(axis=1)[:, None], ones]) @ turned[b]
                left &= sums <= limit[:, None].astype(np.float32)
                if np.count_nonzero(left) * 32 <= left.size:
                    row, at = np.nonzero(left)
                    sums = sums[row, at]
            else:
                sums = sums + ((part[row] - block[at]) ** 2).sum(axis=1)
                keep = sums <= limit[row]
                row, at, sums = row[keep], at[keep], sums[keep]
        if row is None:
            if cut and k <= len(vectors):
                sums[~left] = np.inf
                left &= sums <= np.partition(sums, k - 1, axis=1)[:, k - 1 : k] + np.float32(4 * ROUNDING)
            row, at = np.nonzero(left)
        elif cut and len(row):
            sums, by = sums.astype(float), np.lexsort((sums, row))
            place = _places(row[by])
            farthest = np.full(len(asked), np.inf)
            farthest[row[by][place == k - 1]] = sums[by][place == k - 1]
            keep = sums <= farthest[row] + 4 * ROUNDING
            row, at = row[keep], at[keep]
        yield row + start, at


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of every element among its equals, which lie together."""
    begin = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, bool)
    return np.arange(len(groups)) - np.maximum.accumulate(np.where(begin, np.arange(len(groups)), 0))


def best_of_list(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, rotation: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, vector id and cosine of each query's k best in a list. Rows are the original vectors.

    Pairs are scored and cut to the best query by query: what is held at once does not grow with the
    queries times the list.
    """
    asked_length, length = (np.sqrt((v * v).sum(axis=1)) for v in (queries, vectors))
    # Where squares overflow or vanish, distances of unit vectors don't tell the order of the scores.
    lengths = np.concatenate([asked_length, length])
    plain = bool(((lengths > 1e-140) & (lengths < 1e140)).all())
    step = max(1, VALUES // vectors.shape[1])
    found = []
    for row, at in search_list(
        (unit(queries) @ rotation).astype(np.float32), query_ids, (unit(vectors) @ rotation).astype(np.float32), ids, k, plain
    ):
        score = np.empty(len(row))
        for i in range(0, len(row), step):
            r, a = row[i : i + step], at[i : i + step]
            score[i : i + step] = (queries[r] * vectors[a]).sum(axis=1) / (asked_length[r] * length[a])
        order = np.lexsort((ids[at], -score, row))
        order = order[_places(row[order]) < k]
        found.append((query_ids[row[order]], ids[at[order]], score[order]))
    return tuple(np.concatenate(c) for c in zip(*found))


def packed_lists(rows_in: np.ndarray, most: int) -> np.ndarray:
    """The part of every list: neighbouring lists together, of ``most`` rows at most unless one list has more."""
    part_of, part, held = np.zeros(len(rows_in), int), 0, 0
    for i, n in enumerate(rows_in):
        if held and held + n > most:
            part, held = part + 1, 0
        part_of[i], held = part, held + n
    return part_of


def nearest(
    embeddings: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    sample_rows: int = 20_000, recall: float = 0.97, most_lists: int = 512,
    chunk_rows: int | None = None, query_rows: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest other rows.

    Score is the cosine in double precision on the original vectors; ties go to the smaller
    id. The centres and the number of probed lists are fitted on at most ``sample_rows`` rows,
    those of least hash; every row is indexed. A query probes more lists if they hold fewer
    than 20 k rows, so with few rows it gets all of them.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do
    those of another dimension than most of the sample. Rows with a query's own id are not
    its candidates; rows without an id take no part; repeated rows are one.

    Small lists are put together into parts, large ones are cut into chunks by a hash; a part's queries
    are cut into shares by their own number. Each chunk meets each share in a group of its own, so
    neither a list nor its queries have to fit one task. A query travels once to a part. ``chunk_rows`` and
    ``query_rows`` bound the two sides; without them, the bytes of their vectors do.
    """
    spark = embeddings.sparkSession
    # Single precision stays as it is: half the bytes to move.
    single = isinstance(getattr(embeddings.select(vector_col).schema[0].dataType, "elementType", None), T.FloatType)
    kind, dtype = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    wanted = embeddings.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), is_query.alias("asks")
    )
    valid = wanted.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    # The largest hash of the sample first: only its own vectors are gathered.
    place = F.xxhash64("vec_id")
    last = valid.select(place.alias("place")).orderBy("place").limit(sample_rows).agg(F.max("place")).first()[0]
    chosen = valid.where(place <= last).orderBy(place, "vec_id", "vector").limit(sample_rows).select("vector").toPandas()["vector"]
    if not len(chosen):
        return spark.createDataFrame([], schema)
    sizes = chosen.map(len)
    dims = int(sizes.mode().iloc[0])
    sample = np.stack(chosen[sizes == dims].to_list()).astype(float)
    rows_ = valid.where(F.size("vector") == dims)
    together = max(1, GROUP_BYTES // (8 * dims))
    chunk_rows, query_rows = chunk_rows or together, query_rows or together
    index = fit(sample, rows_.count(), k, recall, most_lists)
    held = spark.sparkContext.broadcast(index)

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dims).astype(float)

    def deal(batches):
        centres = held.value.centres
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy().reshape(-1, dims)
            near = (unit(flat.astype(float)) @ centres.T).argmax(axis=1) if len(flat) else np.zeros(0, int)
            packed = pa.array([v.tobytes() for v in flat.astype(dtype)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), packed, batch.column("asks"), pa.array(near, pa.int32())],
                ["vec_id", "vector", "asks", "list"],
            )

    dealt = written(
        rows_.dropDuplicates(["vec_id", "vector"]).mapInArrow(deal, "vec_id bigint, vector binary, asks boolean, list int"), "lists"
    )
    # One number per list: bounded by the lists, not by the rows.
    counts = dict(dealt.groupBy("list").agg(F.count("*")).collect())
    lists = len(index.centres)
    rows_in = np.array([counts.get(i, 0) for i in range(lists)])
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_of = packed_lists(rows_in, max(1, min(chunk_rows, int(rows_in.sum()) // (2 * width))))
    parts = int(part_of[-1]) + 1
    chunks = np.maximum(1, -(-np.bincount(part_of, rows_in, parts).astype(int) // chunk_rows))

    def probed(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, part and list of every probe, sorted."""
        one = held.value
        order = np.argsort(-(unit(vectors) @ one.centres.T), axis=1, kind="stable")
        # Lists in order of nearness, until they are enough and hold enough.
        before = np.cumsum(rows_in[order], axis=1) - rows_in[order]
        row, place = np.nonzero((np.arange(lists)[None] < one.probes) | (before < 20 * k))
        found = order[row, place]
        by = np.lexsort((found, row))
        return row[by], part_of[found[by]], found[by]

    def askers(batches):
        for batch in batches:
            row, part, _ = probed(matrix(batch.column("vector")))
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])])[: len(row)]
            held_by, n = np.unique(part[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(held_by, pa.int32()), pa.array(n, pa.int64())], ["part", "n"])

    def probe(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                row, part, found = probed(matrix(some.column("vector")))
                first = np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])])[: len(row)]
                begin = np.nonzero(first)[0]
                own = pa.ListArray.from_arrays(
                    pa.array(np.append(begin, len(row)), pa.int32()), pa.array(found, pa.int32())
                )
                for i in range(0, len(begin), BATCH_ROWS):
                    at = begin[i : i + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column("vec_id").take(pa.array(row[at])), some.column("vector").take(pa.array(row[at])),
                            pa.array(part[at], pa.int32()), own.slice(i, len(at)),
                        ],
                        ["vec_id", "vector", "part", "lists"],
                    )

    asked = dealt.where("asks").select("vec_id", "vector")
    # One number per part.
    asking = dict(asked.mapInArrow(askers, "part int, n bigint").groupBy("part").agg(F.sum("n")).collect())
    shares = [max(1, -(-asking.get(i, 0) // query_rows)) for i in range(parts)]
    probing = asked.mapInArrow(probe, "vec_id bigint, vector binary, part int, lists array<int>")

    def cut_into(numbers: Iterable[int]) -> Column:
        return F.array(*[F.lit(int(n)) for n in numbers])[F.col("part")]

    # Rows that share an id still part.
    hashed = F.xxhash64("vec_id", "vector")
    key = ["part", "chunk", "share"]
    candidates = dealt.withColumn("part", F.array(*[F.lit(int(p)) for p in part_of])[F.col("list")]).select(
        "vec_id", "vector", "list", "part", F.pmod(hashed, cut_into(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), cut_into(shares) - 1)).alias("share"),
    )
    queries = probing.select(
        "vec_id", "vector", "lists", "part", F.explode(F.sequence(F.lit(0), cut_into(chunks) - 1)).alias("chunk"),
        F.pmod(hashed, cut_into(shares)).cast("int").alias("share"),
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        found = [[np.zeros(0, t.to_pandas_dtype()) for t in kinds]]
        if left.num_rows and right.num_rows:
            ask, have = matrix(left.column("vector")), matrix(right.column("vector"))
            ask_ids, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            wanted = left.column("lists").combine_chunks()
            asker, wanted = wanted.value_parent_indices().to_numpy(), wanted.flatten().to_numpy()
            own = right.column("list").to_numpy()
            for each in np.unique(own):
                row, at = asker[wanted == each], np.nonzero(own == each)[0]
                if len(row):
                    found.append(best_of_list(ask[row], ask_ids[row], have[at], ids[at], k, held.value.rotation))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), kinds)], names)

    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(
        search, "query_id bigint, vec_id bigint, score double"
    )
    # Spark cuts each task's rows to the k first of a query before it shuffles them.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
