"""Exact top-k inner products by block-at-a-time pruning.

Vectors of integers are ordered by a hash that keeps like vectors together, cut
into ranges and, inside a range, into blocks. A block's forward index is its
matrix; its summary holds each dimension's largest and smallest component. For
a query the sum over dimensions of the larger product with either bounds every
score in the block. Blocks are scored in descending order of that bound until
it falls below the k-th best score so far. Each query first meets its own range,
which gives a k-th score to start from; then queries meet the ranges' summaries
in tiles, and each goes only to ranges whose bound reaches its score. Nothing
of a range or a query passes the driver. Ties go to the smaller vec_id, so a bound equal to the k-th
score does not end the search.

Vectors that are null, empty or hold a null or non-finite component take no
part; nor do rows without a vec_id. Of rows with one vec_id the least embedding
counts. Vectors of different lengths have no product. Scores beyond 64 bits are
held at the ends of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save, table
from .vectors import finite, matrix, one_each, sign_codes

K, SCALE, QUERY_EVERY = 20, 64, 20
RANGE_ROWS, BLOCK_ROWS = 8192, 128
#: Ranges at most, as a sample of each goes to the driver when rows are dealt out; and ranges whose summaries a task holds at once.
MOST_RANGES, TILE_RANGES = 1 << 16, 256
#: Queries that meet one range, or one tile of summaries, in one task.
QUERY_ROWS = 4096
SEED = 11
_EXACT = float(1 << 53)


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles where they are exact, whole numbers of any size elsewhere."""
    if np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * len(query) < _EXACT:
        return (rows @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(r, query)) for r in rows]
    return np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in exact], np.int64)


class Blocks:
    """One range's vectors in blocks, with their summaries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.starts = np.arange(0, len(ids), BLOCK_ROWS)
        self.high = np.maximum.reduceat(vectors, self.starts, axis=0)
        self.low = np.minimum.reduceat(vectors, self.starts, axis=0)

    def best(self, query_id: int, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the best k whose score is not below ``floor``."""
        bounds = np.maximum(query * self.high, query * self.low).sum(axis=1)
        slack = np.abs(bounds) * 1e-12 if np.abs(bounds).max(initial=0) >= _EXACT else 0
        bounds = bounds + slack
        ids, scores, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), floor
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] < kth:
                break
            own = slice(self.starts[b], self.starts[b] + BLOCK_ROWS)
            s = _products(self.vectors[own], query)
            near = (s >= kth) & (self.ids[own] != query_id)
            if not near.any():
                continue
            ids, scores = np.append(ids, self.ids[own][near]), np.append(scores, s[near])
            if len(ids) >= k:
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
                kth = max(floor, scores[-1])
        return ids, scores


def top_k(rows: DataFrame, k: int = K, scale: int = SCALE, query_every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, embedding)."""
    rows = rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    each = save(one_each(rows.where(finite()), "embedding"), "vectors")
    n = each.count()
    ranges = min(MOST_RANGES, max(1, n // RANGE_ROWS))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).value_lengths().to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x = matrix(own.column(1))
                whole = np.floor(x * scale)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * int(dim)), pa.array(whole.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, np.int32)), pa.array(sign_codes(x, SEED)), own.column(0), lists], names=["dim", "code", "vec_id", "vec"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(b), pa.int32()), *b.columns], names=["part", *b.schema.names])

    order = ["dim", "code", "vec_id"]
    dealt = each.mapInArrow(coded, "dim int, code bigint, vec_id bigint, vec array<double>").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # a range is a partition's rows of one length, in the order of the code
    ranged = save(dealt.mapInArrow(placed, "part int, dim int, code bigint, vec_id bigint, vec array<double>"), "ranges")

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = t.sort_by([("code", "ascending"), ("vec_id", "ascending")])
        return t.column("vec_id").to_numpy(), matrix(t.column("vec"))

    found_kind = "kind string, part int, dim int, query_id bigint, vec_id bigint, score bigint, floor bigint, vec array<double>, high array<double>, low array<double>"
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3]
    names = [x.split()[0] for x in found_kind.split(", ")]

    def within(key: tuple, t: pa.Table) -> pa.Table:
        part, dim = key[0].as_py(), key[1].as_py()
        ids, vectors = read(t)
        blocks = Blocks(ids, vectors)
        out = [("summary", part, dim, None, None, None, None, None, vectors.max(axis=0).tolist(), vectors.min(axis=0).tolist())]
        for i in np.flatnonzero(ids % query_every == 0):
            q = int(ids[i])
            best, scores = blocks.best(q, vectors[i], k, -np.inf)
            floor = int(scores[-1]) if len(best) >= k else None
            out.append(("query", part, dim, q, None, None, floor, vectors[i].tolist(), None, None))
            out += [("found", part, dim, q, int(v), int(s), None, None, None, None) for v, s in zip(best, scores)]
        return pa.table([pa.array(v, t_) for v, t_ in zip(zip(*out), kinds)], names=names)

    first = save(ranged.groupBy("part", "dim").applyInArrow(within, found_kind), "first", "kind")
    tile = F.floor(F.col("part") / TILE_RANGES)
    summaries = first.where("kind = 'summary'").select(tile.alias("t"), F.col("dim").alias("d"), F.col("part").alias("p"), "high", "low")
    queries = first.where("kind = 'query'").select("part", "dim", "query_id", "floor", "vec")
    # the queries in blocks against all tiles of summaries of their length
    blocks = max(1, -(-(n // query_every) // QUERY_ROWS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    tiles = summaries.select("t", "d").distinct()
    asking = queries.select(block, "part", "dim", "query_id", "floor", "vec").join(tiles, F.col("dim") == F.col("d")).withColumn("tile", F.col("t") + 0).drop("t", "d")
    shown = summaries.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def routed(key: tuple, ranges_: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(ranges_) and len(asked):
            parts, high, low = ranges_.column("p").to_numpy(), matrix(ranges_.column("high")), matrix(ranges_.column("low"))
            dim = high.shape[1]
            for home, q, floor, vec in zip(*(asked.column(c).to_pylist() for c in ("part", "query_id", "floor", "vec"))):
                v = np.array(vec)
                bounds = np.maximum(v * high, v * low).sum(axis=1)
                go = parts != home
                if floor is not None:
                    go &= bounds + np.abs(bounds) * 1e-12 >= floor
                out += [(int(p), dim, q, floor) for p in parts[go]]
        columns = list(zip(*out)) if out else [()] * 4
        return pa.table([pa.array(v, t_) for v, t_ in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["part", "dim", "query_id", "floor"])

    way = shown.groupBy("t", "d", "b").cogroup(asking.groupBy("tile", "dim", "block")).applyInArrow(routed, "part int, dim int, query_id bigint, floor bigint")
    way = save(way, "routed")
    # a range is repeated for the blocks of queries that come to it, and for none where none do
    wanted = way.groupBy("part", "dim").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("salts"))
    sent = way.join(wanted, ["part", "dim"]).join(queries.select("query_id", "vec"), "query_id")
    sent = sent.select("part", "dim", "query_id", "floor", "vec", F.pmod(F.xxhash64("query_id"), F.col("salts")).alias("salt"))
    salted = ranged.join(wanted, ["part", "dim"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")

    def beyond(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(own) and len(asked):
            blocks = Blocks(*read(own))
            for q, floor, vec in zip(asked.column("query_id").to_pylist(), asked.column("floor").to_pylist(), asked.column("vec").to_pylist()):
                best, scores = blocks.best(q, np.array(vec), k, -np.inf if floor is None else floor)
                out += [(q, int(v), int(s)) for v, s in zip(best, scores)]
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table([pa.array(v, pa.int64()) for v in columns], names=["query_id", "vec_id", "score"])

    rest = salted.groupBy("part", "dim", "salt").cogroup(sent.groupBy("part", "dim", "salt")).applyInArrow(beyond, "query_id bigint, vec_id bigint, score bigint")
    both = first.where("kind = 'found'").select("query_id", "vec_id", "score").unionByName(rest)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every twentieth."""
    return top_k(table(spark, sf_dir, "embeddings"))
