"""Embedding near-duplicates: all pairs of a label, however large it is.

Vectors of a label and length are all compared with each other, in blocks dealt
out over tasks; a block pair sends a count of links and a forest of its links,
never the pairs. So no link is missed at any size, and the time a label takes
grows with the square of its distinct vectors, what is shuffled for it with that
square over ``BLOCK_BYTES``.

A caller for whom that is too much may ask for passes instead; no size does.
Vectors are then hashed by 64 random half-spaces in several passes. A pass orders them lexicographically by
the hash and compares each with its next ``WINDOW`` neighbours, across partition
bounds too: a sketch of ``SKETCH_WORDS`` more hashes goes with each id in place
of its vector, and pairs whose sketches differ in few enough bits have their
vectors fetched and their cosine taken. A cell (vectors that agree in the first ``cell_bits``) with more
than a window holds is counted and compared whole, in blocks; where the cells
of all passes would cost as much as the whole label, the label is compared
whole. So a pair is missed only if no pass leaves it in one cell, which is up to
the half-spaces and not to how the vectors lie: for a pair at the least cosine
the chance is ``MISSED`` at any size. Links are counted exactly inside each component.
Equal vectors stand for each other and are never expanded into pairs.

Vectors that are null, empty, zero or hold a null or non-finite component, and
those without a label, link with nothing. Of rows with one vec_id the least
(label, embedding) counts; rows without a vec_id give one row with null ids and
no links. Vectors of different lengths never link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table
from .components import connected_components
from .vectors import finite, matrix, one_each, sign_codes

LEAST_COSINE = 0.98
WINDOW = 16
#: Chance at most that all passes miss a pair at the least cosine which nothing else links.
MISSED = 1e-4
PARTITION_ROWS = 1 << 16
#: Ranges at most that a pass is cut into, as a sample of each goes to the driver.
MOST_PARTS = 10_000
#: What is compared whole is cut into ``BLOCKS`` blocks, fewer where they would have under ``BLOCK_ROWS``, more where one would have over ``BLOCK_BYTES``.
BLOCKS = 4
BLOCK_ROWS = 256
BLOCK_BYTES = 8 << 20
SEED, SKETCH_SEED = 7, 1 << 20

#: Sketches of 64 half-spaces each that stand for a vector while it is ordered, and the standard errors granted them.
SKETCH_WORDS, SKETCH_ERRORS = 2, 6.0

_SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
_SWEPT = "kind string, bound bigint, tail boolean, place int, run int, label bigint, dim int, a bigint, b bigint, " + ", ".join(f"{s} bigint" for s in _SKETCH)
_KINDS = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int64()] * SKETCH_WORDS]
_NAMES = [x.split()[0] for x in _SWEPT.split(", ")]


def sketch_bits(least: float) -> int:
    """Bits at most in which the sketches of a pair at the least cosine differ, but for ``SKETCH_ERRORS`` standard errors."""
    n, p = 64 * SKETCH_WORDS, math.acos(min(1.0, max(-1.0, least))) / math.pi
    return min(n, math.ceil(n * p + SKETCH_ERRORS * math.sqrt(n * p * (1 - p))))


def cell_bits(rows: int, window: int) -> int:
    """First bits of a hash that leave half a window of so many vectors in a cell, if cells fill evenly."""
    return max(0, math.ceil(math.log2(max(1, rows) / window) + 1))


def passes_for(rows: int, least: float, window: int, missed: float = MISSED) -> int:
    """Passes to make over a label of so many vectors.

    A pass is sure to meet a pair whose hashes agree in the first ``cell_bits``;
    each bit differs with probability angle / pi.
    """
    met = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** cell_bits(rows, window)
    return 1 if met > 1 - missed else math.ceil(math.log(missed) / math.log1p(-met))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.max(np.abs(x), axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _neighbours(group: np.ndarray, ids: np.ndarray, sketch: np.ndarray, window: int, most: int, old: int = 0) -> list[np.ndarray]:
    """Pairs within the window whose sketches are near; the first ``old`` rows have been compared among themselves."""
    out = []
    for k in range(1, min(window, len(ids) - 1) + 1):
        i = np.arange(max(0, old - k), len(ids) - k)
        i = i[(group[i] == group[i + k]).all(axis=1)]
        i = i[np.bitwise_count(sketch[i] ^ sketch[i + k]).sum(axis=1) <= most]
        out.append(np.stack([np.maximum(ids[i], ids[i + k]), np.minimum(ids[i], ids[i + k])], 1))
    return out


def _pair_rows(pairs: list[np.ndarray]) -> pa.RecordBatch | None:
    both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    both = both[both[:, 0] != both[:, 1]]
    if not len(both):
        return None
    values = {"kind": pa.array(["pair"] * len(both)), "a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])}
    return pa.RecordBatch.from_arrays([values.get(n, pa.nulls(len(both), k)) for n, k in zip(_NAMES, _KINDS)], names=_NAMES)


def _sketches(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in _SKETCH], 1).view(np.uint64)


def sorted_passes(vectors: DataFrame, least: float, passes: int, window: int, rows: int) -> DataFrame:
    """(a, b), a > b, of vectors (rep, label, embedding) at least so alike, found by the passes."""
    most = sketch_bits(least)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x, n = matrix(own.column(2)), len(own)
                sketch = [pa.array(sign_codes(x, SKETCH_SEED + k)) for k in range(SKETCH_WORDS)]
                for run in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, run, np.int32)), own.column(1), pa.array(np.full(n, dim, np.int32)), pa.array(sign_codes(x, SEED + run)), own.column(0), *sketch],
                        names=["run", "label", "dim", "code", "rep", *_SKETCH],
                    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        none = (np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros((0, SKETCH_WORDS), np.uint64))
        held = head = none

        def edge(bound: int, tail: bool, rows_: tuple) -> pa.RecordBatch:
            group, ids, sketch = rows_
            n = len(ids)
            values = {
                "kind": pa.array(["edge"] * n), "bound": pa.array([bound] * n, pa.int64()), "tail": pa.array([tail] * n), "place": pa.array(range(n), pa.int32()),
                "run": pa.array(group[:, 0].astype(np.int32)), "label": pa.array(group[:, 1]), "dim": pa.array(group[:, 2].astype(np.int32)), "a": pa.array(ids),
                **{c: pa.array(sketch[:, k].view(np.int64)) for k, c in enumerate(_SKETCH)},
            }
            return pa.RecordBatch.from_arrays([values.get(n_, pa.nulls(n, k)) for n_, k in zip(_NAMES, _KINDS)], names=_NAMES)

        for b in batches:
            now = np.stack([b.column(c).to_numpy() for c in ("run", "label", "dim")], 1).astype(np.int64), b.column("rep").to_numpy(), _sketches(b)
            old = len(held[1])
            both = tuple(np.concatenate(x) for x in zip(held, now))
            if (found := _pair_rows(_neighbours(*both, window, most, old))) is not None:
                yield found
            if len(head[1]) < window:
                head = tuple(np.concatenate([x, y[: window - len(head[1])]]) for x, y in zip(head, now))
            held = tuple(x[-window:] for x in both)
        if len(head[1]):
            yield edge(part, False, head)
            yield edge(part + 1, True, held)

    def across(key: tuple, rows_: pa.Table) -> pa.Table:
        rows_ = rows_.sort_by([("tail", "descending"), ("place", "ascending")])
        group = np.stack([rows_.column(c).to_numpy() for c in ("run", "label", "dim")], 1).astype(np.int64)
        out = _neighbours(group, rows_.column("a").to_numpy(), _sketches(rows_), window, most, int(rows_.column("tail").to_numpy().sum()))
        found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        found = found[found[:, 0] != found[:, 1]]
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                near = np.einsum("ij,ij->i", _unit(matrix(own.column(2))), _unit(matrix(own.column(3)))) >= least
                yield own.filter(pa.array(near)).select(["a", "b"])

    keyed = vectors.select("rep", "label", "embedding").mapInArrow(hashed, "run int, label bigint, dim int, code bigint, rep bigint, " + ", ".join(f"{s} bigint" for s in _SKETCH))
    order = ["dim", "label", "run", "code", "rep"]
    parts = min(MOST_PARTS, max(1, rows * passes // PARTITION_ROWS))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    swept = save(ordered.mapInArrow(sweep, _SWEPT), "swept", "kind")
    columns = ("bound", "tail", "place", "run", "label", "dim", "a", *_SKETCH)
    edges = swept.where("kind = 'edge'").select(*columns).groupBy("bound").applyInArrow(across, "a bigint, b bigint")
    near = swept.where("kind = 'pair'").select("a", "b").unionByName(edges).distinct()
    own = vectors.select("rep", F.col("embedding").alias("x"))
    both = near.join(own.withColumnsRenamed({"rep": "a"}), "a").join(own.withColumnsRenamed({"rep": "b", "x": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint")


def _cells(vectors: DataFrame, passes: int, bits: int) -> DataFrame:
    """(run, label, dim, cell, rep): the first bits of each pass's hash of vectors (rep, label, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x, n = matrix(own.column(2)), len(own)
                for k in range(passes):
                    cell = sign_codes(x, SEED + k) >> np.int64(64 - bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, k, np.int32)), own.column(1), pa.array(np.full(n, dim, np.int32)), pa.array(cell), own.column(0)],
                        names=["run", "label", "dim", "cell", "rep"],
                    )

    return vectors.select("rep", "label", "embedding").mapInArrow(run, "run int, label bigint, dim int, cell bigint, rep bigint")


def _united(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """root, each place's least place in its group, after groups of u and v have been united pairwise."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _all_pairs(members: DataFrame, least: float) -> DataFrame:
    """(rep, links, other) from comparing all members (unit, rep, copies, embedding) of each unit.

    A row says that rep has so many links, copies counted, to members of one
    block pair, and that it is connected with other. A rep's links are the sum of its rows.
    """
    sizes = members.groupBy("unit").agg(F.count("*").alias("size"), F.max(F.size("embedding")).alias("dim"))
    few = F.least(F.lit(BLOCKS), F.ceil(F.col("size") / BLOCK_ROWS))
    blocks = members.join(sizes, "unit").withColumn("blocks", F.greatest(few, F.ceil(F.col("size") * F.col("dim") * 8 / BLOCK_BYTES)).cast("bigint"))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = blocks.select("unit", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "rep", "copies", "embedding")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pa.RecordBatch) -> list[np.ndarray]:
            x, ids = _unit(matrix(rows.column(6))), rows.column(4).to_numpy()
            copies, own = rows.column(5).to_numpy(), rows.column(3).to_numpy()
            i, j = (rows.column(k)[0].as_py() for k in (1, 2))
            n = len(ids)
            found, root = np.zeros(n, np.int64), np.arange(n)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            # single precision tells all but those within its error, which double precision decides
            short, error = x.astype(np.float32), (x.shape[1] + 16) * 2.0**-23
            others = short[right].T
            step = max(16, (1 << 21) // max(1, len(right)))
            for at in range(0, len(left), step):
                cosine = short[left[at : at + step]] @ others
                u, v = np.nonzero(cosine >= least - error)
                sure = cosine[u, v] >= least + error
                u, v = left[u + at], right[v]
                unsure = np.flatnonzero(~sure)
                for k in (unsure[z : z + 4096] for z in range(0, len(unsure), 4096)):
                    sure[k] = np.einsum("ij,ij->i", x[u[k]], x[v[k]]) >= least
                sure &= u != v
                u, v = u[sure], v[sure]
                if len(u):
                    found += np.bincount(u, copies[v], n).astype(np.int64)
                    if i != j:
                        found += np.bincount(v, copies[u], n).astype(np.int64)
                    root = _united(root, u, v)
            some = found > 0
            return [ids[some], found[some], ids[root[some]]]

        def rows_of(done: list[list[np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*done)], names=["rep", "links", "other"])

        held = None
        for b in batches:
            if held is not None:
                b = pa.concat_batches([held, b])
            unit = b.column(0).to_numpy(zero_copy_only=False)
            place = np.stack([b.column(k).to_numpy() for k in (1, 2)], 1)
            cuts = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (place[1:] != place[:-1]).any(axis=1))).tolist()
            done = [links(b.slice(a, z - a)) for a, z in zip(cuts, cuts[1:])]
            held = b.slice(cuts[-1])
            if done:
                yield rows_of(done)
        if held is not None and len(held):
            yield rows_of([links(held)])

    sorted_ = dealt.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return sorted_.mapInArrow(compare, "rep bigint, links bigint, other bigint")


def _edges(compared: DataFrame) -> DataFrame:
    return compared.where("rep != other").select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b"))


def _sums(compared: DataFrame) -> DataFrame:
    return compared.groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, least: float = LEAST_COSINE, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector of rows (vec_id, label, embedding).

    All pairs of a label are compared unless so many passes are asked for, which may miss some links (``passes_for``).
    """
    rows = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>"))
    each = save(one_each(rows, "label", "embedding"), "vectors")
    able = each.where(finite() & F.col("label").isNotNull()).where(F.exists("embedding", lambda v: v != 0))
    reps = save(able.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first(F.size("embedding")).alias("dim")), "reps")
    group = ["label", "dim"]
    groups = save(reps.groupBy(*group).agg(F.count("*").alias("n")), "groups")
    whole, large = (groups.select(*group), groups.limit(0)) if passes is None else (groups.limit(0).select(*group), groups)
    total, largest = large.agg(F.sum("n"), F.max("n")).first() if passes is not None else (0, 0)
    if total:
        bits = max(1, cell_bits(largest, window))
        cells = save(_cells(reps.join(large, group, "left_semi"), passes, bits), "cells")
        crowded = save(cells.groupBy("run", *group, "cell").agg(F.count("*").alias("held")).where(F.col("held") > window + 1), "crowded")
        # cells that cost as much as the whole label give way to it
        cost = crowded.groupBy(*group).agg(F.sum(F.col("held").cast("double") * F.col("held")).alias("cost"))
        dense = save(large.join(cost, group).where(F.col("cost") >= F.col("n").cast("double") * F.col("n")).select(*group), "dense")
        whole = whole.unionByName(dense)
        swept = save(reps.join(large.join(dense, group, "left_anti"), group, "left_semi"), "large")
    unit = F.concat_ws("/", *group)
    compared = save(_all_pairs(reps.join(whole, group, "left_semi").select(unit.alias("unit"), "rep", "copies", "embedding"), least), "compared")
    pairs = _edges(compared)
    if total:
        met = cells.join(crowded, ["run", *group, "cell"], "left_semi").select(F.concat_ws("/", *group, "run", "cell").alias("unit"), "rep")
        met = _all_pairs(met.join(swept, "rep").select("unit", "rep", "copies", "embedding"), least)
        pairs = pairs.unionByName(sorted_passes(swept, least, passes, window, total)).unionByName(_edges(met))
    found = save(connected_components(pairs, "a", "b"), "found")
    links = _sums(compared)
    if total:
        inside = found.join(swept, found["node"] == swept["rep"]).select(F.col("component").cast("string").alias("unit"), "rep", "copies", "embedding")
        links = links.unionByName(_sums(_all_pairs(inside, least)))
    linked = found.join(links, found["node"] == links["rep"], "left").select("node", "component", F.coalesce("links", F.lit(0)).alias("links"))
    named = reps.join(linked, reps["rep"] == linked["node"], "left").select("label", "embedding", "rep", "copies", F.coalesce("component", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    own = able.join(named, ["label", "embedding"]).select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    rest = each.join(own.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    nameless = rows.where("vec_id is null").select("vec_id").distinct().select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(rest).unionByName(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors of each label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
