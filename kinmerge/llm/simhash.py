"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into one segment more than the bits that may differ, in a
ring. If two fingerprints differ in at most t bits, some segment starts a chain
in which the first l segments differ in at most l * t / m bits, for every l.
The first two links of the chain are an equality lookup: the first segment is
equal, the second differs in at most one bit, whose places are enumerated on
one side. The other links prune what the lookup finds before the last, the
whole distance, is tested. Only distinct fingerprints meet; links become
components without expanding copies into pairs.

Null and wordless texts have fingerprint zero and link like any other; equal
rows share it; a null doc_id belongs to its fingerprint's component but is never
its smallest id (a component of such rows only has a null id). Rows with one
doc_id and several texts join the components of all of them. Texts are hashed
whole at any length. Columns other than those named are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_of_equals, save, table, width
from .components import connected_components

SEED, SHINGLE_WORDS, MOST_BITS = 42, 4, 4


def fingerprint(text: bytes, n: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's n-word shingles (XXH64), repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = max(1, len(words) - n + 1)
    starts, ends = starts[:k].tolist(), ends[len(words) - k :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, k, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], ">u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > k).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): fp as a signed long, h a hash of the whole text that tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"") for t in b.column(2).cast(pa.large_binary())), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "h", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h bigint, fp bigint")


def _segments(most: int) -> list[tuple[int, int]]:
    """(shift, bits) of most + 1 segments covering 64 bits."""
    m = most + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(a, b) with a > b: distinct fingerprints (column fp) at most ``most`` bits apart, every such pair once.

    The keys fix two of ``most + 1`` segments, about 26 bits for 4: unrelated
    fingerprints meet at one in 2**26.
    """
    segments = _segments(most)
    m = len(segments)
    # a fingerprint becomes many keys: they are made in as many tasks as the session sets. By number only: partitions by column would be taken for those of the step before and be joined again
    fps = fps.repartition(width(fps))

    def part(i: int) -> Column:
        shift, bits = segments[i % m]
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))

    def key(i: int, flip: int = 0) -> Column:
        return F.lit(i << 58) + F.shiftleft(part(i), 29) + part(i + 1).bitwiseXOR(F.lit(flip))

    flips = [[0, *(1 << j for j in range(segments[(i + 1) % m][1]))] for i in range(m)]
    index = fps.select("fp", F.explode(F.array(*(key(i) for i in range(m)))).alias("key"))
    probe = fps.select(F.col("fp").alias("other"), F.explode(F.array(*(key(i, x) for i in range(m) for x in flips[i]))).alias("key"))
    met = index.join(probe.hint("merge"), "key").where("fp > other")
    diff = F.col("fp").bitwiseXOR(F.col("other"))
    start = F.shiftrightunsigned("key", 58)
    holds = F.lit(False)
    for i in range(m):
        chain = start == i
        for length in range(3, m + 1):
            mask = 0
            for j in range(i, i + length):
                shift, bits = segments[j % m]
                mask |= ((1 << bits) - 1) << shift
            chain &= F.bit_count(diff.bitwiseAND(F.lit(_signed(mask)))) <= length * most // m
        holds |= chain
    return met.where(holds).select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def _grouped(marked: DataFrame, most: int) -> DataFrame:
    """(doc_id, h, fp, component): component is one fingerprint of each group."""
    distinct = marked.select("fp").distinct()
    # an id under several fingerprints links them: each such row gives an edge to the id's least fingerprint
    several = marked.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top and doc_id is not null")
    shared = marked.join(several.hint("merge"), "doc_id").where("fp > b").select(F.col("fp").alias("a"), "b")
    # saved tables on both sides of a join let Spark split a hot fingerprint or component. All tables here grow with the input: none is to pass through the driver as a broadcast
    found = save(connected_components(links(distinct, most).unionByName(shared), "a", "b"), "components")
    return marked.join(found.hint("merge"), F.col("fp") == F.col("node"), "left").select("doc_id", "h", "fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    grouped = _grouped(save(fingerprints(docs), "fingerprints"), most)
    least = save(grouped.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return grouped.join(least.hint("merge"), "component").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """docs with one row left of each component: the smallest doc_id, a null one last, then the least text hash."""
    marked = save(fingerprints(docs), "fingerprints")
    grouped = _grouped(marked, most)
    first = grouped.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "h")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("kept_id"), F.col("x.h").alias("kept_h"))
    counts = marked.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    keys = first.join(counts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h"))).select("kept_id", "kept_h", "n")
    return one_of_equals(docs, save(keys, "kept"), "kept_id", "kept_h")[0]


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
