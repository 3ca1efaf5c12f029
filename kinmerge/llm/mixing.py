"""Mixing sources to target weights: fixed-length blocks, multinomial shards, index permutations.

Each source's texts, laid end to end in a pseudorandom order, form a stream of
words cut into blocks of ``block_words``. A source's target turns into a quota
of block draws. Every output shard draws how many blocks it takes of each
source from a multinomial; a source's draws, numbered through the shards, end
at its quota (what the draws leave open goes to a last shard). Draw number j is
block ``permutation(j mod blocks)`` of pass ``j div blocks``: each block is used
before one is used again, and none more than twice as no target exceeds twice
the source. The drawn blocks then meet the texts by (source, block).

Null and empty texts have no words and are never taken; a null source is a
source, last in order; repeated rows count as rows of their own, in an order of
their ids and a hash of their texts, and ties among equal rows change nothing;
texts are read whole at any length; empty tables give empty results; columns
other than doc_id, source and text are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import one_of_equals, save, table
from .text import as_bytes, mix, spans, word_counts

BLOCK_WORDS = 128
SHARD_BLOCKS = 4096
BUCKET_ROWS = 4096
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_PASSES = 2
SEED = 20240229


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h, size): words of each text (null: 0) and a hash of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(word_counts(b.column(3)))],
                names=["doc_id", "source", "h", "size"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("source").cast("string"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(count, f"doc_id {kind}, source string, h bigint, size bigint")


def targets(by_source: pd.DataFrame, weights=WEIGHTS, share=TOTAL_SHARE, most=MOST_PASSES) -> np.ndarray:
    """Words to take of each source. Rows are sources in code-point order, null last.

    Weights repeat down the rows. What would lift a target over ``most`` times
    its source goes to the others by weight: a common level, found from the
    sources sorted by the level at which each is full.
    """
    size = by_source["source_size"].to_numpy(float)
    weight = np.resize(np.array(weights, float), len(size))
    full = most * size
    order = np.argsort(full / weight, kind="stable")
    left, heavy = share * size.sum(), weight.sum()
    out = np.zeros(len(size))
    for k, i in enumerate(order):
        if full[i] > left / heavy * weight[i]:
            out[order[k:]] = weight[order[k:]] * (left / heavy)
            break
        out[i] = full[i]
        left, heavy = left - full[i], heavy - weight[i]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of ``index`` under a keyed permutation of range(size), elementwise.

    A four-round Feistel network over the next even number of bits; values at or
    over ``size`` walk on along their cycle until they fall below it.
    """
    out, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix(right + mix(k + np.uint64(r))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _draws(spark: SparkSession, quota: np.ndarray, seed: int, shard_blocks: int) -> DataFrame:
    """(s, shard, first, n): draws of source number s by each shard, numbered from ``first``."""
    total = int(quota.sum())
    shards = -(-total // shard_blocks)
    share = quota / max(1, total)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f["id"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, int(shard)]))
                n = rng.multinomial(min(shard_blocks, total - int(shard) * shard_blocks), share)
                s = np.flatnonzero(n)
                yield pd.DataFrame({"s": s.astype(np.int32), "shard": int(shard), "n": n[s]})

    drawn = spark.range(shards).mapInPandas(draw, "s int, shard bigint, n bigint")
    limits = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quota) if q], "s int, quota bigint")
    before = W.partitionBy("s").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    within = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).join(limits, "s")
    within = within.select("s", "shard", "first", F.least("n", F.col("quota") - F.col("first")).alias("n")).where("n > 0")
    rest = limits.join(drawn.groupBy("s").agg(F.sum("n").alias("got")), "s", "left")
    rest = rest.select("s", F.lit(shards).cast("bigint").alias("shard"), F.coalesce("got", F.lit(0)).alias("first"), (F.col("quota") - F.coalesce("got", F.lit(0))).alias("n")).where("n > 0")
    # a row's draws stay few: what goes to the last shard is cut into runs
    runs = within.unionByName(rest).withColumn("run", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / shard_blocks).cast("bigint"))))
    return runs.select(
        "s", "shard", (F.col("first") + F.col("run") * shard_blocks).alias("first"), F.least(F.lit(shard_blocks), F.col("n") - F.col("run") * shard_blocks).alias("n")
    )


class Mix:
    """A mix of ``docs``: its plan, its segments and its texts.

    ``docs`` needs doc_id, source and text; other columns are left alone. A null
    text has no words; a null source is a source of its own, last in order;
    repeated rows count as rows of their own; an empty table gives empty results.
    """

    def __init__(self, docs: DataFrame, *, weights=WEIGHTS, share=TOTAL_SHARE, most=MOST_PASSES, block_words=BLOCK_WORDS, seed=SEED):
        spark = docs.sparkSession
        self.docs, self.block_words = docs, block_words
        rows = save(sized(docs), "sized")
        # one row for each source: what a caller would state weights for
        by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).toPandas()
        by["last"] = by["source"].isna()
        by["code"] = [b"" if s is None else s.encode() for s in by["source"]]
        by = by.sort_values(["last", "code"]).reset_index(drop=True)
        by["target"] = targets(by, weights, share, most)
        size = by["source_size"].to_numpy(np.int64)
        blocks = -(-size // block_words)
        quota = np.minimum(most * blocks, np.floor(by["target"].to_numpy() * blocks / np.maximum(size, 1) + 0.5)).astype(np.int64)
        self.plan = by.assign(blocks=blocks, quota=quota)
        sources = spark.createDataFrame(
            [(i, r.source if not r.last else None, int(r.source_size), float(r.target), 1 + int(r.n) // BUCKET_ROWS) for i, r in enumerate(by.itertuples())],
            "s int, source string, source_size bigint, target double, buckets bigint",
        )
        placed = rows.join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
        placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.col("buckets")))
        per_bucket = placed.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
        ahead = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        per_bucket = per_bucket.select("s", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
        inside = W.partitionBy("s", "bucket").orderBy("doc_id", "h", "size").rowsBetween(W.unboundedPreceding, -1)
        placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(per_bucket.hint("merge"), ["s", "bucket"])
        #: one row for each row of docs; (s, start, doc_id, h) is its place in its source's stream
        self.placed = save(
            placed.select("s", (F.col("base") + F.col("inside")).alias("start"), "doc_id", "h", "size", "source_size", "target"), "placed"
        )
        count = np.maximum(1, blocks)
        keys = mix(np.arange(1, len(by) + 1, dtype=np.uint64) + np.uint64(seed))

        @F.pandas_udf("bigint")
        def block_of(s: pd.Series, draw: pd.Series) -> pd.Series:
            i = s.to_numpy()
            return pd.Series(permuted(draw.to_numpy() % count[i], count[i], keys[i]))

        @F.pandas_udf("bigint")
        def pass_of(s: pd.Series, draw: pd.Series) -> pd.Series:
            return draw // pd.Series(count[s.to_numpy()])

        draws = _draws(spark, quota, seed, SHARD_BLOCKS).withColumn("draw", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
        #: one row for each block drawn: the output shard, the source's number, which use of the block it is
        self.slots = draws.select("shard", "s", "draw", pass_of("s", "draw").alias("pass"), block_of("s", "draw").alias("block"))

    def segments(self) -> DataFrame:
        """The mix itself: for each drawn block the runs of words of texts it holds.

        (shard, s, draw, pass, block, start, doc_id, h, size, word_from, word_to);
        word numbers count within the text, the end excluded.
        """
        n = self.block_words
        cut = self.placed.where("size > 0").select(
            "s", "start", "doc_id", "h", "size",
            F.explode(F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + F.col("size") - 1) / n))).alias("block"),
        )
        cut = cut.withColumns({
            "word_from": F.greatest(F.lit(0), F.col("block") * n - F.col("start")),
            "word_to": F.least("size", (F.col("block") + 1) * n - F.col("start")),
        })
        return cut.join(self.slots.hint("merge"), ["s", "block"])

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken), one row for each row of docs."""
        words = self.segments().groupBy("s", "start", "doc_id").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
        empty = self.placed.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
        full = self.placed.where("size > 0").withColumnRenamed("doc_id", "id")
        same = (full["s"] == words["s"]) & (full["start"] == words["start"])
        full = full.join(words.select("s", "start", "taken").hint("merge"), same, "left").select(
            F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
        )
        return full.unionByName(empty.select("doc_id", "size", "source_size", "target", "taken"))

    def texts(self) -> DataFrame:
        """The mixed corpus with the columns of docs: a row for each text and pass that took words of it.

        A text taken whole is unchanged; of a text taken in part the runs of words
        taken are kept as they stand and joined by a line feed.
        """
        runs = self.segments().groupBy("s", "start", "doc_id", "h", "pass").agg(
            F.array_sort(F.collect_list(F.struct("word_from", "word_to"))).alias("runs"), F.max("size").alias("size")
        )  # one text's own blocks: bounded by its length
        # equal rows have places of their own in the stream; the first of them stands for each
        equal = self.placed.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
        keys = runs.join(equal.withColumnsRenamed({"doc_id": "id", "h": "hash"}).hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash")))
        keys = save(keys.select("doc_id", "h", "runs", "size", "n"), "taken")
        joined, (taken, size) = one_of_equals(self.docs, keys, "doc_id", "h", "runs", "size")
        whole = F.aggregate(taken, F.lit(0).cast("bigint"), lambda a, r: a + r["word_to"] - r["word_from"]) == F.col(size)
        text = F.when(whole, F.col("text")).otherwise(F.pandas_udf(cut_words, "string")("text", taken))
        return joined.withColumn("text", text).select(*(f"`{c}`" for c in self.docs.columns))


def cut_words(text: pd.Series, runs: pd.Series) -> pd.Series:
    """The given runs of words of each text; runs that touch stay one piece."""
    out = []
    for t, r in zip(text, runs, strict=True):
        data, offsets = as_bytes(pa.array([t or ""]))
        starts, ends, _ = spans(data, offsets)
        pieces: list[list[int]] = []
        for x in r:
            a, b = int(x["word_from"]), int(x["word_to"])
            if pieces and pieces[-1][1] == a:
                pieces[-1][1] = b
            else:
                pieces.append([a, b])
        out.append(b"\n".join(data[starts[a] : ends[b - 1]].tobytes() for a, b in pieces).decode())
    return pd.Series(out)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 5, 2, 1 in turn and share 150% of all words."""
    return Mix(table(spark, sf_dir, "documents")).taken()
