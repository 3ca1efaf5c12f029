"""Tables that grow with the input are joined without a broadcast, which would pass them through the driver."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinmerge.llm import components, katz, mixing, repair, simhash


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two three four five"), F.sha2((F.col("id") % 50).cast("string"), 256)).alias("text"))
    return rows.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y"))


def test_no_broadcast_of_fingerprints(spark):
    docs = texts(spark)
    edges = spark.createDataFrame([(2, 1), (3, 2)], "u bigint, v bigint")
    found = simhash.near_duplicates(docs)
    for df in (simhash.links(simhash.fingerprints(docs).select("fp").distinct()), found, components._large_star(edges), components._small_star(edges)):
        assert "BroadcastHashJoin" not in planned(df)
    assert found.where("component_id <> doc_id").count() >= 10


def test_no_broadcast_in_the_mix(spark):
    mixed = mixing.Mix(texts(spark))
    plan = planned(mixed.segments())
    # the text's blocks meet the blocks drawn by a merge; what is broadcast has a row for each source
    assert "SortMergeJoin [s#" in plan and ", block#" in plan.split("SortMergeJoin")[1].split("\n")[0]
    assert mixed.texts().count() > 0


def test_what_katz_sends_is_coded_by_frequency():
    rng = np.random.default_rng(5)
    counts = (rng.geometric(0.3, 50_000) * rng.integers(1, 9, 50_000)).astype(np.uint64)
    assert (katz._unplaned(katz._planes(counts), np.uint64) == counts).all()
    assert len(katz._planes(counts)) < 0.8 * len(pa.compress(counts.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="lz4", asbytes=True))
    for n in (0, 1, 8, 4097):
        some = rng.random(n) < 0.3
        assert (katz._unbits(katz._bits(some)) == some).all() and len(katz._bits(some)) <= 8 + -(-n // 8)


def test_late_rounds_look_at_few_places(monkeypatch):
    ids = np.random.default_rng(6).zipf(1.3, 60_000) % 3000
    seen, real = [], repair._rank_of
    monkeypatch.setattr(repair, "_rank_of", lambda codes, pairs: seen.append(len(codes)) or real(codes, pairs))
    seq, rules, first = repair.grammar(ids)
    assert (repair.expand(seq, rules, first) == ids).all() and not len(repair._frequent(repair._pair_codes(seq)))
    assert seen[0] == len(ids) - 1 and seen[-1] < len(seq) / 4
