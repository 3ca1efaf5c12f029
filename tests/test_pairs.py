"""Candidate pairs against plain ones, repeated records and large blocks among them, and without a shuffle of pairs."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from kinmerge.functions.similarity import jaro_winkler_many, jaro_winkler_of
from kinmerge.operators import matching as M
from kinmerge.operators import meet
from kinmerge.operators.matching import FAMILIES
from kinmerge.plans.resolve import no_pairs

_SCHEMA = "record_id string, email_keys array<string>, phones array<string>, fn string, fn_raw string, ln string, suffix string, dob string, postal string, addr string, city string, ambiguous array<string>, rare boolean, source_id string, truth bigint"


def _rows(n=120):
    rows = [(f"r{i}", [f"e{i % 17}", f"e{i % 5 + 50}"][: i % 3], [f"p{i % 11}"] if i % 2 else [], f"f{i % 4}" if i % 7 else None, f"f{i % 4}", f"l{i % 3}", None, f"d{i % 13}", f"z{i % 6}", f"a{i % 19}", None, [], False, "s", i) for i in range(n)]
    return rows + [("r3", ["e9"], ["p4"], "f1", "f1", "l2", None, "d5", "z1", "a7", None, [], False, "s", 3), rows[5]]


def _plain(rows, most):
    blocks = {}
    for r in rows:
        of = dict(zip(("email_keys", "phones", "fn", "ln", "dob", "postal", "addr"), (r[1], r[2], r[3], r[5], r[7], r[8], r[9])))
        for tag, parts in FAMILIES.items():
            keys = [(v,) for v in of[parts[0]]] if tag in "ep" else [tuple(of[p] for p in parts)]
            for k in keys:
                if None not in k:
                    blocks.setdefault((tag, k), set()).add(r[0])
    return {p for b in blocks.values() if len(b) <= most for p in combinations(sorted(b), 2)}


def test_pairs_are_made_once_where_records_meet_first(spark):
    rows = _rows()
    keyed = spark.createDataFrame(rows, _SCHEMA)
    for most in (7, 12, 25, 1000):
        got = [tuple(r) for r in M.candidate_pairs(keyed, most).collect()]
        assert len(got) == len(set(got)) and set(got) == _plain(rows, most)
    plan = M.candidate_pairs(keyed)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("SortMergeJoin")[0] and "HashAggregate" not in plan.split("SortMergeJoin")[0]


def test_compared_where_they_meet(spark):
    known = spark.createDataFrame(_rows(), _SCHEMA)
    for most in (12, 1000):
        want = M.compare(M.candidate_pairs(known, most), known).collect()
        assert sorted(map(str, M.compare_candidates(known, most).collect())) == sorted(map(str, want))


def test_similar_many_at_once():
    rng = random.Random(3)
    values = ["", "a", "main st", "x" * 70, "é́ß", "martha", "marhta", "dixon", "dicksonx"] + ["".join(rng.choice("abcde 12") for _ in range(rng.randrange(1, 20))) for _ in range(150)]
    x, y = (np.array(v) for v in zip(*((i, j) for i in range(len(values)) for j in range(len(values)))))
    assert jaro_winkler_many(values, x, y).tolist() == [jaro_winkler_of(values[i], values[j]) for i, j in zip(x, y)]


def test_compared_in_many_buckets_by_compressed_columns(spark, monkeypatch):
    rows = _rows()
    known = spark.createDataFrame(rows, _SCHEMA)
    one = sorted(map(str, M.compare_candidates(known, 25).collect()))
    monkeypatch.setattr(meet, "BUCKET_ENTRIES", 40)
    many = M.compare_candidates(known, 25)
    assert many._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1  # of buckets; no row of a record travels by itself
    assert sorted(map(str, many.collect())) == one
    assert {(r.a, r.b) for r in many.select("a", "b").collect()} == _plain(rows, 25)
    assert M.compare_candidates(known.limit(0)).count() == 0


def test_no_pair_is_looked_up_in_an_empty_table(spark):
    scored = M.score_and_band(M.compare_candidates(spark.createDataFrame(_rows(), _SCHEMA)))
    decided = M.decide(scored, no_pairs(spark))
    assert "Join" not in decided._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(decided.collect()) == sorted(M.decide(scored).collect())


def test_cannot_links_told_by_the_pairs_themselves(spark, monkeypatch):
    # a rare name with a postal code in common makes gray matches
    rows = [(f"r{i}", [], [], f"f{i % 3}", f"f{i % 3}", "l", None, None, "z", None, None, [], True, "s", i % 2) for i in range(12)]
    known = spark.createDataFrame(rows, _SCHEMA)
    scored = M.score_and_band(M.compare_candidates(known))
    barred = (F.col("a_truth") == 1) & (F.col("b_truth") == 1)
    monkeypatch.setattr(meet, "ALIKE", 2)
    told = M.decide_candidates(known, cannot=barred)
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
    looked_up = M.decide(scored, scored.where(barred).select(F.col("b").alias("a"), F.col("a").alias("b")))
    assert sorted(map(str, told.collect())) == sorted(map(str, looked_up.collect()))
    assert 0 < told.where("final = 'review'").where(barred).count() < told.count() and told.where("final = 'match'").count()
