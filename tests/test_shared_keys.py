"""Denials over keys that many hold, open pairs that bring no denial, and facts counted once for each value."""

import random


from kinmerge.operators import consent as K
from kinmerge.operators import mapping as MAP


def test_channel_denied_by_others(spark):
    rng = random.Random(5)
    members = [(f"r{i}", i % 9, [f"e{rng.randrange(6)}@x"], [f"p{rng.randrange(40)}"]) for i in range(80)]
    events = [(r[0], p, rng.random() < 0.5, f"2025-01-{rng.randrange(1, 6):02}", "s") for r in members for p in K.CHANNELS]
    m = spark.createDataFrame(members, "record_id string, cluster int, email_keys array<string>, phones array<string>")
    e = spark.createDataFrame(events, "record_id string, purpose string, granted boolean, observed_at string, source_id string")
    got = {}
    for r in K.channel_denied_by_others(m, e).collect():
        got[r.cluster, r.purpose] = max(got.get((r.cluster, r.purpose), ""), r.observed_at)
    of, want = {r[0]: r for r in members}, {}
    for record, purpose, granted, at, _ in events:
        column = 2 if purpose == "email_marketing" else 3
        for r in members:
            if not granted and r[1] != of[record][1] and set(r[column]) & set(of[record][column]):
                want[r[1], purpose] = max(want.get((r[1], purpose), ""), at)
    assert got == want
    # a key that all share costs a row a cluster, not one a denial
    assert K.channel_denied_by_others(m, e).where("purpose = 'email_marketing'").count() <= 9 * 6


def test_values_are_tested_once(spark):
    flat = spark.createDataFrame([("1", "email", "a@x.com"), ("2", "email", "a@x.com"), ("3", "email", "nobody"), ("4", "email", " "), ("5", "email", None), ("6", "email", "[1]")], "key string, field string, value string")
    found = MAP.facts(flat, 2026)
    row = found.first()
    assert (row.non_null, row.non_null_rate, row.valid["email"]) == (3, 0.5, 0.667)
    assert "keys=[field#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) or "Aggregate [field#" in plan
    assert any("Aggregate [field#" in line and "value#" in line.split("],")[0] for line in plan.split("\n"))
