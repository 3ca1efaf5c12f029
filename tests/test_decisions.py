import json

from pyspark.sql import functions as F

from kinmerge.operators import mapping as MAP
from kinmerge.operators import state as S
from kinmerge.plans import decisions as D

STATUSES = dict(email="missing", phone="missing", first_name="agree", last_name="agree", birth_date="missing", name_suffix="missing", address="agree", postal_code="agree", city="missing", name_frequency="common")


def _scored(spark, *rows):
    named = [dict(STATUSES, a=f"a{i}", b=f"b{i}", digest=f"d{i}", score=8.0, band="gray", cannot=False) | r for i, r in enumerate(rows)]
    columns = sorted(named[0])
    kinds = {"score": "double", "cannot": "boolean"}
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in named], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))


def _verdict(spark, p, **statuses):
    row = _scored(spark, statuses).withColumn("p", F.from_json(F.lit(json.dumps(p)), D.PROPOSAL))
    return row.select(D.gate().alias("v")).first()[0]


def test_gates(spark):
    cite = lambda *fields: [{"field": f, "status": "agree"} for f in fields]
    say = lambda d, c, e: {"decision": d, "confidence": c, "evidence": e}
    whole = cite("first_name", "last_name", "address", "postal_code")
    assert _verdict(spark, say("match", 0.9, whole)) == "auto_applied"
    assert _verdict(spark, say("match", 0.8, whole)) == "queued"
    assert _verdict(spark, say("match", 0.9, whole), cannot=True) == "rejected"
    assert _verdict(spark, say("match", 0.9, whole), birth_date="conflict") == "rejected"
    assert _verdict(spark, say("match", 0.9, cite("first_name", "last_name"))) == "rejected"  # not enough is cited
    assert _verdict(spark, say("no_match", 0.9, cite("email"))) == "rejected"  # untrue
    assert _verdict(spark, say("no_match", 0.9, cite("nonsense"))) == "rejected"
    assert _verdict(spark, say("abstain", 0.9, [])) == "queued" and _verdict(spark, say("maybe", 0.9, [])) == "rejected"
    assert _verdict(spark, say("no_match", 1.5, [])) == "rejected" and _verdict(spark, {"decision": "no_match", "confidence": 0.9}) == "rejected"
    both = cite("first_name", "last_name", "birth_date")
    assert _verdict(spark, say("match", 0.9, both), birth_date="agree") == "auto_applied"
    assert _verdict(spark, say("match", 0.9, both), birth_date="agree", email="disagree", phone="disagree") == "rejected"


def test_decisions_are_kept_and_the_budget_holds(spark):
    rows = _scored(spark, {}, {}, {"band": "match"}, {"band": "conflict"}, {"first_name": "disagree"}).drop("cannot")
    none = spark.createDataFrame([], "a string, b string, digest string, decision string, score double, band string")
    no_pairs = spark.createDataFrame([], "a string, b string")
    plain = {r["a"]: (r["decision"], r["decided_by"]) for r in D.decide(rows, none, no_pairs).collect()}
    assert plain == {"a0": ("match", "rules"), "a1": ("match", "rules"), "a2": ("match", "band"), "a3": ("no_match", "band"), "a4": ("no_match", "rules")}
    barred = spark.createDataFrame([("b0", "a0")], "a string, b string")
    assert {r["a"]: r["decision"] for r in D.decide(rows, none, barred).collect()}["a0"] == "review"
    ask = lambda task: 'I say {"decision": "no_match", "confidence": 0.95, "evidence": []} so'
    asked = {r["a"]: (r["decision"], r["decided_by"]) for r in D.decide(rows, none, no_pairs, ask, budget=1).collect()}
    assert asked["a0"] == ("no_match", "proposer") and asked["a1"] == ("match", "rules")
    kept = spark.createDataFrame([("a0", "b0", "d0", "no_match", 1.0, "gray"), ("a1", "b1", "other", "no_match", 1.0, "gray")], none.schema)
    again = {r["a"]: (r["decision"], r["decided_by"]) for r in D.decide(rows, kept, no_pairs).collect()}
    assert again["a0"] == ("no_match", "kept") and again["a1"] == ("match", "rules")
    replayed = {r["a"]: r["decision"] for r in D.replayed(rows, kept).collect()}
    assert replayed == {"a0": "no_match", "a1": None, "a2": "match", "a3": "no_match", "a4": None}

    def broken(task):
        raise OSError("down")

    assert {r["a"]: r["decision"] for r in D.decide(rows, none, no_pairs, broken).collect()} == {k: v[0] for k, v in plain.items()}
    assert D.first_object("no object") is None and D.first_object(None) is None


def test_reviews_and_mapping_versions(spark):
    queued = spark.createDataFrame([(1, "match_adjudication", "y|x"), (2, "schema_mapping", "s"), (3, "cluster_conflict", "p|q")], "id bigint, kind string, subject string")
    said = spark.createDataFrame([(1, True, 2), (1, False, 1), (2, True, 3), (9, True, 4)], "id bigint, approved boolean, seq bigint")
    outcome, links, mappings = S.review(queued, said)
    assert sorted(map(tuple, outcome.collect())) == [(1, "rejected"), (2, "approved")] and [tuple(r) for r in links.collect()] == [("x", "y", "cannot_link", 1)]
    versions = spark.createDataFrame([("s", 1, "active", 0), ("s", 2, "proposed", 2)], "source string, version int, status string, proposal bigint")
    got = S.activate_mappings(versions, mappings)
    assert sorted((r["version"], r["status"]) for r in got.collect()) == [(1, "superseded"), (2, "active")]
    assert S.sources_overview(spark.createDataFrame([("s",), ("t",)], "source string"), got).where("mapping_version is null").first()["source"] == "t"


def test_stewards_meet_the_gates():
    bad = {"x": MAP.Use("no_such_target")}
    assert MAP.steward(bad, {}) == "rejected" and MAP.steward(bad, {}, force=True) == "overridden"
    good, known = {"e": MAP.Use("email")}, {"e": MAP.Facts(10, {"email": 1.0}), "z": MAP.Facts(0, {})}
    assert MAP.steward(good, known) == "approved"
    new = MAP.versioned("s", 3, good | {"z": MAP.Use(None)}, known, "auto_applied")
    assert new["version"] == 4 and new["deferred"] == ["z"] and list(new["fields"]) == ["e"] and MAP.versioned("s", None, good, known, "rejected") is None


def test_residual_identifiers(spark):
    df = spark.createDataFrame([("mail Ann@x.org.", 1), (None, 2)], "t string, n int")
    got = S.residual_identifiers({"t": df, "u": df.limit(0)}, spark.createDataFrame([("ann@x.org",), ("bob@x.org",)], "word string"))
    assert [tuple(r) for r in got.collect()] == [("t", "ann@x.org")]
