"""The driver plans the steps of consent and publication one by one."""

from kinmerge import session
from kinmerge.operators import consent as K
from kinmerge.plans import resolve as R

session_trim = session.trim_driver
PEOPLE = "cluster string, record_id string, email_keys array<string>, phones array<string>, fn string, ln string, addr string, postal string, city string"
SAID = "record_id string, purpose string, granted boolean, observed_at string, source_id string"
GOLDEN = "cluster string, first_name string"
STANDING = "cluster string, purpose string, granted boolean, observed_at string, source string"


def planned(df):
    """How many shuffles and broadcasts a plan has."""
    return df._jdf.queryExecution().sparkPlan().toString().count("Join ") + df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def watched(monkeypatch, module):
    seen, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, *a, **b: seen.append(planned(df)) or cut(df, *a, **b))
    return seen


def test_consent_is_planned_in_steps(spark, monkeypatch):
    frame = spark.createDataFrame
    people = frame([("A", "a", ["x"], ["1"], "ann", "lee", None, None, None), ("B", "b", ["x"], ["1"], "bob", "ray", None, None, None)], PEOPLE)
    said = frame([("a", "email_marketing", True, "2", "s"), ("b", "email_marketing", False, "3", "s")], SAID)
    none = R.no_pairs(spark)
    seen = watched(monkeypatch, K)
    standing = K.consent(people, said, none, none)
    assert {(r["cluster"], r["granted"]) for r in standing.collect()} == {("A", False), ("B", False)}
    assert max([*seen, planned(standing)]) <= 30


def test_publication_reads_profiles_that_are_kept(spark, monkeypatch):
    frame = spark.createDataFrame
    members = frame([("A", "a"), ("A", "b"), ("B", "c")], "cluster string, record_id string")
    golden, consent = frame([("A", "Ann"), ("B", "Bob")], GOLDEN), frame([("A", "email_marketing", True, "2", "s")], STANDING)
    found = R.Resolution(members, members, members, members, golden, consent)
    before = frame([("a", "p1"), ("c", "p2"), ("gone", "p3")], "record_id string, profile string")
    seen = watched(monkeypatch, R)
    new = R.publish(found, before, frame([], "old string, new string"), frame([("p1", "d"), ("p2", "d"), ("p3", "d")], "profile string, digest string"))
    assert {(r["profile"], r["change"]) for r in new["changes"].collect()} == {("p1", "updated"), ("p2", "updated"), ("p3", "retired")}
    assert {tuple(r) for r in new["members"].collect()} == {("a", "p1"), ("b", "p1"), ("c", "p2")}
    assert len(seen) == 3 and max(planned(new[k]) for k in ("changes", "events", "aliases")) <= 20


def test_freed_memory_goes_back(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(session, "trim_driver", lambda s: asked.append(session_trim(s)))
    session.free_shuffles(spark, 1 << 30)
    assert len(asked) == 1 and asked[0] in (True, False)
