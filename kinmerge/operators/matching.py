"""From contact records to scored pairs: match keys, blocks, corpus context, comparison, score, band.

Every stage is a function from DataFrames to a DataFrame of native expressions;
only string similarity leaves the JVM, and only for distinct pairs of unequal
values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.similarity import jaro_winkler, similarities
from ..session import cut
from . import meet

# Weights, thresholds and limits that decide results.
WEIGHTS = {
    "email": {"agree": 14.0, "shared": 1.0, "disagree": -2.0}, "phone": {"agree": 9.0, "shared": 1.0, "disagree": -1.0},
    "first_name": {"agree": 4.0, "partial": 2.5, "disagree": -5.0}, "last_name": {"agree": 4.0, "partial": 2.5, "disagree": -5.0},
    "birth_date": {"agree": 8.0}, "address": {"agree": 4.0, "shared": 0.5, "partial": 2.0, "disagree": -0.5},
    "postal_code": {"agree": 2.0, "disagree": -1.0}, "city": {"agree": 0.5}, "name_frequency": {"rare": 1.5},
}
BOTH_CONTACTS_DISAGREE = -3.0
MATCH_AT, NON_MATCH_AT = 12.0, 4.0
FIRST_NAME_PARTIAL, LAST_NAME_PARTIAL, ADDRESS_PARTIAL, SAME_FIRST_NAME = 0.90, 0.92, 0.93, 0.8
PARTLY = {"fn": FIRST_NAME_PARTIAL, "ln": LAST_NAME_PARTIAL, "addr": ADDRESS_PARTIAL}
MOST_IN_BLOCK = 200
FAMILIES = {"e": ("email_keys",), "p": ("phones",), **meet.SINGLE}


def match_keys(contacts: DataFrame, this_year: int) -> DataFrame:
    """One row for each record with its canonical values and match keys; columns that contacts lacks are null.

    Three projections, each over columns of the one before, so that no expression is repeated inside another.
    """
    optional = ("city", "company", "job_title", "observed_at", "consent", "sms", "truth", "trust_rank")
    rows = contacts.select("record_id", "source_id", *(F.col(c) if c in contacts.columns else F.lit(None).cast("string").alias(c) for c in ("first_name", "last_name", "email", "phone", "dob", "street", "zip", *optional)))
    words = rows.withColumn("words", F.split(N.clean(F.col("last_name")), " "))
    ending = words.withColumn("ending", N.suffix(F.try_element_at("words", F.lit(-1))))
    embedded = (F.size("words") > 1) & F.col("ending").isNotNull()
    last = F.when(embedded, F.array_join(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))), " ")).otherwise(F.col("last_name"))
    values = ending.select(
        "record_id", "source_id", *optional[3:], N.clean(F.col("city")).alias("city_name"), *(N.clean(F.col(c)).alias(c) for c in ("company", "job_title")),
        N.email(F.col("email")).alias("email"), N.phone(F.col("phone")).alias("phone"),
        N.name_part(F.col("first_name")).alias("first_name"), N.name_part(last).alias("last_name"),
        F.when(embedded, F.col("ending")).alias("suffix"), N.date(F.col("dob"), this_year).alias("dob"),
        N.clean(F.col("street")).alias("street"), N.postal(F.col("zip")).alias("postal"),
    )
    keys = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.array(c))))
    keyed = values.withColumns({
        "email_keys": keys(N.email_key(F.col("email"))), "phones": keys(F.col("phone")), "fn_raw": N.name_key(F.split_part(F.col("first_name"), F.lit(" "), F.lit(1))),
        "ln": N.name_key(F.col("last_name")), "addr": N.address_key(F.col("street")), "city": N.name_key(F.col("city_name")),
    })
    return keyed.withColumn("fn", N.canonical_first(F.col("fn_raw")))


def _joined(tag: str, *parts: str) -> Column:
    """tag:part|part, null where a part is."""
    whole = F.lit(tag + ":")
    for i, p in enumerate(parts):
        whole = F.concat(whole, F.lit("|" if i else ""), F.col(p))
    return whole


def _tagged(tag: str, column: str) -> Column:
    return F.transform(F.col(column), lambda v: F.concat(F.lit(tag + ":"), v))


def _keys_of(families: dict[str, tuple[str, ...]]) -> Column:
    listed = [_tagged(tag, c[0]) for tag, c in families.items() if c[0] in ("email_keys", "phones")]
    single = [_joined(tag, *c) for tag, c in families.items() if c[0] not in ("email_keys", "phones")]
    return F.concat(*listed, F.array_compact(F.array(*single)))


def blocks(keyed: DataFrame) -> DataFrame:
    """(block, record_id): every blocking key of every record."""
    return keyed.select("record_id", F.explode(_keys_of(FAMILIES)).alias("block")).distinct()


def block_sizes(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("block").agg(F.count("*").alias("size"))


def _met(keyed: DataFrame, most: int, *fields: str) -> DataFrame:
    """(a, b, x, y), a < b, once for each pair of records that share a block of at most ``most`` records; x and y list the fields of a's and b's rows.

    A pair is made in the first block its records share, so that pairs need not be told apart afterwards: they are
    never shuffled, only the records are, once for each of their blocks. Blocks go by 64-bit hashes of their names.
    """
    own = F.collect_list(F.struct(*fields)) if fields else F.lit(None)
    keys = F.transform(_keys_of(FAMILIES), lambda k: F.xxhash64(k))
    each = keyed.select("record_id", *fields, keys.alias("keys"))
    # rows of one record_id are one record with the blocks of all
    one = lambda what: each.groupBy("record_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"), what.alias("own"))
    sizes = one(F.max(F.lit(0))).select(F.explode("keys").alias("block")).groupBy("block").agg(F.count("*").alias("size"))
    # one row for more than ``most`` of the records' keys: known beforehand, so that few of them need no shuffle of the records
    large = cut(sizes.where(F.col("size") > most).select("block"))
    left = one(own if fields else F.max(F.lit(0))).select("record_id", "own", F.explode("keys").alias("block")).join(large, "block", "left_anti")
    kept = left.groupBy("record_id").agg(F.array_sort(F.collect_list("block")).alias("keys"), F.first("own").alias("own"))
    rows = kept.select("record_id", "own", "keys", F.posexplode("keys").alias("at", "block")).select("block", "record_id", F.slice("keys", F.lit(1), F.col("at")).alias("before"), "own")
    x, y = (rows.select("block", F.col("record_id").alias(r), F.col("before").alias(p), F.col("own").alias(o)) for r, p, o in (("a", "p", "x"), ("b", "q", "y")))
    return x.join(y.hint("merge"), "block").where((F.col("a") < F.col("b")) & ~F.arrays_overlap("p", "q")).select("a", "b", "x", "y")


def candidate_pairs(keyed: DataFrame, most: int = MOST_IN_BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of records that share a block of at most ``most`` records."""
    return _met(keyed, most).select("a", "b")


IDENTIFIERS = {"e": ("email_keys",), "p": ("phones",), "na": ("fn", "ln", "addr"), "np": ("fn", "ln", "postal")}


def identifiers(keyed: DataFrame) -> DataFrame:
    """(ident, record_id, and the keys that tell people apart)."""
    contacts = F.concat(F.transform("email_keys", lambda v: F.concat(F.lit("e:"), v)), F.transform("phones", lambda v: F.concat(F.lit("p:"), v)))
    return keyed.select("record_id", "fn", "ln", "suffix", "dob", "postal", "addr", contacts.alias("contacts"), F.explode(_keys_of(IDENTIFIERS)).alias("ident"))


def ambiguous_identifiers(keyed: DataFrame) -> DataFrame:
    """(ident, rule): identifiers that more than one person seems to use."""
    rows = identifiers(keyed)
    r1 = rows.groupBy("ident").agg(F.countDistinct("dob").alias("d"), F.countDistinct("suffix").alias("s")).where("d > 1 or s > 1").select("ident", F.lit("several birth dates or suffixes").alias("rule"))
    named = rows.where(F.col("ident").rlike("^n[ap]:"))
    r2 = named.groupBy("ident").agg(F.bool_or(F.col("suffix").isNotNull()).alias("w"), F.bool_or(F.col("suffix").isNull()).alias("o")).where("w and o").select("ident", F.lit("suffix sometimes").alias("rule"))
    contact = rows.where(F.col("ident").rlike("^[ep]:"))
    names = contact.where("fn is not null").select("ident", "fn").distinct()
    pairs = names.join(names.select("ident", F.col("fn").alias("fn2")), "ident").where("fn < fn2")
    alike = pairs.select("fn", "fn2").distinct().withColumn("jw", jaro_winkler(F.col("fn"), F.col("fn2")))
    r3 = pairs.join(alike.where(F.col("jw") < SAME_FIRST_NAME), ["fn", "fn2"]).select("ident", F.lit("unlike first names").alias("rule")).distinct()
    full = contact.where("fn is not null and ln is not null").withColumn("other", F.explode_outer(F.array_remove("contacts", F.col("ident"))))
    sides = full.groupBy("ident", "fn", "ln").agg(
        F.collect_set(F.when(F.col("suffix").isNotNull(), F.col("other"))).alias("w"), F.collect_set(F.when(F.col("suffix").isNull(), F.col("other"))).alias("o")
    )
    r4 = sides.where((F.size("w") > 0) & (F.size("o") > 0) & ~F.arrays_overlap("w", "o")).select("ident", F.lit("contacts part with suffix").alias("rule")).distinct()
    at = full.where(F.col("ident").startswith("e:") & F.col("postal").isNotNull() & F.col("addr").isNotNull()).withColumn("loc", F.concat_ws("|", "postal", "addr"))
    places = at.groupBy("ident", "fn", "ln", "loc").agg(F.countDistinct("record_id").alias("n"), F.collect_set("dob").alias("dobs"), F.collect_set("other").alias("others"))
    second = places.select("ident", "fn", "ln", *(F.col(c).alias(c + "2") for c in ("loc", "n", "dobs", "others")))
    both = places.join(second, ["ident", "fn", "ln"]).where("loc < loc2")
    apart = (F.greatest("n", "n2") > 1) & ~F.arrays_overlap("dobs", "dobs2") & (F.size("others") > 0) & (F.size("others2") > 0) & ~F.arrays_overlap("others", "others2")
    r5 = both.where(apart).select("ident", F.lit("one name at two places").alias("rule")).distinct()
    return r1.unionByName(r2).unionByName(r3).unionByName(r4).unionByName(r5)


def rare_names(keyed: DataFrame) -> DataFrame:
    """(fn, ln) that the whole corpus has in exactly one locality: the postal code, else the city."""
    place = F.coalesce("postal", F.concat(F.lit("c:"), F.col("city")))
    rows = keyed.where("fn is not null and ln is not null").select("fn", "ln", place.alias("loc")).where("loc is not null")
    return rows.groupBy("fn", "ln").agg(F.countDistinct("loc").alias("n")).where("n = 1").select("fn", "ln")


def with_context(keyed: DataFrame) -> DataFrame:
    """keyed with each record's own ambiguous identifiers and whether its name is rare."""
    shared = cut(ambiguous_identifiers(keyed).select("ident").distinct(), free=True)  # what its rules shuffle is gone when records are
    own = identifiers(keyed).select("record_id", "ident").join(shared, "ident").groupBy("record_id").agg(F.collect_set("ident").alias("ambiguous"))
    rare = rare_names(keyed).withColumn("rare", F.lit(True))
    out = keyed.join(own, "record_id", "left").join(rare, ["fn", "ln"], "left")
    return out.withColumns({"ambiguous": F.coalesce("ambiguous", F.array().cast("array<string>")), "rare": F.coalesce("rare", F.lit(False))})


def _contact_status(a: Column, b: Column, tag: str, ambiguous: Column) -> Column:
    common = F.transform(F.array_intersect(a, b), lambda v: F.concat(F.lit(tag), v))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), "missing").when(F.size(common) == 0, "disagree")
        .when(F.size(F.array_except(common, ambiguous)) > 0, "agree").otherwise("shared")
    )


COMPARED = ("email", "phone", "first_name", "last_name", "birth_date", "name_suffix", "address", "postal_code", "city", "name_frequency")
#: What pairs and clusters ask of a record's keys; ``with_context`` adds ambiguous and rare.
PAIRED = ("email_keys", "phones", "fn", "fn_raw", "ln", "suffix", "dob", "postal", "addr", "city", "source_id", "truth")
_FIELDS = (*PAIRED[:10], "ambiguous", "rare", *PAIRED[10:])


def candidates_with(keyed: DataFrame, *fields: str, most: int = MOST_IN_BLOCK, either: str | None = None) -> DataFrame:
    """The candidate pairs with fields of both sides, as a_field and b_field; a side with several rows gives as many.

    ``either`` names a boolean field that must be true in one of the two records.
    """
    met = _met(keyed, most, *fields)
    if either is not None:
        met = met.where(F.exists("x", lambda r: F.coalesce(r[either], F.lit(False))) | F.exists("y", lambda r: F.coalesce(r[either], F.lit(False))))
    met = met.select("a", "b", F.explode("x").alias("x"), "y").select("a", "b", "x", F.explode("y").alias("y"))
    return met.select("a", "b", *(F.col(f"{o}.{c}").alias(f"{s}_{c}") for s, o in (("a", "x"), ("b", "y")) for c in fields))


def compare_candidates(known: DataFrame, most: int = MOST_IN_BLOCK, told: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The candidate pairs of ``known`` compared where they meet: what ``compare`` gives for them, without a shuffle of pairs.

    ``told`` (say ``score_and_band``) works on statuses alone and is worked out once for many pairs.
    """
    return meet.compared(known, most, PARTLY, COMPARED, told)


def compare(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs with a status for each field; ``known`` comes from ``with_context``."""
    side = lambda s: known.select(F.col("record_id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in _FIELDS))
    return _statuses(pairs.join(side("a"), "a").join(side("b"), "b"))


def _statuses(rows: DataFrame) -> DataFrame:
    """(a, b, truths, a status for each field) of rows with the fields of both sides."""
    rows = rows.withColumn("jw", similarities([(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in ("fn", "fn_raw", "ln", "addr")]))
    a, b = (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))
    there = lambda c: a(c).isNotNull() & b(c).isNotNull()
    near = lambda c, least: F.coalesce(F.col("jw")[("fn", "fn_raw", "ln", "addr").index(c)] >= least, F.lit(False))

    def name(c: str, close: Column) -> Column:
        return F.when(~there(c), "missing").when(a(c) == b(c), "agree").when(close, "partial").otherwise("disagree")

    na = F.concat(F.lit("na:"), a("fn"), F.lit("|"), a("ln"), F.lit("|"), a("addr"))
    np_ = F.concat(F.lit("np:"), a("fn"), F.lit("|"), a("ln"), F.lit("|"), a("postal"))
    in_use = lambda ident: F.coalesce(F.array_contains(a("ambiguous"), ident), F.lit(False))
    same_name = F.coalesce((a("fn") == b("fn")) & (a("ln") == b("ln")), F.lit(False))
    both_suffix, one_suffix = there("suffix"), a("suffix").isNotNull() | b("suffix").isNotNull()
    return rows.select(
        "a", "b", F.col("a_truth"), F.col("b_truth"),
        _contact_status(a("email_keys"), b("email_keys"), "e:", a("ambiguous")).alias("email"),
        _contact_status(a("phones"), b("phones"), "p:", a("ambiguous")).alias("phone"),
        name("fn", near("fn", FIRST_NAME_PARTIAL) | near("fn_raw", FIRST_NAME_PARTIAL)).alias("first_name"),
        name("ln", near("ln", LAST_NAME_PARTIAL)).alias("last_name"),
        F.when(~there("dob"), "missing").when(a("dob") == b("dob"), "agree").otherwise("conflict").alias("birth_date"),
        F.when(both_suffix & (a("suffix") == b("suffix")), "agree").when(both_suffix, "conflict").when(one_suffix, "partial").otherwise("missing").alias("name_suffix"),
        F.when(~there("addr"), "missing").when(a("addr") == b("addr"), F.when(in_use(na), "shared").otherwise("agree")).when(near("addr", ADDRESS_PARTIAL), "partial").otherwise("disagree").alias("address"),
        F.when(~there("postal"), "missing").when(a("postal") == b("postal"), F.when(in_use(np_), "shared").otherwise("agree")).otherwise("disagree").alias("postal_code"),
        F.when(~there("city"), "missing").when(a("city") == b("city"), "agree").otherwise("disagree").alias("city"),
        F.when(~same_name, "missing").when(a("rare"), "rare").otherwise("common").alias("name_frequency"),
    )


def score_and_band(compared: DataFrame) -> DataFrame:
    """compared with score and band, in one projection."""
    score = F.lit(0.0)
    for field, weights in WEIGHTS.items():
        part = F.lit(0.0)
        for status, weight in weights.items():
            part = F.when(F.col(field) == status, F.lit(weight)).otherwise(part)
        score = score + part
    dcc = (F.col("email") == "disagree") & (F.col("phone") == "disagree")
    score = F.round(score + F.when(dcc, F.lit(BOTH_CONTACTS_DISAGREE)).otherwise(F.lit(0.0)), 3)
    conflict = (F.col("birth_date") == "conflict") | (F.col("name_suffix") == "conflict")
    dob = F.col("birth_date") == "agree"
    contact = (F.col("email") == "agree") | (F.col("phone") == "agree")
    sure = (contact | dob) & (F.col("first_name") != "disagree") & ~dcc & ~(dob & ~contact & (F.col("last_name") == "partial"))
    band = F.when(conflict, "conflict").when((F.col("score") >= MATCH_AT) & sure, "match").when(F.col("score") <= NON_MATCH_AT, "non_match").otherwise("gray")
    return compared.withColumn("score", score).withColumn("band", band)


def adjudicate(scored: DataFrame) -> DataFrame:
    """scored with the ordered rules' decision, confidence, cited evidence and the gates' verdict."""
    st = F.col
    agree = lambda c: st(c) == "agree"
    fine = lambda c: st(c).isin("agree", "partial")
    conflict = (st("birth_date") == "conflict") | (st("name_suffix") == "conflict")
    dcc = (st("email") == "disagree") & (st("phone") == "disagree")
    names, exact = fine("first_name") & fine("last_name"), agree("first_name") & agree("last_name")
    by_city = agree("postal_code") & agree("city") & (st("address") != "disagree")
    by_street = agree("address") & (agree("postal_code") | agree("city")) & (st("postal_code") != "disagree") & (st("city") != "disagree")
    shared = (st("email") == "shared") | (st("phone") == "shared")
    dob_only = agree("birth_date") & ~agree("email") & ~agree("phone")
    rules = [
        (conflict, "no_match", 0.99, "conflict"), (st("first_name") == "disagree", "no_match", 0.90, "first name"),
        (names & (agree("first_name") | agree("last_name")) & (st("name_suffix") != "partial") & (by_city | by_street) & shared & ~dcc, "match", 0.89, "name, locality, shared contact"),
        (names & agree("birth_date") & dob_only & ~agree("last_name"), "abstain", 0.5, "birth date only"),
        (names & agree("birth_date"), "match", 0.95, "name, birth date"), (names & (agree("email") | agree("phone")), "match", 0.93, "name, contact"),
        (exact & agree("address") & agree("postal_code") & ~dcc, "match", 0.88, "name, address, postal code"),
        (exact & agree("postal_code") & (st("name_frequency") == "rare") & ~dcc, "match", 0.87, "rare name, postal code"),
        ((st("last_name") == "disagree") & ~agree("email") & ~agree("phone") & ~agree("birth_date"), "no_match", 0.90, "surname"),
        (names & (st("postal_code") == "disagree") & ~agree("address"), "no_match", 0.86, "postal code"),
    ]
    pick = F.struct(F.lit("abstain").alias("decision"), F.lit(0.5).alias("confidence"), F.lit("none").alias("evidence"))
    for test, decision, confidence, evidence in reversed(rules):
        pick = F.when(test, F.struct(F.lit(decision).alias("decision"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence"))).otherwise(pick)
    strong = agree("email") | agree("phone") | agree("birth_date")
    enough = (st("first_name") != "disagree") & ~dcc & (
        (names & strong & (~dob_only | agree("last_name"))) | (exact & ((agree("address") & agree("postal_code")) | (agree("postal_code") & (st("name_frequency") == "rare"))))
        | (names & (agree("first_name") | agree("last_name")) & (st("name_suffix") != "partial") & (by_city | by_street) & shared)
    )
    hard = (F.col("d.decision") == "match") & (conflict | ~enough)
    soft = (F.col("d.confidence") < 0.85) | (F.col("d.decision") == "abstain")
    verdict = F.when(hard, "rejected").when(soft, "queued").otherwise("auto_applied")
    return scored.withColumn("d", pick).withColumn("verdict", verdict).select("*", "d.*").drop("d")


def decide(scored: DataFrame, cannot: DataFrame | Column | None = None) -> DataFrame:
    """(a, b, score, band, evidence, verdict, final): bands decide, gray pairs go through the rules and gates.

    A gray pair that a cannot-link bars is no match by any rule: it is for review. Cannot-links are a table (a, b),
    or what tells them by columns of the pairs themselves; then no pair is shuffled to be looked up.
    """
    return _final(adjudicate(scored), cannot)


def decide_candidates(known: DataFrame, most: int = MOST_IN_BLOCK, cannot: DataFrame | Column | None = None) -> DataFrame:
    """What ``decide`` gives for the candidate pairs of ``known``; rules are worked out once for pairs of the same statuses."""
    ruled = compare_candidates(known, most, lambda rows: adjudicate(score_and_band(rows)).select("pairs", "score", "band", "decision", "evidence", "verdict"))
    return _final(ruled, cannot)


def _final(ruled: DataFrame, cannot: DataFrame | Column | None) -> DataFrame:
    if isinstance(cannot, DataFrame):
        barred = cannot.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("barred", F.lit(True))
        ruled, cannot = ruled.join(barred, ["a", "b"], "left"), F.col("barred")
    if cannot is not None:
        ruled = ruled.withColumn("verdict", F.when(cannot & (F.col("decision") == "match"), "rejected").otherwise(F.col("verdict")))
    gray = F.col("band") == "gray"
    final = F.when(F.col("band") == "match", "match").when(~gray, "no_match").when(F.col("verdict") == "auto_applied", F.col("decision")).otherwise("review")
    return ruled.select("a", "b", "a_truth", "b_truth", "score", "band", "evidence", "verdict", final.alias("final"))


def rank_within(*by: Column | str, over: list[str]) -> Column:
    return F.row_number().over(W.partitionBy(*over).orderBy(*by))
