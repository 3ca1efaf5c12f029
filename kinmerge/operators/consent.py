"""Consent: what each cluster's records say, what follows from others' denials, and the holds on grants.

``members`` has (cluster, record_id, email_keys, phones, fn, ln, addr, postal, city), ``events``
(record_id, purpose, granted, observed_at, source_id). Denials are brought to one row for each key
before they meet clusters, so a key that a third of all records share costs one row a cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler
from ..session import cut

# Which purposes go with an address, the labels of holds, how alike first names must be.
CHANNELS = {"email_marketing": "email_keys", "sms_marketing": "phones"}
NAME_HOLD, CONTACT_HOLD, IDENTITY_HOLD = "same_name_denial_hold", "conflicting_contact_denial_hold", "identity_uncertainty_denial_hold"
ALIKE = 0.82

_EVENT = ("cluster", "purpose", "granted", "observed_at", "source_id", "record_id")


def resolve(events: DataFrame) -> DataFrame:
    """(cluster, purpose, granted, observed_at, source): the latest event wins, of equal times a denial, then the least source and record."""
    first = F.row_number().over(W.partitionBy("cluster", "purpose").orderBy(F.desc("observed_at"), "granted", "source_id", "record_id"))
    return events.withColumn("n", first).where("n = 1").select("cluster", "purpose", "granted", "observed_at", F.col("source_id").alias("source"))


def current_events(events: DataFrame) -> DataFrame:
    """(record_id, purpose, observed_at, source_id, granted): each record's latest event for each purpose; of equal times a denial."""
    last = F.max(F.struct("observed_at", (~F.col("granted")).alias("denied"), "source_id"))
    return events.groupBy("record_id", "purpose").agg(last.alias("m")).select("record_id", "purpose", "m.observed_at", "m.source_id", (~F.col("m.denied")).alias("granted"))


def own_events(members: DataFrame, events: DataFrame) -> DataFrame:
    return members.select("cluster", "record_id").join(events, "record_id").select(*_EVENT)


def _latest(denials: DataFrame, *key: str) -> DataFrame:
    """Of each key the latest denial, of equal times the least source and record."""
    first = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("observed_at"), "source_id", "record_id"))
    return denials.withColumn("n", first).where("n = 1").drop("n")


def channel_denials(members: DataFrame, events: DataFrame) -> DataFrame:
    """Denials of a channel's purpose that reach a cluster through an e-mail address or phone it shares; of each the latest.

    A cluster's own denials are among them; they are its own events anyway.
    """
    out = None
    for purpose, column in CHANNELS.items():
        keys = members.select("cluster", F.explode(column).alias("k")).distinct()
        denied = events.where(~F.col("granted") & (F.col("purpose") == purpose)).join(members.select("record_id", F.explode(column).alias("k")), "record_id")
        reached = keys.join(_latest(denied.select("k", "purpose", "granted", "observed_at", "source_id", "record_id"), "k"), "k").select(*_EVENT)
        out = reached if out is None else out.unionByName(reached)
    return out


def channel_denied_by_others(members: DataFrame, events: DataFrame) -> DataFrame:
    """(cluster, purpose, observed_at): of each address or phone a cluster holds the latest denial of its channel's purpose by a record of another cluster.

    A key's latest denial of all and its latest by any other cluster than that one's are enough for every cluster, so a key held by many costs each one row.
    """
    out = None
    for purpose, column in CHANNELS.items():
        held = members.select("record_id", "cluster", F.explode(column).alias("k"))
        denied = events.where(~F.col("granted") & (F.col("purpose") == purpose)).select("record_id", "observed_at")
        per = held.join(denied, "record_id").groupBy("k", F.col("cluster").alias("from")).agg(F.max("observed_at").alias("at"))
        top = per.groupBy("k").agg(F.max(F.struct("at", "from")).alias("top"))
        next_ = per.join(top, "k").where(F.col("from") != F.col("top.from")).groupBy("k").agg(F.max("at").alias("at2"))
        reached = held.select("cluster", "k").distinct().join(top.join(next_, "k", "left"), "k")
        at = F.when(F.col("top.from") != F.col("cluster"), F.col("top.at")).otherwise(F.col("at2"))
        found = reached.select("cluster", F.lit(purpose).alias("purpose"), at.alias("observed_at")).where("observed_at is not null")
        out = found if out is None else out.unionByName(found)
    return out


def neighbour_denials(members: DataFrame, events: DataFrame, undecided: DataFrame, cannot: DataFrame) -> DataFrame:
    """Denials by records that an open pair (a, b) ties to a cluster, but its own and its cannot-link partners'."""
    denied = events.where(~F.col("granted"))
    who = denied.select(F.col("record_id").alias("b")).distinct()
    # only ways to a record that denies matter, on either side
    both = lambda df: df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(who, "b", "left_semi")
    of = members.select(F.col("record_id").alias("a"), "cluster")
    ways = both(undecided).join(of, "a").select("cluster", "b").distinct()
    barred = both(cannot).join(of, "a").select("cluster", "b").distinct()
    theirs = members.select(F.col("record_id").alias("b"), F.col("cluster").alias("from"))
    ways = ways.join(barred, ["cluster", "b"], "left_anti").join(theirs, "b").where(F.col("from") != F.col("cluster"))
    return ways.join(denied, F.col("b") == F.col("record_id")).select(*_EVENT)


def contact_holds(members: DataFrame, current: DataFrame, granted: DataFrame) -> DataFrame:
    """Holds on grants (cluster, purpose, observed_at) where a cluster's own active denial and active grant have addresses or phones that do not overlap."""
    own = members.select("cluster", "record_id", "email_keys", "phones").join(current, "record_id").join(granted.select("cluster", "purpose", F.col("observed_at").alias("at")), ["cluster", "purpose"])
    yes = own.where("granted").select("cluster", "purpose", F.col("email_keys").alias("e"), F.col("phones").alias("p"))
    no = own.where("not granted").select("cluster", "purpose", "at", "record_id", F.col("email_keys").alias("de"), F.col("phones").alias("dp"))
    apart = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    held = no.join(yes, ["cluster", "purpose"]).where(apart("e", "de") | apart("p", "dp"))
    return _held(held.groupBy("cluster", "purpose", "at").agg(F.min("record_id").alias("record_id")), CONTACT_HOLD)


def _held(holds: DataFrame, label: str) -> DataFrame:
    return holds.select("cluster", "purpose", F.lit(False).alias("granted"), F.col("at").alias("observed_at"), F.lit(label).alias("source_id"), "record_id")


def name_holds(members: DataFrame, current: DataFrame, granted: DataFrame) -> DataFrame:
    """Holds by the latest active denial of the same full name, at least as recent as the grant.

    A cluster's own denials are older than its standing grant, so what is found is another's.
    """
    named = members.where("fn is not null and ln is not null")
    denied = current.where(~F.col("granted")).join(named.select("record_id", "fn", "ln"), "record_id")
    latest = _latest(denied.select("purpose", "fn", "ln", F.col("observed_at"), "source_id", "record_id"), "purpose", "fn", "ln").select("purpose", "fn", "ln", F.col("observed_at").alias("at"), "record_id")
    mine = named.select("cluster", "fn", "ln").distinct().join(granted, "cluster")
    return _held(mine.join(latest, ["purpose", "fn", "ln"]).where(F.col("at") >= F.col("observed_at")).select("cluster", "purpose", "at", "record_id"), NAME_HOLD)


def _identity_keys() -> Column:
    joined = lambda tag, *parts: F.concat(F.lit(tag), *(x for p in parts for x in (F.lit("|"), F.col(p))))
    return F.array_compact(F.array(joined("a", "fn", "addr", "postal"), joined("l", "fn", "ln", "postal")))


def identity_holds(members: DataFrame, current: DataFrame, granted: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Holds, whatever their age, by an active denial of who may be the same person outside the cluster.

    The same first name with the same address and postal code, or with the same surname and postal code; or the same
    surname and city with a like first name. The hold bears the grant's time.
    """
    named = members.where("fn is not null and ln is not null")
    held = named.join(granted.select("cluster", "purpose", F.col("observed_at").alias("at")), "cluster")
    denied = current.where(~F.col("granted")).select("record_id", "purpose").join(named, "record_id")
    # of a key's denials the least and the greatest cluster are enough to know that one is another's
    ends = (F.min(F.struct("cluster", "record_id")).alias("low"), F.max(F.struct("cluster", "record_id")).alias("high"))
    theirs = denied.select("purpose", "cluster", "record_id", F.explode(_identity_keys()).alias("k")).groupBy("purpose", "k").agg(*ends)
    exact = held.select("cluster", "purpose", "at", F.explode(_identity_keys()).alias("k")).distinct().join(theirs, ["purpose", "k"])
    other = lambda df: df.withColumn("o", F.when(F.col("low.cluster") != F.col("cluster"), F.col("low.record_id")).when(F.col("high.cluster") != F.col("cluster"), F.col("high.record_id"))).where("o is not null").select("cluster", "purpose", "at", "o")
    near = denied.where("city is not null").select("purpose", "ln", "city", F.col("fn").alias("other"), "cluster", "record_id").groupBy("purpose", "ln", "city", "other").agg(*ends)
    like = held.where("city is not null").select("cluster", "purpose", "at", "ln", "city", "fn").distinct().join(near, ["purpose", "ln", "city"])
    names = like.select("fn", "other").distinct().withColumn("jw", jaro_winkler(F.col("fn"), F.col("other"))).where(F.col("jw") >= alike).drop("jw")
    both = other(exact).unionByName(other(like.join(names, ["fn", "other"], "left_semi")))
    return _held(both.groupBy("cluster", "purpose", "at").agg(F.min("o").alias("record_id")), IDENTITY_HOLD)


def consent(members: DataFrame, events: DataFrame, undecided: DataFrame, cannot: DataFrame) -> DataFrame:
    """(cluster, purpose, granted, observed_at, source) after denials from outside and all holds.

    Holds look at purposes granted after channel and neighbour denials; as ties deny, a hold with the grant's time wins over it.
    """
    # each step is kept before the next begins: the driver never plans them all at once, and what one shuffles is gone when the next begins
    outside = [cut(df, free=True) for df in (channel_denials(members, events), neighbour_denials(members, events, undecided, cannot))]
    base = cut(resolve(own_events(members, events).unionByName(outside[0]).unionByName(outside[1])), free=True)
    granted = base.where("granted").select("cluster", "purpose", "observed_at")
    current = cut(current_events(events), free=True)
    standing = base.withColumn("record_id", F.lit("")).withColumnRenamed("source", "source_id").select(*_EVENT)
    for holds in (contact_holds, name_holds, identity_holds):
        standing = standing.unionByName(cut(holds(members, current, granted), free=True))
    return resolve(standing)
