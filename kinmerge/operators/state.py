"""State between runs: upserts, consent capture, suppression, publication, queues, ledger, export, profiling."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..session import cut


def upsert(state: DataFrame, batch: DataFrame) -> DataFrame:
    """(key, digest, mapping, payload, change): the state after a batch, both (key, digest, mapping, payload), the batch with seq.

    The last row of a key counts. A row is unchanged if digest and mapping version are what they were; keys the
    batch does not name are kept, with a null change.
    """
    last = batch.groupBy("key").agg(F.max_by(F.struct("digest", "mapping", "payload"), "seq").alias("new"))
    both = state.select("key", F.struct("digest", "mapping", "payload").alias("old")).join(last, "key", "full")
    same = (F.col("old.digest") == F.col("new.digest")) & F.col("old.mapping").eqNullSafe(F.col("new.mapping"))
    change = F.when(F.col("new").isNull(), F.lit(None)).when(F.col("old").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.withColumn("change", change).withColumn("now", F.coalesce("new", "old")).select("key", "now.*", "change")


def upsert_diff(state: DataFrame, batch: DataFrame) -> DataFrame:
    """(key, change) of a batch (key, seq, digest[, mapping]) against a state (key, digest[, mapping])."""
    filled = lambda df: df.withColumns({c: F.lit(None).cast("string") for c in ("mapping", "payload") if c not in df.columns})
    return upsert(filled(state), filled(batch)).where("change is not null").select("key", "change")


def _ordered_fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows folded in order inside each group of keys, streamed: a group is read once and never held."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(step, schema)


def consent_changes(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(subject, purpose, seq, at, granted): the events, in order of arrival, that are a subject's first for a
    purpose, or differ from the last one kept and are strictly newer than it.

    ``stored`` (subject, purpose, at, granted) are the last events kept by earlier runs, at most one for each subject and purpose.
    """
    columns = ["subject", "purpose", "seq", "at", "granted"]
    rows = events.select(*columns, F.lit(False).alias("old"))
    if stored is not None:
        seq = F.lit(-1).cast(events.schema["seq"].dataType).alias("seq")
        rows = stored.select("subject", "purpose", seq, "at", "granted", F.lit(True).alias("old")).unionByName(rows)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = last = None
        for b in batches:
            keep = []
            for subject, purpose, at, granted, old in zip(*(b.column(c).to_pylist() for c in ("subject", "purpose", "at", "granted", "old"))):
                if (subject, purpose) != group:
                    group, last = (subject, purpose), None
                new = last is None or (granted != last[1] and at > last[0])
                if new:
                    last = (at, granted)
                keep.append(new and not old)
            yield b.filter(pa.array(keep, pa.bool_())).select(columns)

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return _ordered_fold(rows, ["subject", "purpose"], ["seq"], step, schema)


def suppress(keyed: DataFrame, suppressions: DataFrame, key: bytes) -> DataFrame:
    """Records none of whose hashed identifiers is suppressed (column hash): e-mail keys, or phones where there is no e-mail."""
    emails = F.transform("email_keys", lambda v: N.keyed_hash(v, "email", key))
    phones = F.transform("phones", lambda v: N.keyed_hash(v, "phone", key))
    hashed = keyed.select("record_id", F.explode(F.when(F.size("email_keys") > 0, emails).otherwise(phones)).alias("hash"))
    hit = hashed.join(suppressions.select("hash"), "hash", "left_semi").select("record_id").distinct()
    return keyed.join(hit, "record_id", "left_anti")


def flatten(json_rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, field, value): nested JSON objects as dotted names, to any depth; lists stay JSON text; an empty object gives no field.

    The depth is that of the deepest row, counted from the braces outside of strings.
    """
    braces = F.regexp_replace(payload, r'"(?:[^"\\\\]|\\\\.)*"|[^{}]+', "")
    step = lambda acc, ch: F.struct(acc["now"] + F.when(ch == "{", 1).otherwise(-1), F.greatest(acc["most"], acc["now"] + F.when(ch == "{", 1).otherwise(0)))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deep = F.aggregate(F.split(braces, ""), start, lambda acc, ch: F.when(ch == "", acc).otherwise(F.struct(step(acc, ch)["col1"].alias("now"), step(acc, ch)["col2"].alias("most"))))
    depth = json_rows.select(F.max(deep["most"])).first()[0] or 0
    kind = "map<string,string>"
    rows = json_rows.select(key, F.explode(F.from_json(payload, kind)).alias("field", "value"))
    for _ in range(depth - 1):
        inner = F.map_entries(F.when(F.col("value").startswith("{"), F.from_json("value", kind)))
        parts = F.transform(inner, lambda e: F.struct(F.concat_ws(".", "field", e["key"]).alias("field"), e["value"].alias("value")))
        rows = rows.select(key, F.explode(F.coalesce(parts, F.array(F.struct("field", "value")))).alias("x")).select(key, "x.*")
    return rows


def quarantine(facts: DataFrame, mapped: DataFrame, least_rows: int = 20, least_rate: float = 0.90) -> DataFrame:
    """(field, target, non_null, rate): identity columns of mapping facts, mapped (field, target), with enough values of which too few are valid."""
    return facts.join(mapped, "field").withColumn("rate", F.coalesce(F.try_element_at("valid", F.col("target")), F.lit(0.0))).where((F.col("non_null") >= least_rows) & (F.col("rate") < least_rate)).select("field", "target", "non_null", "rate")


def guarded(state: DataFrame, merged: DataFrame, bad: DataFrame) -> DataFrame:
    """The state after a batch, or the one before it, whole, where any column is quarantined: (key, digest, mapping, payload)."""
    columns = ("key", "digest", "mapping", "payload")
    stop = bad.agg((F.count("*") > 0).alias("stop"))  # one row
    before = state.select(*columns).join(F.broadcast(stop), F.col("stop")).drop("stop")
    return merged.select(*columns).join(F.broadcast(stop), ~F.col("stop")).drop("stop").unionByName(before)


def profile_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(profile, change) of two (profile, digest) tables."""
    both = before.select("profile", F.col("digest").alias("old")).join(after.select("profile", F.col("digest").alias("new")), "profile", "full")
    return both.select("profile", F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "retired").when(F.col("old") == F.col("new"), "kept").otherwise("updated").alias("change"))


def assign_ids(clusters: DataFrame, before: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(cluster, profile): clusters (cluster, record_id) keep the earlier profile most of their members had.

    Larger clusters choose first, then the smaller cluster id: each takes of its earlier profiles, most members first
    and the smaller id among equals, the first that none before it took. Offers and refusals come to the same: every
    cluster asks for its best profile, a profile holds on to who comes first in the order of choice, and who is
    refused, at once or later, asks for its next. What gets none has a new id, unlike any in use or in aliases (old).
    """
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    overlap = clusters.join(before.select("record_id", "profile"), "record_id").groupBy("cluster", "profile").agg(F.count("*").alias("n")).join(size, "cluster")
    choice = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "profile"))
    wishes = cut(overlap.withColumn("choice", choice).select("cluster", "profile", "size", "choice"))
    asked = cut(wishes.select("cluster").distinct().withColumn("choice", F.lit(1)))
    first = F.row_number().over(W.partitionBy("profile").orderBy(F.desc("size"), "cluster"))
    while True:
        offers = wishes.join(asked, ["cluster", "choice"]).withColumn("place", first)
        refused = offers.where("place > 1").select("cluster", F.lit(1).alias("more"))
        if not refused.limit(1).count():
            break
        asked = cut(asked.join(refused, "cluster", "left").select("cluster", (F.col("choice") + F.coalesce("more", F.lit(0))).alias("choice")))
    held = cut(offers.select("cluster", "profile"))
    used = before.select("profile")
    used = used if aliases is None else used.unionByName(aliases.select(F.col("old").alias("profile")))
    used = used.distinct()
    open_, made, n = size.select("cluster").join(held.select("cluster"), "cluster", "left_anti"), held, 0
    while True:  # a digest that is in use is passed over for the next
        tried = open_.select("cluster", F.concat(F.lit("p_"), F.substring(F.sha2(F.concat("cluster", F.lit(f"|{n}")), 256), 1, 20)).alias("profile"))
        made = made.unionByName(tried.join(used, "profile", "left_anti").select("cluster", "profile"))
        open_ = cut(tried.join(used, "profile", "left_semi").select("cluster"))
        n += 1
        if not open_.limit(1).count():
            return made


def new_aliases(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new): each earlier profile that is gone, and where most of its members are now, the smaller id among equals; '' if nowhere."""
    gone = before.join(after.select("profile").distinct(), "profile", "left_anti").select("record_id", F.col("profile").alias("old"))
    votes = gone.join(after.select("record_id", F.col("profile").alias("new")), "record_id", "left").groupBy("old", "new").agg(F.count("new").alias("n"))
    return votes.groupBy("old").agg(F.coalesce(F.min_by("new", F.struct(-F.col("n"), F.col("new"))), F.lit("")).alias("new"))


def merges_and_splits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(profile, event, others): 'merged' with the earlier profiles whose members came in, 'split' with those that members went to."""
    both = before.select("record_id", F.col("profile").alias("was")).join(after.select("record_id", F.col("profile").alias("now")), "record_id", "left")
    moved = both.where("was <> now or now is null")
    merged = moved.where("now is not null").groupBy(F.col("now").alias("profile")).agg(F.sort_array(F.collect_set("was")).alias("others")).withColumn("event", F.lit("merged"))
    kept = after.select(F.col("profile").alias("was")).distinct()
    split = moved.join(kept, "was", "left_semi").groupBy(F.col("was").alias("profile")).agg(F.sort_array(F.collect_set("now")).alias("others")).withColumn("event", F.lit("split"))
    return merged.unionByName(split).select("profile", "event", "others")


def consolidate_queue(proposals: DataFrame) -> DataFrame:
    """(id, outcome) of queued (id, cluster_a, cluster_b, score): moot inside a cluster, else the best of each pair of clusters stays."""
    pair = F.least("cluster_a", "cluster_b"), F.greatest("cluster_a", "cluster_b")
    place = F.row_number().over(W.partitionBy(*pair).orderBy(F.desc("score"), "id"))
    return proposals.withColumn("n", place).select("id", F.when(F.col("cluster_a") == F.col("cluster_b"), "moot").when(F.col("n") == 1, "queued").otherwise("superseded").alias("outcome"))


def breakers(clusters: DataFrame, previous_profiles: int, previous_records: int, largest: int = 25) -> DataFrame:
    """One row: records, clusters, largest cluster, and whether publication must halt.

    It halts for too large a cluster, and for a fifth fewer profiles than before unless there are fewer records too.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    found = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    collapsed = (F.lit(previous_profiles) >= 50) & (F.col("clusters") < 0.8 * previous_profiles) & (F.col("records") >= previous_records)
    return found.withColumn("halt", (F.col("largest") > largest) | collapsed)


def ledger_links(events: DataFrame, tails: DataFrame | None = None, genesis: str = "0" * 64) -> DataFrame:
    """(chain, seq, body, prev, hash): events (chain, seq, body) appended to their chains in order, each hash over the one before.

    ``tails`` (chain, seq, hash) are the ends of chains that exist; new events are numbered on from there. A chain is a
    sequence, so one task writes it, holding its last hash only.
    """
    rows = events.select("chain", "seq", "body", F.lit(None).cast("string").alias("tail"))
    if tails is not None:
        rows = rows.unionByName(tails.select("chain", F.lit(-1).cast(events.schema["seq"].dataType).alias("seq"), F.col("seq").cast("string").alias("body"), F.col("hash").alias("tail")))
    fixed = tails is not None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last, count = object(), genesis, 0
        for b in batches:
            out: list[tuple] = []
            for own, seq, body, tail in zip(*(c.to_pylist() for c in b.columns)):
                if own != chain:
                    chain, last, count = own, genesis, 0
                if tail is not None:
                    last, count = tail, int(body)
                    continue
                count = count + 1 if fixed else seq
                new = hashlib.sha256(f"{last}|{count}|{body}".encode()).hexdigest()
                out.append((own, count, body, last, new))
                last = new
            columns = list(zip(*out)) or [()] * 5
            kinds = [b.schema.field(0).type, b.schema.field(1).type, pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["chain", "seq", "body", "prev", "hash"])

    kind = events.schema
    return _ordered_fold(rows, ["chain"], ["seq"], step, f"chain {kind['chain'].dataType.simpleString()}, seq {kind['seq'].dataType.simpleString()}, body string, prev string, hash string")


def ledger_verify(ledger: DataFrame, genesis: str = "0" * 64) -> DataFrame:
    """(chain, events, first_bad): every row checked by itself against its neighbour."""
    w = W.partitionBy("chain").orderBy("seq")
    before, last = F.coalesce(F.lag("hash").over(w), F.lit(genesis)), F.lag("seq").over(w)
    bad = (F.col("prev") != before) | (F.coalesce(F.col("seq") - last, F.lit(1)) != 1) | (F.col("hash") != F.sha2(F.concat_ws("|", before, F.col("seq").cast("string"), F.col("body")), 256))
    return ledger.withColumn("bad", bad).groupBy("chain").agg(F.count("*").alias("events"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_bad"))


def pairwise_metrics(members: DataFrame) -> DataFrame:
    """precision and recall of pairs from contingency counts (cluster, truth)."""
    pairs = lambda *by: members.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"))
    both, found, true = pairs("cluster", "truth"), pairs("cluster"), pairs("truth")
    one = both.select(F.col("p").alias("hit")).join(found.select(F.col("p").alias("found")), F.lit(True)).join(true.select(F.col("p").alias("real")), F.lit(True))
    return one.select(F.round(F.col("hit") / F.col("found"), 6).alias("precision_"), F.round(F.col("hit") / F.col("real"), 6).alias("recall_"))


def ingest_stats(rows: DataFrame) -> DataFrame:
    """One row of counts over (change, suppressed, identity) of a batch."""
    kept = ~F.col("suppressed")
    return rows.agg(
        F.count("*").alias("seen"), *(F.count_if(kept & (F.col("change") == c)).alias(c) for c in ("new", "changed", "unchanged")),
        F.count_if("suppressed").alias("suppressed"), F.count_if(kept & ~F.col("identity")).alias("no_identity"),
    )


def follow_aliases(aliases: DataFrame) -> DataFrame:
    """(old, profile): where each alias (old, new) ends; '' if the profile is gone, null if the chain runs in a circle.

    Each round doubles the distance followed; after as many rounds as the number
    of aliases has bits, what still leads on is a circle.
    """
    at = cut(aliases.select("old", F.col("new").alias("profile")))
    for _ in range(max(1, at.count().bit_length() + 1)):
        step = at.select(F.col("old").alias("profile"), F.col("profile").alias("next"))
        # a step leads on where the place reached is an alias itself
        if not at.join(step, "profile", "left_semi").limit(1).count():
            return at
        at = cut(at.join(step, "profile", "left").select("old", F.coalesce("next", "profile").alias("profile")))
    on = at.select(F.col("old").alias("profile")).distinct().withColumn("circles", F.lit(True))
    return at.join(on, "profile", "left").select("old", F.when(F.col("circles").isNull(), F.col("profile")).alias("profile"))


def new_conflicts(refused: DataFrame, queued: DataFrame) -> DataFrame:
    """(a, b, reason) of refused unions, one for each sorted pair, whose pair was never queued."""
    pair = refused.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "reason").groupBy("a", "b").agg(F.min("reason").alias("reason"))
    return pair.join(queued.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def add_constraints(held: DataFrame, new: DataFrame) -> DataFrame:
    """(a, b, kind) after new ones (with seq): pairs sorted, once each; the last kind said of a pair stands."""
    pair = lambda df, seq: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", seq.alias("seq"))
    both = pair(held, F.lit(-1).cast("bigint")).unionByName(pair(new, F.col("seq").cast("bigint")))
    return both.groupBy("a", "b").agg(F.max_by("kind", "seq").alias("kind"))


def split_profile(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """(a, b, kind): cannot-links between the chosen records of each profile and the rest of it."""
    marked = members.select("cluster", "record_id").join(chosen.select("record_id").distinct().withColumn("out", F.lit(True)), "record_id", "left")
    out, rest = marked.where("out").select("cluster", F.col("record_id").alias("x")), marked.where("out is null").select("cluster", F.col("record_id").alias("y"))
    return out.join(rest, "cluster").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("cannot_link").alias("kind"))


def erased_records(members: DataFrame, targets: DataFrame) -> DataFrame:
    """(cluster, record_id) of all records of the profiles that hold a target identifier (kind, value)."""
    ids = members.select("cluster", F.explode(_held_identifiers()).alias("i")).select("cluster", "i.*")
    hit = ids.join(targets.select("kind", "value"), ["kind", "value"], "left_semi").select("cluster").distinct()
    return members.join(hit, "cluster", "left_semi").select("cluster", "record_id")


def _held_identifiers(phones: str = "phones"):
    tag = lambda c, kind: F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(tag("email_keys", "email"), tag(phones, "phone"))


def new_suppressions(members: DataFrame, erased: DataFrame) -> DataFrame:
    """(kind, value) to suppress after an erasure: phones only of records without an e-mail, and nothing that others hold too."""
    ids = members.select("record_id", F.explode(_held_identifiers()).alias("i"), F.size("email_keys").alias("n")).select("record_id", "i.*", "n")
    gone = ids.join(erased.select("record_id"), "record_id", "left_semi").where("kind = 'email' or n = 0").select("kind", "value").distinct()
    return gone.join(ids.join(erased.select("record_id"), "record_id", "left_anti"), ["kind", "value"], "left_anti")


def id_stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: profiles before, and those of which most members (of ties the smaller id) still have the same profile."""
    both = before.select("record_id", F.col("profile").alias("was")).join(after.select("record_id", F.col("profile").alias("now")), "record_id")
    votes = both.groupBy("was", "now").agg(F.count("*").alias("n"))
    top = votes.groupBy("was").agg(F.min_by("now", F.struct(-F.col("n"), F.col("now"))).alias("now"))
    return top.agg(F.count("*").alias("profiles"), F.count_if(F.col("was") == F.col("now")).alias("stable"))


def erasure_effects(erased: DataFrame, consent: DataFrame, decisions: DataFrame, constraints: DataFrame, proposals: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table once the erased records (record_id) are out of it, and the aliases of profiles that emptied.

    consent has record_id; decisions, constraints and proposals have a and b; members (record_id, profile).
    Pairs that come with their ends marked (a_gone, b_gone: true where the record is erased) are not looked up again.
    """
    gone = erased.select("record_id").distinct()
    one = lambda df: df.join(gone, "record_id", "left_anti")
    looked_up = lambda df: df.join(gone.withColumnRenamed("record_id", "a"), "a", "left_anti").join(gone.withColumnRenamed("record_id", "b"), "b", "left_anti")
    both = lambda df: df.where("a_gone is not true and b_gone is not true").drop("a_gone", "b_gone") if "a_gone" in df.columns else looked_up(df)
    left = one(members)
    empty = members.select("profile").distinct().join(left.select("profile").distinct(), "profile", "left_anti")
    return {
        "consent": one(consent), "decisions": both(decisions), "constraints": both(constraints), "proposals": both(proposals), "members": left,
        "aliases": empty.select(F.col("profile").alias("old"), F.lit("").alias("new")),
    }


def impure_clusters(members: DataFrame) -> DataFrame:
    """(cluster, people, distinguishable): clusters of several people, and whether birth dates or suffixes would have told."""
    told = (F.countDistinct("dob") > 1) | (F.countDistinct("suffix") > 1)
    return members.groupBy("cluster").agg(F.countDistinct("truth").alias("people"), told.alias("distinguishable")).where("people > 1")


def consent_violations(granted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: clusters counted as granted (cluster, person), and how many of their people's own latest word (person, granted) is a denial."""
    both = granted.select("cluster", "person").join(truth.select("person", F.col("granted").alias("own")), "person", "left")
    each = both.groupBy("cluster").agg(F.bool_or(~F.coalesce("own", F.lit(False))).alias("wrong"))
    return each.agg(F.count("*").alias("granted"), F.count_if("wrong").alias("violations"))


def review(queued: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stewards' verdicts (id, approved, seq) on queued proposals (id, kind, subject) come to.

    Three tables: (id, outcome); new constraints (a, b, kind, seq) from pairs written
    ``a|b``; and (id, source, status) of mappings. A verdict on what is not queued
    has no effect, and the first of several counts, as the proposal is settled then.
    """
    first = verdicts.groupBy("id").agg(F.min_by(F.struct("approved", "seq"), "seq").alias("v"))
    done = queued.join(first, "id").select("id", "kind", "subject", "v.approved", "v.seq")
    outcome = done.select("id", F.when(F.col("approved"), "approved").otherwise("rejected").alias("outcome"))
    x, y = F.split_part("subject", F.lit("|"), F.lit(1)), F.split_part("subject", F.lit("|"), F.lit(2))
    pairs = done.where(F.col("kind").isin("match_adjudication", "cluster_conflict"))
    links = pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(F.col("approved"), "must_link").otherwise("cannot_link").alias("kind"), "seq")
    mappings = done.where("kind = 'schema_mapping'").select("id", F.col("subject").alias("source"), F.when(F.col("approved"), "active").otherwise("rejected").alias("status"))
    return outcome, links, mappings


def activate_mappings(versions: DataFrame, settled: DataFrame) -> DataFrame:
    """(source, version, status, proposal) after ``review``'s mappings: of each source the newest approved version is active, the one active before is superseded."""
    said = versions.join(settled.select(F.col("id").alias("proposal"), F.col("status").alias("said")), "proposal", "left")
    now = said.withColumn("status", F.coalesce("said", "status"))
    newest = now.groupBy("source").agg(F.max(F.when(F.col("status") == "active", F.col("version"))).alias("active"))
    status = F.when((F.col("status") == "active") & (F.col("version") < F.col("active")), "superseded").otherwise(F.col("status"))
    return now.join(newest, "source").select("source", "version", status.alias("status"), "proposal")


def sources_overview(sources: DataFrame, versions: DataFrame) -> DataFrame:
    """sources (source, ...) with the version of their active mapping, null without one."""
    active = versions.where("status = 'active'").select("source", F.col("version").alias("mapping_version"))
    return sources.join(active, "source", "left")


def mapping_accuracy(mapped: DataFrame, expected: DataFrame) -> DataFrame:
    """(source, accuracy): share of expected (source, field, target) that mapped (source, field, target) has.

    A field expected to have no target may be used for anything that does not identify a person.
    """
    identity = ("birth_date", "email", "phone", "first_name", "last_name", "full_name")
    both = expected.join(mapped.select("source", "field", F.col("target").alias("got")), ["source", "field"], "left")
    free = F.col("target").isNull()
    right = F.when(free, ~F.coalesce(F.col("got").isin(*identity), F.lit(False))).otherwise(F.coalesce(F.col("got") == F.col("target"), F.lit(False)))
    return both.groupBy("source").agg(F.round(F.avg(right.cast("double")), 4).alias("accuracy"))


def residual_identifiers(tables: dict[str, DataFrame], words: DataFrame) -> DataFrame:
    """(table, word): erased values (column word) that any text of a table still holds as a whole token, case aside.

    Rows are cut into tokens, each with the punctuation at its ends taken off, and
    meet the words by equality, so the search is a join and not a product.
    """
    wanted = words.select(F.lower("word").alias("word")).distinct()
    out = None
    for name, df in sorted(tables.items()):
        tokens = F.split(F.lower(F.to_json(F.struct("*"))), r'[\s",:{}\[\]|;()<>]+')
        held = df.select(F.explode(tokens).alias("token")).select(F.regexp_replace("token", r"^[.!?']+|[.!?']+$", "").alias("word"))
        hit = held.join(wanted, "word", "left_semi").distinct().select(F.lit(name).alias("table"), "word")
        out = hit if out is None else out.unionByName(hit)
    return out
