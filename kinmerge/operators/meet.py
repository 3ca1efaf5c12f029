"""Candidate pairs compared where they meet.

A record travels to each of its blocks, many records together in compressed
columns, and a task compares the pairs of a block as numbers: equal values have
equal numbers, and only distinct pairs of unequal values are held against each
other as text. Neither pairs nor single rows with all their values are shuffled.
A pair is made in the first block its records share, so pairs need not be told
apart afterwards.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler_many
from ..session import cut

#: Blocks' entries that a bucket holds on average, records packed together, and pairs compared at once.
BUCKET_ENTRIES, PACKED, AT_ONCE = 1 << 17, 1 << 17, 1 << 17
#: Pairs of the same statuses at most that travel in one row.
ALIKE = 1 << 12
#: Value pairs of a bucket whose similarity is kept.
KEPT_PAIRS = 1 << 20
STATUSES = ("missing", "agree", "partial", "disagree", "shared", "conflict", "rare", "common")
MISSING, AGREE, PARTIAL, DISAGREE, SHARED, CONFLICT, RARE, COMMON = range(8)
_VALUES = ("fn", "fn_raw", "ln", "suffix", "dob", "postal", "addr", "city")
#: Families of one value each, in the order of their keys, which follow those of email_keys and phones.
SINGLE = {"lp": ("ln", "postal"), "ld": ("ln", "dob"), "fd": ("fn", "dob"), "fp": ("fn", "postal"), "fa": ("fn", "addr")}
_LIVE, _AMBIGUOUS = 2, 1
_RARE, _NA, _NP, _COMPLEX = 32, 64, 128, 256


def _listed(c: str) -> Column:
    return F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))


def _names() -> Column:
    """The names of a row's keys: one for each of email_keys, of phones and of the single families, null where a part is."""
    each = lambda c, t: F.transform(c, lambda v: F.concat(F.lit(t), v))
    return F.concat(each("email_keys", "e:"), each("phones", "p:"), F.array(*(F.concat(F.lit(f + ":"), F.col(x), F.lit("|"), F.col(y)) for f, (x, y) in SINGLE.items())))


def tagged(known: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``known`` with what their comparison asks for, and ``keys``: hashes of the names of the blocks they are compared in.

    Second come the blocks of more than ``most`` records, in which nothing is compared. Rows of one record_id are one record with the blocks of all; what a row itself does not name is in ``more``.
    """
    flags = lambda c, t: F.transform(c, lambda v: F.array_contains("ambiguous", F.concat(F.lit(t), v)))
    ident = lambda t, *parts: F.coalesce(F.array_contains("ambiguous", F.concat(F.lit(t + ":"), *[x for p in parts for x in (F.lit("|"), F.col(p))][1:])), F.lit(False))
    rows = known.withColumns({"email_keys": _listed("email_keys"), "phones": _listed("phones"), "ambiguous": _listed("ambiguous")}).select(
        "record_id", "truth", "email_keys", "phones", flags("email_keys", "e:").alias("e_flags"), flags("phones", "p:").alias("p_flags"), *_VALUES,
        F.coalesce("rare", F.lit(False)).alias("rare"), ident("na", "fn", "ln", "addr").alias("na"), ident("np", "fn", "ln", "postal").alias("np"),
    )
    each = rows.select("record_id", F.array_compact(_names()).alias("names"))
    several = cut(rows.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").select("record_id"))
    wide = each.join(several, "record_id", "left_semi").groupBy("record_id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    one = each.join(several, "record_id", "left_anti").unionByName(wide)
    block = one.select("record_id", F.explode(F.transform("names", lambda n: F.xxhash64(n))).alias("block"))
    large = cut(block.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > most).select("block"), free=True)
    over = block.join(large, "block", "left_semi").groupBy("record_id").agg(F.collect_set("block").alias("over"))
    live = lambda n: F.when(~F.coalesce(F.array_contains("over", F.xxhash64(n)), F.lit(False)), n)
    whole = rows.join(over, "record_id", "left").join(wide.withColumnRenamed("names", "all"), "record_id", "left")
    flat = whole.withColumns({"names": F.transform(_names(), live), "all": F.array_compact(F.transform("all", live))})
    mine = F.array_compact("names")
    several = (F.size("email_keys") > 1) | (F.size("phones") > 1) | F.col("all").isNotNull()
    flat = flat.withColumn("all", F.when(several, F.coalesce("all", mine)))
    bits = sum((F.when(c, F.lit(b)).otherwise(F.lit(0)) for c, b in ((F.col("rare"), _RARE), (F.col("na"), _NA), (F.col("np"), _NP), (several, _COMPLEX))), F.lit(0))
    at = lambda f: F.get("names", F.size("email_keys") + F.size("phones") + f)
    bits = bits + sum((F.when(at(f).isNotNull(), F.lit(1 << f)).otherwise(F.lit(0)) for f in range(len(SINGLE))), F.lit(0))
    marks = lambda c, start: F.transform(c, lambda a, i: (F.when(a, F.lit(_AMBIGUOUS)).otherwise(F.lit(0)) + F.when(F.get("names", i + start).isNotNull(), F.lit(_LIVE)).otherwise(F.lit(0))).cast("tinyint"))
    hashes = F.transform("names", lambda n: F.when(n.isNotNull(), F.xxhash64(n)))
    more = F.transform(F.array_except("all", mine), lambda n: F.xxhash64(n))
    named = F.transform("all", lambda n: F.struct(n.alias("name"), F.xxhash64(n).alias("block")))
    rows = flat.select(
        "record_id", "truth", "email_keys", "phones", marks("e_flags", F.lit(0)).alias("e_flags"), marks("p_flags", F.size("email_keys")).alias("p_flags"), *_VALUES,
        bits.cast("int").alias("bits"), named.alias("all"), hashes.alias("keys"), more.alias("more"),
    )
    return rows, large


def _packed(buckets: int):
    def blobs(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        rows = rows.combine_chunks()
        places, blocks, family = [], [], []
        emails, phones = (pc.list_value_length(rows["email_keys"]).to_numpy(), pc.list_value_length(rows["phones"]).to_numpy())
        for c in ("keys", "more"):
            lists = rows[c].combine_chunks()
            parent, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            start = np.searchsorted(parent, np.arange(len(rows)))
            at = np.arange(len(parent)) - start[parent] if len(parent) else np.zeros(0, np.int64)
            e, p = emails[parent], phones[parent]
            kind = np.where(at < e, 0, np.where(at < e + p, 1, at - e - p + 2)) if c == "keys" else np.full(len(parent), 7)
            places.append(parent[there])
            blocks.append(flat.drop_null().to_numpy())
            family.append(kind[there])
        place, block, kind = np.concatenate(places), np.concatenate(blocks).astype(np.int64), np.concatenate(family).astype(np.int8)
        bucket = (block.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((place, block, bucket))
        place, block, kind, bucket = place[order], block[order], kind[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(bucket)] if len(bucket) else []
        rows = rows.drop_columns(["keys", "more"])
        for a, z in zip(cuts, cuts[1:]):
            part = rows.take(pa.array(place[a:z])).append_column("block", pa.array(block[a:z])).append_column("family", pa.array(kind[a:z]))
            out = io.BytesIO()
            pq.write_table(part, out, compression="zstd", write_statistics=False, store_schema=False)
            yield int(bucket[a]), out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for bucket, blob in blobs(pa.Table.from_batches(held)):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACKED:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    return run


class _Bucket:
    """The entries of a bucket, in the order of their blocks, values as numbers in the order of the values."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows["block"])).combine_chunks()
        self.seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.block, self.family, self.bits = (rows[c].to_numpy() for c in ("block", "family", "bits"))
        self.truth, self.all = rows["truth"], rows["all"]
        self.ids, self.code = {}, {}
        for c in ("record_id", *_VALUES):
            self.code[c], self.ids[c] = numbered(rows[c].combine_chunks())
        for c, flags in (("email_keys", "e_flags"), ("phones", "p_flags")):
            lists = rows[c].combine_chunks()
            parent, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
            at = np.arange(len(parent)) - np.searchsorted(parent, np.arange(len(rows)))[parent] if len(parent) else np.zeros(0, np.int64)
            slots = max(1, int(at.max(initial=0)) + 1)
            number, self.ids[c] = numbered(flat)
            self.code[c], self.code[flags] = np.full((len(rows), slots), -1, np.int32), np.zeros((len(rows), slots), np.int8)
            self.code[c][parent, at] = number
            self.code[flags][parent, at] = pc.list_flatten(rows[flags].combine_chunks()).to_numpy()

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of entries of one block and of different records, the lesser record first."""
        n, held, count = len(self.block), [], 0
        first = np.flatnonzero(np.append(True, self.block[1:] != self.block[:-1]))
        left = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n))) - np.arange(n) - 1  # entries after this one in its block
        i, k = np.arange(n), 0
        record = self.code["record_id"]
        while True:
            k += 1
            i = i[left[i] >= k]
            if not len(i):
                break
            for at in range(0, len(i), AT_ONCE):
                x = i[at : at + AT_ONCE]
                y = x + k
                r, s = record[x], record[y]
                apart = r != s
                held.append((np.where(r < s, x, y)[apart], np.where(r < s, y, x)[apart]))
                count += int(apart.sum())
                if count >= AT_ONCE:
                    yield tuple(np.concatenate(v) for v in zip(*held))
                    held, count = [], 0
        if count:
            yield tuple(np.concatenate(v) for v in zip(*held))

    def first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether a pair shares no block before the one it is in."""
        bits, family = self.bits[x], self.family[x]
        same = {c: self.code[c][x] == self.code[c][y] for c in ("fn", "ln", "dob", "postal", "addr")}
        earlier, out = np.zeros(len(x), bool), np.zeros(len(x), bool)
        shared = [(self.code[c][x, 0] == self.code[c][y, 0]) & (self.code[f][x, 0] & _LIVE > 0) for c, f in (("email_keys", "e_flags"), ("phones", "p_flags"))]
        shared += [same[p] & same[q] & (bits & (1 << k) > 0) for k, (p, q) in enumerate(SINGLE.values())]
        for k, met in enumerate(shared):
            out |= (family == k) & met & ~earlier
            earlier |= met
        for k in np.flatnonzero((bits | self.bits[y]) & _COMPLEX).tolist():
            i, j = int(x[k]), int(y[k])
            mine, theirs = self._names(i), self._names(j)
            least = min(mine.keys() & theirs.keys(), default=None)
            out[k] = least is not None and self.block[i] in (mine[least], theirs[least])
        return out

    def _names(self, i: int) -> dict[str, int | None]:
        """The names of all blocks of an entry's record, with their hashes where a record has more than a key of each family."""
        if (every := self.all[i].as_py()) is not None:
            return {n["name"]: n["block"] for n in every}
        value = lambda c: self.ids[c][self.code[c][i]]
        out = [t + self.ids[c][self.code[c][i, 0]] for c, f, t in (("email_keys", "e_flags", "e:"), ("phones", "p_flags", "p:")) if self.code[f][i, 0] & _LIVE]
        out += [f"{f}:{value(p)}|{value(q)}" for k, (f, (p, q)) in enumerate(SINGLE.items()) if self.bits[i] & (1 << k)]
        return dict.fromkeys(out)

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries by block, alike ones together, and each entry's place in its block by that order."""
        alike = [self.code[c] for c in ("addr", "suffix", "city", "dob", "fn_raw", "ln")] + [self.code[c][:, 0] for c in ("phones", "email_keys")]
        order = np.lexsort((self.code["record_id"], *alike, self.block))
        first = np.flatnonzero(np.append(True, self.block[1:] != self.block[:-1]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        return order, rank

    def near(self, c: str, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
        """Whether values that are there and unequal are so alike."""
        a, b = self.code[c][x], self.code[c][y]
        out = np.zeros(len(x), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0) & (a != b))
        if not len(at):
            return out
        n = len(self.ids[c])
        both, back = np.unique(a[at].astype(np.int64) * n + b[at], return_inverse=True)
        known, value = self.seen.get(c, (np.zeros(0, np.int64), np.zeros(0)))
        place = np.minimum(np.searchsorted(known, both), len(known) - 1)
        have = known[place] == both if len(known) else np.zeros(len(both), bool)
        got = np.empty(len(both))
        got[have] = value[place[have]]
        if not have.all():
            new = both[~have]
            got[~have] = jaro_winkler_many(self.ids[c], new // n, new % n)
            if len(known) + len(new) > KEPT_PAIRS:
                known, value = known[:0], value[:0]
            keys, values = np.concatenate([known, new]), np.concatenate([value, got[~have]])
            order = np.argsort(keys)
            self.seen[c] = keys[order], values[order]
        out[at] = (got >= least)[back]
        return out

    def _empty(self, c: str) -> np.ndarray:
        return np.array([not v for v in self.ids[c]] + [True])

    def _contact(self, c: str, flags: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b, mark = self.code[c][x], self.code[c][y], self.code[flags][x]
        common, clear = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for i in range(a.shape[1]):
            for j in range(b.shape[1]):
                same = (a[:, i] == b[:, j]) & (a[:, i] >= 0)
                common |= same
                clear |= same & (mark[:, i] & _AMBIGUOUS == 0)
        missing = (a[:, 0] < 0) | (b[:, 0] < 0)
        return np.select([missing, ~common, clear], [MISSING, DISAGREE, AGREE], SHARED)

    def statuses(self, x: np.ndarray, y: np.ndarray, partial: dict[str, float]) -> np.ndarray:
        """A number with three bits for each field's status."""
        v = lambda c: (self.code[c][x], self.code[c][y])
        there = {c: (v(c)[0] >= 0) & (v(c)[1] >= 0) for c in _VALUES}
        same = {c: there[c] & (v(c)[0] == v(c)[1]) for c in _VALUES}
        bits = self.bits[x]
        raw = same["fn_raw"] & ~self._empty("fn_raw")[self.code["fn_raw"][x]]
        s = [self._contact("email_keys", "e_flags", x, y), self._contact("phones", "p_flags", x, y)]
        s.append(np.select([~there["fn"], same["fn"], self.near("fn", x, y, partial["fn"]) | raw | self.near("fn_raw", x, y, partial["fn"])], [MISSING, AGREE, PARTIAL], DISAGREE))
        s.append(np.select([~there["ln"], same["ln"], self.near("ln", x, y, partial["ln"])], [MISSING, AGREE, PARTIAL], DISAGREE))
        s.append(np.select([~there["dob"], same["dob"]], [MISSING, AGREE], CONFLICT))
        one = (self.code["suffix"][x] >= 0) | (self.code["suffix"][y] >= 0)
        s.append(np.select([same["suffix"], there["suffix"], one], [AGREE, CONFLICT, PARTIAL], MISSING))
        s.append(np.select([~there["addr"], same["addr"] & (bits & _NA > 0), same["addr"], self.near("addr", x, y, partial["addr"])], [MISSING, SHARED, AGREE, PARTIAL], DISAGREE))
        s.append(np.select([~there["postal"], same["postal"] & (bits & _NP > 0), same["postal"]], [MISSING, SHARED, AGREE], DISAGREE))
        s.append(np.select([~there["city"], same["city"]], [MISSING, AGREE], DISAGREE))
        s.append(np.select([~(same["fn"] & same["ln"]), bits & _RARE > 0], [MISSING, RARE], COMMON))
        code = np.zeros(len(x), np.int32)
        for k, status in enumerate(s):
            code |= status.astype(np.int32) << (3 * k)
        return code


def numbered(values: pa.Array) -> tuple[np.ndarray, list]:
    """Each value's place among the distinct ones in order, -1 for null, and those."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order) + 1, np.int32)
    rank[order.to_numpy()] = np.arange(len(order))
    rank[-1] = -1
    return rank[pc.fill_null(coded.indices, len(order)).to_numpy()], coded.dictionary.take(order).to_pylist()


def _alike(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal codes together, and where rows of at most ALIKE of them begin in it."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    new = np.append(True, code[1:] != code[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
    return order, np.flatnonzero(new | ((np.arange(len(code)) - start) % ALIKE == 0))


def _lists(cuts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(cuts, len(values)), pa.int32()), values)


def _by_bucket(bucket: Callable[[int, pa.Table | None, list[dict]], Iterator[pa.RecordBatch]]):
    """Calls ``bucket`` with the number, the records and the other rows of each bucket of (bucket, blob, ...)."""

    def done(at: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        records = [pq.read_table(pa.BufferReader(r["blob"])) for r in held if r["blob"] is not None]
        yield from bucket(at, pa.concat_tables(records) if records else None, [r for r in held if r["blob"] is None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] != at and held:
                    yield from done(at, held)
                    held = []
                at = row["bucket"]
                held.append(row)
        if held:
            yield from done(at, held)

    return run


def _compared(partial: dict[str, float]):
    def bucket(_: int, rows: pa.Table, __: list[dict]) -> Iterator[pa.RecordBatch]:
        own = _Bucket(rows)
        ids, record, truth = pa.array(own.ids["record_id"], pa.string()), own.code["record_id"], own.truth.combine_chunks()
        for x, y in own.pairs():
            first = own.first(x, y)
            x, y = x[first], y[first]
            if not len(x):
                continue
            code = own.statuses(x, y, partial)
            order, cuts = _alike(code)
            x, y, code = x[order], y[order], code[order]
            sides = [ids.take(pa.array(record[x])), ids.take(pa.array(record[y])), truth.take(pa.array(x)), truth.take(pa.array(y))]
            pairs = pa.StructArray.from_arrays(sides, names=["a", "b", "a_truth", "b_truth"])
            yield pa.RecordBatch.from_arrays([pa.array(code[cuts]), _lists(cuts, pairs)], names=["statuses", "pairs"])

    return _by_bucket(bucket)


class Records:
    """Records tagged once, to be compared as often as is asked for. Buckets are a power of two, so that an earlier run's can be dealt out among more."""

    def __init__(self, known: DataFrame, most: int):
        rows, self.large = tagged(known, most)
        self.rows = cut(rows, free=True)
        self.kind = known.schema["truth"].dataType.simpleString()
        self.buckets = 1 << (max(1, -(-self.rows.count() * (len(SINGLE) + 2) // BUCKET_ENTRIES)) - 1).bit_length()

    def packed(self, buckets: int) -> DataFrame:
        return self.rows.mapInArrow(_packed(buckets), "bucket bigint, blob binary")


def _dealt(packed: DataFrame, buckets: int) -> DataFrame:
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def _told(met: DataFrame, names: tuple[str, ...], told: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """met with the number ``statuses`` spelt out, and what ``told`` makes of that."""
    status = F.array(*(F.lit(s) for s in STATUSES))
    # a column that counts as not repeatable keeps the optimizer from writing these expressions into every test above them, which no longer compiles
    zero = (F.monotonically_increasing_id() * 0).cast("int")
    at = [F.shiftright("statuses", 3 * k).bitwiseAND(7) for k in range(len(names))]
    rows = met.select(*(c for c in met.columns if c != "statuses"), *(F.get(status, i + zero if n == names[0] else i).alias(n) for i, n in zip(at, names)))
    return rows if told is None else told(rows)


# --- pairs' decisions kept by bucket, a place for each pair of a block's records ---------------------------

_PLACED = "bucket bigint, statuses int, at array<int>, blocks binary, sizes binary, records binary"
_KEPT = "bucket bigint, blocks binary, sizes binary, records binary, codes binary, score array<double>, band array<string>, decision array<string>"
_AGAIN = "statuses int, _score double, _band string, _decision string, fate string, pairs array<struct<a:string,b:string>>"


def _squeezed(x: np.ndarray) -> bytes:
    """x in planes of bytes, compressed, after its length in bytes."""
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _whole(blob: bytes, kind: type) -> np.ndarray:
    data = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _texts(values: pa.Array) -> bytes:
    out = io.BytesIO()
    pq.write_table(pa.table({"v": values}), out, compression="zstd", use_dictionary=False, write_statistics=False)
    return out.getvalue()


def _bases(sizes: np.ndarray) -> np.ndarray:
    """Where the places of each block's pairs begin, and their number."""
    return np.append(0, np.cumsum(sizes * (sizes - 1) // 2))


def _place(n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The place of a pair of ranks among the pairs of n records."""
    i, j = np.minimum(i, j), np.maximum(i, j)
    return i * n - i * (i + 1) // 2 + j - i - 1


def _placed(partial: dict[str, float]):
    """Pairs alike in their statuses by their places; then the bucket's blocks and their records, by rank."""

    def bucket(at: int, rows: pa.Table, _: list[dict]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in _PLACED.split(", ")]
        own = _Bucket(rows)
        order, rank = own.ranks()
        blocks, number, sizes = np.unique(own.block, return_inverse=True, return_counts=True)
        base = _bases(sizes)
        for x, y in own.pairs():
            first = own.first(x, y)
            x, y = x[first], y[first]
            if not len(x):
                continue
            code = own.statuses(x, y, partial)
            k = number[x]
            place = base[k] + _place(sizes[k], rank[x], rank[y])
            by, cuts = _alike(code)
            columns = [pa.array(np.full(len(cuts), at)), pa.array(code[by][cuts]), _lists(cuts, pa.array(place[by], pa.int32())), *(pa.nulls(len(cuts), pa.binary()) for _ in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        ids = pa.array(own.ids["record_id"], pa.string()).take(pa.array(own.code["record_id"][order]))
        row = [at, None, None, _squeezed(blocks), _squeezed(sizes), _texts(ids)]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return _by_bucket(bucket)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of decisions for each bucket of (*_PLACED, score, band, decision): a number for each place, 0 where no pair was decided."""
    kinds = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.string())]
    said: dict[tuple, int] = {}
    held: list[tuple[np.ndarray, int]] = []
    for b in batches:
        at = b.column("at")
        places, cuts = pc.list_flatten(at).to_numpy(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(at), 0).to_numpy()))
        rows = b.drop_columns(["at"]).to_pylist()
        for row, a, z in zip(rows, cuts, cuts[1:]):
            if row["records"] is None:
                held.append((places[a:z], said.setdefault((row["score"], row["band"], row["decision"]), len(said) + 1)))
                continue
            codes = np.zeros(int(_bases(_whole(row["sizes"], np.int64))[-1]), np.uint16 if len(said) > 255 else np.uint8)
            if len(said) > 65535:
                raise ValueError("more kinds of decisions than two bytes tell apart")
            for place, code in held:
                codes[place] = code
            out = [row["bucket"], row["blocks"], row["sizes"], row["records"], bytes([codes.itemsize]) + _squeezed(codes), *(list(c) for c in (zip(*said) if said else ((), (), ())))]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds)], names=[c.split()[0] for c in _KEPT.split(", ")])
            said, held = {}, []


class _Earlier:
    """What was kept of the blocks of a bucket."""

    def __init__(self, rows: list[dict], bucket: int, buckets: int):
        blocks, sizes, records, codes, self.said = [], [], [], [], [None]
        for row in rows:
            block, size, ids = _whole(row["blocks"], np.int64), _whole(row["sizes"], np.int64), pq.read_table(pa.BufferReader(row["records"]))["v"].combine_chunks()
            code = _whole(row["codes"][1:], (np.uint8, np.uint16)[row["codes"][0] - 1]).astype(np.int64)
            mine = block.view(np.uint64) % np.uint64(buckets) == bucket  # there may be more buckets by now
            code[code > 0] += len(self.said) - 1
            self.said += zip(row["score"], row["band"], row["decision"])
            blocks.append(block[mine])
            sizes.append(size[mine])
            records.append(ids.filter(pa.array(np.repeat(mine, size))))
            codes.append(code[np.repeat(mine, size * (size - 1) // 2)])
        if len(rows) > 1:
            raise ValueError("a bucket was kept twice")
        none = np.zeros(0, np.int64)
        self.block, self.size, self.record, self.code = (v[0] if rows else empty for v, empty in ((blocks, none), (sizes, none), (records, pa.array([], pa.string())), (codes, none)))
        self.base = _bases(self.size)
        self.used = np.zeros(len(self.code), bool)

    def match(self, own: _Bucket) -> tuple[np.ndarray, np.ndarray]:
        """The kept block and rank of each entry, -1 where it was in no such block."""
        n = len(own.ids["record_id"]) + 1
        number = pc.fill_null(pc.index_in(self.record, pa.array(own.ids["record_id"], pa.string())), n - 1).to_numpy().astype(np.int64)
        start = np.append(0, np.cumsum(self.size))
        rank = np.arange(len(number)) - np.repeat(start[:-1], self.size)
        key = np.repeat(np.arange(len(self.size)), self.size) * n + number
        order = np.argsort(key)
        block = np.searchsorted(self.block, own.block)
        there = block < len(self.block)
        there[there] = self.block[block[there]] == own.block[there]
        wanted = block * n + own.code["record_id"]
        at = np.searchsorted(key[order], wanted)
        there &= at < len(key)
        there[there] = key[order][at[there]] == wanted[there]
        out = np.full(len(wanted), -1)
        out[there] = rank[order][at[there]]
        return np.where(there, block, -1), out

    def unused(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a's record, b's record, code) of kept pairs that no pair was held against."""
        place = np.flatnonzero((self.code > 0) & ~self.used)
        k = np.searchsorted(self.base, place, "right") - 1
        n, t = self.size[k], place - self.base[k]
        i = np.floor((2 * n - 1 - np.sqrt((2 * n - 1.0) ** 2 - 8 * t)) / 2).astype(np.int64)
        i -= i * n - i * (i + 1) // 2 > t
        i += (i + 1) * n - (i + 1) * (i + 2) // 2 <= t
        j = t - (i * n - i * (i + 1) // 2) + i + 1
        start = np.append(0, np.cumsum(self.size))[k]
        return start + i, start + j, self.code[place]


def _again(partial: dict[str, float], buckets: int, orphans: bool):
    """Pairs with what was kept of them; those whose evidence is not what it was are compared.

    With ``orphans`` also kept pairs that do not meet here, and as lost those of the old evidence of which nothing was kept here.
    """

    def told(x, y, code, statuses, said, fate, ids) -> pa.RecordBatch:
        by, cuts = _alike(code)
        pairs = pa.StructArray.from_arrays([ids.take(pa.array(x[by])), ids.take(pa.array(y[by]))], names=["a", "b"])
        own = [said[c] if said else None for c in code[by][cuts].tolist()]
        cols = [pa.array([s and s[k] for s in own], t) for k, t in enumerate((pa.float64(), pa.string(), pa.string()))]
        arrays = [pa.array(statuses[by][cuts], pa.int32()) if statuses is not None else pa.nulls(len(cuts), pa.int32()), *cols, pa.array([fate] * len(cuts)), _lists(cuts, pairs)]
        return pa.RecordBatch.from_arrays(arrays, names=["statuses", "_score", "_band", "_decision", "fate", "pairs"])

    def bucket(at: int, rows: pa.Table | None, more: list[dict]) -> Iterator[pa.RecordBatch]:
        was = _Earlier([r for r in more if r["marks"] is None], at, buckets)
        if rows is not None:
            own = _Bucket(rows)
            ids, record = pa.array(own.ids["record_id"], pa.string()), own.code["record_id"]
            block, rank = was.match(own)
            same, moved = np.full(len(own.ids["record_id"]), 2), {}
            for r in more:
                if r["marks"] is not None:
                    marks = pq.read_table(pa.BufferReader(r["marks"]))
                    number = pc.index_in(marks["record_id"], ids).to_pylist()
                    same[number] = marks["same"].to_numpy()
                    moved |= {n: set(m) for n, m in zip(number, marks["moved"].to_pylist()) if m}
            some = np.isin(np.arange(len(same)), list(moved))[record]
            same = same[record]
            for x, y in own.pairs():
                first = own.first(x, y)
                x, y = x[first], y[first]
                old = (same[x] == 2) & (same[y] >= 1)  # rarity is told by the lesser record's name
                for k in np.flatnonzero(old & some[x] & some[y]).tolist():
                    old[k] = moved[int(record[x[k]])].isdisjoint(moved[int(record[y[k]])])
                here = np.flatnonzero(old & (rank[x] >= 0) & (rank[y] >= 0))
                k = block[x[here]]
                place = was.base[k] + _place(was.size[k], rank[x[here]], rank[y[here]])
                code = np.zeros(len(x), np.int64)
                code[here] = was.code[place]
                was.used[place] = True
                found = code > 0
                if found.any():
                    yield told(record[x[found]], record[y[found]], code[found], None, was.said, "kept", ids)
                for fate, which in (("lost", ~found & old), ("new", ~found & ~old)):
                    if which.any():
                        i, j = x[which], y[which]
                        statuses = own.statuses(i, j, partial)
                        yield told(record[i], record[j], statuses, statuses, None, fate, ids)
        if orphans and len(was.code):
            a, b, code = was.unused()
            for k in range(0, len(a), AT_ONCE):
                left, right = was.record.take(pa.array(a[k : k + AT_ONCE])), was.record.take(pa.array(b[k : k + AT_ONCE]))
                less = pc.less(left, right)
                names = pa.concat_arrays([pc.if_else(less, left, right), pc.if_else(less, right, left)])
                n = len(left)
                yield told(np.arange(n), np.arange(n, 2 * n), code[k : k + AT_ONCE], None, was.said, "orphan", names)

    return _by_bucket(bucket)


def keep(of: Records, partial: dict[str, float], names: tuple[str, ...], told: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Decisions on all pairs of records that meet, a row for each bucket; ``told`` makes score, band and decision of statuses, many pairs at a time."""
    placed = _dealt(of.packed(of.buckets), of.buckets).mapInArrow(_placed(partial), _PLACED)
    rows = _told(placed, names, told).select(*(c.split()[0] for c in _PLACED.split(", ") if not c.startswith("statuses")), "score", "band", "decision")
    return rows.mapInArrow(_kept, _KEPT)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, marks): rows (bucket, record_id, same, moved) together in compressed columns, as many at once as fit PACKED."""
    held, n = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by("bucket").combine_chunks()
        at = rows["bucket"].to_numpy()
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist() + [len(at)]
        for a, z in zip(cuts, cuts[1:]):
            blob = io.BytesIO()
            pq.write_table(rows.slice(a, z - a).drop_columns(["bucket"]), blob, compression="zstd", write_statistics=False, store_schema=False)
            yield pa.RecordBatch.from_arrays([pa.array([at[a]], pa.int64()), pa.array([blob.getvalue()], pa.binary())], names=["bucket", "marks"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= PACKED:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def again(of: Records, marks: DataFrame, kept: DataFrame, kept_buckets: int, moved_blocks: bool, partial: dict[str, float], names: tuple[str, ...], told: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(pairs, _score, _band, _decision, what ``told`` makes of statuses) of all pairs that meet; the kept ones have a _decision.

    ``marks`` (record_id, same, moved) names the records whose evidence is not what it was: same is 2 where keys and rarity are, 1 where keys are,
    else 0; moved lists the identifiers that have become ambiguous or ceased to be. They travel to their records' blocks, as kept rows do. A pair
    whose first common block is another than it was, as one has outgrown the limit or fallen below it, is looked up by its records; nothing of
    the kind can be where no block did (``moved_blocks``).
    """
    buckets = max(of.buckets, kept_buckets)
    of_kept = kept.withColumn("bucket", F.explode(F.sequence("bucket", F.lit(buckets - 1).cast("bigint"), F.lit(kept_buckets).cast("bigint"))))
    # the number of buckets is a power of two, so these bits are the remainder
    block = F.explode(F.array_distinct(F.transform(F.array_compact(F.concat("keys", "more")), lambda k: k.bitwiseAND(F.lit(buckets - 1).cast("bigint")))))
    places = of.rows.select("record_id", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys"), F.coalesce("more", F.array().cast("array<bigint>")).alias("more"))
    of_marks = places.join(marks, "record_id").select(block.alias("bucket"), "record_id", "same", "moved").distinct().mapInArrow(_marks, "bucket bigint, marks binary")
    both = of.packed(buckets).unionByName(of_kept, allowMissingColumns=True).unionByName(of_marks, allowMissingColumns=True)
    met = _dealt(both, buckets).mapInArrow(_again(partial, buckets, moved_blocks), _AGAIN)
    if moved_blocks:
        every = cut(met, free=True)
        orphans = every.where("fate = 'orphan'").select(F.inline("pairs"), *(F.col(c).alias("o" + c) for c in ("_score", "_band", "_decision")))
        lost = every.where("fate = 'lost'").select("statuses", F.inline("pairs")).join(orphans, ["a", "b"], "left")
        lost = lost.select("statuses", *(F.col("o" + c).alias(c) for c in ("_score", "_band", "_decision")), F.array(F.struct("a", "b")).alias("pairs"))
        met = every.where("fate in ('kept', 'new')").drop("fate").unionByName(lost)
    return _told(met, names, told)


def compared(known: DataFrame, most: int, partial: dict[str, float], names: tuple[str, ...], told: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b, a_truth, b_truth, a status for each of names), a < b, of records that share a block of at most ``most`` records.

    ``known`` comes from ``matching.with_context``; partial has the least similarity at which fn, ln and addr are partly the same.
    What ``told`` adds to or leaves of the statuses is worked out once for pairs that are alike in all of them, and what it
    drops is never made a pair of; it keeps the column ``pairs``.
    """
    of = Records(known, most)
    met = _dealt(of.packed(of.buckets), of.buckets).mapInArrow(_compared(partial), f"statuses int, pairs array<struct<a:string,b:string,a_truth:{of.kind},b_truth:{of.kind}>>")
    rows = _told(met, names, told)
    return rows.select(F.inline("pairs"), *(c for c in rows.columns if c != "pairs"))
