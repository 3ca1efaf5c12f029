"""Token-id files compressed by Re-Pair grammars, with random access.

Documents are dealt out by ranges of doc_id, encoded and packed into shards of
about ``SHARD_TOKENS`` ids, whole documents always. In each shard the most
frequent pairs of neighbouring symbols are replaced by new symbols, round after
round until no pair is frequent, each new symbol keeping its two parts and the
length of what it stands for. A file is a row (part, shard, n_docs, n_tokens,
blob) of a Parquet table written by Spark's own committer, so a lost executor
leaves no half file; rows by (part, shard) run in ascending doc_id order.

The tokenizers library encodes whole texts by way of ``units``: each distinct
piece of a chunk goes through the library's own normaliser, splitter and model
once, and words outside the unit tables go through it whole.

A null text encodes as empty and has its end id only; rows with equal doc_id
stand in the order of a hash of their texts; a null doc_id comes first; texts
are read whole at any length; columns other than doc_id and text are left
alone, whatever their names; an empty table writes no shard.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import END, default_path, texts_of
from .common import save, table, width
from .units import ENTRIES, UnitEncoder, table_for

END_ID = 2
SHARD_TOKENS = 1 << 20
RULES_A_ROUND = 4096
LEAST_COUNT = 8
_MAGIC = b"RPGR"
_HEAD = struct.Struct("<4sIIIIII")  # magic, docs, symbols, rules, first new symbol, bytes of a symbol, has null ids


# --- the grammar -----------------------------------------------------------


def _pair_codes(seq: np.ndarray) -> np.ndarray:
    if len(seq) and int(seq.max()) < 1 << 16:
        return (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:].astype(np.uint32)
    return (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:].astype(np.uint64)


def _codes_at(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The codes of the pairs at some places."""
    kind, half = (np.uint32, 16) if int(seq.max()) < 1 << 16 else (np.uint64, 32)
    return (seq[at].astype(kind) << kind(half)) | seq[at + 1].astype(kind)


def _frequent(codes: np.ndarray, most: int = RULES_A_ROUND) -> np.ndarray:
    """The most frequent pairs, most frequent first, ties by code."""
    s = np.sort(codes)
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    counts = np.diff(np.append(at, len(s)))
    enough = np.flatnonzero(counts >= LEAST_COUNT)
    enough = enough[np.lexsort((s[at[enough]], -counts[enough]))[:most]]
    return s[at[enough]]


_SLOTS = 1 << 18


def _rank_of(codes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The rank of each code among pairs, their number for codes that are none of them."""
    none = len(pairs)
    small = codes.dtype == np.uint32
    shift = codes.dtype.type(14 if small else 46)
    # fewer pairs than a round takes: small numbers keep the tables near
    kind = np.int16 if none < 1 << 15 else np.int32
    out = np.full(len(codes), none, kind)
    factor, todo, open_ = 0x9E3779B1 if small else 0x9E3779B97F4A7C15, np.arange(none), None
    while len(todo):  # pairs that share a slot with another are looked up in a further table, by the codes that met the other there
        slot = (pairs[todo] * codes.dtype.type(factor)) >> shift
        _, first = np.unique(slot, return_index=True)
        rank_at = np.full(_SLOTS, none, kind)
        rank_at[slot[first]] = todo[first]
        rank = rank_at[((codes if open_ is None else codes[open_]) * codes.dtype.type(factor)) >> shift]
        near = np.flatnonzero(rank < none)
        rank, near = rank[near], near if open_ is None else open_[near]
        hit = pairs[rank] == codes[near]
        out[near[hit]] = rank[hit]
        open_, todo = near[~hit], np.delete(todo, first)
        factor = factor * 0x2C1B3C6D & (0xFFFFFFFF if small else 0xFFFFFFFFFFFFFFFF) | 1
    return out


def grammar(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules, first): rules[k] holds the two parts of symbol first + k.

    Counts of old pairs only fall, so once a pair is not frequent its places are not looked at again: after the first
    rounds few places are left, those of pairs still frequent and those beside new symbols.
    """
    seq = ids.astype(np.uint32)
    first = int(seq.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    made, few, live = 0, False, None  # places whose pair may be frequent, None for all
    while len(seq) > 1:
        codes = _pair_codes(seq) if live is None else _codes_at(seq, live)
        ranked = _frequent(codes, len(codes) if few else RULES_A_ROUND)
        if not len(ranked):
            break
        rank = _rank_of(codes, ranked)
        often = np.flatnonzero(rank < len(ranked))
        rank, often = rank[often], often if live is None else live[often]  # the frequent pairs' places
        pairs = ranked[:RULES_A_ROUND]
        none = len(pairs)
        now = rank < none
        near, own = often[now], rank[now]
        beside = near[1:] == near[:-1] + 1
        before, after = np.full(len(own), none, own.dtype), np.full(len(own), none, own.dtype)
        np.copyto(before[1:], own[:-1], where=beside)
        np.copyto(after[:-1], own[1:], where=beside)
        chosen = (own <= before) & (own <= after)
        again = before == own
        if again.any():  # in a run of one pair, every second
            place = np.arange(len(near))
            chosen &= ((place - np.maximum.accumulate(np.where(again, 0, place))) & 1) == 0
        at, used_by = near[chosen], own[chosen]
        if not len(at):
            break
        half = np.uint64(32) if codes.dtype == np.uint64 else np.uint32(16)
        low = codes.dtype.type((1 << int(half)) - 1)
        used = np.bincount(used_by, minlength=none) > 0  # pairs that others cover everywhere take no symbol
        pairs = pairs[used]
        rules.append(np.stack([pairs >> half, pairs & low], 1).astype(np.uint32))
        seq[at] = (first + made + (np.cumsum(used) - 1)[used_by]).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        if few:  # places in what stays: pairs still frequent, and each new symbol's with its neighbours
            to = np.cumsum(stay, dtype=np.int32) - 1
            new = to[at]
            mark = np.zeros(len(seq) + 1, bool)
            mark[to[often[stay[often]]]] = True
            mark[new] = True
            mark[new[new > 0] - 1] = True
            live = np.flatnonzero(mark[: len(seq) - len(at) - 1])
        few = few or len(at) < len(seq) >> 3
        seq = seq[stay]
        made += len(pairs)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), first


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each new symbol stands for. Parts come before what is made of them."""
    out = np.ones(len(rules), np.int64)
    done = 0
    while done < len(rules):
        known = (rules < first + done).all(axis=1)
        upto = len(rules) if known[done:].all() else done + int(np.argmin(known[done:]))
        parts = rules[done:upto].astype(np.int64) - first
        out[done:upto] = np.where(parts >= 0, out[np.maximum(parts, 0)], 1).sum(axis=1)
        done = upto
    return out


def rule_expansions(rules: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): what every rule stands for, side by side."""
    starts = np.append(0, np.cumsum(lengths))
    out = np.empty(int(starts[-1]), np.uint32)
    done = 0
    while done < len(rules):
        known = (rules[done:] < first + done).all(axis=1)
        upto = len(rules) if known.all() else done + int(np.argmin(known))
        at = starts[done:upto].copy()
        for side in (0, 1):
            part = rules[done:upto, side].astype(np.int64) - first
            plain = part < 0
            out[at[plain]] = rules[done:upto, side][plain]
            size = np.where(plain, 1, lengths[np.maximum(part, 0)])
            out[_places(at[~plain], size[~plain])] = out[_places(starts[part[~plain]], size[~plain])]
            at += size
        done = upto
    return out, starts


def _places(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... for size[0] places, then the same for the next."""
    upto = np.cumsum(size)
    return np.repeat(at - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    lengths = expansion_lengths(rules, first)
    return _expanded(seq.astype(np.int64), *rule_expansions(rules, lengths, first), lengths, first)


def _expanded(seq: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    made = seq >= first
    rule = np.where(made, seq - first, 0)
    size = np.where(made, lengths[rule], 1) if len(lengths) else np.ones(len(seq), np.int64)
    out = np.empty(int(size.sum()), np.uint32)
    at = np.cumsum(size) - size
    out[at[~made]] = seq[~made]
    out[_places(at[made], size[made])] = ids[_places(starts[rule[made]], size[made])]
    return out


# --- the file --------------------------------------------------------------


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard as bytes: header, document ids and lengths, rules with expansion lengths, symbols."""
    seq, rules, first = grammar(ids)
    kind = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    missing = np.array([d is None for d in doc_ids], bool)
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(seq), len(rules), first, int(kind[-1]), int(missing.any()))
    return b"".join([
        head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(missing).tobytes() if missing.any() else b"",
        lengths.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), expansion_lengths(rules, first).astype("<u4").tobytes(), seq.astype(kind).tobytes(),
    ])


class Shard:
    """A shard opened for reading, whole or at any document."""

    def __init__(self, blob: bytes):
        magic, docs, symbols, rules, self.first, size, missing = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        ids = take("<i8", docs).tolist()
        gone = np.unpackbits(take("u1", -(-docs // 8)))[:docs] if missing else np.zeros(docs, bool)
        self.doc_ids = [None if g else i for i, g in zip(ids, gone)]
        self.lengths = take("<u4", docs).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.expansions = take("<u4", rules).astype(np.int64)
        self.symbols = take(f"<u{size}", symbols).astype(np.uint32)
        self.starts = np.append(0, np.cumsum(self.lengths))
        self._rules = rule_expansions(self.rules, self.expansions, self.first)
        self._ends: np.ndarray | None = None

    @staticmethod
    def documents_of(blob: bytes) -> list[int | None]:
        """The ids of a shard's documents; nothing else of it is read."""
        _, docs, _, _, _, _, missing = _HEAD.unpack_from(blob)
        ids = np.frombuffer(blob, "<i8", docs, _HEAD.size).tolist()
        gone = np.unpackbits(np.frombuffer(blob, "u1", -(-docs // 8), _HEAD.size + 8 * docs))[:docs] if missing else np.zeros(docs, bool)
        return [None if g else i for i, g in zip(ids, gone)]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return _expanded(symbols.astype(np.int64), *self._rules, self.expansions, self.first)

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document: only the symbols that reach into it are expanded."""
        a, b = self.starts[i], self.starts[i + 1]
        if a == b:
            return np.zeros(0, np.uint32)
        if self._ends is None:
            rule = self.symbols.astype(np.int64) - self.first
            self._ends = np.cumsum(np.where(rule >= 0, self.expansions[np.maximum(rule, 0)], 1) if len(self.rules) else np.ones(len(rule), np.int64))
        lo, hi = np.searchsorted(self._ends, a, "right"), np.searchsorted(self._ends, b, "left")
        part = self._expand(self.symbols[lo : hi + 1])
        skip = a - (self._ends[lo - 1] if lo else 0)
        return part[skip : skip + b - a]


# --- on tables -------------------------------------------------------------


class Library:
    """The tokenizers library as an encoder of units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(1 + max(vocabulary.values()), bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith(END)]] = True
        self._units = table_for(entries=4 * ENTRIES)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def units(self, units: list[str], easy: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, side by side, and their numbers: pieces go through the library together, parted by spaces, other words one by one."""
        plain = units if all(easy) else [u for u, e in zip(units, easy) if e]
        ids = self._ids(" ".join(plain))
        ends = np.flatnonzero(self._ends[ids])
        if len(ends) != len(plain):
            raise ValueError("the tokenizer cuts pieces anew")
        sizes = np.diff(ends, prepend=-1)
        if len(plain) == len(units):
            return ids, sizes
        own = iter(np.split(ids, ends[:-1] + 1))
        out = [next(own) if e else self._ids(u) for u, e in zip(units, easy)]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def long(self, blocks: Iterable[str]) -> Iterator[np.ndarray]:
        yield self._ids("".join(blocks))

    def encoder(self) -> UnitEncoder:
        """An encoder of streams of texts; a task's own, over the process's table."""
        return UnitEncoder(self.units, self.long, self.special, table=self._units)


_libraries: dict[str, Library] = {}


def library(path: str) -> Library:
    """This process's library for a vocabulary file, with a table of units of fixed size; it holds no texts."""
    return _libraries.get(path) or _libraries.setdefault(path, Library(path))


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs as shards in the shared folder; gives the table (part, shard, n_docs, n_tokens, blob)."""
    path = path or default_path()
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library(path).encoder()
        part, shard = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []
        held = own = 0

        def full() -> pa.RecordBatch:
            nonlocal ids, names, lengths, held, shard
            blob = pack(names, np.array(lengths, np.int64), np.concatenate(ids))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(lengths)], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())],
                names=["part", "shard", "n_docs", "n_tokens", "blob"],
            )
            ids, names, lengths, held, shard = [], [], [], 0, shard + 1
            return row

        for b in batches:
            name = iter(b.column(0).to_pylist())
            for x, closed in encoder.stream(texts_of(b.column(1))):
                ids.append(x)
                own += len(x)
                if not closed:
                    continue
                ids.append(end)
                names.append(next(name))
                lengths.append(own + 1)
                held, own = held + own + 1, 0
                if held >= shard_tokens:
                    yield full()
        if lengths:
            yield full()

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("_h"))
    ordered = rows.repartitionByRange(2 * width(docs), "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return save(ordered.mapInArrow(run, "part int, shard int, n_docs bigint, n_tokens bigint, blob binary"), "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """(part, shard, doc_id, inner, n_tokens, ids): every document of the files; inner is its place in its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, blob in zip(b.column(0), b.column(1), b.column(2)):
                s = Shard(blob.as_py())
                n = len(s.doc_ids)
                offsets = pa.array(s.starts.astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(s.ids().view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1]), pa.array(s.lengths), ids],
                    names=["part", "shard", "doc_id", "inner", "n_tokens", "ids"],
                )

    return shards.select("part", "shard", "blob").mapInArrow(run, "part int, shard int, doc_id bigint, inner bigint, n_tokens bigint, ids array<int>")


def read_digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, blob in zip(b.column(0), b.column(1), b.column(2)):
                s = Shard(blob.as_py())
                n, data = len(s.doc_ids), memoryview(s.ids().astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(s.starts.tolist(), s.starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1]), pa.array(s.lengths), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "shard", "blob").mapInArrow(run, "part int, shard int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    # ids before a shard: those of earlier parts, then those of earlier shards of its part
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(W.orderBy("part"))), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("n_tokens").over(before(W.partitionBy("part").orderBy("shard"))), F.lit(0))
    bases = shards.select("part", "shard", "n_tokens").withColumn("inside", inside).join(parts, "part")
    bases = bases.select("part", "shard", (F.col("earlier") + F.col("inside")).alias("base"))
    return rows.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def lookup(shards: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents wanted (column doc_id), by random access: of a shard only the symbols that reach into them are expanded.

    The ids wanted meet the shards' own lists of documents in a join first, so a
    shard that holds none of them is never opened by a task.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, blob in zip(b.column(0), b.column(1), b.column(2)):
                names = Shard.documents_of(blob.as_py())
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(names, pa.int64())], names=["part", "shard", "place", "doc_id"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, places in zip(b.column(0), b.column(1)):
                s = Shard(blob.as_py())
                for i in places.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([s.doc_ids[i]], pa.int64()), pa.array([s.document(i).view(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    places = shards.select("part", "shard", "blob").mapInArrow(listed, "part int, shard int, place int, doc_id bigint")
    wanted = places.join(doc_ids.select(F.col("doc_id").cast("bigint")).distinct(), "doc_id", "left_semi").groupBy("part", "shard").agg(F.collect_list("place").alias("places"))  # at most a shard's documents
    return shards.join(wanted, ["part", "shard"]).select("blob", "places").mapInArrow(fetch, "doc_id bigint, ids array<int>")


def op2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Re-Pair shards and read back."""
    return read_digests(write(table(spark, sf_dir, "documents")))
