"""A Katz backoff language model: Good-Turing discounts, exact backoff weights, recursive scoring.

The corpus is cut into chunks of whole texts, each saved with its distinct word
hashes. For every order a chunk sends its distinct n-grams, as sorted 63-bit
keys, to buckets by key range, one row a bucket: rows are chunks times buckets,
a chunk's n-grams over ``BUCKET_TOKENS`` at the least, and never more than the
n-grams themselves. A bucket adds up the counts of all chunks, keeps
them as a part of the model table, and answers each chunk with the totals of
the n-grams it sent, in the same order; one chunk is named owner of each n-gram
and adds it to its context's sums, from which the backoff weights follow:

    alpha(h) = (1 - sum p*(w|h)) / (1 - sum p(w|h'))   over the w seen after h

where h' is h without its first word. A token's probability is p*(w|h) if h w
was seen, else alpha(h) p(w|h'), with alpha 1 for an unseen h; the last resort
is the smoothed word probability (c + 0.1) / (N + 0.1 (V + 1)), which keeps a
share for words never seen, so that each distribution sums to one. Discounts
are Good-Turing's for small counts and, from the line fitted to the counts of
counts, for all others: every seen context leaves mass to the unseen.

Words and n-grams are told apart by 64 and 63-bit hashes. Texts are read whole;
a null text is empty and has its end only; a null doc_id counts as training;
equal rows count as often as they stand; with nothing to learn from, every text
scores zero. Columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, id_remainder, remove, save, table
from .text import as_bytes, mix, slices, spans, word_hashes

ORDER = 2
CHUNK_TOKENS = 1 << 20
BUCKET_TOKENS = 1 << 18
ADDED = 0.1
_U = np.uint64
_END = _U(0x5851F42D4C957F2D)
_STEP = _U(0xC2B2AE3D27D4EB4F)
_EVEN = _U(0xFFFFFFFFFFFFFFFE)


# --- packed arrays: planes of bytes compress well --------------------------

_LENGTH = struct.Struct("<Q")


def _squeezed(data: bytes) -> bytes:
    """data with its length, by a codec that codes symbols by their frequency, as that of Spark's shuffles does not."""
    return _LENGTH.pack(len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def _whole(blob: bytes) -> bytes:
    return pa.decompress(blob[_LENGTH.size :], _LENGTH.unpack_from(blob)[0], codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    return _squeezed(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unplaned(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_whole(blob), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _bits(x: np.ndarray) -> bytes:
    """True and false, a bit each, after their number."""
    return _LENGTH.pack(len(x)) + np.packbits(x).tobytes()


def _unbits(blob: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8, offset=_LENGTH.size), count=_LENGTH.unpack_from(blob)[0]).astype(bool)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=_U(0)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(blob, np.uint64), dtype=np.uint64)


# --- chunks ----------------------------------------------------------------

_CHUNK = "chunk bigint, doc_ids array<bigint>, held array<boolean>, lengths array<int>, words binary, places binary, n_tokens bigint"


def _chunks(docs: DataFrame) -> DataFrame:
    """Whole texts, about ``CHUNK_TOKENS`` tokens a row: distinct word hashes by frequency, and each word's place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list = []
        hashes: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        tokens = 0

        def full() -> pa.RecordBatch:
            nonlocal ids, held, hashes, lengths, tokens, n
            words, place, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            by = np.argsort(-count, kind="stable")
            new = np.empty(len(by), np.uint32)
            new[by] = np.arange(len(by), dtype=np.uint32)
            row = [[(part << 32) + n], [ids], [held], [np.concatenate(lengths)], [words[by].tobytes()], [_planes(new[place])], [tokens]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
            ids, held, hashes, lengths, tokens, n = [], [], [], [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _CHUNK.split(", ")])

        for b in batches:
            names, out = b.column(0).to_pylist(), b.column(1).to_pylist()
            data, offsets = as_bytes(b.column(2))
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1]
                part_data = data[own[0] : own[-1]]
                starts, ends, first = spans(part_data, own - own[0])
                hashes.append(word_hashes(part_data, starts, ends))
                lengths.append(np.diff(first).astype(np.int32))
                ids += names[lo:hi]
                held += out[lo:hi]
                tokens += len(starts) + hi - lo
                if tokens >= CHUNK_TOKENS:
                    yield full()
        if ids:
            yield full()

    held = F.coalesce(id_remainder("doc_id", 10) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("bigint"), held.alias("held"), "text").mapInArrow(run, _CHUNK)


class _Tokens:
    """A chunk unpacked: its tokens, texts in order, each closed by an end."""

    def __init__(self, row: dict, order: int):
        lengths = np.asarray(row["lengths"], np.int64)
        words = np.frombuffer(row["words"], np.uint64)
        ends = np.cumsum(lengths + 1) - 1
        total = int(ends[-1]) + 1
        token = np.full(total, _END, np.uint64)
        inside = np.ones(total, bool)
        inside[ends] = False
        token[inside] = words[_unplaned(row["places"], np.uint32)]
        self.text = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.place = np.arange(total) - np.repeat(ends - lengths, lengths + 1)
        self.held = np.asarray(row["held"], bool)[self.text]
        self.lengths, self.texts = lengths, len(lengths)
        #: keys[m - 1][i]: the n-gram of order m that ends at token i, where its text has m tokens up to there
        self.keys = [token & _EVEN]
        for _ in range(1, order):
            before = np.append(_U(0), self.keys[-1][:-1])
            self.keys.append(mix(before * _STEP + token) & _EVEN)

    def valid(self, m: int) -> np.ndarray:
        return np.flatnonzero(self.place >= m - 1)


def _bucketed(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys, by their first bits."""
    if not bits:
        yield 0, 0, len(keys)
        return
    bucket = keys >> _U(64 - bits)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
        yield int(bucket[a]), a, z


_SENT = "m int, bucket bigint, chunk bigint, keys binary, counts binary"


def _sent(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """Each chunk's distinct n-grams with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                t = _Tokens(row, order)
                out = []
                for m in range(1, order + 1):
                    at = t.valid(m)
                    # the lowest bit tells training from held-out occurrences, and sorting keeps them together; those of held-out texts ask for totals
                    marked = np.sort(t.keys[m - 1][at] | (~t.held[at]).astype(np.uint64))
                    first = np.flatnonzero(np.append(True, (marked[1:] & _EVEN) != (marked[:-1] & _EVEN))) if len(marked) else np.zeros(0, np.int64)
                    keys = marked[first] & _EVEN
                    learnt = np.add.reduceat(marked & _U(1), first).astype(np.uint32) if len(first) else np.zeros(0, np.uint32)
                    out += [(m, k, row["chunk"], _pack_keys(keys[a:z]), _planes(learnt[a:z])) for k, a, z in (_bucketed(keys, bits) if len(keys) else ())]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _SENT.split(", ")])

    return chunks.mapInArrow(run, _SENT)


_ADDED_UP = "kind string, m int, bucket bigint, chunk bigint, keys binary, counts binary, owned binary, r array<bigint>, n array<bigint>"


def _added_up(key: tuple, rows: pa.Table) -> pa.Table:
    """One bucket: model part, answers to the chunks, counts of counts."""
    m, bucket = key[0].as_py(), key[1].as_py()
    rows = rows.sort_by("chunk")
    chunks = rows.column("chunk").to_pylist()
    keys = [_unpack_keys(x) for x in rows.column("keys").to_pylist()]
    counts = np.concatenate([_unplaned(x, np.uint32) for x in rows.column("counts").to_pylist()])
    distinct, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(place, counts, len(distinct)).astype(np.int64)
    owned = np.zeros(len(place), bool)
    owned[first] = True
    sums = total.astype(np.uint64)[place]
    cuts = np.cumsum([0, *map(len, keys)])
    seen = total > 0
    r, n = np.unique(total[seen], return_counts=True)
    out = [("answer", m, bucket, c, None, _planes(sums[a:z]), _bits(owned[a:z]), None, None) for c, a, z in zip(chunks, cuts, cuts[1:])]
    out.append(("counts", m, bucket, None, _pack_keys(distinct[seen]), _planes(total[seen]), None, None, None))
    out.append(("histogram", m, bucket, None, None, None, None, r.tolist(), n.tolist()))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _ADDED_UP.split(", ")])


# --- the model's numbers ---------------------------------------------------


class Discounts:
    """Good-Turing discount factors of one order, from its counts of counts."""

    def __init__(self, r: np.ndarray, n: np.ndarray, turing_upto: int = 5):
        r, n = np.asarray(r, float), np.asarray(n, float)
        slope = -2.0
        if len(r) >= 2:
            below, above = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
            z = n / (0.5 * (above - below))  # averaged over the gaps between counts that occur
            x, y = np.log(r), np.log(z)
            slope = float(np.sum((x - x.mean()) * (y - y.mean())) / np.sum((x - x.mean()) ** 2))
        #: below -1, so that every count is lowered
        self.slope = min(slope, -1.05)
        self.small = {}
        have = dict(zip(r.tolist(), n.tolist()))
        for k in range(1, turing_upto + 1):
            if have.get(k) and have.get(k + 1):
                d = (k + 1) * have[k + 1] / (k * have[k])
                if 0.01 < d < 0.999:
                    self.small[k] = d

    def __call__(self, count: np.ndarray) -> np.ndarray:
        count = np.maximum(np.asarray(count, float), 1)
        out = (1 + 1 / count) ** (self.slope + 1)
        for k, d in self.small.items():
            out = np.where(count == k, d, out)
        return out


_SCORED = (
    "kind string, chunk bigint, text int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, known_score double, "
    "m int, context bigint, times bigint, seen double, lower double"
)
_SCORED_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
_SCORED_NAMES = [x.split()[0] for x in _SCORED.split(", ")]


def _table(kind: str, n: int, **columns) -> pa.Table:
    arrays = [pa.array(columns[name], k) if name in columns else pa.array([kind] * n, k) if name == "kind" else pa.nulls(n, k) for name, k in zip(_SCORED_NAMES, _SCORED_KINDS)]
    return pa.table(arrays, names=_SCORED_NAMES)


def _score_chunk(row: dict, answers: dict[int, tuple[np.ndarray, np.ndarray]], order: int, discounts: list[Discounts], total: int, distinct: int) -> pa.Table:
    """What one chunk knows once its n-grams' totals are there: its texts' scores but for backoff
    weights, the weights they wait for, and the sums of the n-grams it owns."""
    t = _Tokens(row, order)
    count, index, owned = [], [], []
    first_at = []
    for m in range(1, order + 1):
        at = t.valid(m)
        _, first, place = np.unique(t.keys[m - 1][at], return_index=True, return_inverse=True)
        sums, marks = answers.get(m, (np.zeros(0, np.int64), np.zeros(0, bool)))
        c, i = np.zeros(len(t.place), np.int64), np.full(len(t.place), -1)
        c[at], i[at] = sums[place], place
        count.append(c)
        index.append(i)
        owned.append(marks)
        first_at.append(at[first])
    p = [(count[0] + ADDED) / (total + ADDED * (distinct + 1))]
    for m in range(2, order + 1):
        context = np.append(0, count[m - 2][:-1])
        seen = (count[m - 1] > 0) & (t.place >= m - 1)
        p.append(np.where(seen, discounts[m - 1](count[m - 1]) * count[m - 1] / np.maximum(context, 1), 0.0))
    out = []
    open_ = np.ones(len(t.place), bool)
    known = np.zeros(len(t.place))
    for m in range(order, 1, -1):
        done = open_ & (p[m - 1] > 0)
        known[done] = np.log10(p[m - 1][done])
        open_ &= ~done
        context = np.append(0, count[m - 2][:-1])
        wait = np.flatnonzero(open_ & (t.place >= m - 1) & (context > 0))
        if len(wait):
            pairs = np.stack([t.text[wait], index[m - 2][wait - 1]], 1)
            pairs, times = np.unique(pairs, axis=0, return_counts=True) if len(pairs) < 64 else _unique_pairs(pairs)
            keys = t.keys[m - 2][first_at[m - 2][pairs[:, 1]]].view(np.int64)
            out.append(_table("wait", len(keys), chunk=np.full(len(keys), row["chunk"]), text=pairs[:, 0].astype(np.int32), m=np.full(len(keys), m, np.int32), context=keys, times=times))
        own = first_at[m - 1][owned[m - 1]]
        own = own[(p[m - 1][own] > 0)]
        if len(own):
            contexts, place = np.unique(index[m - 2][own - 1], return_inverse=True)
            keys = t.keys[m - 2][first_at[m - 2][contexts]].view(np.int64)
            out.append(_table("sums", len(keys), m=np.full(len(keys), m, np.int32), context=keys, seen=np.bincount(place, p[m - 1][own]), lower=np.bincount(place, p[m - 2][own])))
    known[open_] = np.log10(p[0][open_])
    n = t.texts
    out.append(_table(
        "text", n, chunk=np.full(n, row["chunk"]), text=np.arange(n, dtype=np.int32), doc_id=row["doc_ids"], held_out=row["held"], n_tokens=t.lengths + 1,
        n_known=np.bincount(t.text, count[0] > 0, n).astype(np.int64), base_score=np.bincount(t.text, np.log10(p[0]), n), known_score=np.bincount(t.text, known, n),
    ))
    return pa.concat_tables(out)


def _unique_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = int(pairs[:, 1].max()) + 1
    both, times = np.unique(pairs[:, 0].astype(np.int64) * wide + pairs[:, 1], return_counts=True)
    return np.stack([both // wide, both % wide], 1), times


class Katz:
    """A model learnt from the rows of docs that are not held out, and the scores of all rows.

    ``counts`` (m, bucket, keys, counts) and ``weights`` (m, context, alpha) are
    its saved tables; weights has every context seen in training, so that any
    text can be scored.
    """

    def __init__(self, docs: DataFrame, order: int = ORDER):
        chunks = save(_chunks(docs), "chunks")
        tokens = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        bits = max(0, int(tokens // BUCKET_TOKENS).bit_length())
        added = save(_sent(chunks, order, bits).groupBy("m", "bucket").applyInArrow(_added_up, _ADDED_UP), "ngrams", "kind", "m", free=True)
        self.counts = added.where("kind = 'counts'").select("m", "bucket", "keys", "counts")
        # counts of counts: as many rows as different counts, at most the root of twice the tokens
        histogram = added.where("kind = 'histogram'").select("m", F.explode(F.arrays_zip("r", "n")).alias("x"))
        histogram = histogram.groupBy("m", F.col("x.r").alias("r")).agg(F.sum("x.n").alias("n")).orderBy("m", "r").toPandas()
        by = [histogram[histogram["m"] == m] for m in range(1, order + 1)]
        self.discounts = [Discounts(x["r"].to_numpy(), x["n"].to_numpy()) for x in by]
        self.train_tokens = int((by[0]["r"] * by[0]["n"]).sum())
        self.distinct = int(by[0]["n"].sum())
        discounts, total, distinct = self.discounts, self.train_tokens, self.distinct

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            answers = {}
            right = right.sort_by("bucket")
            for m in range(1, order + 1):
                own = right.filter(pa.compute.equal(right.column("m"), m))
                if len(own):
                    answers[m] = (
                        np.concatenate([_unplaned(x, np.uint64) for x in own.column("counts").to_pylist()]).astype(np.int64),
                        np.concatenate([_unbits(x) for x in own.column("owned").to_pylist()]),
                    )
            return _score_chunk(left.to_pylist()[0], answers, order, discounts, total, distinct)

        answers = added.where("kind = 'answer'").select("chunk", "m", "bucket", "counts", "owned")
        scored = save(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, _SCORED), "scored", "kind", free=True)
        # nothing reads the texts' words or the answers again, and what follows shuffles
        drop_saved(chunks)
        remove(docs.sparkSession, f"{added._saved_path}/kind=answer")
        sums = scored.where("kind = 'sums'").groupBy("m", "context").agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower"))
        self.weights = save(sums.select("m", "context", ((1 - F.col("seen")) / (1 - F.col("lower"))).alias("alpha")), "weights", "m")
        waits = scored.where("kind = 'wait'").select("chunk", "text", "m", "context", "times")
        backed = waits.join(self.weights, ["m", "context"]).groupBy("chunk", "text").agg(F.sum(F.col("times") * F.log10("alpha")).alias("backed"))
        texts = scored.where("kind = 'text'").join(backed, ["chunk", "text"], "left")
        #: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs
        self.scores = texts.select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score",
            (F.col("known_score") + F.coalesce("backed", F.lit(0.0))).alias("score"),
        )


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a Katz model of those not held out."""
    return Katz(table(spark, sf_dir, "documents")).scores
