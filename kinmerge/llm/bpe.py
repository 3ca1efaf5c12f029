"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Texts arrive in chunks (``units``), which are cut into pieces that no merge
crosses. Within a piece, what follows can change a token only as far back as a
chain of ever later merges reaches. ``lookahead`` computes the longest such
chain of the merge list, so a token that ends that far before the end of what
has been read is stable and leaves; the end of a piece settles the rest. The
pieces of a chunk go through side by side, each holding ``window`` symbols at
most, so memory depends on neither texts nor words, and the result equals
encoding the whole text at once. ``Decoder`` is the way back, a machine that
takes ids some at a time and holds a character's bytes until they are complete.

Nulls encode as empty texts; an empty text has no ids; equal rows give equal
results; texts are read whole at any length; an empty table gives an empty one;
columns other than doc_id and text are left alone, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .units import HARD, UnitEncoder, table_for, tables

END = "</w>"
_NO_PAIR = np.uint64(0xFFFFFFFFFFFFFFFF)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [chr(b) if b in shown else "" for b in range(256)]
    spare = iter(range(256, 512))
    return [s or chr(next(spare)) for s in out]


class PairTable:
    """Places of pairs of numbers below 2**32 in a list, looked up many at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.none = len(left)
        keys = self._key(left, right)
        self._levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        todo = np.arange(len(keys), dtype=np.int32)
        bits = max(4, len(keys).bit_length() + 2)
        factor = 0x9E3779B97F4A7C15
        while len(todo):  # what shares a slot with another goes to a further table
            shift = np.uint64(64 - bits)
            slot = (keys[todo] * np.uint64(factor)) >> shift
            _, first = np.unique(slot, return_index=True)
            held, place = np.full(1 << bits, _NO_PAIR), np.full(1 << bits, self.none, np.int32)
            held[slot[first]], place[slot[first]] = keys[todo[first]], todo[first]
            self._levels.append((np.uint64(factor), held, place))
            todo = np.delete(todo, first)
            factor = (factor * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF | 1

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair, ``none`` for others."""
        key = self._key(left, right)
        out = np.full(len(key), self.none, np.int32)
        for factor, held, place in self._levels:
            slot = (key * factor) >> np.uint64(64 - (len(held).bit_length() - 1))
            hit = held[slot] == key
            out[hit] = place[slot[hit]]
        return out


class Merges:
    """A vocabulary and its merge list, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: tokens by id, in byte symbols
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.uint32) for k in (0, 1))
        self.rank = PairTable(left, right)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        symbols = byte_symbols()
        #: ids of single bytes inside a piece, and at its end
        self.byte, self.last_byte = (np.array([vocab[s + e] for s in symbols], np.uint32) for e in ("", END))
        #: bytes that each token stands for
        self.length = np.array([len(t.removesuffix(END)) for t in self.tokens], np.int64)
        self.lookahead = lookahead(pairs)

    def tokenize(self, ids: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge neighbours inside each piece, lowest rank first and leftmost among equals, until no rule applies.

        ``piece`` numbers the piece of each id, in ascending order; so does the result.
        """
        none = self.rank.none
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank = np.full(len(ids), none, np.int32)
            inner = np.flatnonzero(piece[1:] == piece[:-1])
            rank[inner] = self.rank(ids[inner], ids[inner + 1])
            opens = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            best = np.minimum.reduceat(rank, opens)
            size = np.diff(np.append(opens, len(ids)))
            if (best == none).any():  # pieces that no rule applies to are done
                out = np.repeat(best == none, size)
                done.append((ids[out], piece[out]))
                ids, piece, rank = ids[~out], piece[~out], rank[~out]
                best, size = best[best != none], size[best != none]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            # in a run of one symbol every second pair: those at an even distance from the run's start
            run = np.append(True, (at[1:] != at[:-1] + 1) | (rank[at[1:]] != rank[at[:-1]]) | (piece[at[1:]] != piece[at[:-1]]))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            ids[at] = self.merged[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, piece = ids[stay], piece[stay]
        if not done:
            return ids, piece
        ids, piece = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(piece, kind="stable")
        return ids[order], piece[order]


def lookahead(merges: Iterable) -> int:
    """Symbols after a token's end that settle the token, for this merge list.

    Text still unread can change which symbol starts at some place. Such a
    symbol s matters further left only through a later rule (w, s), which moves
    the unsettled place left by w and leaves w or ws unsettled there; a later
    rule (s, z) keeps the place and leaves sz unsettled. Rules act in order of
    rank, so going through them backwards gives each symbol's longest reach.
    """
    reach: dict[str, int] = {}
    for left, right in reversed(list(merges)):
        whole = left + right
        moved = len(left.removesuffix(END)) + max(reach.get(left, 0), reach.get(whole, 0))
        kept = reach.get(whole, 0)
        reach[right] = max(reach.get(right, 0), moved)
        reach[left] = max(reach.get(left, 0), kept)
    return max(reach.values(), default=0)


class Transducer:
    """Encodes streams of symbols; what it holds of a piece is bounded by the lookahead."""

    def __init__(self, merges: Merges, window: int | None = None):
        self.merges = merges
        #: symbols of a piece read before its stable tokens leave
        self.window = window or 2 * merges.lookahead + 64

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids side by side, number of ids of each) of pieces that go through side by side."""
        m = self.merges
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = size <= self.window
        data = np.frombuffer(b"".join(texts if whole.all() else [t for t, w in zip(texts, whole) if w]), np.uint8)
        ids = m.byte[data]
        ends = np.cumsum(size[whole])[size[whole] > 0] - 1
        ids[ends] = m.last_byte[data[ends]]
        ids, piece = m.tokenize(ids, np.repeat(np.flatnonzero(whole), size[whole]))
        counts = np.bincount(piece, minlength=len(texts))
        if not whole.all():
            out = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(~whole):
                out[i] = np.concatenate(list(self.piece([texts[i]])))
            ids, counts = np.concatenate(out), np.array([len(x) for x in out], np.int64)
        return ids, counts

    def piece(self, blocks: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of one piece that comes in blocks; the last byte carries the end of the piece."""
        m = self.merges
        held, last = np.zeros(0, np.uint32), None
        for block in blocks:
            for at in range(0, len(block), self.window):
                data = np.frombuffer(block, np.uint8)[at : at + self.window]
                if last is not None:
                    held = np.append(held, m.byte[last])
                held, last = np.append(held, m.byte[data[:-1]]), data[-1]
                if len(held) >= self.window:
                    tokens = m.tokenize(held.copy(), np.zeros(len(held), np.int32))[0]
                    ends = np.cumsum(m.length[tokens])
                    stable = int(np.searchsorted(ends, len(held) - m.lookahead, "right"))
                    if stable:
                        yield tokens[:stable]
                        held = held[ends[stable - 1] :]
        if last is not None:
            held = np.append(held, m.last_byte[last])
            yield m.tokenize(held, np.zeros(len(held), np.int32))[0]


class Splitter:
    """The tokenizer's own normaliser and pattern: for words outside ``units``' tables, and for words too long to hold."""

    def __init__(self, path: str, special: dict[str, int]):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self._normalise = t.normalizer.normalize_str if t.normalizer else str
        self._split = t.pre_tokenizer.pre_tokenize_str
        self._byte = {s: b for b, s in enumerate(byte_symbols())}
        self._special = special
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        #: no special token and no sequence that the pattern looks ahead for is longer
        self._margin = max([4, *map(len, special)])

    def pieces(self, word: str) -> list[bytes | int]:
        """The bytes of a word's pieces; a special token as its id."""
        out: list[bytes | int] = []
        for part in self._marks.split(word) if self._marks else [word]:
            if part in self._special:
                out.append(self._special[part])
            elif part:
                out += [bytes(map(self._byte.__getitem__, p)) for p, _ in self._split(self._normalise(part))]
        return out

    def _safe(self, text: str) -> int:
        """The last place where text can be cut: NFC composes nothing across it, and neither a special token nor a 's-like piece spans it."""
        kind, _ = tables()
        spans = [m.span() for m in self._marks.finditer(text)] if self._marks else []
        for at in range(len(text) - self._margin, 0, -1):
            before = text[max(0, at - 3) : at]
            quote = before.endswith("'") and not before.endswith("''") or before[-2:-1] == "'" and before[-3:-2] != "'"
            if not quote and (c := ord(text[at])) < len(kind) and kind[c] != HARD and not any(a < at < z for a, z in spans):
                return at
        return 0

    def stream(self, blocks: Iterable[str]) -> Iterator[tuple[bytes | int, bool]]:
        """(bytes or special id, whether they go on the piece before) of one word that comes in blocks."""
        held, before = "", ""  # before: the end of the piece still open, as the pattern must see it
        for last, block in _with_last(blocks):
            held += block
            at = len(held) if last else self._safe(held)
            if not at:
                continue
            now, held = held[:at], held[at:]
            for part in self._marks.split(now) if self._marks else [now]:
                if part in self._special:
                    yield self._special[part], False
                    before = ""
                    continue
                new = self._normalise(part)
                if not new:
                    continue
                joined = before + new
                for k, (p, (a, z)) in enumerate(self._split(joined)):
                    raw = bytes(map(self._byte.__getitem__, p))
                    if k == 0 and before and a == 0:
                        if z > len(before):
                            yield raw[len(before.encode()) :], True
                    else:
                        yield raw, False
                    open_ = joined[a:z]
                # the end of a piece of two or more tells how it goes on, but a number never does; after a 's-like piece letters start anew
                closed = z < len(joined) or open_[-1:].isnumeric() or (open_[0] == "'" and len(open_) > 1 and open_[1] != "'" and open_[1:].isalpha())
                before = "" if closed else open_[-2:] if open_[0] != "'" or len(open_) > 2 else open_


def _with_last(items: Iterable) -> Iterator[tuple[bool, object]]:
    it = iter(items)
    try:
        now = next(it)
    except StopIteration:
        return
    for after in it:
        yield False, now
        now = after
    yield True, now


def by_pieces(units: list[str], easy: list[bool], splitter: Splitter, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units, side by side, and their numbers; ``encode`` does so for pieces."""
    if all(easy):
        return encode([u.encode("utf-8", "surrogatepass") for u in units])
    pieces: list[bytes] = []
    special: list[tuple[int, int]] = []  # (piece before which it stands, its id)
    parts = np.zeros(len(units), np.int64)
    for i, (u, plain) in enumerate(zip(units, easy)):
        cut = [u.encode("utf-8", "surrogatepass")] if plain else splitter.pieces(u)
        parts[i] = len(cut)
        for p in cut:
            if isinstance(p, int):
                special.append((len(pieces), p))
                p = b""  # holds the place
            pieces.append(p)
    ids, counts = encode(pieces)
    if special:
        at = np.array([k for k, _ in special])
        ids = np.insert(ids, np.cumsum(counts)[at], [i for _, i in special]).astype(np.uint32)
        counts[at] += 1
    upto = np.append(0, np.cumsum(counts))
    ends = np.cumsum(parts)
    return ids, upto[ends] - upto[ends - parts]


class Coder:
    """What a process keeps of a vocabulary: merges, splitter, transducer, the decoder's tables, and a table of units of fixed size. No texts."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.splitter = Splitter(path, self.merges.special)
        self.transducer = Transducer(self.merges)
        self.tables = Decoder.tables_of(self.merges)
        self._units = table_for()

    def units(self, units: list[str], easy: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, side by side, and their numbers: easy units are pieces, others go through the splitter."""
        return by_pieces(units, easy, self.splitter, self.transducer.pieces)

    def long(self, blocks: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of one word that comes in blocks, however long."""
        stream = self.splitter.stream(blocks)
        item = next(stream, None)
        while item is not None:
            if isinstance(item[0], int):
                yield np.array([item[0]], np.uint32)
                item = next(stream, None)
                continue
            first, item = item[0], None

            def one_piece(first: bytes = first) -> Iterator[bytes]:
                nonlocal item
                yield first
                for x in stream:
                    if isinstance(x[0], int) or not x[1]:
                        item = x
                        return
                    yield x[0]

            yield from self.transducer.piece(one_piece())

    def encoder(self) -> UnitEncoder:
        """An encoder of streams of texts; a task's own, over the process's table."""
        return UnitEncoder(self.units, self.long, self.merges.special, table=self._units)


class Decoder:
    """Ids back to text, some at a time.

    ``feed`` gives two things for each array of ids: what a decoder-less
    tokenizer's ``decode`` gives, tokens with single spaces between them, and the
    text itself, in which byte symbols are bytes again, turned into characters
    as soon as they are complete, and ends of words are spaces.
    """

    def __init__(self, tables: tuple[list[bytes], list[bytes]]):
        self._shown, self._raw = tables
        self._any = False
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    @staticmethod
    def tables_of(merges: Merges) -> tuple[list[bytes], list[bytes]]:
        byte = {s: b for b, s in enumerate(byte_symbols())}
        raw = [t.encode() if t in merges.special else bytes(map(byte.__getitem__, t.removesuffix(END))) + b" " * t.endswith(END) for t in merges.tokens]
        return [t.encode() for t in merges.tokens], raw

    def feed(self, ids: Iterable[int]) -> tuple[bytes, str]:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        shown = b" ".join(map(self._shown.__getitem__, ids))
        if self._any and shown:
            shown = b" " + shown
        self._any |= bool(shown)
        return shown, self._utf8.decode(b"".join(map(self._raw.__getitem__, ids)))

    def end(self) -> str:
        """What an unfinished character comes to; the decoder is as new afterwards."""
        self._any = False
        out = self._utf8.decode(b"", True)
        self._utf8.reset()
        return out


_held: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """This process's coder for a vocabulary file."""
    if path not in _held:
        _held[path] = Coder(path)
    return _held[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of a column one by one, as bytes."""
    for t in column.cast(pa.large_binary()):
        yield t.as_py()


#: Ids in a batch that leaves a task, at least; a text's own may be more.
BATCH_IDS = 1 << 18


def encode(docs: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """docs with the ids of each whole text, array<int>, in ``column``; one of that name that is there already is replaced."""
    path = path or default_path()
    names = [c for c in docs.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(path).encoder()
        for b in batches:
            at, ids, lengths, held, own = 0, [], [], 0, 0

            def rows(upto: int) -> pa.RecordBatch:
                offsets = np.cumsum([0, *lengths]).astype(np.int32)
                flat = np.concatenate(ids).view(np.int32) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                part = b.slice(at, upto - at)
                return pa.RecordBatch.from_arrays([*part.columns, lists], names=[*b.schema.names, column])

            row = 0
            for x, closed in encoder.stream(texts_of(b.column(b.schema.get_field_index("text")))):
                ids.append(x)
                own += len(x)
                if closed:
                    lengths.append(own)
                    held, own, row = held + own, 0, row + 1
                    if held >= BATCH_IDS:
                        yield rows(row)
                        at, ids, lengths, held = row, [], [], 0
            if row > at:
                yield rows(row)

    from pyspark.sql import types as T

    kept = docs.select(*(f"`{c}`" for c in names))
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, text_sha256) of each whole text, encoded and decoded again.

    ``text_sha256`` is that of the text that the decoder restores: lower case, a space after each piece.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        encoder, decoder = own.encoder(), Decoder(own.tables)
        sha = hashlib.sha256
        for b in batches:
            n, columns = [], ([], [], [])
            count, digest = 0, (sha(), sha(), sha())
            for ids, closed in encoder.stream(texts_of(b.column(1))):
                count += len(ids)
                for at in range(0, len(ids), 1 << 16):
                    part = ids[at : at + (1 << 16)]
                    shown, plain = decoder.feed(part)
                    digest[0].update(part.astype("<u4", copy=False).tobytes())
                    digest[1].update(shown)
                    digest[2].update(plain.encode())
                if closed:
                    digest[2].update(decoder.end().encode())
                    n.append(count)
                    for c, d in zip(columns, digest):
                        c.append(d.hexdigest())
                    count, digest = 0, (sha(), sha(), sha())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, text_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"))
