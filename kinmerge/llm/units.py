"""Texts cut into the units that a BPE tokenizer merges inside of, many texts at once.

White space and the tokenizer's pattern cut a text into pieces, and no merge
crosses a cut. Code points of which NFC leaves every sequence as it is, and
whose lower case is one code point, are looked up in tables; a word (no white
space) that holds any other, or a special token, is one unit, left to the
tokenizer's own normaliser and splitter. Equal units are found by a hash and
compared letter by letter, so a batch's distinct units are encoded once each.

Texts are read in chunks of ``CHUNK`` bytes cut at white space, so memory does
not grow with a text; a word longer than a chunk is handed on block by block.
Bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from .text import mix, polynomial_hashes

SPACE, LETTER, NUMBER, OTHER, HARD = range(5)
#: Bytes of text cut at once.
CHUNK = 1 << 18
#: Distinct units that a process remembers, at about 100 bytes each; at least a chunk's.
ENTRIES = 1 << 18
_LIMIT = 0xD7A4
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_CUT = re.compile(rb"[\x20\x09-\x0D]")
_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower) by code point, the kind being that of the lower-case letter; built once in a process."""
    if not _TABLES:
        kind, lower = np.full(_LIMIT + 1, HARD, np.uint8), np.arange(_LIMIT + 1, dtype=np.uint32)
        # one code point is left as it is by NFC beside any other unless it decomposes, reorders or is the second of a composition
        seconds = {ord(d[-1]) for c in range(0x3000) if len(d := unicodedata.normalize("NFD", chr(c))) > 1}
        for c in range(0x3000):
            ch = chr(c)
            low = ch.lower()
            if len(low) != 1 or c in seconds or unicodedata.combining(ch) or 0x1160 <= c < 0x1200 or not unicodedata.is_normalized("NFC", ch):
                continue
            category = unicodedata.category(low)
            if category == "Cn" or unicodedata.category(ch) == "Cn":
                continue
            kind[c], lower[c] = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER), ord(low)
        # ideographs and Hangul syllables: letters without case
        for first, last in ((0x3400, 0x4DC0), (0x4E00, 0x9FF0), (0xAC00, _LIMIT)):
            kind[first:last] = LETTER
        kind[[c for c in _WHITE if kind[c] != HARD]] = SPACE
        _TABLES.extend((kind, lower))
    return _TABLES[0], _TABLES[1]


class UnitTable:
    """Units met before, by hash, with their letters and their ids: arrays of fixed size that start anew when full."""

    def __init__(self, entries: int, letters: int, ids: int):
        self._entries = entries
        self._shift = np.uint64(64 - (2 * entries).bit_length())
        self._slot = np.zeros(1 << (2 * entries).bit_length(), np.int32)  # entry number + 1
        self._hash = np.zeros(entries, np.uint64)
        self.letter_at, self.letters = np.zeros(entries + 1, np.int64), np.zeros(letters, np.uint32)
        self.id_at, self.ids = np.zeros(entries + 1, np.int64), np.zeros(ids, np.uint32)
        self.count = 0

    def reset(self) -> None:
        self._slot[:] = 0
        self.count = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        slot = (hashes >> self._shift).astype(np.int64)
        mask = len(self._slot) - 1
        while len(todo):
            entry = self._slot[slot] - 1
            there = entry >= 0
            hit = there & (self._hash[entry] == hashes[todo])
            out[todo[hit]] = entry[hit]
            on = there & ~hit
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out

    def room(self, entries: int, letters: int, ids: int) -> bool:
        n = self.count
        return n + entries <= self._entries and self.letter_at[n] + letters <= len(self.letters) and self.id_at[n] + ids <= len(self.ids)

    def add(self, hashes: np.ndarray, letters: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray, findable: bool = True) -> None:
        """Entries for units whose letters and ids lie side by side. Hashes are distinct and not there yet."""
        n, k = self.count, len(lengths)
        for at, pool, data, size in ((self.letter_at, self.letters, letters, lengths), (self.id_at, self.ids, ids, sizes)):
            upto = int(at[n])
            pool[upto : upto + len(data)] = data
            at[n + 1 : n + k + 1] = upto + np.cumsum(size)
        self.count += k
        if not findable:
            return
        self._hash[n : n + k] = hashes
        entry = np.arange(n, n + k)
        slot = (hashes >> self._shift).astype(np.int64)
        mask = len(self._slot) - 1
        while len(entry):
            free = np.flatnonzero(self._slot[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            now = free[first]
            self._slot[slot[now]] = entry[now] + 1
            stay = np.ones(len(entry), bool)
            stay[now] = False
            entry, slot = entry[stay], slot[stay]
            # whose slot another holds goes on to the next one
            slot = np.where(self._slot[slot] > 0, (slot + 1) & mask, slot)


def cut(text: str, marks: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends, easy) of a text's units; easy ones are lower-cased pieces, others whole words as they stand."""
    kind_of, lower_of = tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    near = np.minimum(codes, _LIMIT)
    kind, low = kind_of[near], lower_of[near]
    low[near == _LIMIT] = codes[near == _LIMIT]
    space = kind == SPACE
    hard = kind == HARD
    if marks is not None and "<" in text:
        hard = hard.copy()
        for m in marks.finditer(text):
            hard[m.start() : m.end()] = True
    start = ~space
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    # 's 't 'm 'd 're 've 'll, where the apostrophe starts a piece
    at = np.flatnonzero(start & (low == 0x27))
    at = at[at + 1 < n]
    if len(at):
        one, two = low[at + 1], low[np.minimum(at + 2, n - 1)]
        short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        long = (at + 2 < n) & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
        after = at + 2 + long
        at, after = at[short | long], after[short | long]
        start[at + 1] = False
        after = after[after < n]
        start[after] |= ~space[after]
    easy_word = None
    if hard.any():
        opens = ~space
        opens[1:] &= space[:-1]
        word = np.cumsum(opens) - 1
        bad = np.zeros(int(word[-1]) + 1, bool)
        bad[word[hard]] = True
        inside = bad[word] & ~space
        start = np.where(inside, opens, start)
        low = np.where(inside, codes, low)
        easy_word = ~inside
    closes = ~space
    closes[:-1] &= start[1:] | space[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(closes) + 1
    return low, starts, ends, np.ones(len(starts), bool) if easy_word is None else easy_word[starts]


def table_for(chunk: int = CHUNK, entries: int = ENTRIES) -> UnitTable:
    """An empty table; a chunk's own units always fit."""
    entries = max(entries, chunk + 1)
    return UnitTable(entries, 8 * entries, 8 * entries)


def _flat(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... for size[0] places, then the same for the next."""
    upto = np.cumsum(size)
    return np.repeat(at - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)


class UnitEncoder:
    """Ids of streams of texts, by way of ``encode`` (units, easy) -> (ids side by side, number of ids of each).

    ``long`` turns the blocks of a word longer than a chunk into arrays of ids.
    """

    def __init__(self, encode: Callable[[list[str], list[bool]], tuple[np.ndarray, np.ndarray]], long: Callable[[Iterator[str]], Iterator[np.ndarray]], special: Iterable[str] = (), chunk: int = CHUNK, table: UnitTable | None = None):
        self._encode, self._long, self.chunk = encode, long, chunk
        self._table = table or table_for(chunk)
        special = sorted(special, key=len, reverse=True)
        self._marks = re.compile("|".join(map(re.escape, special))) if special else None

    def _encoded(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, easy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = low.tobytes().decode("utf-32-le", "surrogatepass")
        return self._encode([text[a:z] for a, z in zip(starts.tolist(), ends.tolist())], easy.tolist())

    def _entries_of(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, easy: np.ndarray) -> tuple[np.ndarray, int]:
        """(the table's entry of each unit, number of entries that later chunks may use)."""
        t = self._table
        hashes = polynomial_hashes(low, starts, ends, lambda x: mix(x.astype(np.uint64)))
        entry = t.find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[first]
            ids, sizes = self._encoded(low, starts[one], ends[one], easy[one])
            lengths = ends[one] - starts[one]
            if t.count and not t.room(len(one), int(lengths.sum()), len(ids)):
                t.reset()
                return self._entries_of(low, starts, ends, easy)
            t.add(hashes[one], low[_flat(starts[one], lengths)], lengths, ids, sizes)
            entry[new] = t.count - len(one) + which
        kept = t.count
        # equal hashes are not enough: letters are compared
        length = ends - starts
        same = length == (t.letter_at[1:] - t.letter_at[:-1])[entry]
        if not same.all() or not np.array_equal(t.letters[_flat(t.letter_at[entry], length)], low[_flat(starts, length)]):
            odd = np.array([i for i in range(len(entry)) if not np.array_equal(low[starts[i] : ends[i]], t.letters[t.letter_at[entry[i]] : t.letter_at[entry[i] + 1]])])
            ids, sizes = self._encoded(low, starts[odd], ends[odd], easy[odd])
            if not t.room(len(odd), int(length[odd].sum()), len(ids)):
                t.reset()
                return self._entries_of(low, starts, ends, easy)
            t.add(hashes[odd], low[_flat(starts[odd], length[odd])], length[odd], ids, sizes, findable=False)
            entry[odd] = np.arange(kept, t.count)
        return entry, kept

    def _part(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts side by side, parted by line feeds; text i starts at code point bounds[i]."""
        low, starts, ends, easy = cut(text, self._marks)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) + 1, np.int64)
        entry, kept = self._entries_of(low, starts, ends, easy)
        t = self._table
        at, size = t.id_at[entry], (t.id_at[1:] - t.id_at[:-1])[entry]
        ids = t.ids[_flat(at, size)]
        t.count = kept
        edges = np.append(np.searchsorted(starts, bounds), len(starts))
        return ids, np.append(0, np.cumsum(size))[edges]

    def stream(self, texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, bool]]:
        """(ids, closed) in the order of the texts: one or more arrays for each, the last of which closes it."""
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[tuple[np.ndarray, bool]]:
            parts = [t.decode("utf-8", "replace") for t in held]
            bounds = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])]) if parts else np.zeros(0, np.int64)
            ids, offsets = self._part("\n".join(parts), bounds)
            for a, z in zip(offsets.tolist(), offsets[1:].tolist()):
                yield ids[a:z], True

        for text in texts:
            text = text or b""
            if len(text) <= self.chunk:
                held.append(text)
                size += len(text)
                if size >= self.chunk:
                    yield from flush()
                    held, size = [], 0
                continue
            yield from flush() if held else ()
            held, size = [], 0
            yield from self._parts_of(text)
            yield np.zeros(0, np.uint32), True
        if held:
            yield from flush()

    def _parts_of(self, text: bytes) -> Iterator[tuple[np.ndarray, bool]]:
        at = 0
        while at < len(text):
            end = min(len(text), at + self.chunk)
            if end < len(text):
                spaces = list(_CUT.finditer(text, max(at, end - 4096), end)) or list(_CUT.finditer(text, at, end))
                if not spaces:  # the word goes on beyond the chunk
                    m = _CUT.search(text, end)
                    end = m.start() if m else len(text)
                    for ids in self._long(self._blocks(text, at, end)):
                        yield ids, False
                    at = end
                    continue
                end = spaces[-1].end()
            yield self._part(text[at:end].decode("utf-8", "replace"), np.zeros(1, np.int64))[0], False
            at = end

    def _blocks(self, text: bytes, at: int, end: int) -> Iterator[str]:
        step = max(64, self.chunk // 4)
        while at < end:
            to = min(end, at + step)
            while to < end and to > at + step - 4 and text[to] & 0xC0 == 0x80:  # not inside a character
                to -= 1
            yield text[at:to].decode("utf-8", "replace")
            at = to
