"""Personal data replaced by surrogates: keyed, of the same type, gender, script and format.

Detected entities (e-mail addresses, IPv4 and IPv6 addresses, bank account
numbers with their check digits, phone numbers, long account or card numbers,
social security numbers, street addresses, names after a title) are replaced by
format-preserving encryption under a secret key: every character class keeps its
place and punctuation stays. Encryption is a bijection without fixed points on
each format, so two entities never share a surrogate, none is its own, and one
entity has the same everywhere, in however many documents, without a table of
entities. Given names known to be borne by men or women map within their list;
other name parts map vowel to vowel and consonant to consonant, and letters of
any other script to letters of their own block and case. A name found once is
replaced wherever it recurs in its text, with a title or without.

``collisions`` checks distinctness over the whole corpus all the same; if it
ever fails, the corpus is done again under the next key derived from the
caller's. A key must be given: whoever has it can undo the surrogates.

A null text stays null and has no entities; equal texts get equal results, and
repeated rows a row each; texts are read whole at any length; an empty table
gives an empty one; columns other than doc_id and text are left alone, whatever
their names. What looks like several kinds is the first of them in KINDS.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, save, table

#: Characters that are encrypted as one number at most.
PART_PLACES = 256

MALE = ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Pierre", "Louis", "Hans", "Carlos", "Pablo", "Jürgen", "José", "Иван", "Пётр", "Сергей", "Николай", "Алексей", "Γιώργος", "Νίκος", "Κώστας", "Δημήτρης")
FEMALE = ("Mary", "Linda", "Susan", "Karen", "Nancy", "Sarah", "Emma", "Anna", "Marie", "Claire", "Greta", "Lucía", "Carmen", "Elena", "Sofía", "Мария", "Анна", "Елена", "Ольга", "Татьяна", "Μαρία", "Ελένη", "Κατερίνα", "Σοφία")
_TITLES_MALE, _TITLES_FEMALE, _TITLES_ANY = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Κύριος"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "госпожа", "Κυρία"), ("Dr", "Prof")

_CLASSES = [
    "0123456789",
    *(s for base in ("aeiouy", "bcdfghjklmnpqrstvwxz", "áéíóúàèìòùâêîôûäëïöü", "çñýÿšž", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ") for s in (base, base.upper()) if len(set(s)) == len(base)),
]
_SCRIPTS = ("latin", "cyrillic", "greek")
_PLACE = {c: (k, i) for k, chars in enumerate(_CLASSES) for i, c in enumerate(chars)}
_BLOCK = 128
_others: dict[tuple[int, str], int] = {}


def _place(c: str) -> tuple[int, int] | None:
    """(class, place in it) of a character; letters outside the tables are classed by block and category as they come up."""
    found = _PLACE.get(c)
    if found is None and c.isalpha():
        first, category = ord(c) // _BLOCK * _BLOCK, unicodedata.category(c)
        if (first, category) not in _others:
            fellows = [ch for ch in map(chr, range(first, first + _BLOCK)) if ch not in _PLACE and unicodedata.category(ch) == category and unicodedata.normalize("NFC", ch) == ch and _one_case(ch)]
            if len(fellows) > 1 and c in fellows:
                _others[first, category] = len(_CLASSES)
                _PLACE.update({ch: (len(_CLASSES), i) for i, ch in enumerate(fellows)})
                _CLASSES.append("".join(fellows))
        found = _PLACE.get(c)
    return found


def _one_case(c: str) -> bool:
    """Whether upper and lower case lead back to the character, as names are cased after encryption."""
    return c in (c.upper().lower(), c.lower().upper()) and len(c.upper()) == len(c.lower()) == 1


def script(text: str) -> str:
    """latin, cyrillic or greek, by the first letter that tells."""
    for c in text:
        if "\u0400" <= c <= "\u04ff":
            return "cyrillic"
        if "\u0370" <= c <= "\u03ff":
            return "greek"
    return "latin"


class Cipher:
    """Keyed permutations of ranges and of strings of one format."""

    def __init__(self, key: bytes):
        self._key = hashlib.sha256(key).digest()

    def _round(self, tweak: bytes, r: int, x: int, bits: int) -> int:
        size = -(-bits // 8)
        out = b""
        n = 0
        while len(out) < size:
            out += hmac.digest(self._key, b"%s|%d|%d|%d|%d" % (tweak, r, n, bits, x), "sha256")
            n += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _encrypt(self, x: int, size: int, half: int, tweak: bytes, rounds: Iterable[int]) -> int:
        """x under a permutation of range(size) or its inverse: a Feistel network, walking on while the result is too large."""
        mask = (1 << half) - 1
        back = rounds[0] > rounds[-1]
        while True:
            left, right = x >> half, x & mask
            for r in rounds:
                if back:
                    left, right = right ^ self._round(tweak, r, left, half), left
                else:
                    left, right = right, left ^ self._round(tweak, r, right, half)
            x = left << half | right
            if x < size:
                return x

    def number(self, x: int, size: int, tweak: bytes) -> int:
        """x under a keyed permutation of range(size) that leaves no number where it is: encrypted, moved on by one, decrypted."""
        if size < 2:
            return x
        half = max(1, -(-(size - 1).bit_length() // 2))
        y = (self._encrypt(x, size, half, tweak, range(6)) + 1) % size
        return self._encrypt(y, size, half, tweak, range(5, -1, -1))

    def string(self, text: str, tweak: bytes) -> str:
        """Each character becomes one of its class; others stay. One to one on strings of one format.

        Long strings go in parts, each under a tweak that holds the surrogates of those before it.
        """
        where = [_place(c) for c in text]
        places = [p for p in where if p]
        shape = hashlib.sha256("".join(f"{_CLASSES[p[0]]}," if p else c for c, p in zip(text, where)).encode()).digest()
        new, before = [], b""
        for at in range(0, len(places), PART_PLACES):
            part = places[at : at + PART_PLACES]
            value, size = 0, 1
            for k, i in part:
                value, size = value * len(_CLASSES[k]) + i, size * len(_CLASSES[k])
            value = self.number(value, size, tweak + shape + before)
            own = []
            for k, _ in reversed(part):
                value, i = divmod(value, len(_CLASSES[k]))
                own.append(_CLASSES[k][i])
            new += reversed(own)
            before = hashlib.sha256(before + "".join(own).encode()).digest()
        it = iter(new)
        return "".join(next(it) if p else c for c, p in zip(text, where))


def luhn(digits: str) -> int:
    """The check digit that the digits before it call for."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _into(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def iban_check(country: str, rest: str) -> str:
    """The two check digits of a bank account number."""
    digits = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(digits) % 97:02d}"


def _ranges(wanted: Callable[[str], bool]) -> str:
    """The characters of the first plane that are wanted, as the inside of a character class."""
    out, c = [], 0
    while c < 0x10000:
        if not 0xD800 <= c < 0xE000 and wanted(chr(c)):
            last = c
            while last + 1 < 0x10000 and not 0xD800 <= last + 1 < 0xE000 and wanted(chr(last + 1)):
                last += 1
            out.append(f"\\u{c:04x}-\\u{last:04x}")
            c = last
        c += 1
    return "".join(out)


_UPPER = _ranges(lambda c: unicodedata.category(c) in ("Lu", "Lt"))
#: Letters without case whose names are written with spaces between their parts.
_SPACED = "\u0590-\u074f\u08a0-\u08ff\u0900-\u0dff\u10a0-\u139f"
_CASELESS = _ranges(lambda c: unicodedata.category(c) == "Lo")
_NAME = r"(?:[^\W\d_]+(?:[-'’][^\W\d_]+)*)"
_TITLES = "|".join((*_TITLES_MALE, *_TITLES_FEMALE, *_TITLES_ANY))
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive"
_FIRST = "".join(sorted({t[0] for t in (*_TITLES_MALE, *_TITLES_FEMALE, *_TITLES_ANY)}))
_PATTERN = re.compile(
    # an address is tried at the start of its local part only and never given back, and what cannot start the other kinds is passed over at once: long words cost no more than others
    r"(?P<email>(?<![\w.%+-])[\w.%+-]++@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    rf"|(?=[\da-fA-F(+:{_FIRST}A-Z])(?:"
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9a-fA-F]{0,4}:[0-9a-fA-F:]{3})(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![\w:]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<account>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d){8,12}(?!\w))"
    rf"|(?P<street>(?<![\w.,-])(?P<house>\d{{1,5}})[ ](?P<road>(?:[{_UPPER}][^\W\d_]+[ ]){{1,3}})(?:{_STREETS})\b)"
    rf"|(?P<name>\b(?P<title>{_TITLES})\b(?:\.[ ]|[ ](?=[{_UPPER}{_CASELESS}]))(?P<first>{_NAME})(?:[ ](?P<last>(?=[{_UPPER}]){_NAME}|(?<=[{_SPACED}][ ])(?=[{_SPACED}]){_NAME}))?))",
)
_HINT = re.compile(r"[@\d]|::|[0-9a-fA-F]:[0-9a-fA-F]|\b(?:" + _TITLES + r")\b")
KINDS = ("email", "ip", "ipv6", "iban", "ssn", "account", "phone", "street", "name")


class Surrogates:
    """Finds entities in a text and replaces them."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("surrogates need a secret key")
        self._cipher = Cipher(key)
        self._lists = {(g, s): [n for n in names if script(n) == s] for g, names in (("m", MALE), ("f", FEMALE)) for s in _SCRIPTS}
        self._given = {n.lower(): (g, s, i) for (g, s), names in self._lists.items() for i, n in enumerate(names)}

    def _cased(self, shape: str, text: str) -> str:
        """text, in lower case, cased as shape is: letter by letter where they are as long."""
        if len(shape) == len(text):
            return "".join(t.upper() if c.isupper() else t for c, t in zip(shape, text))
        return text.upper() if shape.isupper() and len(shape) > 1 else text[:1].upper() + text[1:] if shape[:1].isupper() else text

    def given(self, name: str) -> str:
        """A name of its list for a known given name; any other stays outside of the lists."""
        known = self._given.get(name.lower())
        if known:
            g, s, i = known
            names = self._lists[g, s]
            return self._cased(name, names[self._cipher.number(i, len(names), f"given {g} {s}".encode())].lower())
        new = name.lower()
        while True:
            new = self._cipher.string(new, b"first")
            if new not in self._given:
                return self._cased(name, new)

    def family(self, name: str) -> str:
        return self._cased(name, self._cipher.string(name.lower(), b"last"))

    def replace(self, kind: str, m: re.Match) -> tuple[str, str, str] | None:
        """(what the entity is, however written; what its surrogate is; the surrogate in the format of this mention), None for no entity."""
        text, c = m.group(kind), self._cipher
        if kind == "email":
            local, _, domain = text.lower().rpartition("@")
            host, _, top = domain.rpartition(".")
            new = f"{c.string(local, b'local')}@{c.string(host, b'host')}.{top}"
            return text.lower(), new, new
        if kind in ("ip", "ipv6"):
            try:
                address = ipaddress.ip_address(text)
            except ValueError:
                return None
            bits = 32 if kind == "ip" else 128
            new = str(type(address)(c.number(int(address), 1 << bits, kind.encode())))
            return str(address), new, new
        if kind == "iban":
            compact = text.replace(" ", "")
            country, check, rest = compact[:2], compact[2:4], compact[4:]
            if not 11 <= len(rest) <= 30 or iban_check(country, rest) != check:
                return None
            body = c.string(rest, b"iban" + country.encode())
            new = country + iban_check(country, body) + body
            it = iter(new)
            return compact, new, "".join(ch if ch == " " else next(it) for ch in text)
        if kind == "street":
            house, road = m.group("house"), m.group("road").split()
            new = (c.string(house, b"house"), *(self._cased(w, c.string(w.lower(), b"road")) for w in road))
            tail = text[len(house) + 1 + len(m.group("road")) :]
            return " ".join((house, *road)).lower(), " ".join(new).lower(), " ".join((*new, tail))
        if kind == "name":
            first, last = m.group("first"), m.group("last")
            new = [self.given(first), self.family(last)] if last else [self.given(first) if first.lower() in self._given else self.family(first)]
            what, made = " ".join(filter(None, (first, last))).lower(), " ".join(new)
            return what, made.lower(), text[: m.start("first") - m.start(kind)] + made
        digits = "".join(ch for ch in text if ch.isdigit())
        if kind == "account":
            body, check = digits[:-1], int(digits[-1])
            new = c.string(body, b"account")
            new += str((luhn(new) + check - luhn(body)) % 10)  # right stays right, wrong stays wrong
            return digits, new, _into(text, new)
        keep = max(0, len(digits) - 10) if kind == "phone" else 0
        new = c.string(digits[keep:], kind.encode())
        return digits[keep:], new, _into(text, digits[:keep] + new)

    def _found(self, text: str) -> list[tuple[str, int, int, str, str, str]]:
        """(kind, start, end, what it is, what its surrogate is, how that is written) by start."""
        found = []
        for m in _PATTERN.finditer(text):
            kind = next(k for k in KINDS if m.group(k) is not None)
            done = self.replace(kind, m)
            if done is not None:
                found.append((kind, m.start(), m.end(), *done))
        again: dict[str, tuple[str, str, str]] = {}
        for kind, a, z, what, made, new in found:
            if kind == "name":  # its name without the title, and the family name by itself
                words = text[a:z].rsplit(" ", what.count(" ") + 1)[1:]
                again[" ".join(words)] = what, made, " ".join(new.rsplit(" ", made.count(" ") + 1)[1:])
                if len(words) > 1:
                    again.setdefault(words[-1], (words[-1].lower(), made.rsplit(" ", 1)[1], new.rsplit(" ", 1)[1]))
        if again:
            names = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(again, key=len, reverse=True))) + r")(?!\w)")
            taken = [(a, z) for _, a, z, *_ in found]
            k = 0
            for m in names.finditer(text):
                while k < len(taken) and taken[k][1] <= m.start():
                    k += 1
                if k == len(taken) or m.end() <= taken[k][0]:
                    found.append(("name", m.start(), m.end(), *again[m.group()]))
            found.sort(key=lambda e: e[1])
        return found

    def apply(self, text: str) -> tuple[str, list[tuple[str, int, int, str, str]]]:
        """(new text, entities as (kind, start, end, what it is, what its surrogate is))."""
        if not _HINT.search(text):
            return text, []
        out, at, found = [], 0, []
        for kind, a, z, what, made, new in self._found(text):
            out += [text[at:a], new]
            at = z
            found.append((kind, a, z, what, made))
        out.append(text[at:])
        return "".join(out), found


_ENTITY = "array<struct<kind:string,start:bigint,end:bigint,entity:string,surrogate:string>>"
_ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.string()), ("surrogate", pa.string())]))


def masked(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, entities, text): each whole text with its personal data replaced, and what was found where, in code points of the old text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Surrogates(key)
        names = ("kind", "start", "end", "entity", "surrogate")
        for b in batches:
            done = [own.apply(t) if t else (t, []) for t in b.column(1).to_pylist()]
            found = pa.array([[dict(zip(names, e)) for e in f] for _, f in done], _ENTITIES)
            yield pa.RecordBatch.from_arrays([b.column(0), found, pa.array([t for t, _ in done], pa.string())], names=["doc_id", "entities", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, entities {_ENTITY}, text string")


def collisions(found: DataFrame) -> DataFrame:
    """(kind, surrogate, entities) of rows from ``masked``: surrogates that stand for more than one entity, or for themselves."""
    each = found.select(F.explode("entities").alias("e")).select("e.kind", "e.surrogate", "e.entity").distinct()
    counted = each.groupBy("kind", "surrogate").agg(F.count("*").alias("entities"), F.bool_or(F.col("entity") == F.col("surrogate")).alias("own"))
    return counted.where("entities > 1 or own").select("kind", "surrogate", "entities")


#: Keys derived from the caller's that are tried before giving up.
KEYS = 8


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, n_entities, kinds, text): each whole text with its personal data replaced; entities are looked for once.

    Should two entities of the corpus share a surrogate, all are made anew under the next derived key.
    """
    for n in range(KEYS):
        done = save(masked(docs, hmac.digest(key, b"surrogates %d" % n, "sha256")), "masked")
        if not collisions(done).limit(1).count():
            return done.select("doc_id", F.size("entities").cast("bigint").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["kind"]), ",").alias("kinds"), "text")
        drop_saved(done)
    raise ValueError("no key keeps entities apart")


#: The setting that holds the secret key, in hexadecimal digits.
KEY_SETTING = "spark.kinmerge.surrogate.key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates, under the session's key or, without one, a key made for this run and kept nowhere."""
    held = spark.conf.get(KEY_SETTING, None)
    return surrogates(table(spark, sf_dir, "documents"), bytes.fromhex(held) if held else os.urandom(32))
