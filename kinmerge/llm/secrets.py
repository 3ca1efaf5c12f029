"""Secret scans: an Aho-Corasick keyword prefilter, anchored patterns at its hits, embedded checksums.

One automaton over the lower-cased bytes of a text finds where a keyword of
some kind stands. Only there is that kind's pattern tried, anchored; matches
are taken from left to right, each kind for itself, and one that fails its
length or checksum test still uses up its text, as a search for the whole
pattern would. Long runs of hexadecimal digits have no keyword: they are found
by an automaton over the text's character classes. Kinds whose tokens carry a
CRC-32 are kept only if it is right.

A null text counts as empty; equal rows give equal results; whole texts are
read at any length; columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(body: bytes) -> bytes:
    """CRC-32 of the body in six base-62 digits, as token issuers append it."""
    n, out = zlib.crc32(body), ""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.rjust(6, "0").encode()


def _checksum_holds(m: re.Match) -> bool:
    body = m.group(0).split(b"_", 1)[1]
    return base62_crc32(body[:-6]) == body[-6:]


@dataclass(frozen=True)
class Kind:
    """A kind of secret: its lower-case keywords, its pattern where one stands, and what a match must hold."""

    name: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    holds: Callable[[re.Match], bool]


HEX_RUN = 24
KINDS = (
    Kind(
        "assign",
        (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"),
        re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
        lambda m: len(m.group(2)) >= 6,
    ),
    Kind("access", (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m.group(0)) >= 20),
    Kind("hex", (), re.compile(rb"[0-9a-f]+"), lambda m: len(m.group(0)) >= HEX_RUN),
    Kind("github", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), _checksum_holds),
    Kind("npm", (b"npm_",), re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), _checksum_holds),
)
BASE = 3  # the first kinds are those of the contract
_CLASSES = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))


def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for k, kind in enumerate(KINDS):
        for w in kind.keywords:
            words.add_word(w.decode(), (k, len(w)))
    runs.add_word("h" * HEX_RUN, HEX_RUN)
    words.make_automaton()
    runs.make_automaton()
    return words, runs


_held: list = []


def find(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets in a UTF-8 text, in bytes, by start and then kind."""
    if not _held:
        _held.extend(_automata())
    words, runs = _held
    out, upto = [], [0] * len(KINDS)
    # one character a byte: places are byte places
    for last, (k, n) in words.iter(data.lower().decode("latin-1")):
        start = last + 1 - n
        if start >= upto[k] and (m := KINDS[k].pattern.match(data, start)):
            upto[k] = m.end()
            if KINDS[k].holds(m):
                out.append((start, k, m.end()))
    for last, n in runs.iter(data.translate(_CLASSES).decode("latin-1")):
        if last >= upto[2]:
            m = KINDS[2].pattern.match(data, last + 1 - n)
            upto[2] = m.end()
            out.append((m.start(), 2, m.end()))
    out.sort()
    return out


def in_code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in characters instead of bytes."""
    if not found or data.isascii():
        return found
    at = {}
    byte = chars = 0
    for p in sorted({x for s, _, e in found for x in (s, e)}):
        chars += len(data[byte:p].decode())
        byte = at[p] = p
        at[p] = chars
    return [(at[s], k, at[e]) for s, k, e in found]


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k].name}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, spans = ([], [], []), [], []
            for t in b.column(1).cast(pa.large_binary()):
                data = t.as_py() or b""
                found = in_code_points(data, find(data))
                base = [x for x in found if x[1] < BASE]
                for k in range(BASE):
                    counts[k].append(sum(x[1] == k for x in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(data: bytes, mark: bytes = b"[secret]") -> bytes:
    """The text with each run of overlapping secrets replaced by a mark."""
    out, at, end = [], 0, -1
    for s, _, e in find(data):
        if s < end:
            at = end = max(end, e)
            continue
        out += [data[at:s], mark]
        at = end = e
    out.append(data[at:])
    return b"".join(out)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by a mark; rows and other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            texts = [None if t is None else redacted(t).decode() for t in b.column(i).cast(pa.large_binary()).to_pylist()]
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan(table(spark, sf_dir, "documents"))
