"""Surrogates: what is found, what replaces it, and that entities stay apart and together as they were."""

import random
import re

import pytest

from kinmerge.llm import pii

RND = random.Random(2)


def test_a_key_is_called_for():
    with pytest.raises(ValueError):
        pii.Surrogates(b"")


def test_kinds_and_formats():
    s = pii.Surrogates(b"key")
    text = "Ann@mail7.example.com, +1 (509) 555-6973, 509-555-6973, 12.84.156.107, 4539578763621486, 2001:db8::1 GB29 NWBK 6016 1331 9268 19 12 Oak Tree Street Mr. John Smith, Mrs Мария Иванова"
    new, found = s.apply(text)
    assert [f[0] for f in found] == ["email", "phone", "phone", "ip", "account", "ipv6", "iban", "street", "name", "name"]
    assert all(w != m for _, _, _, w, m in found)
    by = {f[0]: f for f in found}
    assert re.search(r" \d\d [A-Z][a-z]{2} [A-Z][a-z]{3} Street Mr", new)
    assert found[1][3:] == found[2][3:]  # one number, however written
    assert pii.luhn(by["account"][4][:-1]) == int(by["account"][4][-1])
    assert pii.iban_check("GB", by["iban"][4][4:]) == by["iban"][4][2:4] and re.search(r"GB\d\d( \w{4}){4} \d\d ", new)
    assert found[8][4].split()[0].title() in pii.MALE and pii.script(found[9][4]) == "cyrillic" and found[9][4].split()[0].title() in pii.FEMALE
    assert "12 Oak" not in new and "Oak" not in new


def test_names_in_any_script_and_again():
    s = pii.Surrogates(b"key")
    for name in ("王伟", "محمد علي", "Łukasz Åberg", "Ngọc Trần", "김철수", "Петър Ёлкин", "O’Brien Smith-Jones"):
        new, found = s.apply(f"then Mr. {name} met them")
        assert len(found) == 1 and found[0][3] == name.lower() and new.startswith("then Mr. ") and new.endswith(" met them")
        changed = new[9:-9]
        assert all(a != b or not a.isalpha() for w, v in zip(name.split(), changed.split()) for a, b in [(w, v)])
        assert [c.isalpha() for c in changed] == [c.isalpha() for c in name] and [c.isupper() for c in changed] == [c.isupper() for c in name]
    new, found = s.apply("Mr. John Smith came. John Smith, said Smith; Smithy stayed, JOHN left.")
    first, last = found[0][4].split()
    assert new == f"Mr. {first.title()} {last.title()} came. {first.title()} {last.title()}, said {last.title()}; Smithy stayed, JOHN left."
    assert s.apply("Miss the bus, Mr went home")[1] == []  # without a full stop a name is capital
    assert s.apply("Mr. smith")[1][0][3] == "smith"


def test_none_is_its_own_for_any_key():
    for k in range(20):
        s = pii.Surrogates(b"k%d" % k)
        assert all(s.given(n) != n for n in pii.MALE + pii.FEMALE)
        for size in (2, 3, 7, 10, 1000):
            images = [s._cipher.number(x, size, b"t") for x in range(size)]
            assert sorted(images) == list(range(size)) and all(x != y for x, y in enumerate(images))
        for n in ("Ann", "Li", "Xy", "É", "Thomas", "Ivan"):
            assert s.family(n) != n and s.given(n) != n


def brute(kind, what):
    """An entity of each kind by number."""
    return {
        "email": f"user{what}@site{what % 7}.example.org", "ip": f"10.{what % 250}.{what // 250}.9", "ipv6": f"2001:db8::{what + 1:x}", "ssn": f"{what % 900 + 100}-12-{1000 + what}", "phone": f"(509) 555-{what:04d}",
        "account": f"45395787{what:08d}", "street": f"{what + 1} Elm Street", "name": f"Mr. {pii.MALE[what % 15]} {'Abcdefghij'[what % 10].upper()}{'abcdefghij'[what // 10 % 10]}xo",
    }[kind]


def test_distinct_and_the_same_everywhere(spark):
    rows, at = [], 0
    kinds = ("email", "ip", "ipv6", "ssn", "phone", "account", "street", "name")
    for kind in kinds:
        for what in range(150):
            for _ in range(2):
                rows.append((at, f"see {brute(kind, what)} now"))
                at += 1
    RND.shuffle(rows)
    rows += [(10_000, None), (10_001, ""), (10_002, rows[0][1]), (rows[0][0], rows[0][1]), (None, "call 509-555-0007")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, entities string, n_entities int").repartition(3)
    got = pii.surrogates(docs, b"key").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    one = {i: by[i][0]["text"] for i in range(at)}
    new = {}  # entity -> surrogates
    for i, t in rows:
        if i is not None and i < at:
            new.setdefault(t, set()).add(one[i])
    assert all(len(v) == 1 for v in new.values())  # coreference
    assert len({next(iter(v)) for v in new.values()}) == len(new)  # distinctness
    assert all(t != next(iter(v)) for t, v in new.items())
    assert by[10_000][0]["text"] is None and by[10_001][0]["n_entities"] == 0 and by[10_002][0]["text"] == one[rows[0][0]] and len(by[rows[0][0]]) == 2
    assert one[next(i for i, t in rows if t == "see (509) 555-0007 now")].split()[2][-4:] == by[None][0]["text"][-4:]
    done = pii.masked(docs, b"key")
    assert pii.collisions(done).count() == 0
    empty = spark.createDataFrame([], docs.schema)
    assert pii.surrogates(empty, b"key").count() == 0


def test_a_clash_takes_the_next_key(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "call 509-555-0001"), (2, "call 509-555-0002")], "doc_id bigint, text string")
    real, tried = pii.collisions, []

    def once(found):
        tried.append(1)
        clash = real(found)
        return found.select("doc_id") if len(tried) == 1 else clash

    monkeypatch.setattr(pii, "collisions", once)
    assert pii.surrogates(docs, b"key").count() == 2 and len(tried) == 2
