import json

import pytest

from kinmerge.operators import mapping as MAP
from kinmerge.operators import state as S
from kinmerge.sources import files
from kinmerge.streaming import ingest


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_csv_cursor_keeps_rows_without_a_time(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Customer # ;Last Order\n1;2024-01-01\n2;2025-01-01\n3;\n", encoding="utf-8")
    got = files.csv(spark, str(tmp_path / "a.csv"), "Customer #", "Last Order", "2024-06-01", sep=";")
    assert [r[0] for r in _rows(got)] == ["2", "3"]
    assert json.loads(got.where("key = '2'").first()["payload"])["Last Order"] == "2025-01-01"


def test_jsonl_skips_blank_lines_and_reads_keys(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 7, "at": "b", "x": {"y": 1}}\n\n  \n{"at": "a"}\n')
    got = files.jsonl(spark, str(tmp_path / "a.jsonl"), updated="at").collect()
    assert {(r["key"], r["updated"]) for r in got} == {("7", "b"), ("3", "a")}  # without an id a line has its number
    assert files.jsonl(spark, str(tmp_path / "a.jsonl"), updated="at", cursor="a").count() == 1


def test_rows_without_a_key_are_numbered(spark, tmp_path):
    (tmp_path / "b.csv").write_text('a,b\n1,"x\ny"\n1,"x\ny"\n2,"say ""hi"""\n', encoding="utf-8")
    got = files.csv(spark, str(tmp_path / "b.csv")).collect()
    assert [(r["key"], json.loads(r["payload"])) for r in sorted(got, key=lambda r: r["key"])] == [("0", {"a": "1", "b": "x\ny"}), ("1", {"a": "1", "b": "x\ny"}), ("2", {"a": "2", "b": 'say "hi"'})]
    many = spark.range(1000).repartition(7)
    assert sorted(r["n"] for r in files.with_row_index(many, "n").collect()) == list(range(1000))


def test_settings_urls_and_retries():
    files.check_settings({"token_env": "X", "name": "crm"})
    with pytest.raises(ValueError):
        files.check_settings({"token": "secret"})
    files.check_url("https://a.example.com/x", [r".*\.example\.com"])
    for bad in ("http://a.example.com", "https://example.org"):
        with pytest.raises(ValueError):
            files.check_url(bad, [r".*\.example\.com"])
    answers, waits = iter([(429, {"retry-after": "2"}, None), (503, {}, None), (200, {}, "body")]), []
    assert files.retrying(lambda: next(answers), waits.append) == "body" and waits == [2.0, 2.0]
    with pytest.raises(OSError):
        files.retrying(lambda: (404, {}, None), waits.append)
    assert list(files.pages(lambda p: ([p, p], p + 1 if p < 2 else None), 0)) == [0, 0, 1, 1, 2, 2]


def test_stream_keeps_identify_events_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = {"type": "identify", "userId": "u1", "timestamp": "2025-01-01T00:00:00Z", "traits": {"email": "a@b.co"}}
    lines = [event, event, event | {"type": "track"}, {"type": "identify", "anonymousId": "z", "timestamp": "2025-01-02T00:00:00Z"}]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.append_raw(ingest.read_events(spark, str(tmp_path / "in")), out, state).awaitTermination()
    ingest.append_raw(ingest.read_events(spark, str(tmp_path / "in")), out, state).awaitTermination()
    raw = spark.read.parquet(out)
    assert sorted(r["key"] for r in raw.collect()) == ["u1", "z"]
    assert ingest.latest(raw).count() == 2


def _facts(n=100, **valid):
    return MAP.Facts(n, valid)


def test_mapping_rules_and_gates():
    known = {
        "E-Mail Addr": _facts(email=1.0), "Tel": _facts(phone=1.0), "second_dob": _facts(birth_date=1.0), "DOB": _facts(birth_date=1.0), "id": _facts(),
        "state": _facts(region=1.0), "empty": _facts(0), "Title": _facts(job_title=1.0), "blob": _facts(email=0.96), "odd": _facts(phone=0.99, birth_date=0.1), "zip": _facts(postal_code=0.2),
    }
    got = {f: (u.target, u.confidence) for f, u in MAP.propose(known).items()}
    assert got == {
        "E-Mail Addr": ("email", 0.95), "Tel": ("phone", 0.95), "DOB": ("birth_date", 0.95), "second_dob": ("attribute", 0.8), "id": (None, 0.9),
        "state": (None, 0.9), "empty": (None, 0.9), "Title": ("job_title", 0.95), "blob": ("email", 0.85), "odd": ("phone", 0.8), "zip": (None, 0.6),
    }
    assert MAP.verdict(MAP.gates(MAP.propose(known), known)) == "auto_applied"
    bad = {"E-Mail Addr": MAP.Use("phone", confidence=0.9)}
    assert MAP.verdict(MAP.gates(bad, known)) == "rejected" and MAP.settle(bad, known)[0] == MAP.propose(known)
    assert MAP.verdict(MAP.gates({"Tel": MAP.Use("phone", confidence=0.5)}, known)) == "queued"
    assert MAP.verdict(MAP.gates({}, known)) == "rejected"


def test_canonical_record(spark):
    fields = {"a": '["x@y.co", "bad", "X@y.co"]', "b": "z@y.co", "n": "Smith, Ann Jr", "out": "true", "note": " hi  there ", "p": "(727) 555-0100; 727-555-0101"}
    use = {"a": MAP.Use("email"), "b": MAP.Use("email"), "n": MAP.Use("full_name", "split_full_name"), "out": MAP.Use("consent.email_marketing", "invert_bool"), "note": MAP.Use("attribute"), "p": MAP.Use("phone", "split_list"), "gone": MAP.Use("city")}
    rows = spark.createDataFrame([(1, fields), (2, {}), (3, None)], "id int, fields map<string,string>")
    one, two, three = MAP.canonicalize(rows, use, 2026).orderBy("id").collect()
    assert one["emails"] == ["x@y.co", "z@y.co"] and one["phones"] == ["+17275550100", "+17275550101"]
    assert (one["first_name"], one["last_name"], one["name_suffix"], one["consent_email_marketing"], one["city"]) == ("Ann", "Smith", "jr", False, None)
    assert one["attributes"] == {"note": "hi there"}
    assert two["emails"] == [] and two["first_name"] is None and three["emails"] == [] and three["attributes"] == {}


def test_aliases_end_vanish_and_circle(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("g", "h"), ("h", ""), ("x", "y"), ("y", "x"), ("w", "x")]
    got = dict(_rows(S.follow_aliases(spark.createDataFrame(rows, "old string, new string"))))
    assert got == {"a": "d", "b": "d", "c": "d", "g": "", "h": "", "x": None, "y": None, "w": None}
    assert S.follow_aliases(spark.createDataFrame([], "old string, new string")).count() == 0


def test_flatten_nests_and_keeps_lists(spark):
    deep = spark.createDataFrame([(1, '{"a": {"b": {"c": {"d": {"e": {"f": "x"}}}}}}'), (2, '{"z": "}}{{"}')], "k int, p string")
    assert _rows(S.flatten(deep, "k", "p")) == [(1, "a.b.c.d.e.f", "x"), (2, "z", "}}{{")]
    rows = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}, "e": {}}, "l": [1, 2], "n": null, "t": "{oops"}'), (2, None)], "k int, p string")
    assert _rows(S.flatten(rows, "k", "p")) == [(1, "a.b.c", "1"), (1, "l", "[1,2]"), (1, "n", None), (1, "t", "{oops")]
