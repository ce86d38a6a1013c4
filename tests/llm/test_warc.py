from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re

import duckdb
import pytest

from sievework.llm import warc

SCHEMA = "page_id bigint, url string, html string, target string"


def plain(rows, least=0):
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = min(i, best.get(html or "", i))
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        first = best.get(html or "")
        revisit = len(data) >= least and first is not None and i != first
        out.append((i, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(1)
    bodies = ["<p>a\r\n\r\nb</p>", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "", None, "é🎉" * 9, "\r\n\r\n", "x" * 300_000, "\n"]
    rows = [(i, rng.choice([None, "", f"http://h{i % 5}.org/p q?x=1+2#é\r\nX: y", f"https://a.b/{i}"]), rng.choice(bodies) if rng.random() < 0.6 else f"<html>{i}</html>") for i in rng.sample(range(1000), 250)]
    return [*rows, (None, "http://n/", "<p>null id</p>"), (None, "http://m/", "<p>null id</p>"), (None, None, ""), (2000, "u", "twice"), (2000, "u", "twice")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_equals_brute_force(spark, tmp_path, least):
    rows = corpus()
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    assert got(warc.archive_pages(pages, str(tmp_path / "a"), least)) == plain(rows, least)


def test_captures_are_nested_and_hold_payloads(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>")]
    warc.write_archives(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), str(tmp_path / "a"))
    found = {r.metadata.fields["page-id"]: r for r in warc.captures(warc.read_records(spark, str(tmp_path / "a"))).collect()}
    assert bytes(found["1"].response.payload).decode() == "<p>é</p>" and found["1"].response.fields["status"] == "200"
    assert found["2"].response.payload is None and found["2"].response.refers_to == found["1"].response.record_id
    assert found["1"].request.fields["request"] == "GET http://a/ HTTP/1.1"


def test_repeated_rows_are_captures_with_ids_of_their_own(spark, tmp_path):
    rows = [(3, "u", "body")] * 4 + [(5, "v", "body")] * 3 + [(None, "n", "null")] * 2 + [(9, "w", "alone")]
    warc.write_archives(spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(3), str(tmp_path / "a"))
    records = warc.read_records(spark, str(tmp_path / "a")).collect()
    assert len({r.record_id for r in records}) == len(records) == 3 * len(rows)
    assert got(warc.archive_pages(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), str(tmp_path / "b"))) == plain(rows)
    named = spark.createDataFrame([("b", None, "x"), ("a", None, "x")], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.archive_pages(named, str(tmp_path / "c")).collect()} == {("a", None), ("b", "a")}


def whole(n=3):
    bodies = [b"pay\r\n\r\nload", b"ends\r\n", b"ends\r\n\r\n", b"\r\n\r\n\r\n\r\n", b"", b"\r\n", b"WARC/1.1\r\n\r\n", b"x" * 100_000]
    return bodies, b"".join(warc.transaction(k, "http://a/", b, None) + b"\r\n\r\n" for k, b in enumerate(bodies))


def test_pieces_become_records():
    bodies, data = whole()
    found = list(warc.parse(data.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n")))
    assert [h["warc-type"] for h, _ in found] == ["request", "response", "metadata"] * len(bodies)
    assert [b.partition(b"\r\n\r\n")[2] for h, b in found if h["warc-type"] == "response"] == bodies
    for bad in (data[:-40], data.replace(b"WARC/1.1", b"XARC", 1), re.sub(rb"Content-Length: [0-9]+", b"Content-Length: 2", data, count=1)):
        with pytest.raises(ValueError):
            list(warc.parse(bad.split(b"\r\n\r\n")))


def test_other_writers_archives_and_damage(spark, tmp_path):
    bodies, data = whole()
    members = gzip.compress(data[:30]) + gzip.compress(data[30:])
    (tmp_path / "good").mkdir()
    (tmp_path / "good/a.warc.gz").write_bytes(members)
    (tmp_path / "good/b.warc").write_bytes(data)
    found = [r for r in warc.read_records(spark, str(tmp_path / "good")).collect() if r.type == "response"]
    assert sorted(bytes(r.payload) for r in found) == sorted(bodies * 2)
    for name, bad in (("cut.gz", members[:-40]), ("short.gz", gzip.compress(data[:-60])), ("digest.gz", gzip.compress(data.replace(b"xxxx", b"xxyx", 1)))):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(Exception):
            warc.read_records(spark, str(tmp_path / name)).collect()


def test_empty_table(spark, tmp_path):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA), str(tmp_path / "a")).count() == 0


def test_null_ids_in_job_and_sql_alike(spark, tmp_path):
    from sievework.llm.queries import OP8_SQL

    rows = [(1, "u", "a"), (None, "w", "a"), (None, "x", "b"), (None, "y", "b"), (2, "z", None), (None, "q", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages, str(tmp_path / "n")).collect()), key=repr)
    c = duckdb.connect()
    c.register("pages", pages.toArrow())
    want = sorted(((i, d, t, r) for i, _, d, t, r in c.sql(OP8_SQL).fetchall()), key=repr)
    assert got == want
    by = {(i, t): r for i, _, t, r in got}
    assert by[None, "response"] is None and {r for i, _, t, r in got if i is None and t == "revisit"} == {1, 2}
