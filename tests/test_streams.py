"""Stateful streams and the folder source: runs that go on from a stop, awkward rows, files that appear whole."""

from __future__ import annotations

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import keys
from sievework.sources import files, pages
from sievework.streaming import decisions

SCHEMA = "asset string, field string, action string, value string, at timestamp, seq bigint"
DAY = dt.datetime(2024, 1, 1)
ACTIONS = ["approve", "reject", "correct", "skip"]


def put(spark, rows, schema, at):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(at)


def lot(k):
    at = lambda h: DAY + dt.timedelta(hours=h)
    if k == 0:
        return [("a", "x", "approve", "1", at(5), 1), ("a", "x", "reject", None, at(5), 2), ("a", "y", "skip", "", at(1), 3), ("*", "x", "approve", None, at(1), 4), ("a", "*", "zap", None, at(1), 5)]
    return [("a", "x", "correct", "late", at(2), 9), ("b", "x", "approve", None, at(1), 6), ("b", "x", "approve", None, at(1), 6), ("q", "x", "approve", None, at(1), 7), (None, None, "skip", None, at(1), 8), ("b", "x", None, None, at(9), 10), ("b", "x", "skip", None, None, 11), ("a", "y", "correct", "z", at(3), None)]


def test_decisions_go_on_from_a_stop(spark, tmp_path):
    known = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "asset string, field string")
    found = []
    for name, lots in (("twice", [lot(0), lot(1)]), ("once", [lot(0) + lot(1)])):
        for rows in lots:
            put(spark, rows, SCHEMA, f"{tmp_path}/{name}/in")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{name}/in")
            taken, refused = decisions.import_decisions(stream, known, ACTIONS, f"{tmp_path}/{name}/state")
        found.append((sorted(map(repr, taken.collect())), sorted(map(repr, refused.select("asset", "field", "seq", "reason").collect()))))
    assert found[0] == found[1]
    taken_now = sorted((r.asset, r.field, r.action, r.value, r.seq) for r in taken.collect())
    assert taken_now == [("a", "x", "reject", None, 2), ("a", "y", "skip", "", 3), ("b", "x", "approve", None, 6)]
    why = {r.seq: r.reason for r in refused.collect() if r.seq is not None}
    assert why == {4: "wildcard", 5: "wildcard", 7: "unknown-key", 8: "unknown-key", 10: "unknown-action", 11: "no-time"}
    assert [r.reason for r in refused.where("seq is null").collect()] == ["no-time"]
    # nothing new: the same rows again
    again, _ = decisions.import_decisions(stream, known, ACTIONS, f"{tmp_path}/once/state")
    assert sorted(map(repr, again.collect())) == found[0][0]


def test_decisions_of_one_place_in_time(spark, tmp_path):
    """Of decisions of one key and one (at, seq) the greatest counts, in whatever order they come."""
    rows = [("a", f"f{i % 2}", "approve", str(i // 2), DAY, 7) for i in range(2000)]
    known = spark.createDataFrame([("a", "f0"), ("a", "f1")], "asset string, field string")
    for name, some in (("up", rows), ("down", rows[::-1])):
        put(spark, some, SCHEMA, f"{tmp_path}/{name}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{name}/in")
        taken, _ = decisions.import_decisions(stream, known, ACTIONS, f"{tmp_path}/{name}/state")
        assert sorted((r.asset, r.field, r.value, r.seq) for r in taken.collect()) == [("a", "f0", "999", 7), ("a", "f1", "999", 7)]


def test_windows_close_once_and_late_rows_do_not_count(spark, tmp_path):
    at = lambda day, h=0: DAY + dt.timedelta(days=day, hours=h)
    lots = [[(at(0, 1), 1), (at(0, 2), 1), (at(2), 2), (None, 5), (at(5), 3)], [(at(1), 9), (at(5, 1), 3), (at(8), None)], [(at(364), 1), (at(366), 2), (at(371), 2)]]
    for rows in lots:
        put(spark, rows, "ts timestamp, member bigint", f"{tmp_path}/in")
        stream = spark.readStream.schema("ts timestamp, member bigint").parquet(f"{tmp_path}/in")
        closed = decisions.closed_windows(stream, keys.three_day_key(F.col("ts")), "1 day", f"{tmp_path}/state")
    got = sorted((r.window, (r.starts - DAY).days, (r.ends - DAY).days, r.n, r.members) for r in closed.collect())
    # 2024 has 366 days, so its last window is whole; the row of day 1 in the second lot comes after its window has closed
    assert got == [("2024-000", 0, 3, 3, 2), ("2024-001", 3, 6, 2, 1), ("2024-002", 6, 9, 1, 0), ("2024-121", 363, 366, 1, 1), ("2025-000", 366, 369, 1, 1)]


@pytest.mark.parametrize("own", [True, False])
def test_crawl_routes(spark, tmp_path, own):
    rows = [("index.html", "home"), ("a.html", "first"), ("a/index.html", "second"), ("b/404/index.html", "no"), ("b/404.html", "yes"), ("404.html", "root"), ("_not-found.html", "not"), ("_next/x.html", "no route"), ("c d/ü+%41.html", "ü"), ("e.html", "x\n" * 40_000)]
    at = f"{tmp_path}/site"
    files.write_crawl(spark.createDataFrame(rows, "file string, html string").repartition(4), at)
    assert os.path.exists(f"{at}/_SUCCESS") and not [f for _, _, fs in os.walk(at) for f in fs if f.endswith(".tmp")]
    got = {r.route: r.html for r in files.read_crawl(spark, at, own).collect()}
    want = {"/": "home", "/a": "first", "/b/404": "yes", "/404": "root", "/c d/ü+%41": "ü", "/e": "x\n" * 40_000}
    assert {k: v or "" for k, v in got.items()} == want


def test_folder_source_parts_and_refusals(spark, tmp_path):
    at = f"{tmp_path}/site"
    pages.register(spark)
    read = lambda **o: spark.read.format("html_folder").options(path=at, **o).load()
    assert read().count() == 0
    files.write_crawl(spark.createDataFrame([(f"{i}.html", "x" * i) for i in range(30)], "file string, html string"), at)
    assert read(partBytes=3 << 20).rdd.getNumPartitions() == 15 and read(partBytes=3 << 20).count() == 30
    files.write_crawl(spark.createDataFrame([("0.html", "new")], "file string, html string"), at, "overwrite")
    assert [(r.file, r.html) for r in read().collect()] == [("0.html", "new")]
    for name in ("../x.html", "/x.html", "x.txt", None):
        with pytest.raises(Exception, match="is not the name"):
            files.write_crawl(spark.createDataFrame([("fine.html", "ok"), (name, "bad")], "file string, html string").coalesce(1), at)


def test_a_windows_members_meet_the_state_once_a_batch(monkeypatch):
    """Twelve chunks of the same 30 members: 30 writes of the state instead of 360; beyond ``MOST_MEMBERS`` they go in parts."""

    class Held:
        def __init__(self):
            self.value, self.map, self.calls = None, {}, 0

        exists = lambda self: self.value is not None
        get = lambda self: self.value
        getValueState = getMapState = lambda self, *a: Held()
        registerTimer = lambda self, at: None

        def update(self, value):
            self.value = value

        def getValue(self, key):
            return self.map.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self.map[key] = value

    start = pd.Timestamp("2024-01-01")
    chunk = pd.DataFrame({"member": [f"m{i % 30}" for i in range(90)], "starts": start, "ends": start + pd.Timedelta(days=3), "ends_ms": 1})
    for most, calls in ((1000, 30), (10, 360)):
        monkeypatch.setattr(decisions, "MOST_MEMBERS", most)
        w = decisions.WindowCounts()
        w.init(Held())
        assert list(w.handleInputRows(("w",), iter([chunk] * 12), None)) == []
        assert w.count.value[0] == 1080 and w.members.map == {(f"m{i}",): (36,) for i in range(30)} and w.members.calls == calls


def test_a_windows_parts_write_their_members_at_once(monkeypatch):
    """Two calls of the state for a batch of any number of members; a list that names them again and again is cut down; parts run apart."""

    class Held:
        def __init__(self):
            self.value, self.list, self.calls = None, [], 0

        exists = lambda self: self.value is not None
        getValueState = getListState = lambda self, *a: Held()
        registerTimer = lambda self, at: None

        def get(self):
            return self.value or iter(self.list)

        def update(self, value):
            self.value = value

        def appendList(self, rows):
            self.calls, self.list = self.calls + 1, self.list + rows

        def put(self, rows):
            self.calls, self.list = self.calls + 1, rows

        def clear(self):
            self.value, self.list = None, []

    start = pd.Timestamp("2024-01-01")
    chunk = pd.DataFrame({"member": [f"m{i % 30}" for i in range(90)] + [None], "starts": start, "ends": start + pd.Timedelta(days=3), "ends_ms": 1})
    monkeypatch.setattr(decisions, "MOST_MEMBERS", 40)
    w = decisions.WindowParts()
    w.init(Held())
    for batch in range(12):
        assert list(w.handleInputRows(("w", 3), iter([chunk] * 2), None)) == []
        assert len(w.members.list) <= 2 * 30 + 40
    assert w.members.calls < 2 * 12
    (out,) = w.handleExpiredTimer(("w", 3), None, None)
    assert out[["window", "n", "members"]].values.tolist() == [["w", 12 * 2 * 91, 30]] and w.members.list == []
