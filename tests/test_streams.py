"""The bucketed ledger, crawl states with timers, the partitioned listing, and progress."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lawmill.sources import listing
from lawmill.streaming import crawl_states as S
from lawmill.streaming import runner as U
from lawmill.streaming.ledger_table import LedgerTable

ROW = "k string, n long, v string"


def files(path):
    return {str(p): p.stat().st_size for p in Path(path).rglob("*.parquet")}


def content(table):
    return sorted((r["k"], r["n"], r["v"]) for r in table.read().select("k", "n", "v").collect())


def test_a_batch_rewrites_its_own_buckets(spark, tmp_path):
    table = LedgerTable(spark, str(tmp_path / "l"), ["k"], "n", 32)
    assert table.read() is None
    table.apply(spark.range(2000).selectExpr("concat('k', id) AS k", "0L AS n", "repeat('x', 100) AS v"), 0)
    whole, before = files(tmp_path / "l/data"), table.manifest()[2]
    table.apply(spark.createDataFrame([("k1", 1, "new"), ("k2", 2, "new"), ("k1", 0, "old")], ROW), 1)
    after, added = table.manifest()[2], {p: n for p, n in files(tmp_path / "l/data").items() if p not in whole}
    assert 1 <= sum(after[b] != f for b, f in before.items()) <= 2
    assert sum(added.values()) < sum(whole.values()) / 8
    assert table.read().count() == 2000 and [r for r in content(table) if r[2] != "x" * 100] == [("k1", 1, "new"), ("k2", 2, "new")]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    table = LedgerTable(spark, str(tmp_path / "l"), ["k"], "n", 4)
    rows = spark.createDataFrame([("a", 1, "x"), (None, 1, "null key")], ROW)
    assert table.apply(rows, 5) and not table.apply(spark.createDataFrame([("a", 9, "y")], ROW), 5) and not table.apply(rows, 4)
    assert table.manifest()[:2] == (0, 5) and table.read().where("v = 'y'").count() == 0
    assert table.apply(rows.limit(0), 6) and table.read().count() == 2 and table.manifest()[:2] == (1, 6)


def test_a_half_written_batch_is_not_seen(spark, tmp_path):
    table = LedgerTable(spark, str(tmp_path / "l"), ["k"], "n", 4)
    table.apply(spark.createDataFrame([("a", 1, "x")], ROW), 0)

    def fails(rows, old):
        rows.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "l/data/batch=000000001-half"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.apply(spark.createDataFrame([("a", 2, "y")], ROW), 1, fails)
    assert content(table) == [("a", 1, "x")]
    table.apply(spark.createDataFrame([("a", 2, "y")], ROW), 1)
    assert content(table) == [("a", 2, "y")]


def test_columns_are_added(spark, tmp_path):
    table = LedgerTable(spark, str(tmp_path / "l"), ["k"], "n", 2)
    table.apply(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], ROW), 0)
    table.apply(spark.createDataFrame([("a", 2, "y", 7)], f"{ROW}, more int"), 1)
    assert {(r["k"], r["v"], r["more"]) for r in table.read().collect()} == {("a", "y", 7), ("b", "x", None)}


def test_ticks_by_rows_and_by_time():
    now, told = [0.0], []
    ticks = U.Ticks(told.append, 50, 180.0, lambda: now[0])
    for rows, at in ((30, 1), (15, 2), (10, 3), (5, 100), (5, 184), (120, 185)):
        now[0] = at
        ticks.add(rows)
    assert told == [55, 65, 185]
    ticks.add(1)
    ticks.onQueryTerminated(None)
    assert told[-1] == 186


def test_progress_is_observed(spark, tmp_path):
    spark.range(70).selectExpr("concat('k', id) AS k", "id AS n", "'x' AS v").repartition(3).write.parquet(str(tmp_path / "in"))
    told = []
    ticks = U.Ticks(told.append, 10, 1e9)
    spark.streams.addListener(ticks)
    try:
        q = U.upsert_batches(spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "l"), ["k"], "n", str(tmp_path / "cp"), buckets=2)
        q.awaitTermination()
        for _ in range(100):
            if told and told[-1] == 70:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(ticks)
    assert told[-1] == 70 and len(told) >= 2
    assert U.read_ledger(spark, str(tmp_path / "l")).count() == 70


def crawl(spark, tmp_path, turns, **kind):
    shape = "key string, seq long, status string, time timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in turns:
        spark.createDataFrame([(k, n, s, m) for k, n, s, m in rows], "key string, seq long, status string, minute long").selectExpr("key", "seq", "status", "timestamp_seconds(60 * (minute + 1)) AS time").coalesce(1).write.mode("append").parquet(source)
    with S.keyed_state(spark):
        stream = S.crawl_states(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source), late="0 minutes", **kind)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted((r["key"], r["kind"], r["status"], r["attempts"]) for r in spark.read.schema(S.OUT).parquet(out).collect())


def test_failed_addresses_are_tried_again(spark, tmp_path):
    far = [("clock", 100, None, 1000)]
    got = crawl(spark, tmp_path, [[("a", 1, None, 0), ("b", 1, "failed", 0), ("c", 1, "failed", 0), ("c", 2, "downloaded", 1)], [("a", 2, "downloaded", 2), ("a", 3, "failed", 3)], far, [("b", 3, "failed", 1001)], [("clock", 101, None, 3000)]])
    assert ("b", "retry", "failed", 1) in got and ("b", "state", "failed", 2) in got and ("b", "retry", "failed", 2) in got
    assert [r for r in got if r[0] == "a"] == [("a", "state", "downloaded", 0), ("a", "state", "pending", 0)]
    assert [r for r in got if r[0] == "c"] == [("c", "state", "downloaded", 1)]


def test_after_the_last_attempt_no_timer_runs(spark, tmp_path):
    got = crawl(spark, tmp_path, [[("a", k, "failed", k) for k in range(3)], [("clock", 9, None, 900)], [("clock", 10, None, 2000)]], most=3)
    assert ("a", "state", "failed", 3) in got and sum(r[:2] == ("a", "retry") for r in got) == 2


def site(tmp_path, group, page, links):
    os.makedirs(tmp_path / "site" / group, exist_ok=True)
    (tmp_path / "site" / group / str(page)).write_text(" ".join(links))


def options(tmp_path):
    return {"site": "tests.listing_site:Site", "root": str(tmp_path / "site"), "groups": json.dumps(["a", "x", "b", "none"]), "exclude": '["x"]', "pages": "2", "wait": "0"}


def test_listing_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(listing.Listing)
    for page in (1, 2, 3):
        site(tmp_path, "a", page, [f"a{page}/2", f"a{page}/1", f"a{page}/1"])
    site(tmp_path, "b", 1, ["b1"])
    site(tmp_path, "x", 1, ["never"])

    def turn():
        stream = spark.readStream.format("listing").options(**options(tmp_path)).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("a", p, f"a{p}/{k}") for p in (1, 2, 3) for k in (1, 2)] + [("b", 1, "b1")]
    assert turn() == first
    site(tmp_path, "a", 4, ["a4"])
    assert turn() == sorted([*first, ("a", 4, "a4")])
    asked = {p.name: len(p.read_text()) for p in (tmp_path / "site-log").iterdir()}
    assert asked == {"a-1-executor": 1, "a-2-executor": 2, "a-3-executor": 1, "a-4-executor": 1, "b-1-executor": 1}


def test_listing_as_a_table(spark, tmp_path):
    spark.dataSource.register(listing.Listing)
    site(tmp_path, "a", 1, ["p"])
    rows = spark.read.format("listing").options(**options(tmp_path)).load()
    assert [tuple(r) for r in rows.collect()] == [("a", 1, "p")]
    assert [(r.group, r.first, r.last) for r in listing.ListingStream(options(tmp_path) | {"max_pages": "5"}).partitions({"a": 1}, {"a": 5, "b": 1})] == [("a", 2, 3), ("a", 4, 5), ("b", 1, 1)]


def test_calls_are_made_again():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return ["x"]

    assert listing.again(call, sleep=waits.append) == ["x"] and waits == [0.6, 1.2]
    with pytest.raises(ZeroDivisionError):
        listing.again(lambda: 1 / 0, 2, sleep=waits.append)


def test_few_calls_for_an_address():
    """An address settled at first sight costs one get and one update of its state; timers are asked for after failures only."""
    from pyspark.sql import Row

    calls, timers, kept = [], [], {}

    class Value:
        def get(self):
            calls.append("get")
            return kept.get("v")

        def update(self, v):
            calls.append("update")
            kept["v"] = v

    class Handle:
        getValueState = staticmethod(lambda name, kind: Value())
        registerTimer = staticmethod(timers.append)
        deleteTimer = staticmethod(timers.remove)

        @staticmethod
        def listTimers():
            calls.append("list")
            return iter(list(timers))

    def said(*rows):
        calls.clear()
        return [tuple(r) for r in crawl.handleInputRows(("a",), iter([Row(seq=n, status=s, ts=0) for n, s in rows]), None)]

    crawl = S.Crawl()
    crawl.init(Handle())
    assert said((2, "downloaded"), (1, None)) == [("a", "state", "downloaded", 0, 2)] and calls == ["get", "update"]
    assert said((3, "failed")) == [] and calls == ["get"]
    kept.clear()
    assert said((4, "failed")) == [("a", "state", "failed", 1, 4)] and timers == [60_000]
    assert said((5, "downloaded")) == [("a", "state", "downloaded", 1, 5)] and calls == ["get", "update", "list"] and timers == []


def test_listing_of_many_pages_takes_few_tasks_and_files(spark, tmp_path):
    """Runs grow with the pages, and a site's folder holds a file for many pages; pages without links and groups without pages give nothing."""
    pages = listing.ListingStream({"site": "lawmill.sources.listing:FolderSite", "groups": '["a", "b"]', "pages": "16"})
    runs = pages.runs({"b": 7}, {"a": 1_000_000, "b": 10})
    assert len(runs) <= listing.MOST_RUNS + 2 and sum(r.last - r.first + 1 for r in runs) == 1_000_003 and runs[-1].first == 8
    size = listing.FolderSite.PAGES
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "0.json").write_text(json.dumps({"1": ["x"], str(size): ["y", "z"]}))
    (tmp_path / "a" / "2.json").write_text(json.dumps({str(2 * size + 3): ["w"]}))
    site = listing.FolderSite({"root": f"file://{tmp_path}"})
    assert site.pages("a") == 2 * size + 3 and site.pages("none") == 0
    assert [site.links("a", p) for p in (1, 2, size, size + 1, 2 * size + 3)] == [["x"], [], ["y", "z"], [], ["w"]]
