"""Addresses in parts behave as addresses with a state of their own."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row

from lawmill.streaming import crawl_states as S


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


class Handle:
    def __init__(self):
        self.kept, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, kind):
        return self

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, v):
        self.calls += 1
        self.kept = v

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def listTimers(self):
        return iter(sorted(self.timers))


def one_by_one(turns, most, wait):
    """Each address with a state of its own."""
    out, all_of = [], {}
    for rows, now in turns:
        for key in dict.fromkeys(r[0] for r in rows):
            if key not in all_of:
                all_of[key] = S.Crawl(most, wait), Handle()
                all_of[key][0].init(all_of[key][1])
            out += all_of[key][0].handleInputRows((key,), iter([Row(key=k, seq=n, status=s, ts=t) for k, n, s, t in rows if k == key]), Clock(now))
        for key, (crawl, handle) in all_of.items():
            for due in sorted(t for t in handle.timers if t <= now):
                out += crawl.handleExpiredTimer((key,), Clock(now), None)
                handle.timers.discard(due)
    return out


def in_a_part(turns, most, wait):
    out, crawl, handle = [], S.CrawlParts(most, wait), Handle()
    crawl.init(handle)
    for rows, now in turns:
        if rows:
            frames = [pd.DataFrame(rows[k : k + 7], columns=["key", "seq", "status", "ts"]) for k in range(0, len(rows), 7)]
            out += [Row(**r) for f in crawl.handleInputRows((0,), iter(frames), Clock(now)) for r in f.to_dict("records")]
        assert len(handle.timers) <= 1
        for due in [t for t in handle.timers if t <= now]:
            handle.timers.discard(due)
            out += [Row(**r) for f in crawl.handleExpiredTimer((0,), Clock(now), None) for r in f.to_dict("records")]
    return out, handle


@pytest.mark.parametrize("seed", range(8))
def test_parts_are_as_addresses(seed):
    rng = np.random.default_rng(seed)
    keys, statuses = [None, *(f"đ/{k}" for k in range(40))], [None, "failed", "failed", "pending", "odd", "downloaded", "skipped_scanned"] if seed % 2 else [None, "failed", "failed", "failed", "x"]
    turns, seq = [], 0
    for now in range(0, 30, 3):
        rows = []
        for _ in range(int(rng.integers(0, 60))):
            seq += int(rng.integers(0, 2))
            rows.append((keys[rng.integers(len(keys))], seq, statuses[rng.integers(len(statuses))], int(rng.integers(0, 20))))
        rows.reverse()
        turns.append((rows, now))
    kind = lambda rows: sorted((str(r["key"]), r["kind"], r["status"], int(r["attempts"]), int(r["seq"])) for r in rows)
    got, _ = in_a_part(turns, 3, 2)
    want = one_by_one(turns, 3, 2)
    assert want and kind(got) == kind(want)


def test_few_calls_for_a_part():
    """Thousands of addresses once cost two calls to the state store each."""
    rows = [(f"a{k}", k, "failed" if k % 2 else None, 5) for k in range(3000)]
    got, handle = in_a_part([(rows, 0)], 3, 2)
    assert len(got) == 3000 and handle.calls == 3 and handle.timers == {7}
    with pytest.raises(ValueError):
        in_a_part([([("a", 1, "failed", None)], 0)], 3, 2)
    with pytest.raises(ValueError):
        in_a_part([([("a", None, None, 1)], 0)], 3, 2)


def test_a_part_comes_back_as_it_was():
    part = S.Part()
    part.take(pa.array(["a", None, "b"]), np.array([1, 2, 3]), pa.array(["failed", None, "downloaded"]), pa.array([5, 5, 5]), 3, 2)
    again = S.Part(*part.packed())
    assert again.keys.to_pylist() == ["a", None, "b"] and again.state.tolist() == [2, 1, 3] and again.due.tolist() == [7] and S.Part().packed() == (b"", b"")


@pytest.mark.parametrize("parts", [0, 3])
def test_the_stream_says_the_same_with_and_without_parts(spark, tmp_path, parts):
    from tests.test_streams import crawl

    turns = [[("a", 1, None, 0), ("b", 1, "failed", 0), ("c", 1, "failed", 0), ("c", 2, "downloaded", 1), ("", 1, "failed", 1)], [("a", 2, "downloaded", 2), ("d", 3, "failed", 3)], [("clock", 100, None, 1000)], [("b", 3, "failed", 1001)], [("clock", 101, None, 3000)]]
    got = crawl(spark, tmp_path, turns, parts=parts)
    assert got == sorted([
        ("", "retry", "failed", 1), ("", "state", "failed", 1), ("a", "state", "downloaded", 0), ("a", "state", "pending", 0), ("b", "retry", "failed", 1), ("b", "retry", "failed", 2),
        ("b", "state", "failed", 1), ("b", "state", "failed", 2), ("c", "state", "downloaded", 1), ("clock", "state", "pending", 0), ("d", "retry", "failed", 1), ("d", "state", "failed", 1),
    ])
