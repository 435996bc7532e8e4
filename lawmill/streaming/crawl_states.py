"""The states of a crawl as a keyed stream: value state for each page address, timers for retries.

    pending --> downloaded | skipped_scanned     settled: what comes later is passed over
            --> failed --> retry, after a wait that grows with the attempts, `most` times at most

A row says what happened to an address: seen, or the outcome of an attempt. A change of state gives a row of kind "state", an elapsed
timer one of kind "retry", which asks the crawler to try again. Rows of one micro-batch are taken in the order of `seq`; a null status
is a sighting; a null key is an address of its own.

Most addresses have a row or two, so their cost is that of the calls to the state store. Addresses therefore lie in parts, by hash: the
state of a part is a table of its addresses and of the times when they are due, a micro-batch is folded into it in whole columns, and one
timer stands for all, at the earliest time. A part that a micro-batch touches is read and written whole; with parts=0 each address
has a state of its own, which suits small batches over many addresses: one call to get, one to update, timers after failures only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lawmill.operators.ledger import DOWNLOADED, FAILED, PENDING, SCANNED

STATE = "status string, attempts int, seq long"
OUT = "key string, kind string, status string, attempts int, seq long"
PART_STATE = "addresses binary, dues binary, armed long"
#: Parts of the addresses, unless told otherwise.
PARTS = 512
#: Numbers of states in a part's table; 0: none yet.
_NAMES = [None, PENDING, FAILED, DOWNLOADED, SCANNED]
_SETTLED = 3
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Crawl(StatefulProcessor):
    """[STR-2, STR-5, STR-7] One address: rows(key, seq, status, ts in milliseconds)."""

    def __init__(self, most: int = 3, wait: int = 60_000):
        self.most, self.wait = most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("crawl", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        news = sorted(((r["seq"], r["status"], r["ts"]) for r in rows), key=lambda r: r[0])
        status, attempts, seq = self.state.get() or (None, 0, -1)
        before = status, attempts
        for n, said, ts in news:
            if status in (DOWNLOADED, SCANNED):
                break
            if said in (DOWNLOADED, SCANNED):
                status, seq = said, int(n)
            elif said == FAILED:
                status, attempts, seq = FAILED, attempts + 1, int(n)
                if attempts < self.most:
                    self.handle.registerTimer(int(ts) + self.wait * attempts)
            elif status is None:
                status, seq = PENDING, int(n)
        if (status, attempts) != before:
            self.state.update((status, attempts, seq))
            if status in (DOWNLOADED, SCANNED) and attempts:
                for due in list(self.handle.listTimers()):
                    self.handle.deleteTimer(due)
            yield self.row(key, "state", status, attempts, seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, attempts, seq = self.state.get()
        if status == FAILED:
            yield self.row(key, "retry", status, attempts, seq)

    def row(self, key, kind: str, status: str, attempts: int, seq: int) -> Row:
        return Row(key=key[0], kind=kind, status=status, attempts=attempts, seq=seq)

    def close(self) -> None:
        pass


def _packed(columns: dict) -> bytes:
    batch, out = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[pa.Array]:
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches(max_chunksize=None)[0].columns if data else []


class Part:
    """The addresses of a part: keys, state, attempts and seq of each; and (address, time) of what is due."""

    def __init__(self, addresses: bytes = b"", dues: bytes = b""):
        none = [pa.array([], pa.string()), *(pa.array([], t) for t in (pa.int8(), pa.int32(), pa.int64()))]
        keys, *numbers = _unpacked(addresses) or none
        self.keys = keys
        self.state, self.attempts, self.seq = (x.to_numpy(zero_copy_only=False).copy() for x in numbers)
        self.who, self.due = (x.to_numpy(zero_copy_only=False) for x in _unpacked(dues) or (pa.array([], pa.int64()),) * 2)

    def packed(self) -> tuple[bytes, bytes]:
        return _packed({"key": self.keys, "state": self.state, "attempts": self.attempts, "seq": self.seq}) if len(self.keys) else b"", _packed({"who": self.who, "due": self.due}) if len(self.due) else b""

    def take(self, keys: pa.Array, seq: np.ndarray, status: pa.Array, ts: pa.Array, most: int, wait: int) -> np.ndarray:
        """The rows of a micro-batch, each address's in the order of seq; numbers of the addresses whose state has changed."""
        every = pa.chunked_array([self.keys, keys]).combine_chunks().dictionary_encode("encode")
        numbers = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        old = len(self.keys)
        self.keys = every.dictionary
        grown = len(self.keys) - old
        self.state, self.attempts, self.seq = (np.concatenate([x, np.full(grown, v, x.dtype)]) for x, v in ((self.state, 0), (self.attempts, 0), (self.seq, -1)))
        order = np.lexsort((seq, numbers[old:]))
        who, seq = numbers[old:][order], seq[order]
        said = np.array([{FAILED: 2, DOWNLOADED: 3, SCANNED: 4}.get(x, 1) for x in status.to_pylist()], np.int8)[order]
        first = np.concatenate([[True], who[1:] != who[:-1]])[: len(who)]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
        # what comes after a settled state is passed over
        ended = np.cumsum(said >= _SETTLED) - (said >= _SETTLED)
        open_ = (self.state[who] < _SETTLED) & (ended == ended[begin])
        failed = open_ & (said == 2)
        tries = np.cumsum(failed) - (np.cumsum(failed) - failed)[begin]
        told = failed | (open_ & (said >= _SETTLED)) | (first & (self.state[who] == 0))
        tries += self.attempts[who]
        again = failed & (tries < most)
        at = ts.take(pa.array(order[again]))
        if at.null_count:
            raise ValueError("a failed attempt must have a time")
        dues = np.column_stack([np.concatenate([self.who, who[again]]), np.concatenate([self.due, at.to_numpy(zero_copy_only=False).astype(np.int64) + wait * tries[again]])])
        # rows are in order, so the last one told of an address is what stays
        spot = np.flatnonzero(told)
        last = spot[np.concatenate([who[spot][1:] != who[spot][:-1], [True]])[: len(spot)]]
        changed = who[last]
        self.state[changed], self.attempts[changed], self.seq[changed] = said[last], tries[last], seq[last]
        # a timer of an address at a time is one; settled addresses have none
        dues = np.unique(dues[self.state[dues[:, 0]] < _SETTLED], axis=0)
        self.who, self.due = dues[:, 0].copy(), dues[:, 1].copy()
        return changed

    def elapsed(self, now: int) -> np.ndarray:
        """Numbers of the failed addresses that were due by now, in order of time; they are due no more."""
        gone = np.flatnonzero(self.due <= now)
        gone = self.who[gone[np.argsort(self.due[gone], kind="stable")]]
        self.who, self.due = self.who[self.due > now], self.due[self.due > now]
        return gone[self.state[gone] == 2]

    def rows(self, who: np.ndarray, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"key": self.keys.take(pa.array(who)).to_pylist(), "kind": kind, "status": np.array(_NAMES, object)[self.state[who]], "attempts": self.attempts[who], "seq": self.seq[who]})


class CrawlParts(StatefulProcessor):
    """[STR-2, STR-5, STR-7] A part of the addresses: rows(key, seq, status, ts in milliseconds)."""

    def __init__(self, most: int = 3, wait: int = 60_000):
        self.most, self.wait = most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("part", PART_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news = pd.concat(list(rows), ignore_index=True)
        if news["seq"].isna().any():
            raise ValueError("a row must have a seq")
        addresses, dues, armed = self.state.get() or (b"", b"", None)
        part = Part(addresses, dues)
        text = lambda c: pa.array(news[c], pa.string(), from_pandas=True)
        changed = part.take(text("key"), news["seq"].to_numpy(np.int64), text("status"), pa.array(news["ts"], from_pandas=True), self.most, self.wait)
        if len(changed):
            self.put(part, armed)
            yield part.rows(changed, "state")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        addresses, dues, _ = self.state.get()
        part = Part(addresses, dues)
        gone = part.elapsed(timerValues.getCurrentWatermarkInMs())
        # the timer that has elapsed is taken away by Spark
        self.put(part, None)
        if len(gone):
            yield part.rows(gone, "retry")

    def put(self, part: Part, armed: int | None) -> None:
        """Keeps the part, with its timer at the earliest time that is due."""
        due = int(part.due.min()) if len(part.due) else None
        if due != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((*part.packed(), due))

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Value state and timers need the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def crawl_states(rows: DataFrame, most: int = 3, wait: int = 60_000, late: str = "10 minutes", parts: int = PARTS) -> DataFrame:
    """States and retries of a stream of rows(key string, seq long, status string, time timestamp). A row must have a time.

    parts: the number of parts that addresses lie in, which must stay as it is for a checkpoint; 0 for a state an address.
    """
    timed = rows.withWatermark("time", late).selectExpr("key", "seq", "status", "unix_millis(time) AS ts", "time")
    if not parts:
        return timed.groupBy("key").transformWithState(Crawl(most, wait), OUT, "Append", "EventTime")
    dealt = timed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").transformWithStateInPandas(CrawlParts(most, wait), OUT, "Append", "EventTime")
