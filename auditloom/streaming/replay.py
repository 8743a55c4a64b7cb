"""Stateful stages that take each key's events in order of time, whatever the order in which triggers bring them.

The first stage of a chain holds events back until the watermark has passed them, so an event that comes late but inside the watermark takes its
place; later stages get events that are settled. Each stage is a step over settled events and a small state of named values for each key, which ends
`keep_seconds` after the key's last event. Keys are dealt by their hash to a fixed number of shards, and Spark's state is one list for each shard, so a trigger costs a
few calls of the state store for each shard and not for each key. Rows beyond the watermark are dropped and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP_SECONDS = 90 * 86_400
#: Shards of a stage, whatever the session: a restarted query must find its keys where they were.
SHARDS = 256
CHUNK = 10_000


def _packed(rows: pd.DataFrame) -> tuple[bytes, int]:
    """Rows as Arrow bytes, and the earliest of their times."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes(), int(rows["us"].min())


def _unpacked(chunk: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(chunk))).read_pandas()


class Stage(StatefulProcessor):
    """One shard of a stage. step({key: state}, key of each row, settled events in order) -> (rows out, {key: state} of the keys that had rows); end(key, state, watermark in us, all gone?) -> (list of rows out, state or None, next wake or none), for
    each key of the shard whenever it has rows or a timer (a wake, or the expiry) fires."""

    def __init__(self, keys: list[str], step: Callable, state: str, columns: list[str], out: list[str], buffered: bool, keep_seconds: int, end: Callable | None = None):
        self.keys, self.step, self.state_ddl, self.columns, self.out, self.buffered, self.keep, self.end = keys, step, state, columns, out, buffered, keep_seconds, end

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getListState("state", f"{self.state_ddl}, _last bigint")
        self.buffer = handle.getListState("buffer", "chunk binary, low bigint") if self.buffered else None

    def handleInputRows(self, key, rows, timerValues):
        return self.advance(pd.concat(list(rows), ignore_index=True), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self.advance(None, timerValues)

    def settled(self, new, mark: int):
        """The rows that the watermark has passed, and the earliest time of the others, which are held in chunks. Chunks that are not due are not read."""
        chunks = [tuple(c) for c in self.buffer.get()] if self.buffer.exists() else []
        due, later = [c for c in chunks if c[1] <= mark], [c for c in chunks if c[1] > mark]
        parts = [_unpacked(c[0]) for c in due] + ([] if new is None else [new[self.columns]])
        if not parts:
            return None, min((c[1] for c in later), default=None)
        rows = pd.concat(parts, ignore_index=True)
        passed = rows["us"] <= mark
        rest = rows[~passed].sort_values("us", kind="stable")
        fresh = [_packed(rest.iloc[i:i + CHUNK]) for i in range(0, len(rest), CHUNK)]
        if due and (later or fresh):
            self.buffer.put([*later, *fresh])
        elif due:
            self.buffer.clear()
        elif fresh:
            self.buffer.appendList(fresh)
        return rows[passed], min((c[1] for c in [*later, *fresh]), default=None)

    def advance(self, new, timers):
        mark = timers.getCurrentWatermarkInMs() * 1000
        rows, wake = self.settled(new, mark) if self.buffer is not None else (new, None)
        wakes = [] if wake is None else [wake // 1000 + 1]
        n = len(self.keys)
        before = {tuple(s[:n]): (tuple(s[n:-1]), s[-1]) for s in self.state.get()} if self.state.exists() else {}
        now = dict(before)
        if rows is not None and len(rows):
            rows = rows.sort_values(["us", "event_id"], kind="stable", ignore_index=True)
            ids = list(zip(*[rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in self.keys]))
            last = dict(zip(ids, rows["us"].tolist()))  # rows are in order of time
            out, values = self.step({k: s[0] for k, s in before.items()}, ids, rows)
            now |= {k: (v, max(last[k], before[k][1]) if k in before else last[k]) for k, v in values.items()}
            if len(out):
                yield out[self.out]
        ended, kept = [], {}
        for key, (values, last) in now.items():
            gone = last + self.keep * 1_000_000 <= mark
            if self.end is not None:
                more, values, wake = self.end(key, values, mark, gone)
                ended += more
                if wake is not None and wake > mark and not gone:
                    wakes.append(int(wake) // 1000 + 1)
            if not gone and values is not None:
                kept[key] = (values, last)
                wakes.append(last // 1000 + self.keep * 1000 + 1)
        if ended:
            yield pd.DataFrame(ended, columns=self.out)
        if kept != before:
            states = [(*k, *v, last) for k, (v, last) in kept.items()]
            self.state.put(states[:CHUNK]) if states else self.state.clear()
            for i in range(CHUNK, len(states), CHUNK):
                self.state.appendList(states[i:i + CHUNK])
        if wakes:
            self.handle.registerTimer(min(wakes))


def staged(events: DataFrame, keys: list[str], step: Callable, state: str, added: str, buffered: bool = False, keep_seconds: int = KEEP_SECONDS, end: Callable | None = None, replace: bool = False, shards: int = SHARDS) -> DataFrame:
    """events (with us, event_id and the event time ts) through a stage keyed by `keys`: the columns of events and the added ones, or the added ones only.

    Needs the RocksDB state store, which is set in the session. A stage without `buffered` must follow one with it. All keys of a shard pass one call,
    so more shards than tasks are wanted, and a query must keep its number of shards over restarts."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = events.columns
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    own = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    out = added if replace else f"{own}, {added}"
    names = [c.strip().split()[0].strip("`") for c in _split(out)]
    state = ", ".join(f"_key{i} {kinds[k]}" for i, k in enumerate(keys)) + f", {state}"
    stage = Stage(keys, step, state, columns, names, buffered, keep_seconds, end)
    shard = F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")
    return events.withColumn("_shard", shard).groupBy("_shard").transformWithStateInPandas(stage, out, "Append", "EventTime", eventTimeColumnName="" if replace else "ts")


def _split(ddl: str) -> list[str]:
    """Columns of a DDL text, apart at the commas outside of brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]
