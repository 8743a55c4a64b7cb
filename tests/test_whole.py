"""Queries that take all there is: no object, task or line has more than they look at."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from oracle import connect, difference

from auditloom.plans import registry


def events_of(folder, rows):
    """An events table of (user, type, k), a second apart."""
    start = datetime.datetime(2024, 1, 1)
    cols = {"event_id": range(len(rows)), "ts": [start + datetime.timedelta(seconds=i) for i in range(len(rows))], "user_id": [r[0] for r in rows], "event_type": [r[1] for r in rows], "value": [1.0] * len(rows), "props": [f'{{"k": {r[2]}}}' for r in rows]}
    pq.write_table(pa.table({k: list(v) for k, v in cols.items()}, pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])), folder / "events.parquet")
    return str(folder)


def test_path_stages_take_all_bridges_of_an_object(spark, tmp_path):
    """A web service writes a file that 25 interpreters read."""
    readers = [30 + 70 * i for i in range(25)]
    d = events_of(tmp_path, [(70, "purchase", 0), *[(u, "view", 0) for u in readers]])
    out = registry.queries()["i04_path_stages"](spark, d)
    assert {r.chain[1] for r in out.collect() if r.chain[0] == "p70" and len(r.chain) == 2} == {f"p{u}" for u in readers}
    assert difference(out, connect(d), registry.oracle_sql()["i04_path_stages"]) == ""
    assert registry.queries()["h07_bridge_edges"](spark, d).count() == 20  # its SQL has the first twenty of an object


def test_rescued_chains_have_all_processes(spark):
    """Eight processes with precursor events and a sibling that starts near one; another starts too late."""
    from auditloom.operators import paths as P

    states = spark.createDataFrame([("t", f"p{i}", "root", i * 60_000_000) for i in range(9)] + [("t", "late", "root", 3_600_000_000)], "task_id string, process_guid string, parent_process_guid string, first_us long")
    pre = spark.createDataFrame([("t", f"p{i}", i) for i in reversed(range(8))], "task_id string, process_guid string, event_id int")
    none = spark.createDataFrame([], "task_id string, families array<string>")
    assert [(r.task_id, r.chain) for r in P.rescue_precursor(pre, states, none, 60).collect()] == [("t", [f"p{i}" for i in range(9)])]
