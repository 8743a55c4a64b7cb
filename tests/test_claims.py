"""Claims of busy paths: gates and pairs see every event, evidence is cut last."""

import os
import random
import shutil

import pytest

from auditloom.operators import claims as J

SIGNAL = "path_id string, signal string, event_id long, order_index long, us long, process_guid string"
CONTEXT = "path_id string, strong_exec boolean, browser_mail boolean, browser_only boolean, explicit_callback boolean, short_burst boolean, discovery boolean, lineage boolean"
SECOND = 1_000_000


def brute(rows, earlier, later, most, reach=600 * SECOND):
    out = {}
    for path in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == path), key=lambda r: (r[3], r[2]))
        pairs = [(a, b) for a in own if a[1] == earlier for b in own if b[1] == later and a[3] < b[3] and (a[4] is None or b[4] is None or 0 <= b[4] - a[4] <= reach)]
        ids = []
        for a, b in pairs:
            ids += [x for x in (a[2], b[2]) if x not in ids]
        if pairs:
            out[path] = (any(a[5] is not None and a[5] == b[5] for a, b in pairs), ids[:most])
    return out


@pytest.mark.parametrize("seed, falls, nulls", [(1, False, False), (2, False, True), (3, True, False), (4, True, True)])
def test_pair_facts_against_brute_force(spark, seed, falls, nulls):
    rng = random.Random(seed)
    rows, event = [], 0
    for path in range(12):
        us = 0
        for order in range(rng.choice([1, 5, 40])):
            us += rng.choice([0, 1, 60, 700]) * SECOND
            if falls and rng.random() < 0.1:
                us = max(0, us - 500 * SECOND)
            event += 1
            rows.append((f"p{path}", rng.choice(["read", "read", "send", "other"]), event, order, None if nulls and rng.random() < 0.2 else us, rng.choice(["x", "y", None])))
    for most in (2, 16):
        got = {r.path_id: (r.same, r.ids) for r in J.pair_facts(spark.createDataFrame(rows, SIGNAL), "read", "send", most).collect()}
        assert got == brute(rows, "read", "send", most)
    assert J.pair_facts(spark.createDataFrame([], SIGNAL), "read", "send", 4).count() == 0


def test_a_busy_path_keeps_its_leak(spark):
    """Eight external sends, then a sensitive read, then a ninth send of the same process: the ninth makes the claim."""
    rows = [("p", "external_send", i, i, i * SECOND, "x") for i in range(1, 9)] + [("p", "sensitive_strong", 100, 100, 100 * SECOND, "y"), ("p", "external_send", 101, 101, 101 * SECOND, "y")]
    context = spark.createDataFrame([("p", True, False, False, True, False, False, False)], CONTEXT)
    found = {r.behavior: r.evidence for r in J.build_claims(spark.createDataFrame(rows, SIGNAL), context).collect()}
    assert found["sensitive_leak"] == [100, 101] and found["cnc_communication"] == list(range(1, 9))


def test_evidence_is_the_first_of_all_events(spark):
    """Twelve events of each signal: evidence goes on into the next list only where the first is short, whatever the overlap."""
    rows = [("p", "memory", i, i, i * SECOND, "x") for i in (3, 5)] + [("p", s, i, i, i * SECOND, "x") for s in ("external_recv", "precursor") for i in range(1, 13)]
    context = spark.createDataFrame([("p", False, False, False, False, False, False, False), ("empty", True, True, True, True, True, True, True)], CONTEXT)
    found = {r.behavior: r.evidence for r in J.build_claims(spark.createDataFrame(rows, SIGNAL), context).collect()}
    assert found["make_mem_exec"] == [3, 5, 1, 2, 4, 6, 7, 8] and found["interpreter_precursor_chain"] == list(range(1, 9))
    assert J.build_claims(spark.createDataFrame([], SIGNAL), context).count() == 0


def test_changed_files_give_changed_rows(spark, tmp_path):
    """A query of the same session over a rewritten table sees the new rows."""
    from auditloom.plans import registry

    for name in os.listdir("/root/testdata/sf0.001"):
        src = f"/root/testdata/sf0.001/{name}"
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    query = registry.queries()["h02_behaviour_labels"]
    before = query(spark, str(tmp_path)).count()
    events = spark.read.parquet(f"{tmp_path}/events.parquet").toPandas()
    events.head(len(events) // 4).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    after = query(spark, str(tmp_path)).count()
    assert 0 < after < before
