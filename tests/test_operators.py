"""Operators on hand-built rows: golden cases, defined results for nulls, ties and empty input."""

import json
import random

from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.operators import compact as C
from auditloom.operators import graph as G
from auditloom.operators import identity as I
from auditloom.operators import labels as L
from auditloom.operators import paths as P
from auditloom.sources import logs as A


def test_scalars_of_null_and_odd_values(spark):
    df = spark.createDataFrame([(None, None), ("", ""), ("  /tmp//a ", "FILE"), ("C:\\Temp\\x.ZIP", "file"), ("10.1.2.3:4->8.8.8.8:53", "flow"), ("999.1.1.1", "flow")], "key string, kind string")
    got = [r.c for r in df.select(X.classify_object("kind", "key").alias("c")).collect()]
    assert got == ["object", "object", "temp_file", "archive_file", "external_ip", "network"]
    r = df.select(*[f("key").alias(f"x{i}") for i, f in enumerate((X.process_name, X.process_exe, X.basename, X.object_name, X.extract_cmd_path, X.to_epoch_seconds, X.is_external_ip, X.ip_number))]).collect()
    assert len(r) == 6 and r[0].x5 is None and r[0].x6 is False and r[5].x7 is None


def test_epoch_units(spark):
    rows = [("1523000000000000000", 1523000000.0), ("1523000000000000", 1523000000.0), ("1523000000000", 1523000000.0), ("1523000000", 1523000000.0), ("2018-04-06T07:33:20Z", 1523000000.0), ("nope", None), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r.s for r in df.select(X.to_epoch_seconds("t").alias("s")).collect()] == [b for _, b in rows]


def test_segmentation_golden(spark):
    e = spark.createDataFrame([("B", "A"), ("C", "A"), ("D", "A"), ("E", "B"), ("F", "B"), ("G", "B")], "child string, parent string")
    top = e.union(spark.createDataFrame([("A", "R")], "child string, parent string"))
    assert {r.node for r in G.segment_nodes(top, 2).collect()} == {"B"}
    assert {r.node for r in G.segment_nodes(top, 2, count_segmented=True).collect()} == {"A", "B"}
    comp = {(r.root, r.node, r.is_boundary) for r in G.task_components(top, G.segment_nodes(top, 2)).collect()}
    assert comp == {("R", "R", False), ("R", "A", False), ("R", "B", True), ("R", "C", False), ("R", "D", False), ("B", "B", False), ("B", "E", False), ("B", "F", False), ("B", "G", False)}


def test_segmentation_against_recursion(spark):
    rnd = random.Random(4)
    edges = {i: rnd.randrange(max(0, i - 6), i) for i in range(1, 60)}
    kids = {}
    for c, p in edges.items():
        kids.setdefault(p, []).append(c)
    cut = set()
    for n in sorted(range(60), reverse=True):  # children have larger numbers
        if n in edges and sum(k not in cut for k in kids.get(n, [])) > 2:
            cut.add(n)
    df = spark.createDataFrame(list(edges.items()), "child long, parent long")
    assert {r.node for r in G.segment_nodes(df.repartition(5), 2).collect()} == cut


def test_components_of_chains_and_order(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 1)]
    random.Random(1).shuffle(rows)
    for parts in (1, 7):
        got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(rows, "a long, b long").repartition(parts)).collect()}
        assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


EVENT = "task_id string, event_id long, order_index long, us long, process_guid string, process_name string, parent_process_guid string, event_type string, object_type string, object_key string, object_class string"


def events(spark, rows):
    """(seconds or null, process, event, object, class) in order."""
    return spark.createDataFrame([("t", i, i, None if s is None else s * 1_000_000, p, "app", None, e, "file", o, c) for i, (s, p, e, o, c) in enumerate(rows)], EVENT)


def test_semantic_skip_replica(spark):
    rnd = random.Random(7)
    rows, now = [], 0
    for _ in range(300):
        now += rnd.choice([1, 5, 400, 900])
        rows.append((None if rnd.random() < 0.05 else now, rnd.choice("pq"), rnd.choice(["READ", "READ", "OPEN", "WRITE", "EXEC"]), rnd.choice(["/opt/a", "/opt/b"]), "file"))
    e = C.semantic_epochs(events(spark, rows)).withColumn("process_signature", F.lit("")).withColumn("object_signature", F.lit(""))
    got = {r.event_id for r in C.semantic_skip(C.force_keep(e)).where("skipped").collect()}
    table, oep, pep, want = {}, {}, {}, set()
    for i, (s, p, t, o, _) in enumerate(rows):
        state = (oep.get(o, 0), pep.get(p, 0))
        seen = table.get((p, t, o))
        if t != "EXEC" and seen and seen[1] == state and (s is None or seen[0] is None or s - seen[0] <= 600):
            want.add(i)
        oep[o] = oep.get(o, 0) + (t == "WRITE")
        pep[p] = pep.get(p, 0) + (t == "EXEC")
        table[p, t, o] = (s, (oep[o], pep[p]))
    assert got == want and want


def test_bridge_needs_same_version(spark):
    rows = [(0, "p", "WRITE", "/tmp/x", "temp_file"), (10, "q", "EXEC", "/tmp/x", "temp_file"), (20, "r", "WRITE", "/tmp/x", "temp_file"), (30, "p", "READ", "/tmp/x", "temp_file"), (9000, "q", "READ", "/tmp/x", "temp_file")]
    e = C.semantic_epochs(events(spark, rows))
    got = {(r.src, r.dst, r.bridge_type, r.confidence) for r in L.bridge_edges(e, C.object_prelabels(events(spark, rows))).collect()}
    assert got == {("p", "q", "write_to_exec", 0.93), ("r", "p", "write_to_read", 0.55)}


def test_paths_are_simple_and_timed(spark):
    edges = spark.createDataFrame([("t", "a", "b", "parent", 10, 0.0), ("t", "b", "c", "bridge", 20, 0.9), ("t", "c", "a", "parent", 30, 0.0), ("t", "b", "d", "parent", 5, 0.0)], "task_id string, src string, dst string, kind string, edge_us long, confidence double")
    seeds = spark.createDataFrame([("t", "a")], "task_id string, process string")
    assert sorted(r.chain for r in P.search_paths(edges, seeds, 4).collect()) == [["a", "b"], ["a", "b", "c"]]
    assert P.search_paths(edges.limit(0), seeds, 3).count() == 0


def test_staging_sequence(spark):
    good = [(0, "p", "WRITE", "/srv/x", "file"), (60, "p", "CHMOD", "/srv/x", "file"), (120, "p", "EXEC", "/srv/x", "file")]
    late = [(0, "p", "WRITE", "/srv/y", "file"), (60, "p", "CHMOD", "/srv/y", "file"), (90, "p", "WRITE", "/srv/y", "file"), (120, "p", "EXEC", "/srv/y", "file")]
    assert [r.object_key for r in L.staged_objects(events(spark, good + late)).collect()] == ["/srv/x"]


def test_overlap_join_counts_pairs_once(spark):
    rnd = random.Random(3)
    a = [(i, s, s + rnd.randrange(0, 500)) for i, s in enumerate(rnd.randrange(0, 3000) for _ in range(60))]
    b = [(i, s, s + rnd.randrange(0, 900)) for i, s in enumerate(rnd.randrange(0, 3000) for _ in range(40))]
    got = sorted((r.x, r.y) for r in I.overlap_join(spark.createDataFrame(a, "x long, lo long, hi long"), spark.createDataFrame(b, "y long, rlo long, rhi long"), [], 100).collect())
    assert got == sorted((x, y) for x, lo, hi in a for y, rlo, rhi in b if lo <= rhi and rlo <= hi)


def test_raw_records(spark, tmp_path):
    pre = "com.bbn.tc.schema.avro.cdm18."
    good = '{"datum":{"' + pre + 'Event":{"type":"EVENT_WRITE","timestampNanos":1523000000000000000,"subject":{"' + pre + 'UUID":"S1"},"predicateObject":{"' + pre + 'UUID":"O1"},"predicateObjectPath":{"string":"/tmp/a"}}}}'
    lines = spark.createDataFrame([(x,) for x in (good, "x " + good + " y", good[:40], "", None, good.replace("O1", " "))], "line string")
    got = [tuple(r) for r in A.cdm_events(lines).collect()]
    assert got == [("S1", "O1", "WRITE", 1523000000, "/tmp/a")] * 2
    (tmp_path / "b.json").write_text(json.dumps({"objects": [
        {"type": "x-mitre-tactic", "name": "Execution", "x_mitre_shortname": "execution", "external_references": [{"source_name": "mitre-attack", "external_id": "TA0002"}]},
        {"type": "attack-pattern", "name": "Shell", "kill_chain_phases": [{"phase_name": "execution"}, {"phase_name": "impact"}], "external_references": [{"source_name": "x", "external_id": "1"}, {"source_name": "mitre-attack", "external_id": "T1059"}]},
        {"type": "attack-pattern", "name": "Old", "revoked": True}]}))
    assert {r.external_id: r.tactic_ids for r in A.read_stix(spark, str(tmp_path / "b.json")).collect()} == {"TA0002": ["TA0002"], "T1059": ["TA0002", "TA0040"]}


def test_empty_events(spark):
    e = events(spark, [])
    assert C.compacted(e).count() == 0 and C.object_versions(e).count() == 0 and L.staged_objects(e).count() == 0 and I.entity_index(e).count() == 0
