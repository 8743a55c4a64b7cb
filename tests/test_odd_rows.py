"""Core operators on odd tables: nulls in every column, repeated rows and extra columns must not crash, nor change what other rows get; no row gives no row."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.operators import compact as C
from auditloom.operators import graph as G
from auditloom.operators import labels as L
from auditloom.operators.scratch import written
from auditloom.plans.fixture import provenance

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def events(spark):
    return written(provenance(spark, SF).where("task_id in ('task_1', 'task_4') and order_index <= 500").drop("props", "value", "ts", "flow"), "odd")


def labels(e):
    o = C.object_prelabels(e)
    return C.process_prelabels(e, o), o


OPERATORS = {
    "process_states": C.process_states,
    "object_states": C.object_states,
    "semantic_epochs": C.semantic_epochs,
    "recent_network": C.recent_network,
    "object_prelabels": C.object_prelabels,
    "process_prelabels": lambda e: labels(e)[0],
    "compacted": C.compacted,
    "object_versions": C.object_versions,
    "episodes": lambda e: C.episodes(C.compacted(e).where("not skipped")),
    "important_objects": lambda e: C.important_objects(C.triggered(e, *labels(e))),
    "written_then_executed": lambda e: L.written_then_executed(C.semantic_epochs(e)),
    "behaviour_labels": lambda e: L.behaviour_labels(e, *labels(e)),
    "bridge_edges": lambda e: L.bridge_edges(C.semantic_epochs(e), labels(e)[1], 30 * 86_400),
    "staged_objects": lambda e: L.staged_objects(e, labels(e)[1]),
    "node_time_range": lambda e: G.node_time_range(e, "task_id", "process_guid"),
    "classify_object": lambda e: e.select("task_id", X.classify_object("object_type", "object_key").alias("c"), X.flow_endpoints("object_key").alias("f")),
}


def counted(df):
    return Counter(str(tuple(sorted(r.asDict(recursive=True).items()))) for r in df.where("task_id is not null").collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_change_nothing_else(spark, events, name):
    run = OPERATORS[name]
    nothing = events.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])  # two equal rows of nulls
    other = events.limit(3).withColumn("task_id", F.lit(None).cast("string")).withColumn("event_type", F.lit(None).cast("string"))
    odd = events.unionByName(nothing).unionByName(other)
    clean, mixed = run(events), run(odd)
    assert counted(mixed) == counted(clean) and clean.count() > 0
    assert run(events.limit(0)).count() == 0
    run(odd.withColumn("entity", F.lit("clash")).withColumn("label", F.lit("clash")).withColumn("epoch", F.lit(1)).withColumn("labels", F.lit(1))).collect()
