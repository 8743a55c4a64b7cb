"""Fits see all rows and components, and benign ranks meet in no single window."""

import random

from pyspark.sql import functions as F

from auditloom.operators import detect as D
from auditloom.plans import registry


def test_prototypes_are_fitted_on_all_rows(spark):
    hot = F.col("id") % 3 == 0
    df = spark.range(150_000).select(hot.alias("hot"), F.when(hot, 1e6).otherwise(F.col("id") % 7919).cast("double").alias("a"))
    want = [r[0] for r in df.groupBy("hot").agg(F.avg("a").alias("m")).orderBy("m").select("m").collect()]
    got = sorted(r["values"][0] for r in D.fit_prototypes(df, ["a"], 2).collect())
    assert max(abs(x - y) for x, y in zip(got, want, strict=True)) < 1e-3


def test_embeddings_are_fitted_with_all_components(spark):
    rows = registry.queries()["f05_fit_prototypes"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {len(r["values"]) for r in rows} == {64}


def test_temporal_split_without_a_window_of_all_rows(spark):
    rnd = random.Random(2)
    rows = [(f"t{i:04d}", int(rnd.random() < 0.1), None if rnd.random() < 0.2 else rnd.randrange(40)) for i in range(700)]
    df = D.temporal_benign_split(spark.createDataFrame(rows, "task_id string, label int, first long").repartition(5))
    order = sorted((r for r in rows if r[1] == 0), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    a, b = int(len(order) * 0.70), int(len(order) * 0.15)
    want = {r[0]: "evaluation" for r in rows} | {r[0]: "train" for r in order[:a]} | {r[0]: "validation" for r in order[a:a + b]}
    assert {r.task_id: r.part for r in df.collect()} == want
    assert "windowspecdefinition(label" not in df._jdf.queryExecution().toString()
