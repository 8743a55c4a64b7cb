"""Evaluation of predicted paths against time-stamped ground truth.

Paths: path_id, task_id, host, lo, hi (seconds), risk_level, risk_score, process_chain, tactics, techniques.
Windows: window_id, host, rlo, rhi, status, precision, gt_tactics, gt_techniques.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.identity import overlap_join


def _span_match(spans: DataFrame, windows: DataFrame, pad: int, near: int, bucket: int) -> DataFrame:
    """spans (host, lo, hi) and windows (host, rlo, rhi, further columns) that meet or nearly meet: both sides' columns and the facts of time_match."""
    reach = max(near, 0)
    wide = windows.withColumns({"_rlo": F.col("rlo"), "_rhi": F.col("rhi"), "rlo": F.col("rlo") - pad - reach, "rhi": F.col("rhi") + pad + reach})
    p = overlap_join(spans, wide, ["host"], bucket)
    a, b = F.col("rlo") + reach, F.col("rhi") - reach
    inside = (F.col("lo") >= a) & (F.col("hi") <= b)
    raw = F.greatest(F.least("hi", b) - F.greatest("lo", a), F.lit(0)).cast("double")
    p = p.withColumn("overlap", F.when((F.col("lo") == F.col("hi")) & inside & (raw <= 0), 1.0).otherwise(raw))
    p = p.withColumn("ratio", F.col("overlap") / F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo")).cast("double")))
    mid = (F.col("lo") + F.col("hi")) / 2
    p = p.withColumn("mid_inside", mid.between(a, b)).withColumn("loose", (F.col("overlap") > 0) | inside).withColumn("strict", (F.col("ratio") >= 0.8) | inside)
    p = p.withColumn("primary", F.col("loose") & ((F.col("ratio") >= 0.5) | F.col("mid_inside") | inside)).withColumn("near_miss", ~F.col("loose")).withColumn("mid_gap", F.abs(mid - (a + b) / 2))
    return p.withColumns({"rlo": F.col("_rlo"), "rhi": F.col("_rhi")}).drop("_rlo", "_rhi")


def time_match(paths: DataFrame, windows: DataFrame, pad: int = 0, near: int = 0, bucket: int = 86_400, places: int | None = None) -> DataFrame:
    """(path_id, window_id, overlap, ratio, mid_inside, strict, primary, loose, near_miss, mid_gap) of pairs on one host that meet or nearly meet.

    Windows are widened by `pad` seconds; the ratio is of the path's own length, one second at least; an instant within a
    window overlaps it by one second; near misses lie within `near` seconds of it. Equal spans of time are matched once, and the ratio
    is rounded there (to `places`, if given); the pairs of rows come out of the last join, which copies values only, and are not shuffled."""
    met = _span_match(paths.select("host", "lo", "hi").distinct(), windows.select("host", "rlo", "rhi").distinct(), pad, near, bucket)
    if places is not None:
        met = met.withColumn("ratio", F.round("ratio", places))
    pairs = paths.select("path_id", "host", "lo", "hi").join(met, ["host", "lo", "hi"]).join(windows.select("window_id", "host", "rlo", "rhi"), ["host", "rlo", "rhi"])
    return pairs.select("path_id", "window_id", "overlap", "ratio", "mid_inside", "strict", "primary", "loose", "near_miss", "mid_gap")


def assign_windows(paths: DataFrame, windows: DataFrame, pad: int = 0, near: int = 0, bucket: int = 86_400) -> DataFrame:
    """(path_id, match, window_id, ratio, near_window): each path's best confirmed window by ratio and middle, else its best attempted one, else off-window.

    Of windows with equal host, times and status only the smallest id can be chosen, and paths with equal host and times choose alike, so distinct spans meet, not rows."""
    first = windows.groupBy("host", "rlo", "rhi", "status").agg(F.min("window_id").alias("window_id")).where("window_id is not null")
    m = _span_match(paths.select("host", "lo", "hi").distinct(), first, pad, near, bucket)
    place = F.struct(F.when(F.col("status") == "confirmed", 0).otherwise(1).alias("place"), (-F.col("ratio")).alias("less"), "mid_gap", "window_id", "status")
    able = F.col("primary") & F.col("status").isin("confirmed", "attempted_failed")
    best = m.groupBy("host", "lo", "hi").agg(F.min(F.when(able, place)).alias("_hit"), F.min(F.when(F.col("near_miss"), F.col("window_id"))).alias("_near"))
    own = paths.select("path_id", "host", "lo", "hi").join(best, ["host", "lo", "hi"]).groupBy("path_id").agg(F.min("_hit").alias("_hit"), F.min("_near").alias("_near"))
    return paths.select("path_id").join(own, "path_id", "left").select(
        "path_id", F.coalesce("_hit.status", F.lit("off_window")).alias("match"), F.col("_hit.window_id").alias("window_id"), F.coalesce(-F.col("_hit.less"), F.lit(0.0)).alias("ratio"), F.when(F.col("_hit").isNull(), F.col("_near")).alias("near_window"))


CONTINUATION_SECONDS = 900


def reattach_continuations(assignments: DataFrame, paths: DataFrame, windows: DataFrame, seconds: int = CONTINUATION_SECONDS) -> DataFrame:
    """(path_id, window_id, anchor): off-window paths that go on from a confirmed path of their host and task.

    An anchor shares a process or a bridge object with the path, has all its tactics, and overlaps it in time, or its window ends at most `seconds` before the path
    begins. The anchor with the most shared processes counts, then the longest overlap, the smallest gap and the smallest path id. Paths without both times, and
    windows without an end, take no part; a null item is none. Rows that repeat a path id with other times count as they are. Paths meet by host, task and shared item, so only pairs that share something are formed.
    """
    p = assignments.select("path_id", "match", "window_id").join(paths.select("path_id", "host", "task_id", "lo", "hi", "process_chain", "bridge_objects", "tactics"), "path_id").where("match in ('off_window', 'confirmed')")
    known = lambda c: F.array_compact(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    items = F.concat(F.transform(known("process_chain"), lambda x: F.struct(F.lit(1).alias("kind"), x.alias("item"))), F.transform(known("bridge_objects"), lambda x: F.struct(F.lit(0).alias("kind"), x.alias("item"))))
    p = p.withColumn("tactics", known("tactics")).withColumn("_x", F.explode(items)).select("*", "_x.kind", "_x.item").where("trim(item) <> ''").drop("_x", "process_chain", "bridge_objects")
    end = windows.where("rhi is not null").select("window_id", F.col("rhi").alias("_end"))
    off = p.where("match = 'off_window' and lo is not null and hi is not null").drop("match", "window_id")
    on = p.where("match = 'confirmed'").join(end, "window_id").select("host", "task_id", "kind", "item", "window_id", "_end", F.col("path_id").alias("anchor"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("tactics").alias("_t"))
    pairs = off.join(on, ["host", "task_id", "kind", "item"]).where(F.size(F.array_except("tactics", "_t")) == 0)
    overlap = F.coalesce(F.greatest(F.least("hi", "_hi") - F.greatest("lo", "_lo"), F.lit(0)), F.lit(0)).alias("_overlap")
    pairs = pairs.select("path_id", "window_id", "anchor", F.when(F.col("kind") == 1, F.col("item")).alias("_process"), F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), 0).otherwise(overlap).alias("_overlap"), F.greatest(F.col("lo") - F.col("_end"), F.lit(0)).alias("_gap")).where((F.col("_overlap") > 0) | (F.col("_gap") <= seconds))
    best = pairs.groupBy("path_id", "window_id", "anchor", "_overlap", "_gap").agg(F.count_distinct("_process").alias("_shared"))
    w = Window.partitionBy("path_id").orderBy(F.desc("_shared"), F.desc("_overlap"), "_gap", "anchor")
    return best.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("path_id", "window_id", "anchor")


def _share(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def window_level(assignments: DataFrame, windows: DataFrame, paths: DataFrame, top_n: int = 5) -> DataFrame:
    """One row for each confirmed minute window: hits, split factor, tactic and technique sets of its top paths, recall and precision."""
    conf = windows.where("status = 'confirmed' and precision = 'minute_window'")
    p = assignments.where("match = 'confirmed'").join(paths, "path_id")
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("window_id").orderBy(F.desc("risk_score"), F.desc("ratio"), "path_id")))
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_r") <= top_n, F.col(c))))))
    risky = F.col("risk_level").isin("high", "medium")
    g = p.groupBy("window_id").agg(F.count("*").alias("split"), F.bool_or(risky).alias("hit"), F.bool_or(risky & (F.col("ratio") >= 0.8)).alias("strict_hit"), F.bool_or(F.col("risk_level") == "high").alias("high_hit"), sets("tactics").alias("pred_tactics"), sets("techniques").alias("pred_techniques"))
    none = F.array().cast("array<string>")
    df = conf.join(g, "window_id", "left").withColumns({c: F.coalesce(c, none) for c in ("pred_tactics", "pred_techniques")}).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("hit", "strict_hit", "high_hit")}).withColumn("split", F.coalesce("split", F.lit(0)))
    for k in ("tactics", "techniques"):
        both = F.size(F.array_intersect(f"pred_{k}", f"gt_{k}"))
        df = df.withColumn(f"{k}_tp", both).withColumn(f"{k}_recall", _share(both, F.size(f"gt_{k}"))).withColumn(f"{k}_precision", F.when(F.col("split") > 0, _share(both, F.size(f"pred_{k}"))))
    return df


def evaluate(assignments: DataFrame, windows: DataFrame, paths: DataFrame, top_n: int = 5) -> DataFrame:
    """One row: window recalls, macro and micro tactic and technique recall and precision, full coverage, off-window risk, split factors and attempt rate."""
    w = window_level(assignments, windows, paths, top_n)
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    cols = [rate(F.col(c)).alias(n) for c, n in (("hit", "window_recall"), ("strict_hit", "strict_recall"), ("high_hit", "high_recall"), ("tactics_recall", "tactic_recall_macro"), ("tactics_precision", "tactic_precision_macro"), ("techniques_recall", "technique_recall_macro"), ("techniques_precision", "technique_precision_macro"))]
    cols += [_share(F.coalesce(F.sum("tactics_tp"), F.lit(0)), F.coalesce(F.sum(F.size("gt_tactics")), F.lit(0))).alias("tactic_recall_micro"), _share(F.coalesce(F.sum("tactics_tp"), F.lit(0)), F.coalesce(F.sum(F.size("pred_tactics")), F.lit(0))).alias("tactic_precision_micro"),
             rate(F.size(F.array_except("gt_techniques", "pred_techniques")) == 0).alias("full_coverage"), F.coalesce(F.avg("split"), F.lit(0.0)).alias("split_mean"), F.coalesce(F.percentile("split", F.lit(0.5)), F.lit(0.0)).alias("split_median"), F.coalesce(F.percentile("split", F.lit(0.95)), F.lit(0.0)).alias("split_p95"), F.count("*").alias("windows")]
    off = assignments.where("match = 'off_window'").join(paths.select("path_id", "risk_level"), "path_id").agg(rate(F.col("risk_level") == "high").alias("off_window_high_risk_rate"))
    tried = windows.where("status = 'attempted_failed' and precision = 'minute_window'").select("window_id").join(assignments.where("match = 'attempted_failed'").select("window_id", F.lit(True).alias("_h")).distinct(), "window_id", "left").agg(rate(F.col("_h").isNotNull()).alias("attempt_flag_rate"))
    return w.agg(*cols).crossJoin(off).crossJoin(tried)  # one row each


def set_comparison(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """rows plus overlap, missed and extra of two arrays, sorted."""
    return rows.withColumn("overlap", F.array_sort(F.array_intersect(pred, truth))).withColumn("missed", F.array_sort(F.array_except(truth, pred))).withColumn("extra", F.array_sort(F.array_except(pred, truth)))


def shift_windows(windows: DataFrame, minutes: int) -> DataFrame:
    """Windows moved by whole minutes, back if negative; missing ends stay missing."""
    return windows.withColumn("rlo", F.col("rlo") + minutes * 60).withColumn("rhi", F.col("rhi") + minutes * 60)


def merge_broad_techniques(strict: DataFrame, broad: DataFrame, bucket: int = 86_400) -> DataFrame:
    """strict windows plus broad_techniques: those of the broad window of the same host with the largest overlap; ties by id.

    Distinct spans meet: of broad windows with equal host and times only the smallest id can be chosen, and strict windows with equal host and times choose alike."""
    b = broad.groupBy("host", "rlo", "rhi").agg(F.min(F.struct(F.col("window_id").alias("_b"), F.col("gt_techniques").alias("_t"))).alias("_first")).select("host", "rlo", "rhi", "_first.*")
    p = overlap_join(strict.select("host", F.col("rlo").alias("lo"), F.col("rhi").alias("hi")).distinct(), b, ["host"], bucket)
    less = F.greatest("lo", "rlo") - F.least("hi", "rhi")
    best = p.groupBy("host", F.col("lo").alias("rlo"), F.col("hi").alias("rhi")).agg(F.min(F.struct(less.alias("less"), "_b", "_t")).alias("_best"))
    none = F.array().cast("array<string>")
    return strict.join(best, ["host", "rlo", "rhi"], "left").select(*[strict[c] for c in strict.columns], F.coalesce("_best._t", none).alias("broad_techniques"))


def ground_truth_summary(windows: DataFrame) -> DataFrame:
    """Per host: windows by status, and all tactics."""
    return windows.groupBy("host").agg(F.count("*").alias("windows"), F.count(F.when(F.col("status") == "confirmed", 1)).alias("confirmed"), F.count(F.when(F.col("status") == "attempted_failed", 1)).alias("attempted"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("gt_tactics")))).alias("tactics"))


def predicted_paths(paths: DataFrame, timelines: DataFrame) -> DataFrame:
    """paths whose missing time range is taken from their timeline (path_id, us)."""
    t = timelines.groupBy("path_id").agg(F.floor(F.min("us") / 1_000_000).alias("_lo"), F.floor(F.max("us") / 1_000_000).alias("_hi"))
    return paths.join(t, "path_id", "left").withColumn("lo", F.coalesce("lo", "_lo")).withColumn("hi", F.coalesce("hi", "_hi")).drop("_lo", "_hi")


def family_gap(expected: DataFrame, predicted: DataFrame, most: int = 12) -> DataFrame:
    """Per task: expected families (task_id, family, event_id) that no path has, with sample events."""
    e = expected.groupBy("task_id", "family").agg(F.slice(F.array_sort(F.collect_set("event_id")), 1, most).alias("samples"), F.count("*").alias("events"))
    return e.join(predicted.select("task_id", F.explode("families").alias("family")).distinct(), ["task_id", "family"], "left_anti")


def prior_effect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per task: tactics gained and lost between two runs (task_id, tactics)."""
    none = F.array().cast("array<string>")
    x = a.select("task_id", F.col("tactics").alias("_a")).join(b.select("task_id", F.col("tactics").alias("_b")), "task_id", "full")
    x = x.withColumn("_a", F.coalesce("_a", none)).withColumn("_b", F.coalesce("_b", none))
    return x.select("task_id", F.array_sort(F.array_except("_b", "_a")).alias("gained"), F.array_sort(F.array_except("_a", "_b")).alias("lost"))


def miss_causes(windows: DataFrame, assignments: DataFrame, paths: DataFrame) -> DataFrame:
    """(window_id, tactic, cause) of ground-truth tactics: found, or lost at no_path, not_candidate or not_mapped. paths have candidate_tactics and tactics."""
    t = windows.where("status = 'confirmed'").select("window_id", F.explode("gt_tactics").alias("tactic"))
    p = assignments.where("match = 'confirmed'").join(paths.select("path_id", "candidate_tactics", "tactics"), "path_id")
    g = p.groupBy("window_id").agg(F.flatten(F.collect_list("candidate_tactics")).alias("_c"), F.flatten(F.collect_list("tactics")).alias("_t"))
    cause = F.when(F.col("_t").isNull(), "no_path").when(F.array_contains("_t", F.col("tactic")), "found").when(F.array_contains("_c", F.col("tactic")), "not_mapped").otherwise("not_candidate")
    return t.join(g, "window_id", "left").select("window_id", "tactic", cause.alias("cause"))


def node_coverage(events: DataFrame, gt: DataFrame, windows: DataFrame, bucket: int = 86_400) -> DataFrame:
    """Per window: events within it, malicious processes seen and objects they touch. events (process_guid, object_key, lo)."""
    e = events.join(gt.select(F.col("node_id").alias("process_guid")).distinct(), "process_guid", "left_semi").withColumn("hi", F.col("lo"))
    hit = overlap_join(e, windows.select("window_id", "rlo", "rhi"), [], bucket)
    g = hit.groupBy("window_id").agg(F.count("*").alias("events"), F.count_distinct("process_guid").alias("seeds"), F.count_distinct("object_key").alias("objects"))
    return windows.select("window_id").join(g, "window_id", "left").na.fill(0)
