"""Detection, scoring and metrics of tasks."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.identity import exact_quantiles, running_total
from auditloom.operators.scratch import ranked, written


def fit_task_classifier(matrix: DataFrame, cols: list[str], label: str = "label", rounds: int = 20, depth: int = 4, seed: int = 1):
    """Boosted trees with classes weighted alike; None if a class or the features are missing."""
    n = {r[label]: r["count"] for r in matrix.groupBy(label).count().collect()}
    if len(n) < 2 or not cols:
        return None
    total = sum(n.values())
    weight = F.when(F.col(label) == 1, total / (2.0 * n[1])).otherwise(total / (2.0 * n[0]))
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_x"), gbt]).fit(matrix.withColumn("_w", weight))


def late_fusion(p: Column, q: Column, w: float = 0.25) -> tuple[Column, Column]:
    """(fused probability, label)."""
    fused = (1 - w) * p + w * q
    return fused, (fused >= 0.5).cast("int")


def hash_ranks(tasks: DataFrame, label: str, key: str, seed: int, out: str = "_rank") -> DataFrame:
    """tasks plus their rank from 0 within the label in the order of a hash, ties by key; ranges of hashes are ranked apart, so no label meets in one task. A null label is a label."""
    return ranked(tasks.withColumn("_h", F.xxhash64(F.lit(seed), key)), [label], ["_h", key], out).drop("_h")


def stratified_split(tasks: DataFrame, folds: int, label: str = "label", key: str = "task_id", seed: int = 7) -> DataFrame:
    """tasks plus `fold`: rows of each label dealt evenly in the order of a hash."""
    return hash_ranks(tasks, label, key, seed).withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank")


def split_tasks(tasks: DataFrame, strategy: str = "stratified_shuffle_split", fraction: float = 0.2, folds: int = 5, fold: int = 0, label: str = "label", key: str = "task_id", seed: int = 7) -> DataFrame:
    """tasks plus part (train or eval), mode and fallback_reason.

    stratified_kfold puts one fold aside where each label has a task for every fold; the stratified shuffle a rounded `fraction` of each label, one task at least and never all of them, where there are two
    labels with two tasks and more; else a rounded fraction of all tasks in the order of a hash. One task alone is trained on. The labels are few, so their counts are collected; null labels are one of them.
    """
    n = {r[0]: r[1] for r in tasks.groupBy(label).agg(F.count("*")).collect()}
    total, least = sum(n.values()), min(n.values(), default=0)
    stratified = len(n) >= 2 and least >= 2 and total >= 3
    wants_folds = strategy == "stratified_kfold"
    reason = "" if not wants_folds else "kfold_not_feasible_for_class_counts_or_task_count" if stratified else "kfold_requires_stratifiable_labels"
    named = lambda df, mode, why: df.withColumn("mode", F.lit(mode)).withColumn("fallback_reason", F.lit(why))
    if total <= 1:
        return named(tasks.withColumn("part", F.lit("train")), "degenerate_all_train", "")
    if wants_folds and stratified and 2 <= folds <= least:
        out = stratified_split(tasks, folds, label, key, seed)
        return named(out.withColumn("part", F.when(F.col("fold") == fold % folds, "eval").otherwise("train")).drop("fold"), "stratified_kfold", "")
    if stratified:
        cut = F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(y)), min(k - 1, max(1, round(k * fraction)))) for y, k in n.items()])
        mode, ranked = "stratified_shuffle_split", hash_ranks(tasks, label, key, seed)
    else:
        cut = F.lit(min(total - 1, max(1, round(total * fraction))))
        mode, ranked = "random_shuffle_fallback", hash_ranks(tasks.withColumn("_one", F.lit(1)), "_one", key, seed).drop("_one")
    return named(ranked.withColumn("part", F.when(F.col("_rank") < cut, "eval").otherwise("train")).drop("_rank"), mode, reason)


def temporal_benign_split(tasks: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """tasks (task_id, label, first) plus `part`: benign tasks by first time (nulls last) into train, validation and evaluation by floored counts; others evaluate only.

    Rows are dealt by ranges and written, so that no window holds all of them; each part's ranks are moved by the counts of the parts before it."""
    order = [F.asc_nulls_last("first"), F.col("task_id").asc()]
    benign = F.coalesce(F.col("label") == 0, F.lit(False))
    d = written(tasks.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "split")
    n = d.groupBy("_part").agg(F.sum(benign.cast("long")).alias("_s"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    n = n.withColumn("_before", F.coalesce(F.sum("_s").over(w), F.lit(0))).withColumn("_n", F.sum("_s").over(Window.partitionBy(F.lit(1))))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_r", F.sum(benign.cast("long")).over(own)).join(F.broadcast(n), "_part").withColumn("_r", F.col("_r") + F.col("_before"))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * validation)
    part = F.when(~benign | (F.col("_n") < 3), "evaluation").when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "validation").otherwise("evaluation")
    return d.withColumn("part", part).drop("_part", "_s", "_before", "_r", "_n")


def fit_prototypes(vectors: DataFrame, cols: list[str], k: int, seed: int = 1) -> DataFrame:
    """(center, values): k-means centers of standardized columns, in the columns' own units, fitted on all rows."""
    stages = [VectorAssembler(inputCols=cols, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), KMeans(featuresCol="_x", k=k, seed=seed)]
    model = Pipeline(stages=stages).fit(vectors)
    mean, std = model.stages[1].mean.toArray(), model.stages[1].std.toArray()
    rows = [(i, [float(x) for x in c * std + mean]) for i, c in enumerate(model.stages[2].clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "center int, values array<double>")


def prototype_distance(vectors: DataFrame, centers: DataFrame, col: str) -> DataFrame:
    """vectors plus `distance` to the nearest of a few centers (column values; k of them, so their list is broadcast)."""
    all_ = centers.agg(F.collect_list("values").alias("_centers"))
    dist = F.transform("_centers", lambda c: F.sqrt(F.aggregate(F.zip_with(c, F.col(col), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    return vectors.crossJoin(F.broadcast(all_)).withColumn("distance", F.array_min(dist)).drop("_centers")


def local_topk_score(distances: DataFrame, k: int = 3, key: str = "task_id", value: str = "distance") -> DataFrame:
    """Mean of the k largest values of each task."""
    w = Window.partitionBy(key).orderBy(F.desc(value))
    return distances.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(key).agg(F.avg(value).alias("local_score"))


def robust_scale(values: DataFrame, col: str) -> DataFrame:
    """One row: exact median and 1.4826 times the median absolute deviation, at least 1e-8."""
    m = exact_quantiles(values, col, {"center": 0.5})
    off = values.crossJoin(F.broadcast(m)).select(F.abs(F.col(col) - F.col("center")).alias("_off"))  # one row
    return m.join(F.broadcast(exact_quantiles(off, "_off", {"_mad": 0.5}))).select("center", F.greatest(1.4826 * F.col("_mad"), F.lit(1e-8)).alias("scale"))


def combine_scores(local: Column, local_center: Column, local_scale: Column, whole: Column, whole_center: Column, whole_scale: Column, w: float = 0.40) -> Column:
    """Weighted sum of the two scores' distances above their centers, in scales; a null score or scale gives null."""
    zero = F.lit(0.0)
    return w * F.greatest(zero, (local - local_center) / local_scale) + (1 - w) * F.greatest(zero, (whole - whole_center) / whole_scale)


def benign_threshold(scores: DataFrame, col: str, fpr: float = 0.01) -> DataFrame:
    """One row: the interpolated quantile 1 - fpr."""
    return exact_quantiles(scores, col, {"threshold": 1 - fpr})


def detect_normal_only(tasks: DataFrame, nodes: DataFrame, node_cols: list[str], task_cols: list[str], k_node: int = 32, k_task: int = 8, fpr: float = 0.01, seed: int = 1) -> DataFrame:
    """tasks (task_id, label, first, task_cols) plus part, score and flagged: prototypes of benign training tasks, scaled on benign validation tasks, cut at their quantile."""
    parts = temporal_benign_split(tasks)
    train_nodes = nodes.join(parts.where("part = 'train'").select("task_id"), "task_id", "left_semi")
    k = lambda df, most: max(1, min(most, df.count()))
    node_centers = fit_prototypes(train_nodes, node_cols, k(train_nodes, k_node), seed)
    train = parts.where("part = 'train'")
    task_centers = fit_prototypes(train, task_cols, k(train, k_task), seed)
    local = local_topk_score(prototype_distance(nodes.withColumn("_v", F.array(*[F.col(c).cast("double") for c in node_cols])), node_centers, "_v"))
    whole = prototype_distance(parts.withColumn("_v", F.array(*[F.col(c).cast("double") for c in task_cols])), task_centers, "_v").withColumnRenamed("distance", "global_score").drop("_v")
    df = whole.join(local, "task_id", "left").na.fill(0, ["local_score"])
    val = df.where("part = 'validation'")
    ls, gs = (robust_scale(val, c).toDF(f"_{c}_c", f"_{c}_s") for c in ("local_score", "global_score"))
    c = F.col
    df = df.crossJoin(F.broadcast(ls)).crossJoin(F.broadcast(gs)).withColumn("score", combine_scores(c("local_score"), c("_local_score_c"), c("_local_score_s"), c("global_score"), c("_global_score_c"), c("_global_score_s")))
    cut = benign_threshold(df.where("part = 'validation'"), "score", fpr)
    return df.crossJoin(F.broadcast(cut)).withColumn("flagged", F.col("score") >= F.col("threshold")).drop(*[x for x in df.columns if x.startswith("_")])


def binary_metrics(pred: DataFrame, label: str = "label", predicted: str = "predicted_label", score: str = "score") -> DataFrame:
    """One row: accuracy, macro precision, recall and F1, ROC AUC (ties count half), average precision and class counts.

    Ranks run over counts of distinct scores, range-partitioned, never over all rows in one window."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    n = lambda c: F.sum(c.cast("long"))
    c = pred.agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    pr, rc = [share(tp, tp + fp), share(tn, tn + fn)], [share(tp, tp + fn), share(tn, tn + fp)]
    f1 = [share(2 * a * b, a + b) for a, b in zip(pr, rc, strict=True)]
    base = c.select("tp", "fp", "fn", "tn", ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ((pr[0] + pr[1]) / 2).alias("precision"), ((rc[0] + rc[1]) / 2).alias("recall"), ((f1[0] + f1[1]) / 2).alias("f1"))
    by = pred.groupBy((-F.col(score)).alias("_s")).agg(n(y).alias("_p"), n(~y).alias("_n"))
    r = running_total(by, "_s", ["_p", "_n"], ["_cp", "_cn"])
    totals = by.agg(F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"))
    r = r.crossJoin(F.broadcast(totals))  # one row
    # a positive beats the negatives of lower score, and half of those of its own
    area = F.sum(F.col("_p") * (F.col("_neg") - F.col("_cn") + F.col("_n") / 2.0)) / F.nullif(F.max("_pos") * F.max("_neg"), F.lit(0))
    ap = F.sum(F.col("_p") / F.nullif(F.col("_pos"), F.lit(0)) * F.col("_cp") / (F.col("_cp") + F.col("_cn")))
    return base.crossJoin(F.broadcast(r.agg(area.alias("roc_auc"), ap.alias("average_precision"))))


def score_summary(tasks: DataFrame, col: str = "score") -> DataFrame:
    """One row: smallest, largest and exact median."""
    return tasks.agg(F.min(col).alias("smallest"), F.max(col).alias("largest")).join(F.broadcast(exact_quantiles(tasks, col, {"median": 0.5})))


ATTRIBUTION = {"norm": 0.45, "degree": 0.20, "out_degree": 0.15, "in_degree": 0.10}


def node_attribution(metrics: DataFrame) -> DataFrame:
    """metrics (task_id, node_id, norm, degree, out_degree, in_degree, neighbours, is_root) plus `attribution`: weighted values scaled to 0 to 1 in their task (0.5 if constant), and 0.1 for the larger of root and scaled neighbours."""
    w = Window.partitionBy("task_id")

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi == lo, 0.5).otherwise((F.col(c) - lo) / (hi - lo))

    score = sum((v * scaled(c) for c, v in ATTRIBUTION.items()), F.lit(0.0)) + 0.10 * F.greatest(F.col("is_root").cast("double"), scaled("neighbours"))
    return metrics.withColumn("attribution", score)


def top_processes(scored: DataFrame, k: int = 12) -> DataFrame:
    """(task_id, top): the k best nodes, by score and then id, both falling."""
    w = Window.partitionBy("task_id").orderBy(F.desc("attribution"), F.desc("node_id"))
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("top"))


def top_edges(edges: DataFrame, scored: DataFrame, k: int = 12) -> DataFrame:
    """(task_id, src, dst, score, rank): edges by the mean score of their ends."""
    s = scored.select("task_id", F.col("node_id").alias("src"), F.col("attribution").alias("_a"))
    t = scored.select("task_id", F.col("node_id").alias("dst"), F.col("attribution").alias("_b"))
    e = edges.join(s, ["task_id", "src"]).join(t, ["task_id", "dst"]).withColumn("score", (F.col("_a") + F.col("_b")) / 2)
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), F.desc("src"), F.desc("dst"))
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("task_id", "src", "dst", "score", "rank")


def process_scores(tasks: DataFrame, attribution: DataFrame) -> DataFrame:
    """(process, task_id, score): each process's best score over its tasks, the task's own where it is not attributed; ties go to the smallest task."""
    p = tasks.select("task_id", "score", F.explode("process_ids").alias("process"))
    a = attribution.select("task_id", F.col("node_id").alias("process"), "attribution")
    s = p.join(a, ["task_id", "process"], "left").withColumn("score", F.coalesce("attribution", "score"))
    w = Window.partitionBy("process").orderBy(F.desc("score"), "task_id")
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("process", "task_id", "score")


def raised_alarms(tasks: DataFrame) -> DataFrame:
    """One row for each process of a suspicious task."""
    return tasks.where("is_suspicious").select("task_id", F.explode("process_ids").alias("process"), "score")


def task_export(tasks: DataFrame) -> DataFrame:
    """Task table with defaults; write it ordered by score, falling, and id."""
    return tasks.select("task_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("predicted_label", F.lit(0)).alias("predicted_label"),
                        F.coalesce("is_suspicious", F.coalesce("predicted_label", F.lit(0)) == 1).alias("is_suspicious"))


def ground_truth_direct(tasks: DataFrame, metrics: DataFrame) -> DataFrame:
    """Malicious tasks that are no copies, at score 1.0, with nodes' values divided by the task's largest: .45 norm, .25 degree, .15 neighbours, .15 root."""
    w = Window.partitionBy("task_id")

    def part(c: str) -> Column:
        return F.coalesce(F.col(c) / F.nullif(F.max(c).over(w), F.lit(0)), F.lit(0.0))

    bad = tasks.where(F.col("label") == 1).where(~F.col("task_id").rlike(r"_aug\d{3}$")).select("task_id")
    return metrics.join(bad, "task_id", "left_semi").withColumn("attribution", 0.45 * part("norm") + 0.25 * part("degree") + 0.15 * part("neighbours") + 0.15 * F.col("is_root").cast("double")).withColumn("task_score", F.lit(1.0))


def alert_threshold(tasks: DataFrame) -> DataFrame:
    """One row: smallest threshold, else score, of the suspicious tasks; 0 without any."""
    return tasks.where("is_suspicious").agg(F.coalesce(F.min(F.coalesce("threshold", "score")), F.lit(0.0)).alias("threshold"))
