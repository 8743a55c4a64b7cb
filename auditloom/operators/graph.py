"""Task graphs: parent forests, cutting, components and their profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.identity import exact_quantiles
from auditloom.operators.scratch import discard, spread_join, written


def parent_edges(subjects: DataFrame) -> DataFrame:
    """(child, parent): the parent of the largest ord of each child; blank and unknown parents are none."""
    known = F.col("parent").isNotNull() & ~F.col("parent").isin("", "Unknow", "Unknown") & (F.col("parent") != F.col("child"))
    return subjects.where(known).groupBy("child").agg(F.max_by("parent", "ord").alias("parent"))


def cut_leaf_tasks(edges: DataFrame) -> DataFrame:
    """Edges whose child is no parent itself."""
    return edges.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_anti")


def segment_nodes(edges: DataFrame, child_threshold: int = 2, count_segmented: bool = False) -> DataFrame:
    """Nodes (column node) with a parent and more than child_threshold effective children, deepest first.

    Effective children are those that are no cut points, or all with count_segmented. Edges with a null end and self-loops are
    ignored, repeated edges count once; no edge gives no node; a cycle raises ValueError.

    The fixpoint is found by tree contraction. Decided children are counted into their parents (rake). A node whose last undecided child alone decides it is
    that child's opposite, and such nodes point to what decides them, so a chain's pointers double their reach in each round (compress): a forest of n nodes takes
    about log(n) rounds whatever its height. Only undecided nodes are written again.
    """
    e = edges.select("child", "parent").where("child <> parent").distinct()
    if count_segmented:
        wide = e.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > child_threshold)
        return wide.join(e.select(F.col("child").alias("parent")), "parent", "left_semi").select(F.col("parent").alias("node")).distinct()
    e = written(e, "segments")
    inner = e.select(F.col("parent").alias("child")).distinct()
    newly = written(e.join(inner, "child", "left_anti").select(F.col("child").alias("node"), "parent", F.lit(False).alias("cut")), "segments")
    # an open row for each edge of an inner node to its parent; roots are never cut and decide nothing
    rows = e.join(inner, "child").select(F.col("child").alias("node"), "parent", F.lit(0).cast("long").alias("live"), F.lit(None).cast(e.schema["child"].dataType).alias("anchor"), F.lit(0).alias("odd"))
    rows, parts = written(rows, "segments"), []
    while not rows.isEmpty():
        fell = newly.groupBy(F.col("parent").alias("node")).agg(F.count_if(~F.col("cut")).alias("_l"))
        kids = rows.groupBy(F.col("parent").alias("node")).agg(F.count_distinct("node").alias("_m"), F.min("node").alias("_only"))
        df = rows.join(fell, "node", "left").join(kids, "node", "left").withColumn("live", F.col("live") + F.coalesce("_l", F.lit(0))).withColumn("_m", F.coalesce("_m", F.lit(0)))
        own = F.when(F.col("live") > child_threshold, True).when(F.col("live") + F.col("_m") <= child_threshold, False)
        chain = F.col("anchor").isNull() & own.isNull() & (F.col("_m") == 1)
        df = df.withColumn("_cut", own).withColumn("odd", F.when(chain, 1).otherwise(F.col("odd"))).withColumn("anchor", F.when(chain, F.col("_only")).otherwise(F.col("anchor")))
        df = written(df.select("node", "parent", "live", "anchor", "odd", "_cut"), "segments")
        at = df.select(F.col("node").alias("anchor"), F.col("_cut").alias("_c")).distinct()
        past = newly.select(F.col("node").alias("anchor"), F.col("cut").alias("_past")).distinct()
        known = F.coalesce("_c", "_past") != (F.col("odd") == 1)
        now = df.join(at, "anchor", "left").join(past, "anchor", "left").select("node", "parent", "live", "anchor", "odd", F.coalesce("_cut", known).alias("cut"))
        now = written(now, "segments")
        parts.append(newly)
        newly = now.where("cut is not null").select("node", "parent", "cut")
        if newly.isEmpty():
            raise ValueError("the parent edges hold a cycle")
        # a pointer goes on to where its target points, unless the target is decided and answers in the next round
        on = now.select(F.col("node").alias("anchor"), F.col("cut").isNotNull().alias("_c"), F.col("anchor").alias("_a"), F.col("odd").alias("_o")).distinct()
        hop = F.col("_a").isNotNull() & ~F.col("_c")
        nxt = now.where("cut is null").join(on, "anchor", "left").select("node", "parent", "live", F.when(hop, F.col("_a")).otherwise(F.col("anchor")).alias("anchor"), F.when(hop, (F.col("odd") + F.col("_o")) % 2).otherwise(F.col("odd")).alias("odd"))
        nxt = written(nxt, "segments")
        discard(rows, df)
        rows = nxt
    return reduce(DataFrame.union, [*parts, newly]).where("cut").select("node").distinct()


def task_components(edges: DataFrame, segmented: DataFrame) -> DataFrame:
    """(root, node, is_boundary): each node without a parent and each cut point roots a task; a cut child is its boundary, where descent stops.

    Every node looks for the nearest root or cut point above it by pointer jumping, so the rounds are the logarithm of the height. A node with several
    parents is in the tasks of all. Edges with a null end and self-loops are ignored, repeated edges count once; a cycle without a cut point raises ValueError."""
    e = written(edges.select("child", "parent").where("child <> parent").distinct(), "tasks")
    cuts = written(segmented.select("node").where("node is not null").distinct(), "tasks")
    tops = e.select(F.col("parent").alias("node")).distinct().join(e.select(F.col("child").alias("node")), "node", "left_anti")
    stops = written(tops.union(cuts).distinct(), "tasks")
    mark = stops.select(F.col("node").alias("up"), F.lit(True).alias("_stop"))
    up = written(e.select(F.col("child").alias("node"), F.col("parent").alias("up")).join(mark, "up", "left").select("node", "up", F.coalesce("_stop", F.lit(False)).alias("done")), "tasks")
    for _ in range(max(1, up.count()).bit_length() + 1):
        if up.where("not done").isEmpty():
            break
        above = up.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("done").alias("_done"))
        moved = up.where("not done").join(above, "up").select("node", F.col("_up").alias("up"), F.col("_done").alias("done"))
        nxt = written(up.where("done").union(moved).distinct(), "tasks")
        discard(up)
        up = nxt
    else:
        raise ValueError("the parent edges hold a cycle")
    is_cut = cuts.withColumn("_cut", F.lit(True))
    below = up.join(is_cut, "node", "left").select(F.col("up").alias("root"), "node", F.coalesce("_cut", F.lit(False)).alias("is_boundary"))
    return stops.select(F.col("node").alias("root"), "node", F.lit(False).alias("is_boundary")).union(below)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node of the undirected component, for nodes with an edge to another node.

    Alternating large-star and small-star rounds, whose number grows with the logarithm of the longest chain; each is a
    groupBy-min joined back to the edges, where the edges of a hub are dealt evenly: no neighbourhood is ever gathered in one row or task. Null ends and self-loops are
    ignored, repeated edges count once; an empty edge list gives an empty result. Every round is written and the one before it deleted.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    cur = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    seen = mark(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0"), "components")
        above = cur.select(F.col("v").alias("u"), F.col("u").alias("v"))  # edges go from the larger end to the smaller
        mid = written(spread_join(above, low, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")
        least = written(mid.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "components")
        small = spread_join(mid, least, ["u"], "n").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        nxt = written(small.select("x.u", "x.v").where("u <> v").distinct(), "components")
        discard(low, mid, least, cur)
        cur, last, seen = nxt, seen, mark(nxt)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def label_tasks(task_nodes: DataFrame, gt: DataFrame) -> DataFrame:
    """(task_id, attacknum, label): malicious nodes of each task, and whether there are any."""
    bad = gt.select("node_id").distinct().withColumn("_bad", F.lit(1))
    return task_nodes.select("task_id", "node_id").distinct().join(bad, "node_id", "left").groupBy("task_id").agg(F.count("_bad").alias("attacknum")).withColumn("label", (F.col("attacknum") > 0).cast("int"))


def temporal_split(branches: DataFrame, max_span: float = 45 * 60, gap: float = 10 * 60) -> DataFrame:
    """(task_id, branch, cluster) of tasks that are split; branches (task_id, branch, first, last in seconds, null if untimed).

    A task splits if its span is over max_span and at least two branches have a time: timed branches in order of start
    open a new cluster where they begin `gap` or more after all earlier ones have ended; untimed ones are dealt round
    robin. Tasks with a single cluster are not split.
    """
    timed = branches.where("first is not null and last is not null")
    w = Window.partitionBy("task_id").orderBy("first", "branch")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("first") - before >= gap), 1).otherwise(0)
    clustered = timed.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w) - 1)
    able = timed.groupBy("task_id").agg((F.max("last") - F.min("first")).alias("span"), F.count("*").alias("n")).where((F.col("span") > max_span) & (F.col("n") >= 2))
    sizes = clustered.groupBy("task_id").agg((F.max("cluster") + 1).alias("_k")).where("_k >= 2").join(able, "task_id", "left_semi")
    rest = branches.where("first is null or last is null").join(sizes, "task_id").withColumn("cluster", (F.row_number().over(Window.partitionBy("task_id").orderBy("branch")) - 1) % F.col("_k"))
    return clustered.join(sizes, "task_id", "left_semi").select("task_id", "branch", F.col("cluster").cast("long").alias("cluster")).unionByName(rest.select("task_id", "branch", F.col("cluster").cast("long").alias("cluster")))


def node_time_range(events: DataFrame, *keys: str) -> DataFrame:
    """First and last time of each key, null times left out; a key without any has nulls, and a null key is a key."""
    return events.groupBy(*keys).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def segmentation_edges(edges: DataFrame) -> DataFrame:
    """Trimmed, distinct parent-child rows without blanks."""
    return edges.select(F.trim("parent").alias("parent"), F.trim("child").alias("child")).where("parent <> '' and child <> ''").distinct()


def component_diagnostics(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Per root: nodes, boundary nodes, children of the root, and whether it is large (over 500) or huge (over 1000)."""
    kids = edges.groupBy(F.col("parent").alias("root")).agg(F.count_distinct("child").alias("root_children"))
    size = components.groupBy("root").agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_boundary").cast("int")).alias("n_boundary"))
    return size.join(kids, "root", "left").na.fill(0, ["root_children"]).withColumn("large", F.col("n_nodes") > 500).withColumn("huge", F.col("n_nodes") > 1000)


def task_size_profile(tasks: DataFrame) -> DataFrame:
    """One row: smallest, mean, quantiles and largest of n_nodes, and counts above 100, 500 and 1000."""
    n = F.col("n_nodes")
    over = [F.sum((n > k).cast("int")).alias(f"over_{k}") for k in (100, 500, 1000)]
    row = tasks.agg(F.count("*").alias("tasks"), F.min(n).alias("smallest"), F.avg(n).alias("mean"), F.max(n).alias("largest"), *over)
    return row.join(F.broadcast(exact_quantiles(tasks, "n_nodes", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})))


def graph_metrics(task_nodes: DataFrame, task_edges: DataFrame) -> DataFrame:
    """Per task and node: in and out degree, distinct neighbours, root and leaf flags, and the task's density m / (n (n - 1))."""
    out = task_edges.groupBy("task_id", F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    inc = task_edges.groupBy("task_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree"))
    ends = task_edges.select("task_id", F.col("src").alias("node_id"), F.col("dst").alias("o")).union(task_edges.select("task_id", "dst", "src")).where("node_id <> o")
    near = ends.distinct().groupBy("task_id", "node_id").agg(F.count("*").alias("neighbours"))
    nodes = task_nodes.select("task_id", "node_id").distinct()
    n = nodes.groupBy("task_id").agg(F.count("*").alias("_n"))
    m = task_edges.groupBy("task_id").agg(F.count("*").alias("_m"))
    density = F.coalesce(F.coalesce("_m", F.lit(0)) / F.nullif(F.col("_n") * (F.col("_n") - 1), F.lit(0)), F.lit(0.0))
    key = ["task_id", "node_id"]
    df = nodes.join(out, key, "left").join(inc, key, "left").join(near, key, "left").na.fill(0, ["out_degree", "in_degree", "neighbours"])
    return df.join(n, "task_id").join(m, "task_id", "left").withColumn("density", density).withColumn("is_root", F.col("in_degree") == 0).withColumn("is_leaf", F.col("out_degree") == 0).drop("_n", "_m")


def check_graph_meta(graphs: DataFrame, metas: DataFrame) -> DataFrame:
    """Tasks whose node, edge, label or attack numbers differ between graphs and metas, or that only one has: (task_id, problem), the first of them in this order. A number that a meta lacks fits."""
    cols = ["n_nodes", "n_edges", "label", "attacknum"]
    g, m = (df.select("task_id", *[F.col(c).alias(f"{p}_{c}") for c in cols], F.lit(True).alias(p)) for df, p in ((graphs, "g"), (metas, "m")))
    both = g.join(m, "task_id", "full")
    problem = F.when(F.col("g").isNull(), "no_graph").when(F.col("m").isNull(), "no_meta")
    for c in cols:
        problem = problem.when(F.col(f"m_{c}").isNotNull() & ~F.col(f"g_{c}").eqNullSafe(F.col(f"m_{c}")), c)
    return both.select("task_id", problem.alias("problem")).where("problem is not null")


def neighbor_mean(features: DataFrame, edges: DataFrame, rounds: int = 1, dims: int = 4) -> DataFrame:
    """(task_id, node_id, f0 .. ): own features next to the mean of the in-neighbours', `rounds` times; widths double each round."""
    cols = [f"f{i}" for i in range(dims)]
    for _ in range(rounds):
        src = features.select("task_id", F.col("node_id").alias("src"), *cols)
        mean = edges.join(src, ["task_id", "src"]).groupBy("task_id", F.col("dst").alias("node_id")).agg(*[F.avg(c).alias(f"_{c}") for c in cols])
        features = features.join(mean, ["task_id", "node_id"], "left").select("task_id", "node_id", *cols, *[F.coalesce(f"_{c}", F.lit(0.0)).alias(f"f{len(cols) + i}") for i, c in enumerate(cols)])
        cols = [f"f{i}" for i in range(2 * len(cols))]
    return features


def max_pool(features: DataFrame) -> DataFrame:
    """Largest value of each feature in each task."""
    return features.groupBy("task_id").agg(*[F.max(c).alias(c) for c in features.columns if c not in ("task_id", "node_id")])
