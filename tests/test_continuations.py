"""Continuations of confirmed paths: shared processes or bridge objects, time, tactics, order of anchors."""

from auditloom.operators import evaluate as K

PATH = "path_id string, host int, task_id string, lo long, hi long, process_chain array<string>, bridge_objects array<string>, tactics array<string>"


def test_continuations(spark):
    paths = spark.createDataFrame([
        ("anchor", 1, "t", 100, 200, ["p", "q"], ["/tmp/x"], ["A", "B"]), ("late", 1, "t", 900, 950, ["q"], [], ["A"]),
        ("bridge", 1, "t", 1100, 1101, ["z"], ["/tmp/x", None], ["B"]), ("too_late", 1, "t", 1202, 1300, ["q"], [], ["A"]), ("other_tactic", 1, "t", 150, 160, ["q"], [], ["C"]),
        ("other_task", 1, "u", 150, 160, ["q"], [], ["A"]), ("other_host", 2, "t", 150, 160, ["q"], [], ["A"]), ("nothing_shared", 1, "t", 150, 160, ["z"], None, []),
        ("no_time", 1, "t", None, 160, ["q"], [], ["A"]), ("best", 1, "t", 150, 260, ["p", "q"], [], []), ("anchor2", 1, "t", 250, 260, ["p", "q"], ["/tmp/x"], ["A"])], PATH)
    match = {"anchor": ("confirmed", "w"), "anchor2": ("confirmed", "w2")}
    assigned = spark.createDataFrame([(r.path_id, *match.get(r.path_id, ("off_window", None))) for r in paths.collect()], "path_id string, match string, window_id string")
    windows = spark.createDataFrame([("w", 0, 300), ("w2", 0, 200), ("open", 0, None)], "window_id string, rlo long, rhi long")
    got = {r.path_id: (r.window_id, r.anchor) for r in K.reattach_continuations(assigned, paths, windows).collect()}
    # `best` shares two processes with both anchors and overlaps the first for longer; `late` shares one with each and overlaps none: the smaller gap counts
    assert got == {"late": ("w", "anchor"), "bridge": ("w", "anchor"), "best": ("w", "anchor")}
    assert K.reattach_continuations(assigned.limit(0), paths, windows).count() == 0
