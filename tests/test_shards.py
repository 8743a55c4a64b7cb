"""Stages call the state store for each shard, not for each key, and hold, answer and forget each key as if it were alone."""

import pandas as pd

from auditloom.streaming import replay
from auditloom.streaming.streams import _recent_step


class Store:
    """List states in memory that count their calls."""

    def __init__(self):
        self.lists, self.calls, self.timers = {}, 0, []

    def getListState(self, name, ddl):
        store, rows = self, self.lists.setdefault(name, [])

        class State:
            def exists(self):
                store.calls += 1
                return bool(rows)

            def get(self):
                store.calls += 1
                return iter(list(rows))

            def put(self, new):
                store.calls += 1
                rows[:] = new

            def appendList(self, new):
                store.calls += 1
                rows.extend(new)

            def clear(self):
                store.calls += 1
                rows.clear()

        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_calls_do_not_grow_with_keys():
    columns = ["us", "event_id", "task_id", "process_guid", "event_type", "object_class"]
    rows = pd.DataFrame([(1000 * (10 - i // 2000), i, "t", f"p{i % 2000}" if i % 2000 else None, "RECV", "external_ip") for i in range(20_000)], columns=columns)
    stage = replay.Stage(["task_id", "process_guid"], _recent_step, "recv bigint, connect bigint", columns, [*columns, "last_recv_us"], True, 60)
    store = Store()
    stage.init(store)
    assert not list(stage.handleInputRows((1,), iter([rows]), At(0))) and store.timers == [2]  # held back, until the first of them is due
    out = pd.concat(stage.handleExpiredTimer((1,), At(5), None))
    assert len(out) == 10_000 and len(store.lists["state"]) == 2000 and sorted(out["last_recv_us"].dropna().unique()) == [1000, 2000, 3000, 4000]
    out = pd.concat(stage.handleExpiredTimer((1,), At(50), None))
    assert len(out) == 10_000 and out["last_recv_us"].min() == 5000 and not store.lists["buffer"]  # also of the process without a name
    assert store.timers[-1] == 60_000 + 10 + 1
    assert not list(stage.handleExpiredTimer((1,), At(60_011), None)) and not store.lists["state"]
    assert store.calls < 60
