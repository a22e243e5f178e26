"""State machines at their boundaries, and streams against batches."""

import pytest
from pyspark.sql import functions as F

from lodestream.streaming import engine, machines as m


def rows(*items):
    return [{"id": i, "at": t, "item": x, "waits": True, "cap": 0} for i, (t, x) in enumerate(items)]


def test_dedupe_touch_expiry_and_eviction():
    flags = lambda machine, *items: [d for _, d in m.replay(machine, rows(*items))]
    assert flags(m.seen_within(100), (0, "a"), (50, "a"), (140, "a"), (240, "a"), (241, "")) == [False, True, True, False, False]
    assert flags(m.seen_within(0, 2), (0, "a"), (1, "b"), (2, "c"), (3, "a")) == [False, False, False, False]


def test_fixed_window_is_anchored_at_the_first_request():
    out = m.replay(m.fixed_window(2, 1000), rows((5, ""), (6, ""), (7, ""), (1005, "")))
    assert [(a, r) for _, a, _, r in out] == [(True, 0), (True, 0), (False, 998), (True, 0)]


def test_lockout():
    out = [x[1] for x in m.replay(m.lockout(2, 60, 300), rows((0, ""), (60, ""), (90, ""), (100, ""), (389, ""), (390, "")))]
    assert out == [False, False, True, True, True, False]


def test_debounce_flushes_before_what_may_not_wait():
    step, flush = m.debounce(10)
    items = rows((0, "a"), (5, "b"), (9, "c"), (30, "d"))
    items[2]["waits"] = False
    assert m.replay(step, items, flush) == [(0, 2, 5), (2, 1, 9), (3, 1, 30)]


def test_queue_policies():
    size = lambda p: [(a, n, d) for _, a, n, d in m.replay(m.bounded_queue(2, p), rows((0, "a"), (1, "b"), (2, "c")))]
    assert size("new")[-1] == (False, 2, 0) and size("old")[-1] == (True, 2, 0 + 1) and size("summarize")[-1] == (True, 2, 1)


def test_coalesce():
    step, flush = m.coalesce(3, 8, 100)
    texts = lambda *items: [t for _, t in m.replay(step, rows(*items), flush)]
    assert texts((0, "ab"), (1, "cd")) == ["abcd"] and texts((0, "abc"), (200, "d")) == ["abc", "d"] and texts((0, "abcd"), (1, "efghi")) == ["abcd", "efghi"] and texts((0, "x" * 20)) == ["x" * 20] and texts((0, "  ")) == []


def test_presence_sync_and_work():
    machine = m.presence(("mode", "roles"), lambda r: {"mode": r["item"], "roles": [r["item"]]})
    assert [c for _, c in m.replay(machine, rows((0, "a"), (1, "a"), (2, "b"), (3, "a")))] == ["mode,roles", "", "mode,roles", "mode"]
    fired = m.replay(m.sync_trigger(10, 3), [{"id": i, "at": i, "size": s} for i, s in enumerate([4, 6, 1, 1, 1])])
    assert fired == [(1, 10, 2), (4, 3, 3)]
    assert [x[1:] for x in m.replay(m.pending_work(10), rows((0, "a"), (1, "a"), (20, "a")))] == [(True, 1, 1), (False, 1, 1), (True, 3, 1)]


MACHINES = {
    "dedupe": (m.seen_within(36_000_000), "id long, duplicate boolean"), "window": (m.fixed_window(3, 86_400_000), "id long, allowed boolean, remaining int, retry_after_ms long"),
    "lockout": (m.lockout(5, 86_400_000, 172_800_000), "id long, locked boolean, remaining int"), "cap": (m.ttl_cap(259_200_000, 2), "id long, size int"), "ring": (m.ring(4), "id long, size int, oldest string"),
}


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_stream_equals_batch(spark, sf, name):
    machine, schema = MACHINES[name]
    columns = ["user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("item")]
    streamed = engine.drained(spark, engine.keyed(engine.files(spark, sf, "events").select(*columns), "user_id", machine, schema))
    batched = engine.batch(spark.read.parquet(f"{sf}/events.parquet").select(*columns), "user_id", machine, schema)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, streamed.collect()), key=key) == sorted(map(tuple, batched.collect()), key=key)
