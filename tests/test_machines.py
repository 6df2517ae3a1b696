"""State machines read a user's rows in small batches and carry their state from one to the next."""

import pytest

from wayfarer.operators.commands import admit
from wayfarer.streaming import device


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield 7
    spark.conf.set(name, before)


def test_machines_carry_state_between_batches(spark, small_batches):
    rows = spark.range(300).selectExpr("if(id < 200, 1, id % 9) as user_id", "id as event_id", "timestamp_ntz '2026-01-01' + make_dt_interval(0, 0, 0, (id * 37) % 300) as ts")

    def count(state, pdf):
        (n,) = state
        out = [(u, e, n + i + 1, len(pdf)) for i, (u, e) in enumerate(zip(pdf["user_id"], pdf["event_id"]))]
        return (n + len(pdf),), out

    got = device.stateful(rows, count, (0,), "n long", "user_id long, event_id long, n long, held long").collect()
    want, seen = {}, {}
    for x in sorted(rows.collect(), key=lambda x: (x.ts, x.event_id)):
        seen[x.user_id] = want[x.event_id] = seen.get(x.user_id, 0) + 1
    assert {x.event_id: x.n for x in got} == want
    assert max(x.held for x in got) <= small_batches


def test_limiter_carries_state_between_batches(spark, small_batches):
    rows = spark.range(200).selectExpr("if(id < 150, 1, id % 5) as user_id", "id as attempt_id", "timestamp_ntz '2026-01-01' + make_dt_interval(0, 0, 0, (id * 37) % 200) as attempted_at")
    want, recent = {}, {}
    for x in sorted(rows.collect(), key=lambda x: (x.attempted_at, x.attempt_id)):
        held = [t for t in recent.get(x.user_id, []) if (x.attempted_at - t).total_seconds() < 20]
        want[x.attempt_id] = len(held) < 3
        recent[x.user_id] = held + [x.attempted_at] * want[x.attempt_id]
    assert {x.attempt_id: x.admitted for x in admit(rows, 3, 20).collect()} == want
