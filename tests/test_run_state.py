import random
from datetime import datetime, timedelta

import pytest

from concord.operators import run_state
from concord.operators.lifecycle import STEPS
from concord.streaming import events as log, runs

ASKED = [*run_state.STATES[:6], *run_state.INTERRUPTS, "FATAL_ERROR", "", None]
BEGIN = datetime(2024, 1, 1)


@pytest.fixture()
def rocksdb(spark):
    for k, v in runs.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in runs.STORE:
        spark.conf.unset(k)


def invented(n, seed=4):
    """Changes that mostly follow each other, so that runs get far."""
    rng, at, out = random.Random(seed), {}, []
    for k in range(n):
        run = rng.randrange(6)
        state, resume = at.get(run, ("", None))
        led = [s for s in [*run_state.STATES, *run_state.INTERRUPTS] if run_state.change(state, resume, s)]
        to = rng.choice(led) if led and rng.random() < 0.6 else rng.choice(ASKED)
        at[run] = run_state.change(state, resume, to) or (state, resume)
        out.append((run, k, to))
    return out


def folded(rows):
    at, refused = {}, []
    for run, k, to in sorted(rows, key=lambda r: r[1]):
        state, resume, n = at.get(run, ("", None, 0))
        led = run_state.change(state, resume, to)
        if led is None:
            refused.append((run, k, to or "", state or None))
        at[run] = (*(led or (state, resume)), n + (led is None))
    return {run: (s or None, r, n) for run, (s, r, n) in at.items()}, sorted(refused)


def test_changes():
    change = run_state.change
    assert change("", None, "INIT") == ("INIT", None) and change("", None, "PREFLIGHT") is None
    assert change("SMOKE", None, "HUMAN_GATE_SMOKE") == ("HUMAN_GATE_SMOKE", None) and change("SMOKE", None, "BATCH") is None
    assert change("BATCH", None, "PAUSED") == ("PAUSED", "BATCH") and change("PAUSED", "BATCH", "HUMAN_GATE") == ("HUMAN_GATE", "BATCH")
    assert change("HUMAN_GATE", "BATCH", "BATCH") == ("BATCH", None) and change("PAUSED", "BATCH", "FINAL_QC") is None and change("PAUSED", "BATCH", "FATAL_ERROR") is None
    assert change("BATCH", None, "FATAL_ERROR") == ("FATAL_ERROR", None) and change("FATAL_ERROR", None, "PAUSED") is None and change("DONE", None, "PAUSED") is None


@pytest.mark.parametrize("block", [4, 10_000])
def test_batch_fold(spark, monkeypatch, block):
    monkeypatch.setattr(run_state, "BLOCK", block)
    rows = invented(250)
    standing, refused = folded(rows)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "run_id int, event_id long, state string")
    assert {r.run_id: (r.state, r.resume_state, r.refused) for r in run_state.standing(df).collect()} == standing
    assert sorted(map(tuple, run_state.refused(df).collect())) == refused
    assert run_state.standing(df.limit(0)).collect() == [] and run_state.refused(df.limit(0)).collect() == []


def streamed(spark, tmp_path, schema, parts, make, done):
    """Rows that the stream tells: some files, a restart, and the rest; each file is a trigger."""
    got = []
    for at, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/{at}")
        if at in done:
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/*")
            query = make(source).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    return got


def test_stream_of_changes_equals_the_batch_over_triggers_and_a_restart(spark, tmp_path, rocksdb):
    rows = invented(120)
    standing, refused = folded(rows)
    got = streamed(spark, tmp_path, "run_id int, event_id long, state string", [rows[k : k + 30] for k in range(0, 120, 30)], runs.run_states, {1, 3})
    assert sorted((r.run_id, r.event_id, r.state, r.previous) for r in got if r.told == "refused") == refused
    last = {}
    for r in sorted((r for r in got if r.told == "standing"), key=lambda r: r.event_id):
        last[r.run_id] = (r.state, r.resume_state, r.refused)
    assert last == standing


def attempts():
    at = lambda m: BEGIN + timedelta(minutes=m)
    ways = {
        "in time": [("reserve", 0), ("dispatch", 1), ("receive", 11)],
        "late": [("reserve", 0), ("dispatch", 2), ("receive", 40)],
        "never": [("reserve", 3), ("dispatch", 4)],
        "not sent": [("dispatch", 1), ("reserve", 5), ("reject", 6), ("dispatch", 7)],
        "refused first": [("dispatch", 1), ("reserve", 20), ("dispatch", 21), ("fail", 25)],
        "far": [("reserve", 50), ("dispatch", 58)],
        "clock": [("reserve", 60), ("reject", 61)],
    }
    rows = [(a, kind, m) for a, way in ways.items() for kind, m in way]
    return [(a, k, kind, at(m)) for k, (a, kind, m) in enumerate(sorted(rows, key=lambda r: r[2]))]


SCHEMA = "attempt_id string, event_id long, kind string, told_at timestamp"


def test_overdue_attempts(spark):
    df = spark.createDataFrame(attempts(), SCHEMA)
    got = {r.attempt_id: (r.due_at, r.answered_at) for r in run_state.overdue(df, "10 minutes").collect()}
    assert got == {"late": (BEGIN + timedelta(minutes=12), BEGIN + timedelta(minutes=40)), "never": (BEGIN + timedelta(minutes=14), None)}
    assert run_state.overdue(df.limit(0), "10 minutes").collect() == []


def test_deadlines_pass_without_a_further_event(spark, tmp_path, rocksdb):
    rows = attempts()
    parts = [[r for r in rows if b <= (r[3] - BEGIN).seconds // 60 < e] for b, e in ((0, 20), (20, 40), (40, 50), (50, 60), (60, 70))]
    got = streamed(spark, tmp_path, SCHEMA, parts, lambda df: runs.deadlines(df, 600_000), {1, 4})
    batch = {(r.attempt_id, r.due_at) for r in run_state.overdue(spark.createDataFrame(rows, SCHEMA), "10 minutes").collect()}
    assert {(r.attempt_id, r.at) for r in got if r.told == "expired"} == batch and sum(r.told == "expired" for r in got) == len(batch)
    last = {}
    for r in sorted(got, key=lambda r: (r.at, r.told != "expired")):
        last[r.attempt_id] = r.state
    assert last == {"in time": "received", "late": "received", "never": "unknown", "not sent": "rejected", "refused first": "unknown", "far": "dispatched", "clock": "rejected"}
    assert STEPS[("unknown", "receive")] == "received"
