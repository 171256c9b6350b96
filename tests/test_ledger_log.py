import threading

import pytest

from concord.sources import ledger_log as log

ASKED = "attempt_id string, task_id string, request_hash string, tokens long, cost double, place long"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/log"


def now(spark, path):
    return log.read(spark, path)


def test_of_two_writers_of_a_version_one_wins(spark, path):
    rows = lambda k: spark.createDataFrame([("note", k, "{}")], "kind string, key string, payload string")
    assert log.head(spark, path) == 0 and now(spark, path).count() == 0
    assert log.append(rows("a"), path, 0) == 1
    with pytest.raises(log.Lost):
        log.append(rows("b"), path, 0)
    assert log.append(rows("c"), path, 1) == 2 and log.append(rows("d").limit(0), path, 2) == 2
    assert [(r.version, r.key) for r in log.in_order(now(spark, path)).collect()] == [(1, "a"), (2, "c")]


def test_claim_by_rename_doesnt_replace(spark, tmp_path):
    to = f"file://{tmp_path}/claims/1"
    assert log._claim_renamed(spark, to, b"one") and not log._claim_renamed(spark, to, b"two")
    assert (tmp_path / "claims" / "1").read_bytes() == b"one" and not list((tmp_path / "claims").glob(".????????*"))


def test_concurrent_writers_cant_both_reserve_the_last_call(spark, path, monkeypatch):
    meet, read = threading.Barrier(2, timeout=120), log.read
    first = threading.local()

    def read_together(*args):
        rows = read(*args)
        if not getattr(first, "done", False):  # both decide on the same versions before either claims one
            first.done = True
            meet.wait()
        return rows

    monkeypatch.setattr(log, "read", read_together)
    asked = [spark.createDataFrame([(f"a{k}", f"t{k}", "h", 5, 0.5, 1)], ASKED) for k in range(2)]
    writers = [threading.Thread(target=log.reserve, args=(a, path), kwargs={"calls": 1}) for a in asked]
    [w.start() for w in writers], [w.join() for w in writers]
    told = read(spark, path)
    assert log.attempts(told).count() == 1 and log.head(spark, path) == 2
    assert [(r.asked, r.reason) for r in log.refusals(told).collect()] == [("attempt_reserve", "limit")]


def test_tasks_keep_their_identity_and_every_end(spark, path):
    put = lambda *rows: log.put_tasks(spark.createDataFrame(list(rows), "task_id string, stage string, payload string"), path)
    end = lambda *rows: log.finish_tasks(spark.createDataFrame(list(rows), "task_id string, status string, artifacts string, error string"), path)
    assert put(("t1", "examiner", "{}"), ("t2", "cross", None), ("t2", "cross", None), (None, "cross", "{}"), ("t4", " ", "{}")) == 1
    assert put(("t1", "examiner", "{}"), ("t2", "cross", "{}")) == 1
    assert put(("t1", "cross", "{}"), ("t3", "a", "{}"), ("t3", "b", "{}")) == 2
    end(("t1", "failed", "[]", "late"), ("tx", "failed", "[]", None))
    end(("t1", "succeeded", '["f"]', None))
    told = now(spark, path)
    assert sorted((r.task_id, r.stage, r.status, r.artifacts) for r in log.tasks(told).collect()) == [("t1", "examiner", "succeeded", '["f"]'), ("t2", "cross", "planned", None)]
    assert sorted((str(r.key), r.reason) for r in log.refusals(told).collect()) == [("None", "no task_id or stage"), ("t1", "another identity"), ("t3", "another identity"), ("t4", "no task_id or stage"), ("tx", "unknown task")]
    assert told.filter("kind = 'task_finished'").count() == 2


def test_gates_are_decided_once_and_with_a_reason(spark, path):
    log.open_gates(spark.createDataFrame([("g1", "unknown_request", "a1", "why"), ("g2", "limit", "a2", "why"), ("g3", "limit", "a3", " ")], "gate_id string, gate string, target string, reason string"), path)
    approve = lambda *rows: log.approve_gates(spark.createDataFrame(list(rows), "gate_id string, reason string"), path)
    approve(("g1", "seen"), ("g2", ""), ("gx", "seen"))
    approve(("g1", "again"))
    told = now(spark, path)
    assert sorted((r.gate_id, r.status, r.decision) for r in log.gates(told).collect()) == [("g1", "approved", "seen"), ("g2", "pending", None)]
    assert sorted((r.key, r.reason) for r in log.refusals(told).collect()) == [("g1", "decided before"), ("g2", "an approval needs a reason"), ("g3", "a gate needs an id and a reason"), ("gx", "unknown gate")]


def test_reserving_keeps_the_limits_of_the_run(spark, path):
    ask = lambda *rows, **caps: log.reserve(spark.createDataFrame(list(rows), ASKED), path, **caps)
    tell = lambda *rows: log.tell(spark.createDataFrame(list(rows), "attempt_id string, kind string, actual_tokens long, actual_cost double"), path)
    ask(("a1", "t1", "h1", 40, 1.0, 1), ("a2", "t1", "h1", 40, 1.0, 2), ("a3", "t2", "h1", 50, None, 3), ("a4", "t3", "h1", 50, 1.0, 4), tokens=100, cost=9.0)
    tell(("a1", "dispatch", None, None), ("a4", "dispatch", None, None), ("a4", "receive", 1, 0.1))
    tell(("a1", "receive", 10, 0.5), ("a4", "dispatch", None, None))
    ask(("a1", "t9", "h9", 1, 0.1, 1), ("a5", "t4", "h1", 40, 1.0, 2), ("a6", "t5", "h1", 10, 1.0, 3), ("a7", "t6", "h1", 0, 0.0, 4), tokens=100, cost=9.0)
    told = now(spark, path)
    assert sorted((r.attempt_id, r.status, r.reserved_tokens, r.actual_tokens) for r in log.attempts(told).collect()) == [("a1", "received", 40, 10), ("a4", "dispatched", 50, None), ("a5", "reserved", 40, None)]
    assert sorted((r.key, r.reason) for r in log.refusals(told).collect()) == [("a1", "known attempt"), ("a2", "live"), ("a3", "no price"), ("a4", "several events at once"), ("a4", "several events at once"), ("a6", "limit"), ("a7", "limit")]
