import random

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from concord.operators import lifecycle, scope


def test_states_equal_a_plain_fold_over_any_blocks(spark, monkeypatch):
    rng = random.Random(7)
    kinds = ["reserve", "dispatch", "receive", "fail", "reject", "recover", "release", "hold", None]
    rows = [(f"a{rng.randrange(12)}", k, rng.choice(kinds)) for k in range(400)]
    want = {}
    for attempt, _, kind in rows:
        state, refused = want.get(attempt, ("none", 0))
        to = lifecycle.STEPS.get((state, kind))
        want[attempt] = (to or state, refused + (to is None))
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "attempt_id string, event_id long, kind string")
    for block in (3, 100_000):
        monkeypatch.setattr(lifecycle, "BLOCK", block)
        assert {r.attempt_id: (r.state, r.refused) for r in lifecycle.states(events).collect()} == want
    assert lifecycle.states(events.limit(0)).collect() == []


def test_an_attempt_goes_its_way(spark):
    ways = {"a": ["reserve", "dispatch", "receive", "fail"], "b": ["reserve", "dispatch", "fail", "hold", "receive"], "c": ["reserve", "recover", "dispatch"], "d": ["reserve", "dispatch", "recover", "release"], "e": ["dispatch"]}
    rows = [(a, k, kind) for a, way in ways.items() for k, kind in enumerate(way)]
    got = {r.attempt_id: (r.state, r.refused) for r in lifecycle.states(spark.createDataFrame(rows, "attempt_id string, event_id long, kind string")).collect()}
    assert got == {"a": ("received", 1), "b": ("received", 0), "c": ("rejected", 1), "d": ("rejected", 0), "e": ("none", 1)}


def test_admission_and_overshoots(spark):
    attempts = spark.createDataFrame(
        [("t", "h", "rejected", 5, 0, 1.0, 0.0)] * 3 + [("t", "i", "received", 5, 6, 1.0, None), ("t", "j", "received", 5, 5, 0.3, 0.30000000000000004), ("t", "k", "received", 5, 5, 0.3, 0.3001), ("u", "h", "rejected", 1, 9, 0.0, 0.0), ("u", "i", "received", 5, None, 1.0, 2.0)],
        "task_id string, request_hash string, status string, reserved_tokens long, actual_tokens long, reserved_cost double, actual_cost double",
    )
    asked = spark.createDataFrame([("t", "h"), ("t", "i"), ("u", "h"), ("v", "v"), (None, "h")], "task_id string, request_hash string")
    got = {(r.task_id, r.request_hash): r.verdict for r in lifecycle.admitted(asked, attempts).collect()}
    assert got == {("t", "h"): "ceiling", ("t", "i"): "live", ("u", "h"): "free", ("v", "v"): "free", (None, "h"): "free"}
    assert sorted(r.request_hash for r in lifecycle.overshoots(attempts).collect()) == ["i", "k"]


def test_scope(spark):
    rows = spark.createDataFrame([("p1", 1, "12-b"), ("p1", 2, "2-a"), ("p2", 1, "x"), (None, 1, None)], "paper_index string, round_index int, label string")
    papers = spark.createDataFrame([("p1",), ("p1",), (None,)], "paper_index string")
    assert [r.label for r in scope.of_rounds(scope.of_papers(rows, papers), [2, 5]).collect()] == ["2-a"]
    assert scope.of_papers(rows, papers).count() == 2
    assert [r.label for r in rows.orderBy(*scope.number_first("label")).collect()] == ["2-a", "12-b", "x", None]
    assert [r.round_index for r in scope.by_present(rows, "none", "round_index").collect()] == [1, 1, 1, 2] and scope.by_present(rows, "none") is rows
    shape = StructType([StructField("label", StringType()), StructField("round_index", LongType()), StructField("score", DoubleType())])
    got = scope.shaped(rows, shape)
    assert got.dtypes == [("label", "string"), ("round_index", "bigint"), ("score", "double")] and got.filter("score is not null").count() == 0 and got.count() == 4
    assert [tuple(r) for r in scope.display_collisions(spark.createDataFrame([("A",), ("a",), ("b",)], "model string")).collect()] == [("a", 2)]


def test_a_resumed_context_does_not_count_again(spark):
    events = spark.createDataFrame([("t1", 1), ("t1", 5), ("t1", 6), ("t2", 9), (None, 9)], "task_id string, event_id long")
    tasks = spark.createDataFrame([("t1", "c"), ("t1", "c"), ("t2", "d")], "task_id string, context string")
    starts = spark.createDataFrame([("c", 0), ("c", 5), ("e", 0)], "context string, event_id long")
    assert {tuple(r) for r in scope.used_in_context(events, tasks, starts).collect()} == {("c", 2), ("e", 0)}
