import random

import numpy as np
import pytest

from concord.operators import retrieval, running
from concord.plans.queries import QUERIES


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_running_sums_equal_those_of_one_pass(spark, ranges):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, -3, 0, 5, 40]), rng.choice([None, 0.5, 2.25]), "x") for k in rng.sample(range(10_000), 500)] + [(None, 7, 1.0, "no place")]
    df = spark.createDataFrame(rows, "at long, tokens long, cost double, running string").repartition(5)
    tokens, cost, want = 0, 0.0, {None: (None, None)}
    for k, t, c, _ in sorted(r for r in rows if r[0] is not None):
        tokens, cost = tokens + (t or 0), cost + (c or 0)
        want[k] = (tokens, cost)
    got = running.running(df, "at", "tokens", "cost", ranges=ranges)
    assert {r["at"]: (r.running_tokens, r.running_cost) for r in got.collect()} == want
    assert running.running(df.limit(0), "at", "tokens").collect() == []


def test_no_window_of_one_partition(spark, capsys):
    df = running.running(spark.range(1000).selectExpr("id AS at", "id AS tokens"), "at", "tokens")
    df.explain()
    assert "SinglePartition" not in capsys.readouterr().out


def test_limits_of_a_run(spark):
    rows = [("received", 10, 9.0, 5, 0.1), ("rejected", 10, 9.0, 5, 9.0), ("reserved", 10, 0.2, None, None), ("imported", 1, 1.0, 1, 1.0), ("unknown", 10, 9.0, None, None), ("received", 1, 1.0, 100, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n long, status string, reserved_tokens long, reserved_cost double, actual_tokens long, actual_cost double")
    told = lambda **caps: {r.limit_name: (r.place, r.running) for r in running.run_breaches(df, "n", **caps).collect()}
    assert told(calls=1, tokens=15, cost=0.3) == {"calls": (2, 2.0), "tokens": (4, 25.0), "cost": (4, 0.1 + 0.2 + 9.0)}  # 0.1 + 0.2 is within the last digit of 0.3
    assert told(calls=4, tokens=125) == {} and told() == {}


@pytest.mark.parametrize("matrix", [3, 1000])
@pytest.mark.parametrize("others", [False, True])
def test_nearest_chunk_against_all_pairs(spark, monkeypatch, matrix, others):
    monkeypatch.setattr(retrieval, "MATRIX", matrix)
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(60)]  # few different vectors: many ties
    rows += [(1, 100, [0.0] * 4), (1, 101, None), (1, 102, [float("nan")] * 4), (1, 103, [1.0, 2.0])]
    chunks = spark.createDataFrame(rows, "paper int, chunk_id long, vector array<double>")
    evidence = chunks.filter("chunk_id % 4 = 0").withColumnRenamed("chunk_id", "evidence_id")
    unit = {k: (p, np.array(v) / np.linalg.norm(v)) for p, k, v in rows if v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    want = {}
    for k, (p, v) in unit.items():
        found = [(-(v * w).sum(), c) for c, (q, w) in unit.items() if q == p and len(v) == len(w) and (not others or c != k)]
        if k % 4 == 0 and found:
            want[k] = (min(found)[1], -min(found)[0])
    got = {r.evidence_id: (r.chunk_id, r.max_similarity) for r in retrieval.nearest_chunk(evidence, chunks, others=others).collect()}
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_pairs_of_matrices_not_of_vectors(spark, capsys):
    QUERIES["nearest_chunk"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
