import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concord.operators import answers, consensus, evaluation, ledger, numeric_votes, report, text_votes, verification
from concord.plans.queries import QUERIES
from concord.sources import sinks, tables
from concord.streaming import events as streaming

BASE = dict(paper_index="01", question_index=3, item="Flux-1", value="2.12", unit="mg m-2 h-1", evidence="Table 1", confidence_lv="95", cross_score=2.0, experimental="")
SCHEMA = "paper_index string, question_index int, item string, value string, unit string, evidence string, confidence_lv string, cross_score double, experimental string, model string, candidate_id string"


def rows(spark, *changes):
    return spark.createDataFrame([tuple({**BASE, "model": "A", "candidate_id": f"c{k}", **c}[n.split()[0]] for n in SCHEMA.split(", ")) for k, c in enumerate(changes)], SCHEMA)


def gate(spark, *changes, models="ABC", **more):
    found = consensus.confirm(rows(spark, *changes), list(models), 2, **more).collect()
    return [(r.scalar_value, r["count"]) for r in found if r.accepted], sorted(r.gate_reason for r in found)


def test_dual_threshold(spark):
    assert gate(spark, {"model": "A"})[0] == []
    assert gate(spark, {"model": "A", "cross_score": float("nan")}, {"model": "B", "cross_score": float("nan")}) == ([], [])
    assert gate(spark, *[{"model": m, "cross_score": 1.0} for m in "ABC"])[0] == []
    assert gate(spark, {"model": "A"}, {"model": "B"}, {"model": "C", "value": "9", "cross_score": 0.0})[0] == [("2.12", 2)]
    assert gate(spark, *[{"model": "A"}] * 8)[0] == []
    assert gate(spark, {"model": "A"}, {"model": "B"}, {"model": "C", "value": "3.34"}) == ([("2.12", 2)], ["accepted", "not_mode"])
    assert gate(spark, {"model": "A"}, {"model": "B"}, {"model": "C", "value": "3"}, {"model": "D", "value": "3"}, models="ABCD") == ([], ["tied_mode", "tied_mode"])
    for change in ({"unit": "g m-2 h-1"}, {"item": "Flux-2"}, {"experimental": "yes"}):
        assert gate(spark, {"model": "A"}, {"model": "B", **change})[0] == []
    assert gate(spark, {"model": "A"}, {"model": "B"}, models="ABCDE") == ([], ["below_consensus_threshold"])
    assert gate(spark, {"model": "A", "item": "Latitude", "value": "45.00001"}, {"model": "B", "item": "Latitude", "value": "45.00002"}, kind="text")[0] == [("45.00", 2)]


@pytest.mark.parametrize("asked", [0, 4, True, 1.5])
def test_thresholds(asked):
    with pytest.raises(ValueError):
        consensus.consensus_threshold(["A", "B", "C"], asked)
    assert consensus.consensus_threshold(list("ABCDE")) == 3


def test_votes_do_not_depend_on_row_order(spark):
    df = rows(spark, *[{"model": m, "value": v, "confidence_lv": c} for m, v, c in [("A", "9", "5"), ("B", "10", "5"), ("A", "2", "high"), ("B", "2", "90"), ("C", "3", "N/A")]])
    a, b = numeric_votes.tally(df).collect(), numeric_votes.tally(df.orderBy(F.desc("candidate_id"))).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert {r.scalar_value: r.confidence_sum for r in a} == {"9": 5, "10": 5, "2": 91, "3": 1}


def test_winner_takes_the_last_text_of_equals(spark):
    df = rows(spark, {"value": "9"}, {"value": "10", "model": "B"})
    assert [r.ensemble_value for r in numeric_votes.winners(numeric_votes.tally(df)).collect()] == ["9"]


def test_pooled_over_items(spark):
    df = rows(spark, {"item": "a", "value": "0.51"}, {"item": "b", "value": "0.51", "model": "B"}, {"item": "b", "value": "0.22"})
    assert sorted((r.ensemble_value, r.vote_count, r.item) for r in numeric_votes.ensemble(df).collect()) == [("0.22", 1, "b"), ("0.51", 2, "a")]
    assert len(numeric_votes.ensemble(df, ratio=1.1).collect()) == 2


TEXTS = [("Place", ["", None, "Beijing"], (None, 2, "majority_empty")), ("Place", ["Beijing", None, "Beijing"], ("beijing", 2, "text:vote")), ("Longitude", [None, None, "119.5"], (None, 2, "majority_empty+coord_round2")), ("Longitude", ["-74.0 to -73.0"] * 3, ("-74.00–-73.00", 3, "coord:interval_vote+coord_round2")), ("Longitude", ["119.6279", "119.628", "119.63"], ("119.63", 3, "coord:interval_vote+coord_round2")), ("Study_period", ["2011", "2011-01-01", "2011"], ("2011", 2, "period:vote")), ("Place", ["Beijing", "Beijing", "Shanghai", None], ("beijing", 2, "text:vote"))]


def test_text_ensemble(spark):
    df = spark.createDataFrame([(f"{k:02d}", 1, item, v) for k, (item, values, _) in enumerate(TEXTS) for v in values], "paper_index string, question_index int, item string, value string")
    got = {r.paper_index: (r.ensemble_value, r.support, r.method) for r in text_votes.ensemble(df).collect()}
    assert got == {f"{k:02d}": want for k, (*_, want) in enumerate(TEXTS)}
    fine = text_votes.ensemble(df.filter("paper_index = '04'"), digits=4).first()
    assert (fine.ensemble_value, fine.support) == ("119.6280", 1)


RECORD = dict(kind="numeric", paper_uid="p01", question=3, item="CH4_flux", variant="00_full", round=1, experiment_id="exp1", unit="mg m-2 h-1", value="12.5", status="value")
RECORD_SCHEMA = "kind string, paper_uid string, question int, item string, variant string, round int, experiment_id string, unit string, value string, status string"


def judged(spark, gold, predicted):
    make = lambda told: spark.createDataFrame([tuple({**RECORD, **c}[n.split()[0]] for n in RECORD_SCHEMA.split(", ")) for c in told], RECORD_SCHEMA)
    m = evaluation.metrics(evaluation.cases(make(gold), make(predicted))).first()
    return m.tp, m.fp, m.fn, m.tn, m.precision, m.recall


def test_evaluation(spark):
    other = {"paper_uid": "p02"}
    assert judged(spark, [{}, {**other, "value": "7.25"}], [{}, {**other, "value": "7.30"}]) == (1, 1, 1, 0, 0.5, 0.5)
    assert judged(spark, [{}], [{"unit": None}]) == (0, 0, 0, 0, None, None)
    assert judged(spark, [{}], [{"experiment_id": ""}]) == (0, 0, 0, 0, None, None)
    assert judged(spark, [{}], [{"unit": "h-1 mg m-2"}])[:3] == (1, 0, 0)
    assert judged(spark, [{}], [{"unit": "MG m-2 h-1"}])[:3] == (0, 1, 1)
    assert judged(spark, [{"status": "not_reported", "value": None}], [{"status": "not_reported", "value": None}])[3] == 1
    assert judged(spark, [], [{}])[:3] == (0, 1, 0)
    assert judged(spark, [{}], [{"value": "n.n."}])[:3] == (0, 0, 1)


def test_consumed_contexts_and_absences_beside_values(spark):
    e2, absent, diagnostic = {"experiment_id": "exp2"}, {"status": "not_reported", "value": None}, {"status": "parse_failure", "value": None}
    counts = lambda gold, predicted: judged(spark, gold, predicted)[:4]
    # a context that a reference record has consumed charges no further prediction
    assert counts([{"value": "5"}], [{"value": "6"}, {**e2, "value": "7"}]) == (0, 1, 1, 0)
    assert counts([absent], [{**e2, "value": "7"}]) == (0, 0, 0, 0)
    assert counts([{}], [diagnostic, {**e2, "value": "7"}]) == (0, 0, 1, 0)
    assert counts([{}], [{**e2, "value": "n.n."}, {**e2, "value": "7"}]) == (0, 0, 1, 0)
    # one that nothing consumed does
    assert counts([{}], [{**e2, "value": "7"}]) == (0, 1, 0, 0)
    # a key with a value and an absence is judged for both
    assert counts([{}, absent], [absent]) == (0, 0, 1, 1)
    assert counts([{}, absent], [{}]) == (1, 1, 0, 0)
    # an absence is confirmed by an absence, whatever else is predicted there
    assert counts([absent], [absent, {"value": "7"}]) == (0, 0, 0, 1)
    assert counts([absent], [{"value": "7"}]) == (0, 1, 0, 0) and counts([absent], [diagnostic]) == (0, 0, 0, 0) and counts([absent], []) == (0, 0, 0, 0)
    # a reference that is a diagnostic says nothing of its key
    assert counts([diagnostic], [{}]) == (0, 1, 0, 0)
    # what can't be read is so before its unit is looked at
    assert counts([{}], [{"value": "n.n.", "unit": None}]) == (0, 0, 1, 0)


def test_contributors(spark):
    published = spark.createDataFrame([("p", 1, "a", "5", False), ("p", 1, "b", "6", True), ("p", 1, "c", "7", None)], "paper_index string, question_index int, item_key string, ensemble_value string, pooled boolean")
    candidates = spark.createDataFrame([("p", 1, "a", "5", "c1"), ("p", 1, "b", "5", "c2"), ("p", 1, "a", "6", "c3"), ("p", 1, "b", "6", "c4"), ("p", 2, "a", "5", "c5"), ("p", 1, "c", "7", "c6")], "paper_index string, question_index int, item_key string, normalized_value string, candidate_id string")
    assert sorted(r.candidate_id for r in evaluation.contributors(published, candidates).collect()) == ["c1", "c3", "c4", "c6"]


def test_cross_scores_can_be_repeated(spark):
    df = rows(spark, {"model": "A"}, {"model": "B"})
    votes = spark.createDataFrame([("c0", "A", "B", 1, "q"), ("c0", "A", "C", 1, " "), ("c0", "A", "C", 0, ""), ("c0", "A", "A", 1, "q"), ("c1", "B", "C", -1, "q")], "candidate_id string, input_model string, output_model string, existing_flag int, direct_quote string")
    once = verification.cross_scores(df, votes, list("ABC"))
    assert {r.candidate_id: (r.cross_score, r.flag_B, r.flag_C) for r in once.collect()} == {"c0": (1, 1, 0), "c1": (None, None, None)}
    assert sorted(map(str, verification.cross_scores(once, votes, list("ABC")).select(sorted(once.columns)).collect())) == sorted(map(str, once.select(sorted(once.columns)).collect()))
    assert {(r.candidate_id, r.output_model) for r in verification.missing_votes(df, votes, list("ABC")).collect()} == {("c1", "A"), ("c1", "C")}


def test_violations_and_composition(spark):
    df = rows(spark, {}, {"item": "ilegal"}, {"confidence_lv": "high"}, {"unit": None}, {"value": None, "unit": None})
    assert {r.candidate_id: r.rule for r in answers.violations(df, "numeric", require_unit=True).collect()} == {"c1": "item", "c2": "confidence", "c3": "no_unit"}
    with pytest.raises(ValueError):
        answers.must_be_empty(df, "rows")
    tasks = spark.createDataFrame([("01", 3, "A", 1)], "paper_index string, question_index int, model string, round_index int")
    found = answers.compose(tasks, rows(spark, {}, {}, {"model": "Z"}).withColumn("round_index", F.lit(1)))
    assert found.count() == 1


def test_upper_median_and_ranges(spark):
    df = spark.createDataFrame([("p", "i", m, v) for m, v in zip("ABCDE", ["1", "2", "3", "1000", "1-2"])], "paper_index string, item string, model string, scalar_value string")
    assert {(r.scalar_value, r.upper_median, r.warning) for r in report.outliers(df).collect()} == {("1000", 3.0, "outlier"), ("1-2", None, "range")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/001_test.md").write_text("China. 2020.\n\n## References\nx")
    got = tables.papers(spark, f"{tmp_path}/in").first()
    assert (got.paper_index, got.body) == ("001", "China. 2020.\n")
    (tmp_path / "in/001-b.md").write_text("again")
    with pytest.raises(ValueError):
        tables.papers(spark, f"{tmp_path}/in")
    told = spark.createDataFrame([("001", "NA", "")], "paper_index string, value string, unit string")
    sinks.table(told, f"{tmp_path}/tsv", "tsv")
    assert [tuple(r) for r in tables.answers(spark, f"{tmp_path}/tsv", "paper_index string, value string, unit string").collect()] == [("001", "NA", "")]
    sinks.table(told.limit(0), f"{tmp_path}/empty")
    assert spark.read.parquet(f"{tmp_path}/empty").columns == told.columns
    assert sinks.next_version(told, f"{tmp_path}/v").endswith("v000001") and sinks.next_version(told, f"{tmp_path}/v").endswith("v000002")
    sinks.report({"a": told, "b": told.select(F.raise_error(F.lit("no")).alias("x"))}, f"{tmp_path}/r/report.json")
    out = json.loads((tmp_path / "r/report.json").read_text())
    assert out["a"][0]["value"] == "NA" and "unavailable" in out["b"]
    with pytest.raises(ValueError):
        sinks.outside(f"{tmp_path}/run/eval", f"{tmp_path}/run")
    (tmp_path / "gold.json").write_text(json.dumps({"protocol": "single_value", "provenance": "hand", "records": [{"kind": "numeric", "paper_uid": "p", "value": "1", "candidate_set": [{"value": "1", "unit": "m"}]}]}))
    assert tables.gold(spark, f"{tmp_path}/gold.json").first().candidate_set[0].unit == "m"
    pdfs = spark.createDataFrame([("a", "a.pdf", b"x"), ("b", "b.pdf", b"y"), ("c", "c.pdf", b"z")], "stem string, path string, content binary")
    done = spark.createDataFrame([("c", "text")], "stem string, text string")

    def convert(content):
        if content == b"y":
            raise ValueError("encrypted")
        return "told"

    assert {(r.path, r.method) for r in tables.converted(pdfs, done, convert).collect()} == {("a.pdf", "primary"), ("b.pdf", None)}


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{folder}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/log")
    live = lambda: streaming.stream(spark, f"{tmp_path}/log", batch.schema)
    counts = run_stream(spark, streaming.counts(live(), "event_type"), "counts", "complete")
    assert set(map(tuple, counts.collect())) == set(map(tuple, batch.groupBy("event_type").count().collect()))
    over = run_stream(spark, streaming.breaches(live(), "user_id", "value", "event_id", 1000.0), "breaches")
    want = ledger.first_breach(batch.select("user_id", "event_id", F.col("value")), 1000.0, "value", "event_id", "user_id")
    assert {(r.user_id, r.event_id) for r in over.collect()} == {(r.user_id, r.event_id) for r in want.collect()}
    first = run_stream(spark, streaming.first_by_key(live().withColumn("k", F.col("event_id") % 97), "k", "ts", "60 days"), "first")
    assert first.count() == batch.select((F.col("event_id") % 97).alias("k")).distinct().count()


def test_nearest_chunk_among_all_others(spark, tmp_path):
    # 20 is nearest to 40, which is a query too; 7 is the next
    vectors = {20: [1.0, 0.0], 40: [0.99, 0.05], 7: [0.8, 0.6], 60: [0.0, 1.0]}
    spark.createDataFrame([(k, 0, v) for k, v in vectors.items()], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    from concord.plans.queries import QUERIES

    got = {r.evidence_id: r.chunk_id for r in QUERIES["nearest_chunk"](spark, str(tmp_path)).collect()}
    assert got == {20: 40, 40: 20, 60: 7}


def test_short_quotes_are_found(spark, tmp_path, monkeypatch):
    import duckdb

    from concord.plans import queries

    monkeypatch.setattr(queries, "BRIEF_QUOTES", 3)
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(k, t) for k, t in enumerate([words, f"zero {words} end", words.replace("six", "6"), "three four", "", None])]
    asked = ["three four", "wo three", "one", "two three four five six seven", "one two three four five six sev", "one two three four five six seven eig", "ne two three four five six seven eight nine", "not there", ""]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(queries.ORACLE["quote_in_context"]).fetchall()
    assert dict(map(tuple, queries.QUERIES["quote_in_context"](spark, str(tmp_path)).collect())) == dict(want)


@pytest.mark.parametrize("name, parsers, scans", [("numeric_vote_tally", 1, 2), ("value_options_summary", 1, 2), ("dual_threshold_consensus", 1, 1), ("numeric_ensemble", 2, 3)])
def test_numbers_are_parsed_once_a_row(spark, name, parsers, scans):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("ArrowEvalPython"), plan.count("FileScan")) == (parsers, scans)


def test_accounting_and_missing_votes_shuffle_a_row_a_candidate(spark):
    """No row a pair of candidate and model goes into a shuffle, and the counts are those of the pairs, ids and models without a name too."""
    models = [f"n/m{k}" for k in range(14)]
    odd = [None, "x", *models]
    candidates = [(f"c{k % 37}" if k % 11 else None, odd[k % 16], "none" if k % 7 == 0 else "Table") for k in range(80)]
    votes = [(f"c{k % 45}" if k % 13 else None, models[k % 5], [*odd, "y"][k * k % 17], [-1, 0, 1, None, 2][k % 5], "q" if k % 3 else " ") for k in range(900)]
    df = spark.createDataFrame(candidates, "candidate_id string, model string, evidence string")
    cast = spark.createDataFrame(votes, "candidate_id string, input_model string, output_model string, existing_flag int, direct_quote string")
    asked = {(c, m) for c, own, e in candidates if e != "none" and own for m in models if m != own}
    by = {}
    for c, _, m, flag, _ in votes:
        by.setdefault((c, m), []).append(flag)
    meet = {k: v for k, v in by.items() if None not in k and k in asked}
    told = [80, sum(e != "none" for *_, e in candidates), len(asked), sum(bool({0, 1} & set(v)) for v in meet.values()), sum(1 in v for v in meet.values()), sum(-1 in v and not {0, 1} & set(v) for v in meet.values()), len(asked) - len(meet), len(by) - len(meet)]
    accounting = report.verification_accounting(df, cast, models)
    assert list(accounting.first()) == told
    good = {(c, m) for c, i, m, flag, q in votes if c and m in models and i != m and (flag == 0 or flag == 1 and q == "q")}
    missing = verification.missing_votes(df, cast, models)
    want = Counter((c, own, m) for c, own, e in candidates if e != "none" and own for m in models if m != own and (c, m) not in good)
    assert Counter(map(tuple, missing.collect())) == want
    for made in (accounting, missing):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "output_model" in line]


@pytest.mark.parametrize("name", ["numeric_vote_tally", "numeric_winner_by_confidence", "pooled_candidates", "numeric_ensemble", "representative_item_mode", "decimal_majority_papers", "value_options_summary"])
def test_texts_are_read_after_equal_rows_are_counted(spark, name):
    """Every reader of items, numbers or units stands above a grouping in its branch of the plan."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    readers = [k for k, line in enumerate(plan) if "Generate inline" in line or "ArrowEvalPython" in line]
    assert readers
    for k in readers:
        below = next((j for j in range(k + 1, len(plan)) if depth(plan[j]) <= depth(plan[k])), len(plan))
        assert any("Aggregate" in line for line in plan[k + 1 : below])
