import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from concord.functions import body, coords, ids, jsonx, numeric, periods, secrets, text, vectors

NUMBERS = [
    ("10-20", "10-20"), ("10–20", "10-20"), ("10 ~ 20", "10-20"), ("10 to 20", "10-20"), ("20-10", "10-20"), ("-10 to -20", "-20--10"), ("-10 to 20", "-10-20"), ("+5 to +10", "5-10"),
    ("1e-3", "0.001"), ("2.5e-4", "0.00025"), ("1E3", "1000"), ("0.01 kgC m-2 yr-1", "0.01"), ("1.5 ha yr-1", "1.5"), ("2.5e-4 m", "0.00025"), ("12.3 ± 0.4", "12.3"), ("not provided", None), ("N/A", None),
    ("1,234.5", "1234.5"), ("1e20", "100000000000000000000"), ("2.5e-7", "2.5e-07"), ("1e-13", "0"), ("(12)", "12"), ("12345678.9", "12345678.9"), ("CH4 12.5", "4"), ("m-2", "-2"), ("12.3 ± 0.4 mg", "12.3"), ("2.50", "2.5"), (None, None),
]
UNITS = [
    ("0.01 kgC m-2 yr-1", None, "0.01 kgc m-2 yr-1"), ("2 m-2 kg", None, "2 kg m-2"), ("1", "mg・m¯².h¯¹", "1 h¯¹ mg m¯²"), ("1", "μg m-3", "1 m-3 μg"), ("0.01 kgC m-2 yr-1", "g C m-2 yr-1", "0.01 C g m-2 yr-1"), ("1", "mW MW h-1", "1 h-1 MW mW"),
]


def test_numbers(spark):
    df = spark.createDataFrame(NUMBERS, "value string, want string")
    assert [(r.value, r.scalar_value) for r in numeric.with_value_unit(df, "value", None).collect()] == NUMBERS


def test_units(spark):
    df = spark.createDataFrame(UNITS, "value string, unit string, want string")
    assert [(r.value, r.unit, r.normalized_value) for r in numeric.with_value_unit(df).collect()] == UNITS


def test_number_text_is_that_of_python(spark):
    import random

    rng = random.Random(1)
    xs = [rng.uniform(-1, 1) * 10 ** rng.randrange(-11, 16) for _ in range(500)] + [0.0, 1e15, 123456.0, 0.1, 1e-4, 9.99e-5]
    shown = lambda x: str(int(x)) if abs(x - int(x)) < 1e-12 else repr(x)
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(numeric.number_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [shown(x) for x in xs]


def test_confidences(spark):
    df = spark.createDataFrame([("90",), ("high",), (None,), ("12d",), ("NaN",), ("-1",)], "c string")
    assert [r[0] for r in df.select(numeric.confidence("c")).collect()] == [90, 1, 1, 1, 1, -1]


@pytest.mark.parametrize("told, want", [("-74.0 to -73.0", (-74, -73)), ("-74-73", (-74, 73)), ("-74–73", (-74, 73)), ("-74 –73", (-74, 73)), ("33.5-32.0S", (-33.5, -32)), ("33.5S-32.0S", (-33.5, -32)), ("-74 -73", (-74, -73)), ("74W to 73W", (-74, -73)), ("73.5S-74.5S", (-74.5, -73.5)), ("120.0E-119.5E", (119.5, 120)), ("119°30'00\"E to 120°00'00\"E", (119.5, 120)), ("n/a", None), (None, None), ("here", None), ("74.5", (74.5, 74.5)), ("−34.9", (-34.9, -34.9)), ("119°30'E", (119.5, 119.5)), ("33°15'36\"S", (-33.26, -33.26)), ("between 10 and 12.5", (10, 12.5)), ("10E and 12.5E", (10, 12.5)), ("10――12", (10, 10)), ("1––3", (1, 3)), ("tomato", None)])
def test_intervals(told, want):
    assert coords.parse_interval(told) == want


def test_interval_text():
    assert coords.interval_text(-74, -73, 2, 2) == "-74.00–-73.00" and coords.decimal_text(45, 2, 4) == "45" and coords.decimal_text(45, 2, 2) == "45.00" and coords.interval_text(math.nan, 1) == ""


PERIODS = [("2011-01-01 to 2011-06-30", "2011-01-01 to 2011-06-30"), ("2011-01-01 - 2011-06-30", "2011-01-01 to 2011-06-30"), ("from 2011-01-01 to 2011-06-30", "2011-01-01 to 2011-06-30"), ("2011-01 to 2011-06", "2011-01 to 2011-06"), ("2011-2012", "2011 to 2012"), ("May-December 2010", "2010-05 to 2010-12"), ("December 10, 2011 to January 20, 2012", "2011-12-10 to 2012-01-20"), ("2011; May 2013", "2011-01 to 2013-05"), ("2011-13-40", ""), ("soon", ""), ("May2010", ""), ("1599", ""), ("Sept, 1999 until 2003", "1999-09 to 2003-01"), ("3 May 2010", "2010-05"), ("May 3 2010", "2010-05-03"), ("2011; 2013-02-01", "2011-01-01 to 2013-02-01"), ("March to may 2001", "2001-03 to 2001-05"), (None, "")]


def test_periods(spark):
    df = spark.createDataFrame(PERIODS, "t string, want string").withColumn("p", periods.period("t"))
    assert [(r.t, r.s) for r in df.select("t", periods.period_text("p").alias("s")).collect()] == PERIODS


def test_items_and_text(spark):
    df = spark.createDataFrame([("Forest_smoldering",), ("forest  Smouldering",), ("Forest_flaming_None",), ("Forest flamings",), ("glass",), ("N/A",), (None,)], "a string")
    assert [r[0] for r in df.select(text.item_key("a")).collect()] == ["forestsmoldering", "forestsmoldering", "forestflaming", "forestflaming", "glass", "", ""]
    df = spark.createDataFrame([("Beijing (China)", "beijing"), ("China, Beijing", "beijing china"), ("the lake", "lake the"), ("['Lake Erken']", "erken"), ("", ""), (None, "")], "a string, want string")
    assert all(r.want == r.got for r in df.select("want", text.text_key("a").alias("got")).collect())
    one = spark.range(1)
    got = one.select(text.paper_id(F.lit("1.0")), text.paper_id(F.lit("123")), text.paper_id(F.lit(" Smith_2020 ")), text.paper_prefix(F.lit("/x/001_test.md")), text.endpoint(F.lit("HTTPS://Api.X.com/V1/")), text.endpoint(F.lit("https://u:p@x.com")), text.model_name(F.lit("a/b/c"))).first()
    assert tuple(got) == ("01", "123", "Smith_2020", "001", "https://api.x.com/V1", None, "c")
    assert one.select(secrets.redact(F.lit("https://u:p@h/x?token=zz Bearer abc"))).first()[0] == "https://[REDACTED]@h/x?token=[REDACTED] Bearer [REDACTED]"


def test_candidate_ids_are_canonical_json(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("1", 2, 1, "m", "i", "NA", 90.0), ("01", 2, 1, "m", "i", None, 90.0)], "paper_index string, question_index int, round_index int, model string, item string, value string, confidence_lv double")
    want = {"paper_index": "01", "question_index": 2, "round_index": 1, "model": "m", "item": "i", "value": None, "confidence_lv": 90, "unit": None, "evidence": None, "mce": None, "experimental": None, "request_fingerprint": None, "paper_fingerprint": None}
    digest = hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert {r[0] for r in df.select(ids.candidate_id(df)).collect()} == {digest}


def test_replies(spark):
    df = spark.createDataFrame([(1, 'So: {"a": {"value": 2.5, "evidence": "T1",}, b: {value: \'x\'}'), (2, "none"), (3, None), (4, '{"a": 3}')], "id int, reply string")
    assert sorted((r.id, r.item, r.value) for r in jsonx.answer_rows(df).collect() if r.id == 1) == [(1, "a", "2.5"), (1, "b", "x")]
    assert {2, 3} <= {r.id for r in jsonx.unread_replies(df).collect()}


def test_bodies(spark):
    told = "Contents\nReferences\nIntroduction\nreal text\n\n## References\n1. a"
    assert body.body_of(told) == "Contents\nReferences\nIntroduction\nreal text\n"
    assert [body.body_of(t) for t in ("", "no heading", "a\nsee References 1\nb", "a\nReferences\nIntroduction\nb")] == ["", "no heading", "a\nsee References 1\nb", "a\nReferences\nIntroduction\nb"]
    for end in ("References and Notes", "[References]", "■ References", "参 考 文 献", "# 参考文献(References)", "**Bibliography**", "## Acknowledgements:", "appendices"):
        assert body.body_of(f"a\n{end}\nb") == "a\n"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.is_valid(F.col("a"), 2)).collect()
    assert [r[1] for r in got] == [True, False, False, False] and got[0][0] == 1.0 and got[1][0] is None and got[2][0] is None


def test_an_identity_writes_each_different_value_once(monkeypatch):
    rows = pd.DataFrame({"paper_index": ["p%1", "é\x1f\"", None, "p%1"] * 50, "question_index": [1.0, float("nan"), 2.0, 1.0] * 50, "value": [" NA ", "1.50", "nan", None] * 50, "mce": [0.5, -0.0, 3.0, float("nan")] * 50})
    slow = [ids.digest({c: ids.plain_value(c, None if v is None or v != v else v) for c, v in row.items()}) for row in rows.astype(object).to_dict("records")]
    calls, plain = [], ids.plain_value
    monkeypatch.setattr(ids, "plain_value", lambda *a: calls.append(a) or plain(*a))
    assert ids.identity.func(rows).tolist() == slow and len(calls) <= 10
    lists = pd.DataFrame({"value": [[1, 2], None]})
    assert ids.identity.func(lists).tolist() == [ids.digest({"value": [1, 2]}), ids.digest({"value": None})]
