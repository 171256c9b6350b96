import json

import pytest

from concord.functions import json5, jsonx

READ = {
    "{}": {},
    "{a: 1, 'b': \"c\", $d_e: [1, 2,],}": {"a": 1, "b": "c", "$d_e": [1, 2]},
    '{"a, }": {"value": "x,]y"}}': {"a, }": {"value": "x,]y"}},
    "{a: 0x10, b: +1, c: .5, d: 5., e: -0XfF, f: 1e3, g: -.5e-1}": {"a": 16, "b": 1, "c": 0.5, "d": 5.0, "e": -255, "f": 1000.0, "g": -0.05},
    "{a: 'one\\\ntwo', b: 'x\\\r\ny'}": {"a": "onetwo", "b": "xy"},
    "{a: '\\x41\\u00e9\\v\\0\\'\\q', b: '\\ud83d\\ude00'}": {"a": "Aé\v\0'q", "b": "😀"},
    "{// one }\n/* two { */ a: '// no /* no', }": {"a": "// no /* no"},
    "{true: true, null: null, Infinity: -Infinity, NaN: NaN}": {"true": True, "null": None, "Infinity": "-Infinity", "NaN": "NaN"},
    "{a: {b: [{c: 1}]}": {"a": {"b": [{"c": 1}]}},
    "so: {a: 1, a: 2} it is": {"a": 2},
    "{\ufeffa\u00a0:\u2028 1, é: 2, a\\u0062: 3}": {"a": 1, "é": 2, "ab": 3},
}
UNREAD = ["", "none", "{a: 1", "}{", "{a: b}", "{a 1}", "{a: 1 b: 2}", "{a: 01}", "{1: 2}", "{,}", "{a: [1,,]}", "{a: 'x\ny'}", "{a: '\\xg'}", "{a: '\\1'}", "{a: 1}}", "{a: 0x}", "{a: 1a}", "{a: -}", "{a: ,}", "{" * 100_000 + "}"]


@pytest.mark.parametrize("text", READ)
def test_forms(text):
    assert json.loads(json5.object_in(text)) == READ[text]


@pytest.mark.parametrize("text", UNREAD, ids=range(len(UNREAD)))
def test_what_cannot_be_read(text):
    assert json5.object_in(text) is None


def test_digits_stay():
    assert json5.object_in("{a: 1.50, b: 12345678901234567890.10}") == '{"a":1.50,"b":12345678901234567890.10}'


def test_no_string_is_changed(spark):
    odd = ["a, }", ",]", "//", "/* */", "it's", '"', "\\", "{", "}", "\n", "é\u2028", "0x10", "😀"]
    rows = [(k, json.dumps({a: {"value": b} for b in odd})) for k, a in enumerate(odd)] + [(k + 100, "{'" + a.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "': {value: 'v',},}") for k, a in enumerate(odd)]
    got = {r.id: (r.item, r.value) for r in jsonx.answer_rows(spark.createDataFrame(rows, "id int, reply string")).collect()}
    # braces are counted before anything is read, in strings too: a lone { gets a } too many
    assert got == {**{k: (a, odd[-1]) for k, a in enumerate(odd)}, **{k + 100: (a, "v") for k, a in enumerate(odd) if a != "{"}}


def test_plain_json_stays_native(spark):
    df = spark.createDataFrame([(1, "{'a': {value: 1}}"), (2, None), (3, "no"), (4, '{"a": 1}'), (5, '{"a": {}}'), (6, "{}")], "id int, reply string")
    assert {r.id for r in jsonx.unread_replies(df).collect()} == {2, 3, 4, 6}
