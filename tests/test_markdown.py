import pytest
from hypothesis import given, settings, strategies as st

from concord.functions import markdown

TEXTS = st.lists(st.sampled_from(["a", "word ", "\n", "\n\n", "```\n", "# head\n", "~~~\n", "  ", "é" * 9, "x" * 30, "a b c d ", "\t"]), max_size=40).map("".join)


def shown(text, size, percent=20, **more):
    return [text[a:b] for a, b in markdown.chunk_spans(text, size, markdown.checked(size, percent), **more)]


def test_forms():
    assert shown("", 5) == [] and shown(" \n ", 5) == [] and shown(" short ", 50) == ["short"]
    assert shown("abcdefghij", 4, 50) == ["abcd", "cdef", "efgh", "ghij"] and shown("abcdefghij", 4, 0) == ["abcd", "efgh", "ij"]
    assert shown("one two three four", 9, 0) == ["one two", "three", "four"] and shown("one two three four five", 10, 50) == ["one two", "two three", "four five"]
    assert shown("p one\n\np two\n\np three", 14, 0) == ["p one\n\np two", "p three"]
    pieces = shown("A sentence here. " * 200, 500)
    assert max(map(len, pieces)) <= 500 and len(pieces) > 7


def test_fenced_blocks_stay_whole_and_headings_part():
    block = "```py\n# no heading\nx = 1\n\ny = 2\n```\n"
    text = "# A\n" + "words here " * 5 + "\n" + block + "## B\nend"
    assert all(block.strip() in c for c in shown(text, 30, fences=True) if "x = 1" in c) and not any(block.strip() in c for c in shown(text, 30))
    assert [c for c in shown(text, 40, 0, fences=True, headings=True)][-1] == "## B\nend"
    assert shown("```\nopen\n\n" + "z " * 40, 20, fences=True) == [("```\nopen\n\n" + "z " * 40).strip()]
    assert markdown.fenced("````\n```\n````\nx") == [(0, 14)]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 25), st.sampled_from([0, 20, 50, 99]), st.booleans(), st.booleans())
def test_chunks_cover_their_text_in_order(text, size, percent, fences, headings):
    overlap = markdown.checked(size, percent)
    spans = markdown.chunk_spans(text, size, overlap, fences, headings)
    assert spans == sorted(spans) and {p for a, b in spans for p in range(a, b)} >= {p for p, c in enumerate(text) if not c.isspace()}
    stripped = lambda x, y: (x + len(text[x:y]) - len(text[x:y].lstrip()), x + len(text[x:y].rstrip()))
    blocks = [stripped(x, y) for x, y in markdown.fenced(text)] if fences else []
    assert all(b - a <= size or (a, b) in blocks for a, b in spans)
    assert all(b - x <= overlap for (a, b), (x, y) in zip(spans, spans[1:], strict=False))
    assert all(b <= x or y <= a or (a <= x and y <= b) for a, b in spans for x, y in blocks)


def test_table_function(spark):
    df = spark.createDataFrame([(1, "one two three four", {"a": 1}), (2, None, None), (3, "  ", None)], "doc_id long, text string, more map<string,int>")
    got = markdown.chunks(df, size=9, overlap_percent=0)
    assert [(r.doc_id, r.more, r.chunk_id, r.start, r.chunk) for r in got.orderBy("chunk_id").collect()] == [(1, {"a": 1}, 0, 0, "one two"), (1, {"a": 1}, 1, 8, "three"), (1, {"a": 1}, 2, 14, "four")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and markdown.chunks(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="positive integer"):
        markdown.chunks(df, size=0)
    with pytest.raises(Exception, match="name of its text"):
        markdown.chunks(df, text="none")
