"""Markdown texts in chunks, by a table function: 1 row to n, with each chunk's place in the text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# Where public Markdown splitters part a text, best first: fences, paragraphs, lines, words, characters.
MARKS = ("```\n", "\n\n", "\n", " ", "")
HEADING = re.compile(r"(?m)^(?=#{1,6} )")
FENCE = re.compile(r"(?m)^[ ]{0,3}(```+|~~~+)")

Span = tuple[int, int]


def fenced(text: str) -> list[Span]:
    """Blocks between a fence and the next line that begins with the same signs, at least as many; an open one ends with the text."""
    found, at = [], 0
    while begin := FENCE.search(text, at):
        sign = begin[1]
        close = re.compile(rf"(?m)^[ ]{{0,3}}{re.escape(sign)}{re.escape(sign[0])}*[ \t]*$").search(text, begin.end())
        end = close.end() if close else len(text)
        end = end + 1 if end < len(text) else end
        found.append((begin.start(), end))
        at = end
    return found


def cut(start: int, end: int, places: Iterable[int]) -> list[Span]:
    bounds = [start, *[p for p in places if start < p < end], end]
    return [s for s in zip(bounds, bounds[1:], strict=False) if s[0] < s[1]]


def runs(spans: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """Neighbouring spans joined up to size; a run begins with the last spans of the run before, up to the overlap."""
    first = 0
    for n, (_, end) in enumerate(spans):
        if n > first and end - spans[first][0] > size:
            yield spans[first][0], spans[n - 1][1]
            length = end - spans[n][0]
            while first < n and (spans[n][0] - spans[first][0] > overlap or spans[n][0] - spans[first][0] + length > size):
                first += 1
    if spans:
        yield spans[first][0], spans[-1][1]


def places(text: str, start: int, end: int, mark: str) -> Iterator[int]:
    at = text.find(mark, start, end)
    while at >= 0:
        yield at
        at = text.find(mark, at + len(mark), end)


def parted(text: str, start: int, end: int, size: int, overlap: int, marks: tuple[str, ...]) -> Iterator[Span]:
    """Chunks of text[start:end], parted at the first mark that it has; pieces of size or more are parted at the marks behind it."""
    level = next((n for n, m in enumerate(marks) if not m or text.find(m, start, end) >= 0), None)
    if level is None:
        yield start, end
    elif not marks[level]:
        while end - start > size:
            yield start, start + size
            start += size - overlap
        yield start, end
    else:
        yield from joined(text, cut(start, end, places(text, start, end, marks[level])), size, overlap, marks[level + 1 :])


def joined(text: str, spans: list[Span], size: int, overlap: int, marks: tuple[str, ...], whole: frozenset[Span] = frozenset()) -> Iterator[Span]:
    """Runs of the spans shorter than size, and between them what large ones become; those of `whole` stay as they are."""
    held: list[Span] = []
    for span in spans:
        if span[1] - span[0] < size:
            held.append(span)
            continue
        yield from runs(held, size, overlap)
        held = []
        if span in whole or not marks:
            yield span
        else:
            yield from parted(text, *span, size, overlap, marks)
    yield from runs(held, size, overlap)


def chunk_spans(text: str, size: int, overlap: int, fences: bool = False, headings: bool = False) -> list[Span]:
    """Places of a text's chunks without the white space around them; blank ones are left out.

    With fences, fenced blocks are never parted: one of size or more is a chunk of its
    own. With headings, a chunk never goes on past a heading (outside of fences) unless
    both sections are shorter than size.
    """
    blocks = fenced(text) if fences or headings else []
    if blocks or headings:
        inside = lambda p: any(a < p < b for a, b in blocks)
        at = {p for b in blocks for p in b} if fences else set()
        at |= {m.start() for m in HEADING.finditer(text) if not inside(m.start())} if headings else set()
        found = joined(text, cut(0, len(text), sorted(at)), size, overlap, MARKS, frozenset(blocks) if fences else frozenset())
    else:
        found = parted(text, 0, len(text), size, overlap, MARKS)
    out = []
    for a, b in found:
        left = len(text[a:b]) - len(text[a:b].lstrip())
        body = text[a:b].strip()
        if body:
            out.append((a + left, a + left + len(body)))
    return out


def checked(size: int, overlap_percent: float) -> int:
    """The overlap in characters; sizes and overlaps that no splitter takes are refused."""
    if type(size) is not int or size <= 0 or isinstance(overlap_percent, bool) or not 0 <= overlap_percent < 100:
        raise ValueError("size must be a positive integer and overlap_percent from 0 to below 100")
    return int(size * overlap_percent / 100)


class Chunks:
    """A table's rows with chunk_id (from 0), start (characters before it) and chunk, for each chunk of the column named; it wants no shuffle."""

    def __init__(self, told: AnalyzeResult):
        self.columns = [f.name for f in told.schema.fields[:-3]]

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument, overlap_percent: AnalyzeArgument, fences: AnalyzeArgument, headings: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or column.value not in rows.dataType.fieldNames():
            raise ValueError("the first argument is a table, the second the name of its text")
        checked(size.value, float(overlap_percent.value))
        kept = [f for f in rows.dataType.fields if f.name != column.value]
        new = T.StructType().add("chunk_id", T.IntegerType()).add("start", T.LongType()).add("chunk", T.StringType())
        return AnalyzeResult(T.StructType([*kept, *new.fields]))

    def eval(self, row: T.Row, column: str, size: int, overlap_percent: float, fences: bool, headings: bool):
        text = row[column]
        if text is None:
            return
        kept = tuple(row[c] for c in self.columns)
        for n, (a, b) in enumerate(chunk_spans(text, size, checked(size, float(overlap_percent)), fences, headings)):
            yield (*kept, n, a, text[a:b])


def chunks(df: DataFrame, text: str = "text", size: int = 2048, overlap_percent: float = 20, fences: bool = False, headings: bool = False) -> DataFrame:
    """df's other columns, chunk_id, start and chunk: a row for each chunk of each text; none for null and blank texts.

    Columns named like the new ones must be renamed before.
    """
    call = F.udtf(Chunks)
    return call(df.asTable(), F.lit(text), F.lit(size), F.lit(float(overlap_percent)), F.lit(fences), F.lit(headings))
