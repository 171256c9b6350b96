"""A paper's body and its tokens: what needs a scan over the text, as Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Headings that end a body (blanks within the Chinese ones count for nothing), the English words that may
# stand in brackets behind one, and headings that show a contents list still stands before it.
ENDINGS = frozenset(("参考文献", "致谢", "附录", "references", "references and notes", "bibliography", "acknowledgements", "acknowledgments", "appendix", "appendices"))
BRACKETED = frozenset(("references", "bibliography", "acknowledgements", "acknowledgments"))
OPENINGS = frozenset(("abstract", "introduction", "摘要", "引言"))
BULLETS = "■●-–—"


def heading(line: str) -> str:
    """A line without blanks around it and without the marks of a heading."""
    line = line.strip()
    marks = len(line) - len(line.lstrip("#"))
    return line[marks:].strip() if marks <= 6 else line


def folded(words: str) -> str:
    """Lower case, one blank between words, none between Chinese signs."""
    words = " ".join(words.split()).lower()
    return words if words.isascii() else words.replace(" ", "")


def ends_body(line: str) -> bool:
    """Whether a line is an ending heading: perhaps emphasised, behind a bullet, in brackets, or with an English word in brackets behind it."""
    words = heading(line).rstrip(" \t:：")
    words = words.lstrip("*_").rstrip("*_").rstrip(" \t:：")
    words = words.lstrip(BULLETS).strip()
    for left, right in (("(", ")"), ("（", "）")):
        own, mark, behind = words.partition(left)
        if mark and own.strip() and behind.endswith(right) and folded(behind[:-1]) in BRACKETED:
            words = own.strip()
    return folded(words.removeprefix("[").removesuffix("]")) in ENDINGS


def body_of(text: str) -> str:
    """The text up to the first ending heading (and the blank lines before it) behind which no heading of a body comes before the next one."""
    begin, blank, at = None, None, 0
    for line in text.split("\n"):
        if not line.strip():
            blank = at if blank is None else blank
        else:
            if ends_body(line):
                if begin is not None:
                    break
                begin = at if blank is None else blank
            elif begin is not None and heading(line).lower() in OPENINGS:
                begin = None
            blank = None
        at += len(line) + 1
    return text if begin is None else text[:begin]


@F.pandas_udf(T.StringType())
def body(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or t != t else body_of(t) for t in texts], dtype=object)


def token_count(text: Column | str) -> Column:
    """Words and signs of a text: the counter that needs no vocabulary file."""
    return F.size(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"(\w+|[^\w\s])")))


def tokenizer_count(text: Column | str, path: str) -> Column:
    """Tokens by a tokenizer's file, where there is one on every machine."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return pd.Series([len(x.ids) for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)])

    return count(F.col(text) if isinstance(text, str) else text)
