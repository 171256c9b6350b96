"""Model replies as JSON: the tolerant reading of an object in free text, and its rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from concord.functions import json5
from concord.functions.columns import computed

#: Fields of an answer to one item.
ANSWER = "struct<value:string,evidence:string,confidence_lv:double,unit:string,mce:string,experimental:string>"


@F.pandas_udf(T.StringType())
def read_object(reply: pd.Series) -> pd.Series:
    """json5.object_in of each reply."""
    return reply.map(json5.object_in, na_action="ignore").astype(object)


def object_text(reply: Column | str) -> Column:
    """From the first { to the last }, with one } more if there are fewer than {, as JSON; null without an object that can be read.

    What is plain JSON already (with each name once) stays on the native path; only the rest is read as JSON5.
    """
    c = F.col(reply) if isinstance(reply, str) else reply
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    opened, closed = (F.length(inner) - F.length(F.replace(inner, F.lit(x), F.lit(""))) for x in "{}")
    inner = F.when(closed < opened, F.concat(inner, F.lit("\n}"))).otherwise(inner)
    plain = F.try_parse_json(inner).isNotNull()
    return F.coalesce(F.when(plain, inner), read_object(F.when(~F.coalesce(plain, F.lit(False)) & (inner != ""), c)))


def answers(reply: Column | str) -> Column:
    """The reply as a map from item to answer; null if it isn't an object of objects."""
    return F.from_json(object_text(reply), f"map<string,{ANSWER}>")


def answer_rows(df: DataFrame, reply: str = "reply") -> DataFrame:
    """A row for each item of each reply; a reply without items gives none."""
    rows = df.select(*[c for c in df.columns if c != reply], F.explode(answers(reply)).alias("item", "__answer"))
    return rows.select(*[c for c in rows.columns if c != "__answer"], "__answer.*")


def unread_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Replies that aren't an object of objects with at least one item, to be kept apart."""
    found = F.col("__found")
    bad = found.isNull() | (F.size(found) < 1) | F.exists(F.map_values(found), lambda v: v.isNull())
    return computed(df, __found=answers(reply)).filter(F.coalesce(bad, F.lit(True))).drop("__found")


def field(text: Column | str, name: str, kind: str = "string") -> Column:
    """A field of a JSON text, null where the text is damaged."""
    c = F.col(text) if isinstance(text, str) else text
    return F.get_json_object(c, f"$.{name}").try_cast(kind)


def known_usage(text: Column | str) -> Column:
    """(prompt_tokens, completion_tokens) if both are known and not negative, else null."""
    a, b = (field(text, f"usage.{n}", "long") for n in ("prompt_tokens", "completion_tokens"))
    return F.when((a >= 0) & (b >= 0), F.struct(a.alias("prompt_tokens"), b.alias("completion_tokens")))
