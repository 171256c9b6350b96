"""Digests that stay the same across formats and row order, as Arrow UDFs over canonical JSON."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from concord.functions import vocab
from concord.functions.text import paper_id


def canonical(content: object) -> str:
    return json.dumps(content, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def digest(content: object) -> str:
    return hashlib.sha256(canonical(content).encode()).hexdigest()


def plain_value(field: str, value: object) -> object:
    """A field's value in an identity: missing ones null, whole numbers integers."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if field in vocab.ID_TEXT_FIELDS and isinstance(value, str) and value.strip().lower() in vocab.MISSING_IN_ID:
        return None
    if field in ("question_index", "round_index"):
        return int(value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return int(value) if math.isfinite(value) and value == int(value) else float(value)
    return value


def value_texts(field: str, values: pd.Series) -> list[str]:
    """The JSON of a field's values in an identity, made once for each different one."""
    shown = lambda v: canonical(plain_value(field, getattr(v, "item", lambda v=v: v)()))
    try:
        codes, different = pd.factorize(values)
    except TypeError:  # values that can't be hashed
        return [shown(v) for v in values.astype(object).where(values.notna(), None)]
    texts = np.array([*map(shown, pd.Series(different).astype(object)), "null"], dtype=object)
    return texts[codes].tolist()  # a missing value's code is -1


@F.pandas_udf(T.StringType())
def identity(rows: pd.DataFrame) -> pd.Series:
    named = sorted(rows.columns)
    columns = [value_texts(c, rows[c]) for c in named]
    form = "{" + ",".join(canonical(c).replace("%", "%%") + ":%s" for c in named) + "}"
    return pd.Series([hashlib.sha256((form % row).encode()).hexdigest() for row in zip(*columns, strict=True)], dtype=object)


def candidate_id(df: DataFrame) -> Column:
    """The candidate's identity: a digest of its thirteen fields; columns that df lacks count as null."""
    fields = [(paper_id(f) if f == "paper_index" else F.col(f)).alias(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in vocab.ID_FIELDS]
    return identity(F.struct(*fields))


def json_digest(struct: Column) -> Column:
    """A native digest of a struct whose fields are named in order; nulls count."""
    return F.sha2(F.to_json(struct, {"ignoreNullFields": "false"}), 256)
