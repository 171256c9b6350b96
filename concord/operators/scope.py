"""What of a study is looked at: its papers, rounds and contexts, the columns of a table and the order of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType


def of_papers(rows: DataFrame, papers: DataFrame, key: str = "paper_index") -> DataFrame:
    """Rows of the papers in scope: those of a trial, a batch or a list; papers need not be distinct."""
    return rows.join(papers.select(key), key, "left_semi")


def of_rounds(rows: DataFrame, rounds: list[int], column: str = "round_index") -> DataFrame:
    """Rows of some rounds; the filter reaches the scan, and prunes folders where rounds are partitions."""
    return rows.filter(F.col(column).isin(*rounds))


def shaped(rows: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of a schema in its order and kinds: others are left out, missing ones are null."""
    own = set(rows.columns)
    return rows.select(*[(F.col(f"`{f.name}`") if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def by_present(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in order of those keys that are columns; as they are if none is."""
    told = [k for k in keys if k in rows.columns]
    return rows.orderBy(*told) if told else rows


def number_first(c: Column | str) -> list[Column]:
    """Sort keys of labels such as `12-b`: by the number before the first dash, then by text; labels without a number come last."""
    c = F.col(c) if isinstance(c, str) else c
    number = F.substring_index(c, "-", 1).try_cast("double")
    return [number.asc_nulls_last(), c.asc_nulls_last()]


def display_collisions(models: DataFrame, name: str = "model") -> DataFrame:
    """Lower-case names that several selected models share."""
    return models.select(F.lower(F.col(name)).alias("shown"), F.col(name).alias("name")).groupBy("shown").agg(F.count("*").alias("n")).filter("n > 1")


def used_in_context(events: DataFrame, tasks: DataFrame, starts: DataFrame, *, context: str = "context", order: str = "event_id") -> DataFrame:
    """How many events of its tasks each context has from its start on; a resumed context doesn't count those before.

    events has task_id and order, tasks maps task_id to its context, starts has each
    context with the order value of its (last) start; contexts without events count 0.
    """
    begun = starts.groupBy(context).agg(F.max(order).alias("__start"))
    # one count for each task and start, before contexts come together
    told = events.select("task_id", order).join(tasks.select("task_id", context).distinct(), "task_id").join(begun, context).filter(F.col(order) >= F.col("__start"))
    return begun.select(context).join(told.groupBy(context).agg(F.count("*").alias("n")), context, "left").select(context, F.coalesce("n", F.lit(0)).alias("n"))
