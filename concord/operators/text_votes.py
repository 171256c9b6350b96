"""Votes on text, period and coordinate answers of rows of paper_index, question_index, item and value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from concord.functions import coords, periods, text, vocab
from concord.functions.columns import computed

KEYS = ("paper_index", "question_index", "item")


def prepared(df: DataFrame, translate: Callable[[Column], Column] | None = None, kinds: tuple[str, ...] = ("text", "period", "coord")) -> DataFrame:
    """df with kind, normalized_value (empty where missing or unread) and, for the kinds asked for, period and interval.

    Text stays in native expressions; the parsers run only on rows of their kind.
    """
    df = computed(df, item=F.coalesce(F.col("item").cast("string"), F.lit("")), kind=text.item_kind("item"))
    given = F.when(~text.is_missing("value", vocab.MISSING_TEXT), text.strip(F.col("value").cast("string")))
    df, raw = computed(df, __raw=given), F.col("__raw")
    df = computed(df, __text=F.when(F.col("kind") == "text", text.text_key(translate(raw) if translate else raw)))
    of_text = F.col("__text")
    if "period" in kinds:
        df = df.withColumn("period", periods.period(F.when(F.col("kind") == "period", raw)))
        of_text = F.when(F.col("kind") == "period", periods.period_text("period")).otherwise(of_text)
    if "coord" in kinds:
        df = df.withColumn("interval", coords.interval(F.when(F.col("kind") == "coord", raw)))
        df = df.withColumn("__shown", coords.interval_format(F.col("interval.low"), F.col("interval.high")))
        of_text = F.when(F.col("kind") == "coord", F.col("__shown")).otherwise(of_text)
    return computed(df, normalized_value=F.coalesce(of_text, F.lit(""))).drop("__shown", "__raw", "__text")


def tally(rows: DataFrame) -> DataFrame:
    """Rows and share of each normalised value, the empty one too; rows without a paper are left out."""
    counts = rows.filter("paper_index is not null").groupBy(*KEYS, "normalized_value").agg(F.count("*").alias("count"))
    return counts.withColumn("fraction", F.col("count") / F.sum("count").over(Window.partitionBy(*KEYS)))


def vote(boxes: DataFrame) -> DataFrame:
    """The most frequent text of each item: the empty one if it has more than half, of equals one that isn't empty, then the first."""
    best = F.min_by(F.struct("normalized_value", "count"), F.struct((-F.col("count")).alias("a"), (F.col("normalized_value") == "").alias("b"), F.col("normalized_value").alias("c")))
    groups = boxes.groupBy(*KEYS).agg(F.sum("count").alias("n_models"), F.sum(F.when(F.col("normalized_value") == "", F.col("count")).otherwise(0)).alias("empty"), best.alias("best"))
    none = 2 * F.col("empty") > F.col("n_models")
    return groups.select(*KEYS, F.when(~none & (F.col("best.normalized_value") != ""), F.col("best.normalized_value")).alias("ensemble_value"), F.when(none, F.col("empty")).otherwise(F.col("best.count")).alias("support"), F.when(none, "majority_empty").otherwise("text:vote").alias("method"), "n_models")


def period_vote(rows: DataFrame) -> DataFrame:
    """The most frequent period of each item among those that can be read; of equals the finest, then the earliest start and end."""
    rows = rows.filter("paper_index is not null")
    boxes = rows.groupBy(*KEYS, "period").agg(F.count("*").alias("n"), F.count_if(F.col("normalized_value") == "").alias("empty"))
    read = F.col("period.start").isNotNull()
    order = F.struct((-F.col("n")).alias("a"), (-periods.precision_rank(F.col("period.precision"))).alias("b"), F.col("period.start").alias("c"), F.col("period.end").alias("d"))
    groups = boxes.groupBy(*KEYS).agg(F.sum("n").alias("n_models"), F.sum("empty").alias("empty"), F.min_by(F.when(read, F.struct("period", "n")), F.when(read, order)).alias("best"))
    none = 2 * F.col("empty") > F.col("n_models")
    shown = periods.period_text(F.col("best.period"))
    return groups.select(*KEYS, F.when(~none & (shown != ""), shown).alias("ensemble_value"), F.when(none, F.col("empty")).otherwise(F.coalesce("best.n", F.lit(0))).alias("support"), F.when(none, "majority_empty").when(F.col("best").isNull(), "period:no_valid").otherwise("period:vote").alias("method"), "n_models")


def coord_vote(boxes: DataFrame, digits: int = 2) -> DataFrame:
    """The most frequent interval of each item after rounding its ends; of equals the narrowest, then the one whose middle is nearest the median middle of the distinct values, then by its text."""
    parsed = boxes.withColumn("i", coords.interval(F.when(F.col("normalized_value") != "", F.col("normalized_value"))))
    parsed = parsed.withColumns({"low": coords.rounded(F.col("i.low"), digits), "high": coords.rounded(F.col("i.high"), digits)})
    group = Window.partitionBy(*KEYS)
    parsed = parsed.withColumns(
        {
            "middle": F.median((F.col("low") + F.col("high")) / 2).over(group), "n_models": F.sum("count").over(group),
            "empty": F.sum(F.when(F.col("normalized_value") == "", F.col("count")).otherwise(0)).over(group), "read": F.sum(F.when(F.col("low").isNotNull(), F.col("count")).otherwise(0)).over(group),
        }
    )
    merged = parsed.groupBy(*KEYS, "n_models", "empty", "read", "middle", "low", "high").agg(F.sum("count").alias("n"))
    order = F.struct((-F.col("n")).alias("a"), (F.col("high") - F.col("low")).alias("b"), F.abs((F.col("low") + F.col("high")) / 2 - F.col("middle")).alias("c"), F.concat_ws(":", "low", "high").alias("d"))
    there = F.col("low").isNotNull()
    best = merged.groupBy(*KEYS, "n_models", "empty", "read").agg(F.min_by(F.when(there, F.struct("low", "high", "n")), F.when(there, order)).alias("best"))
    none = 2 * F.col("empty") > F.col("n_models")
    best = best.withColumn("shown", coords.interval_format(F.col("best.low"), F.col("best.high"), digits, digits))
    return best.select(*KEYS, F.when(~none & (F.col("shown") != ""), F.col("shown")).alias("ensemble_value"), F.when(none | F.col("best").isNull(), F.col("empty")).otherwise(F.col("best.n")).alias("support"), F.concat(F.when(none, "majority_empty").otherwise("coord:interval_vote"), F.lit(f"+coord_round{digits}")).alias("method"), "n_models")


def ensemble(df: DataFrame, digits: int = 2, translate: Callable[[Column], Column] | None = None) -> DataFrame:
    """The result of each item by its kind: ensemble_value (null if empty), support, method and n_models."""
    rows = prepared(df, translate)
    of = lambda kind: rows.filter(F.col("kind") == kind)
    return vote(tally(of("text"))).unionByName(period_vote(of("period"))).unionByName(coord_vote(tally(of("coord")), digits))
