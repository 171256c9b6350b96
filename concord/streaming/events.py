"""The appended event log as a stream; each operator has a batch twin in concord.operators.ledger.

Windows over event time at the end are extensions, not part of what they stand beside.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a Parquet log as they come; the query's checkpoint holds how far it has read."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def tail(events: DataFrame, after: int, order: str = "event_id") -> DataFrame:
    """Events behind an offset: a batch's form of the stream."""
    return events.filter(F.col(order) > after)


def timed(events: DataFrame, time: str, delay: str) -> DataFrame:
    """events with a watermark; a time without a zone is one of the session's zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def first_by_key(events: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key's first row within the delay, for answers that may be told again."""
    return timed(events, time, delay).dropDuplicatesWithinWatermark([key])


def open_waits(starts: DataFrame, finishes: DataFrame, key: str, time: str, delay: str = "1 hour", longest: str = "1 day") -> DataFrame:
    """Starts joined with their finish where one comes in time; without one the finish is null once the watermark has passed."""
    a = timed(starts, time, delay)
    b = timed(finishes.select(F.col(key).alias("__key"), F.col(time).alias("finished_at")), "finished_at", delay)
    on = (F.col(key) == F.col("__key")) & (F.col("finished_at") >= F.col(time)) & (F.col("finished_at") <= F.col(time) + F.expr(f"interval {longest}"))
    return a.join(b, on, "left_outer").drop("__key")


def counts(events: DataFrame, *keys: str) -> DataFrame:
    """Running counts by key, for complete or update mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


STATE = T.StructType([T.StructField("running", T.DoubleType()), T.StructField("stopped", T.BooleanType())])


def breaches(events: DataFrame, key: str, amount: str, order: str, cap: float) -> DataFrame:
    """Each account's first event at which its running sum exceeds the cap, told once; sums live on in the query's state."""
    kind = events.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField(order, T.LongType()), T.StructField("running", T.DoubleType())])

    def run(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, stopped = state.get if state.exists else (0.0, False)
        for rows in batches:
            if stopped:
                continue
            rows = rows.sort_values(order)
            sums = total + rows[amount].fillna(0).cumsum()
            over = sums > cap
            total = float(sums.iloc[-1]) if len(sums) else total
            if over.any():
                at = int(over.values.argmax())
                stopped = True
                yield pd.DataFrame({key: [name[0]], order: [int(rows[order].iloc[at])], "running": [float(sums.iloc[at])]})
        state.update((total, stopped))

    return events.select(key, order, F.col(amount).cast("double").alias(amount)).groupBy(key).applyInPandasWithState(run, out, STATE, "append", "NoTimeout")


def tumbling(events: DataFrame, time: str, size: str = "1 hour", delay: str = "1 hour", *keys: str) -> DataFrame:
    return timed(events, time, delay).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, time: str, size: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour", *keys: str) -> DataFrame:
    return timed(events, time, delay).groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, gap: str = "30 minutes", delay: str = "1 hour", *keys: str) -> DataFrame:
    return timed(events, time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
