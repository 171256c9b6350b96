"""Sinks: tables that replace what stood there, results in parts, single files at once or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, functions as F


def table(df: DataFrame, path: str, form: str = "parquet", parts: tuple[str, ...] = ()) -> None:
    """Writes df over what is there; an empty one too, with its columns."""
    writer = df.write.mode("overwrite").partitionBy(*parts) if parts else df.write.mode("overwrite")
    if form == "tsv":
        writer.option("sep", "\t").option("header", "true").option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)
    else:
        writer.format(form).save(path)


def results(found: DataFrame, detail: DataFrame, path: str) -> None:
    """Results and all their candidates, in parts by round, variant and question; diagnostic variants are never accepted."""
    for name, df in (("result", found), ("detail", detail)):
        full = F.col("variant") == "00_full"
        df = df.withColumns({"accepted": F.when(full, F.lit(False)).otherwise(F.coalesce(F.col("accepted"), F.lit(False))), "aggregation_mode": F.when(full, "diagnostic").otherwise(F.col("aggregation_mode"))})
        table(df, f"{path}/{name}", parts=("round_index", "variant", "question_index"))


def next_version(df: DataFrame, path: str) -> str:
    """Writes df as a new version below path: an input that is being read is never written over."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = [int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName()[1:].isdigit()] if fs.exists(folder) else []
    to = f"{path}/v{max(taken, default=0) + 1:06d}"
    df.write.parquet(to)
    return to


def json_file(content: object, path: str) -> None:
    """A JSON file, there whole or as it was."""
    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=to.parent, prefix=f".{to.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(content, f, ensure_ascii=False, indent=2, default=str)
        os.replace(part, to)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def report(sections: dict[str, DataFrame], path: str, most: int = 10_000) -> dict:
    """One JSON of small tables; a section that fails or is larger than `most` rows is marked, the others stay."""
    told: dict[str, object] = {}
    for name, df in sections.items():
        try:
            rows = df.limit(most + 1).collect()
            told[name] = [r.asDict(recursive=True) for r in rows] if len(rows) <= most else {"unavailable": f"more than {most} rows"}
        except Exception as e:
            told[name] = {"unavailable": f"{type(e).__name__}: {str(e)[:300]}"}
    json_file(told, path)
    return told


def outside(path: str, run: str) -> str:
    """The path, if it neither lies in the run's folder nor holds it."""
    a, b = Path(path).resolve(), Path(run).resolve()
    if a == b or a in b.parents or b in a.parents:
        raise ValueError(f"{path} must be outside of {run}")
    return str(a)


def quarantine(rows: DataFrame, path: str) -> None:
    """Appends replies that couldn't be read, as they came."""
    rows.write.mode("append").parquet(path)


def events(rows: DataFrame, path: str) -> None:
    """Appends events to a log; states are views of it."""
    rows.write.mode("append").parquet(path)
