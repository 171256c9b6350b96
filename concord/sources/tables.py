"""Sources: papers, answers, votes, vectors, ledgers, references, prices and files, each as a DataFrame with its own schema."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from concord.functions import body, text
from concord.operators import answers as rules

ANSWERS = "paper_index string, question_index string, round_index string, model string, item string, value string, unit string, evidence string, confidence_lv string, mce string, experimental string, request_fingerprint string, paper_fingerprint string"
VOTES = "candidate_id string, input_model string, output_model string, existing_flag int, direct_quote string, verification_fingerprint string, paper_index string, question_index int, max_similarities double"
VECTORS = "paper string, chunk_id int, vector array<float>, fingerprint string"
LEDGER = {
    "run": "singleton int, state string, resume_state string, pause_requested int, started_at double, updated_at double, spec_hash string",
    "tasks": "task_id string, stage string, payload string, status string, artifacts string, error string, updated_at double",
    "attempts": "attempt_id string, task_id string, request_hash string, kind string, status string, reserved_tokens long, reserved_cost double, actual_tokens long, actual_cost double, raw_path string, receipt string, created_at double, updated_at double",
    "gates": "gate_id string, kind string, target string, reason string, status string, decision string, created_at double, updated_at double",
    "events": "event_id long, at double, kind string, payload string",
}
QUOTES = "base_url string, model string, currency string, input_per_million double, output_per_million double, as_of string"
RECORD = "kind string, paper_uid string, question int, item string, variant string, round int, experiment_id string, unit string, value string, status string, method string, candidate_set array<struct<value:string,unit:string>>, raw_candidates array<string>, source_items array<string>, source_experiments array<string>"
PROTOCOLS = ("single_value", "candidate_set")


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, sha256 and bytes of each file; contents stay where they are read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def papers(spark: SparkSession, path: str) -> DataFrame:
    """Markdown papers: paper_index by file name, text, body and digest; two of one index, none at all or an empty body is an error."""
    found = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    found = found.withColumns({"paper_index": text.paper_prefix("path"), "body": body.body("text"), "sha256": F.sha2("text", 256), "size_bytes": F.octet_length("text").cast("long")})
    rules.must_be_empty(rules.duplicates(found, "paper_index"), "papers of one index")
    rules.must_be_empty(found.filter(text.strip("body") == "").select("path"), "papers without a body")
    if found.isEmpty():
        raise ValueError(f"no papers in {path}")
    return found


def explicit_papers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Papers named one by one: .md or .pdf, not empty, each digest and name once."""
    found = spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)).alias("suffix"))
    found = found.withColumns({"display_name": F.regexp_extract("path", r"([^/]+)$", 1), "paper_uid": F.concat(F.lit("p"), F.left("sha256", F.lit(32)))})
    rules.must_be_empty(found.filter("suffix not in ('.md', '.pdf') or size_bytes = 0"), "papers of another kind, or empty")
    rules.must_be_empty(rules.duplicates(found, "sha256"), "papers that are the same")
    return found


def paper_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of paths, one a line; blank lines and those that begin with # are left out."""
    lines = spark.read.text(path).select(text.strip(F.regexp_replace("value", "^﻿", "")).alias("path"))
    return lines.filter("path <> '' and not startswith(path, '#')")


def answers(spark: SparkSession, path: str, schema: str = ANSWERS) -> DataFrame:
    """Tab-separated answers, all text as it stands: `001`, `NA` and empty fields are themselves."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def votes(spark: SparkSession, path: str) -> DataFrame:
    """Votes of all files below path; a file without the columns gives rows without them, which valid_votes leaves out."""
    return spark.read.schema(VOTES).option("header", "true").option("enforceSchema", "false").option("recursiveFileLookup", "true").csv(path)


def composite(spark: SparkSession, path: str) -> DataFrame:
    """Published candidates with normal ids; indexes must be positive integers."""
    rows = rules.require_columns(spark.read.parquet(path))
    rows = rows.withColumns({"paper_index": text.paper_id("paper_index"), **{c: F.col(c).cast("string").try_cast("double") for c in ("question_index", "round_index")}})
    wrong = " or ".join(f"{c} is null or {c} < 1 or {c} % 1 <> 0" for c in ("question_index", "round_index"))
    rules.must_be_empty(rows.filter(wrong).select("candidate_id", "question_index", "round_index"), "indexes that aren't positive integers")
    return rows.withColumns({c: F.col(c).cast("int") for c in ("question_index", "round_index")})


def results(spark: SparkSession, path: str) -> DataFrame:
    """Results partitioned by round, variant and question."""
    return spark.read.parquet(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def ledger(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(LEDGER[table]).parquet(f"{path}/{table}")


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """Prices; damaged dates and negative rates are left out, several currencies are an error."""
    rows = spark.read.schema(QUOTES).option("multiLine", "true").json(path).withColumn("base_url", text.endpoint("base_url"))
    rows = rows.filter("base_url is not null and input_per_million >= 0 and output_per_million >= 0").filter(F.expr("try_to_date(as_of, 'yyyy-MM-dd') is not null"))
    if rows.select("currency").distinct().limit(2).count() > 1:
        raise ValueError("prices in several currencies")
    return rows


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Records of a reference set, whose protocol must be known and whose provenance must be given."""
    record = T.StructType(T._parse_datatype_string(RECORD).fields)
    schema = T.StructType([T.StructField("protocol", T.StringType()), T.StructField("provenance", T.StringType()), T.StructField("records", T.ArrayType(record))])
    whole = spark.read.schema(schema).option("multiLine", "true").json(path)
    rules.must_be_empty(whole.filter(F.col("protocol").isNull() | ~F.col("protocol").isin(*PROTOCOLS) | F.coalesce(text.strip("provenance") == "", F.lit(True))).select("protocol", "provenance"), "reference sets without a known protocol and a provenance")
    return whole.select(F.explode("records").alias("r")).select("r.*")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def study(path: str) -> dict:
    """A study's settings; tables beyond these are refused, and paths are relative to the file."""
    file = Path(path)
    told = tomllib.loads(file.read_text(encoding="utf-8-sig"))
    known = {"project", "domain", "models", "questions", "request", "run", "papers", "budget", "prompts"}
    if more := set(told) - known:
        raise ValueError(f"unknown tables: {sorted(more)}")
    for key in ("papers", "output"):
        if isinstance(told.get("project", {}).get(key), str):
            told["project"][key] = str((file.parent / told["project"][key]).resolve())
    return told


class Responses:
    """Replies as a table by request: no request leaves an executor, so a source of replies is any table of these."""

    def __init__(self, table: DataFrame, key: str = "request_fingerprint"):
        self.table, self.key = table, key

    def of(self, requests: DataFrame) -> DataFrame:
        """Requests with their reply, null where there is none."""
        return requests.join(self.table, self.key, "left")

    def pending(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.table.select(self.key), self.key, "left_anti").dropDuplicates([self.key])


def converted(pdfs: DataFrame, papers: DataFrame, convert, fallback=None) -> DataFrame:
    """PDFs without a text yet, converted where they are read: path, text, method and error.

    convert and fallback take a file's bytes and give its text; the second is tried
    where the first fails or gives none.
    """
    import pandas as pd

    pending = pdfs.join(papers.filter(text.strip("text") != "").select("stem"), "stem", "left_anti")

    def run(batches):
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                told, method, error = None, None, ""
                for name, way in (("primary", convert), ("fallback", fallback)):
                    if way is None:
                        continue
                    try:
                        told = way(bytes(content))
                    except Exception as e:  # a converter's own failure is a row, not the job's
                        error = f"{error}{name}: {type(e).__name__}: {e}; "
                        continue
                    if told and told.strip():
                        method = name
                        break
                out.append((path, told if method else None, method, error or None))
            yield pd.DataFrame(out, columns=["path", "text", "method", "error"])

    return pending.select("path", "content").mapInPandas(run, "path string, text string, method string, error string")
