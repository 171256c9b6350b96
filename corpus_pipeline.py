"""From documents to packed training sequences: five stages, each a pass of one operator over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs; all but the last return the columns
of documents, with their names, order, kinds and values: whatever stands beside
doc_id and text goes through a stage as one struct, so no operator's column can
meet one of the same name.

Defined results: null and empty texts are kept by every filter (they score as clean,
have no lines, are linked with nothing, cover no item) and are packed as empty;
repeated rows are one document from near-dedup on; of rows of one doc_id the least
by text stays there; rows without doc_id are no copies of any; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from concord.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from concord.llm._common import written

#: Similarity from which near-duplicates are one group here; op9 has its own.
NEAR_PERCENT = 80


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one."""
    own = {c.lower(): c for c in docs.columns}
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in (own["doc_id"], own["text"])]
    return docs.select(F.col(f"`{own['doc_id']}`").alias("doc_id"), F.col(f"`{own['text']}`").alias("text"), F.struct(*rest, F.lit(0).alias("nothing")).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of packed(docs) with the columns of docs."""
    return rows.select(*[F.col(c.lower() if c.lower() in ("doc_id", "text") else f"rest.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 1/2; learned from this input and the labels of the learning fold."""
    rows = packed(docs)
    model = toxicity.learned(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(toxicity.score(rows, model).filter("score < 0.5"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of templates that recur in unrelated documents; n_chars follows the text."""
    done = unpacked(line_dedup.dedup_lines(packed(docs)), docs)
    text = next(c for c in docs.columns if c.lower() == "text")
    return done.select(*[F.char_length(f"`{text}`").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near-duplicates; of rows of one doc_id the least by text, all rows without one."""
    rows = packed(docs)
    kept = near_dup.group(rows, percent=NEAR_PERCENT).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    first = Window.partitionBy("doc_id").orderBy("text", F.to_json("rest"))
    named = rows.filter("doc_id is not null").join(kept, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi")
    one = named.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")
    return unpacked(one.unionByName(rows.filter("doc_id is null")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't cover any benchmark item."""
    return unpacked(decontaminate.worst(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("not contaminated"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed corpus with its token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: A trained model, tiles and packing are beyond SQL; tests/llm/test_near_dup_lines_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
