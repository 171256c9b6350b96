"""The context of a piece of evidence: the most similar chunk of its paper and its neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from concord.functions import vectors


#: Vectors of one matrix, about: a paper with more has several, so its pairs of matrices are several tasks' work.
MATRIX = 1_000


def _matrices(rows: DataFrame, key: str, name: str, tag: str) -> DataFrame:
    """key, size, part and the vectors of each part with their ids; a paper has as many parts as its vectors need."""
    parts = F.ceil(F.count("*") / MATRIX).alias("__parts")
    told = rows.join(rows.groupBy(key, "size").agg(parts), [key, "size"])
    told = told.withColumn(f"{tag}_part", F.pmod(F.xxhash64(name), F.col("__parts")))
    return told.groupBy(key, "size", f"{tag}_part").agg(F.collect_list(name).alias(f"{tag}_ids"), F.flatten(F.collect_list("vector")).alias(f"{tag}_vectors"))


def nearest_chunk(evidence: DataFrame, chunks: DataFrame, key: str = "paper", others: bool = False) -> DataFrame:
    """key, evidence_id, the chunk_id of the greatest cosine similarity in its paper, the first of equals, and max_similarity.

    evidence: key, evidence_id, vector. chunks: key, chunk_id, vector. Vectors of a
    paper are gathered into matrices of bounded size. Each pair of matrices is a row and
    one product, from which a task keeps the best chunk of each piece of evidence; what
    the product finds equal but for rounding is summed again in one order, so equal
    vectors tie. Invalid vectors and those of another size take no part. With others,
    evidence_id is a chunk_id too and a chunk isn't compared with itself.
    """
    prepared = lambda df, name: df.filter(vectors.is_valid(F.col("vector"))).select(key, F.col(name).cast("long").alias(name), F.size("vector").alias("size"), F.col("vector").cast("array<double>").alias("vector"))
    a, b = _matrices(prepared(evidence, "evidence_id"), key, "evidence_id", "a"), _matrices(prepared(chunks, "chunk_id"), key, "chunk_id", "b")
    pairs = a.join(b, [key, "size"]).repartition(key, "size", "a_part", "b_part").select(key, "size", "a_ids", "a_vectors", "b_ids", "b_vectors")
    kind = evidence.schema[key].dataType

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                size = row.column(1)[0].as_py()
                (a_ids, a), (b_ids, b) = ((row.column(i).flatten().to_numpy(), row.column(i + 1).flatten().to_numpy().reshape(-1, size)) for i in (2, 4))
                a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
                near = a @ b.T
                if others:
                    near[a_ids[:, None] == b_ids[None, :]] = -np.inf
                top = near.max(axis=1)
                at, to = np.nonzero((near >= top[:, None] - 1e-9) & (top > -np.inf)[:, None])
                exact = (a[at] * b[to]).sum(axis=1)
                order = np.lexsort((b_ids[to], -exact, at))
                at, to, exact = at[order], to[order], exact[order]
                first = np.append(True, at[1:] != at[:-1])[: len(at)]
                n = int(first.sum())
                yield pa.RecordBatch.from_arrays([pa.array([row.column(0)[0].as_py()] * n, row.column(0).type), pa.array(a_ids[at[first]]), pa.array(b_ids[to[first]]), pa.array(exact[first])], names=[key, "evidence_id", "chunk_id", "s"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("evidence_id", T.LongType()), T.StructField("chunk_id", T.LongType()), T.StructField("s", T.DoubleType())])
    told = pairs.mapInArrow(best, schema)
    top = told.groupBy(key, "evidence_id").agg(F.max(F.struct("s", (-F.col("chunk_id")).alias("c"))).alias("m"))
    return top.select(key, "evidence_id", (-F.col("m.c")).alias("chunk_id"), F.col("m.s").alias("max_similarity"))


def neighbours(chunks: DataFrame, extent: int = 1, key: str = "paper", chunk: str = "chunk") -> DataFrame:
    """Each chunk with those up to `extent` before and behind it in its paper, in order, parted by blank lines."""
    near = Window.partitionBy(key).orderBy("chunk_id").rowsBetween(-extent, extent)
    return chunks.withColumn("context", F.array_join(F.collect_list(chunk).over(near), "\n\n"))


def context_of(best: DataFrame, chunks: DataFrame, extent: int = 1, key: str = "paper", chunk: str = "chunk") -> DataFrame:
    """best with the context of its chunk, by a join on each of the few places around it."""
    places = best.withColumn("__at", F.explode(F.sequence(F.col("chunk_id") - extent, F.col("chunk_id") + extent)))
    told = places.join(chunks.select(key, F.col("chunk_id").alias("__at"), F.col(chunk).alias("__t")), [key, "__at"])
    texts = told.groupBy(*best.columns).agg(F.array_sort(F.collect_list(F.struct("__at", "__t"))).alias("__c"))
    return texts.withColumn("context", F.array_join(F.transform("__c", lambda x: x["__t"]), "\n\n")).drop("__c")


def contains(context: Column | str, quote: Column | str) -> Column:
    """Whether the quote, blanks aside, stands in the context; never null."""
    flat = lambda c: F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))
    found = F.contains(flat(context), flat(quote)) & (F.trim(F.col(quote) if isinstance(quote, str) else quote) != "")
    return F.coalesce(found, F.lit(False))
