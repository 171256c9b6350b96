"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, any text of the learning fold the
unlabelled ones; the share of toxic ones among the labelled rows is the class prior
(bounded to PRIOR). A linear model over a document's distinct words and the first
letters of those words is trained in numpy on the driver by minimising

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the logistic loss, and by ascending the second part wherever it falls below
zero. The place of 1/2 then follows from the same estimator with the error rate in
place of the loss (see place_of_half). Labels other than 1 only count for the prior.

The sample is bounded: at most SAMPLE positives and SAMPLE unlabelled documents,
those with the least hash of their doc_id; what reaches
the driver of each is the hashes of its features that occur in at least LEAST
positives, and there RATIO times as often as in the unlabelled. Scoring reads all rows and whole texts and needs no shuffle.

Defined results: null and empty texts have no words and get the score of no
evidence; without a positive to learn from every score is the prior's bound below
1/2; null labels are none; repeated rows are scored each; a doc_id labelled twice
counts as toxic if any row says so; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concord.llm._common import arrow_pass, batch_of, columns

SAMPLE = 3000
LEAST = 5
PRIOR = (0.005, 0.5)
RATIO = 4
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)


def features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its first letters; a word as short as these is only itself."""
    return (zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:n]}-".encode()) for n in PREFIXES if len(word) > n))


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def feature_rows(rows: DataFrame, kept: np.ndarray | None = None) -> DataFrame:
    """kind and the features of each row's distinct words (of those in kept, one entry for each word), 32-bit little-endian."""

    def make():
        def step(batch):
            out = []
            for text in batch.column(1).to_pylist():
                found = np.array([h for w in distinct_words(text) for h in features(w)], np.uint32)
                if kept is None:
                    found = np.unique(found)
                elif len(found):
                    at = np.minimum(np.searchsorted(kept, found), len(kept) - 1)
                    found = np.sort(at[kept[at] == found].astype(np.uint32))
                out.append(found.tobytes())
            return batch_of(kind=batch.column(0), found=pa.array(out, pa.binary()))

        return step

    return arrow_pass(rows.select("kind", "text"), make, "kind string, found binary")


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, float]:
    """kind (toxic, other, unlabelled) and text of the sample, and the share of toxic ones among all labelled rows."""
    marks = columns(labels, "doc_id", "toxic").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter("doc_id is not null and toxic is not null")
    share, n = marks.agg(F.avg(F.col("toxic").cast("double")), F.count("*")).first()
    order = F.xxhash64("doc_id")
    # the least hashes: a bounded top list each, so no task holds more
    positives = marks.filter("toxic = 1").orderBy(order, "doc_id").limit(most).select("doc_id", F.lit("toxic").alias("kind"))
    texts = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = texts.select("doc_id").orderBy(order, "doc_id").limit(most).select("doc_id", F.lit("unlabelled").alias("kind"))
    wanted = positives.unionAll(ids.distinct())
    # at most 2 * most rows of two columns, so this side is bounded
    return texts.join(F.broadcast(wanted), "doc_id").select("kind", "text"), float(share) if n else 0.0


def csr(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = [np.frombuffer(x, np.uint32) for x in rows]
    return np.concatenate([*data, np.empty(0, np.uint32)]).astype(np.int64), np.array([len(x) for x in data], np.int64)


class Sparse:
    """Rows of column numbers, a repeated one counting more."""

    def __init__(self, rows: list[bytes], width: int):
        self.at, self.sizes = csr(rows)
        self.row, self.width = np.repeat(np.arange(len(rows)), self.sizes), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], len(self.sizes))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row], self.width)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(positive: Sparse, unlabelled: Sparse, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over the whole sample."""
    w, moment, square = np.zeros(positive.width + 1), 0.0, 0.0
    w[-1] = np.log(prior / (1 - prior))
    n_p, n_u = max(len(positive.sizes), 1), max(len(unlabelled.sizes), 1)
    for t in range(1, steps + 1):
        z_p, z_u = positive.dot(w[:-1]) + w[-1], unlabelled.dot(w[:-1]) + w[-1]
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        g_u, g_p = sigmoid(z_u) / n_u, -prior * sigmoid(z_p) / n_p
        if negative >= 0:
            g_p = g_p - prior * sigmoid(-z_p) / n_p
        else:  # the risk of the negatives can't be below zero: undo that overfitting
            g_u, g_p = -g_u, -g_p
        g = np.r_[positive.back(g_p) + unlabelled.back(g_u), g_p.sum() + g_u.sum()]
        g[:-1] += decay * w[:-1]
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def place_of_half(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The evidence from which on a document is called toxic.

    Among the places whose non-negative risk under the 0/1 loss is within one standard
    error of the least, the middle of the widest gap between two documents of the sample.
    """
    seen = np.unique(np.r_[positive, unlabelled])
    edges = np.r_[seen[0] - 2, seen, seen[-1] + 2]
    gaps, places = np.diff(edges), (edges[1:] + edges[:-1]) / 2
    missed = np.searchsorted(np.sort(positive), places) / len(positive)
    called = 1 - np.searchsorted(np.sort(unlabelled), places) / len(unlabelled)
    risk = prior * missed + np.maximum(0, called - prior * (1 - missed))
    error = np.sqrt(prior**2 * missed * (1 - missed) / len(positive) + called * (1 - called) / len(unlabelled))
    least = int(np.argmin(risk))
    gaps[risk > risk[least] + error[least]] = -1
    return float(places[np.argmax(gaps)])


class Model:
    """weights by feature hash; a document's evidence is the sum over its distinct words."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float):
        self.weights, self.bias = dict(zip(kept.tolist(), weights.tolist(), strict=True)), bias
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        get = self.weights.get
        got = sum([get(h, 0.0) for h in features(w)])
        if len(self.known) < 400_000 and len(w) < 40:
            self.known[w] = got
        return got

    def score(self, text: str | None) -> float:
        known = self.known
        z = self.bias
        for w in distinct_words(text):
            z += known[w] if w in known else self.word(w)
        return float(sigmoid(z))


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes, weights, bias) from rows of the learning fold."""
    spark = docs.sparkSession
    sample, share = sampled(docs, labels, most)
    prior = min(max(share, PRIOR[0]), PRIOR[1])
    nothing = np.empty(0, np.uint32), np.empty(0), float(np.log(PRIOR[0] / (1 - PRIOR[0])))
    sample = sample.cache()  # at most 2 * most rows; lost parts are read again
    every = feature_rows(sample)
    # features by the documents of either kind that have them, counted where the rows are
    as_ints = every.mapInArrow(_as_ints, "kind string, feature long")
    counts = as_ints.groupBy("feature").pivot("kind", ["toxic", "unlabelled"]).count().na.fill(0)
    n = {r[0]: r[1] for r in sample.groupBy("kind").count().collect()}
    if not n.get("toxic") or not n.get("unlabelled"):
        sample.unpersist()
        return nothing
    ratio = (F.col("toxic") / n["toxic"]) / ((F.col("unlabelled") + 1) / (n["unlabelled"] + 1))
    chosen = counts.filter((F.col("toxic") >= least) & (ratio > RATIO)).orderBy(F.desc("toxic"), "feature").limit(200_000).select("feature")
    kept = np.sort(np.array([r[0] for r in chosen.collect()], np.int64)).astype(np.uint32)
    if not len(kept):
        sample.unpersist()
        return nothing
    shared = spark.sparkContext.broadcast(kept)
    rows: dict[str, list] = {"toxic": [], "unlabelled": []}
    for kind, found in feature_rows(sample, shared.value).collect():
        rows[kind].append(bytes(found))
    sample.unpersist()
    data = {k: Sparse(v, len(kept)) for k, v in rows.items()}
    weights, _ = train(data["toxic"], data["unlabelled"], prior)
    return kept, weights, -place_of_half(data["toxic"].dot(weights), data["unlabelled"].dot(weights), prior)


def _as_ints(batches):
    for batch in batches:
        kinds, found = batch.column(0).to_pylist(), [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
        for b in range(0, len(kinds), 500):
            part = found[b : b + 500]
            sizes = [len(x) for x in part]
            yield batch_of(kind=pa.array(np.repeat(np.array(kinds[b : b + 500], object), sizes), pa.string()), feature=np.concatenate([*part, np.empty(0, np.uint32)]).astype(np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs's columns and score."""
    docs = docs.drop("score")
    fields = docs.columns
    text = [c.lower() for c in fields].index("text")

    def make():
        own = Model(*model)

        def step(batch):
            scores = [own.score(t) for t in batch.column(text).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*fields, "score"])

        return step

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_pass(docs, make, f"{names}, score double")


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def learned(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The model by the learning fold: rows whose crc32 of doc_id isn't divisible by 5."""
    return learn(docs.filter(fold(5) != 0), labels.filter(fold(5) != 0))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), learned(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
