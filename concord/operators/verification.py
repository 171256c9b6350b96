"""Other models' votes on candidates' evidence: who votes, cross scores and whether votes are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concord.functions import text
from concord.operators.consensus import has_evidence

#: Models whose bits one number holds.
WIDTH = 62


def fan_out(candidates: DataFrame, models: list[str]) -> DataFrame:
    """A row for each candidate with evidence and each model that didn't generate it."""
    others = F.filter(F.array(*[F.lit(m) for m in models]), lambda m: m != F.col("model"))
    return candidates.filter(has_evidence()).withColumn("output_model", F.explode(others))


def valid_votes(votes: DataFrame, models: list[str]) -> DataFrame:
    """Votes of 0 or 1 by one model of the pool on another's candidate; a 1 must quote."""
    quoted = F.coalesce(text.strip("direct_quote") != "", F.lit(False))
    return votes.filter((F.col("input_model") != F.col("output_model")) & F.col("input_model").isin(*models) & F.col("output_model").isin(*models) & F.col("existing_flag").isin(0, 1) & ((F.col("existing_flag") == 0) | quoted))


def current(votes: DataFrame, signatures: DataFrame) -> DataFrame:
    """Votes whose fingerprint is that of the present prompt and candidate."""
    return votes.join(signatures.select("output_model", "verification_fingerprint").distinct(), ["output_model", "verification_fingerprint"], "left_semi")


def cross_scores(candidates: DataFrame, votes: DataFrame, models: list[str], pivot: bool = True) -> DataFrame:
    """candidates with cross_score, the models that found the evidence (null without any valid vote), and each model's flag."""
    each = valid_votes(votes, models).groupBy("candidate_id", F.col("input_model").alias("model"), "output_model").agg(F.max("existing_flag").alias("flag"))
    flags = [F.max(F.when(F.col("output_model") == m, F.col("flag"))).cast("double").alias(f"flag_{text_name(m)}") for m in models] if pivot else []
    scores = each.groupBy("candidate_id", "model").agg(F.sum("flag").cast("double").alias("cross_score"), *flags)
    plain = candidates.select([c for c in candidates.columns if c != "cross_score" and not c.startswith("flag_")])
    return plain.join(scores, ["candidate_id", "model"], "left")


def text_name(model: str) -> str:
    return model.rsplit("/", 1)[-1]


def missing_votes(candidates: DataFrame, votes: DataFrame, models: list[str]) -> DataFrame:
    """Votes that are needed and not there; the models that voted on a candidate are bits of numbers, so neither side has a row a pair before it is known to be missing."""
    places = [(m, f"__had{k // WIDTH}", F.lit(1 << k % WIDTH).cast("long")) for k, m in enumerate(dict.fromkeys(models))]
    words = list(dict.fromkeys(w for _, w, _ in places))
    nothing = F.lit(0).cast("long")
    had = [F.bit_or(F.coalesce(*[F.when(F.col("output_model") == m, bit) for m, w, bit in places if w == word], nothing)).alias(word) for word in words]
    have = valid_votes(votes, models).groupBy("candidate_id").agg(*had)
    told = candidates.filter(has_evidence()).select("candidate_id", "model").join(have, "candidate_id", "left")
    lacks = [F.when((F.col("model") != m) & (F.coalesce(word, nothing).bitwiseAND(bit) == 0), F.lit(m)) for m, word, bit in places]
    return told.select("candidate_id", "model", F.explode(F.array_compact(F.array(*lacks))).alias("output_model"))


def uncovered(scored: DataFrame, models: list[str]) -> DataFrame:
    """Scored candidates with evidence that lack another model's flag, have one of their own, or whose score isn't the flags' sum."""
    lacks, total = F.lit(False), F.lit(0.0)
    for m in models:
        flag, own = F.col(f"flag_{text_name(m)}"), F.col("model") == m
        lacks = lacks | (~own & flag.isNull()) | (own & (F.coalesce(flag, F.lit(0.0)) != 0))
        total = total + F.coalesce(flag, F.lit(0.0))
    return scored.filter(has_evidence()).filter(lacks | ~F.col("cross_score").eqNullSafe(total))


def stale(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """Candidates of another version of their paper than the present one."""
    now = papers.select("paper_index", F.col("paper_fingerprint").alias("__now"))
    return candidates.join(now, "paper_index").filter(~F.col("paper_fingerprint").eqNullSafe(F.col("__now"))).drop("__now")
