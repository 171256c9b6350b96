"""Tables of a run's report: coverage, verification, thresholds, disagreement, outliers, vectors and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from concord.functions import body, numeric, text, vectors, vocab
from concord.operators.consensus import has_evidence


def extraction_coverage(grid: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks of the frozen grid by what became of them: answered, invalid, failed, pending or never begun."""
    state = found.groupBy(*keys).agg(F.count_if(F.col("status") == "succeeded").alias("ok"), F.count_if(F.col("status") == "invalid").alias("bad"), F.count_if(F.col("status") == "failed").alias("err"), F.count("*").alias("n"))
    told = grid.join(state, keys, "left")
    outcome = F.when(F.col("ok") > 0, "answered").when(F.col("bad") > 0, "invalid").when(F.col("err") > 0, "failed").when(F.col("n") > 0, "pending").otherwise("not_begun")
    return told.withColumn("outcome", outcome).groupBy("outcome").agg(F.count("*").alias("n"))


#: A model's bits in a candidate's number: asked, cast, a flag of 0 or 1, a flag of 1, an error; models to a number; the bit of votes by none of them.
ASKED, CAST, SEEN, FOUND, ERROR, BITS = 1, 2, 4, 8, 16, 5
WIDTH, STRANGE = 12, 60


def verification_accounting(candidates: DataFrame, votes: DataFrame, models: list[str]) -> DataFrame:
    """One row of counters: candidates, votes expected, seen, of which found, and missing; votes nobody expected.

    A candidate's pairs with models are bits, so one row a candidate is shuffled from
    either side; only pairs with models outside of the pool have rows of their own.
    """
    pool = list(dict.fromkeys(models))
    chunks = [pool[k : k + WIDTH] for k in range(0, len(pool), WIDTH)] or [[]]
    number = lambda chunk, of: reduce(Column.bitwiseOR, [of(m, BITS * k) for k, m in enumerate(chunk)], F.lit(0).cast("long"))
    asks = lambda m, at: F.when(F.col("model") != m, F.lit(ASKED << at)).otherwise(F.lit(0)).cast("long")
    flag = F.col("existing_flag")
    told = F.lit(CAST) + F.when(flag.isin(0, 1), SEEN).otherwise(0) + F.when(flag == 1, FOUND).otherwise(0) + F.when(flag == -1, ERROR).otherwise(0)
    casts = lambda m, at: F.when(F.col("output_model") == m, F.shiftleft(told.cast("long"), at)).otherwise(F.lit(0).cast("long"))
    stranger = ~F.coalesce(F.col("output_model").isin(*pool), F.lit(False))
    strange = F.when(stranger, F.lit(1 << STRANGE)).otherwise(F.lit(0)).cast("long")
    words = [f"w{j}" for j in range(len(chunks))]
    asked = candidates.filter(has_evidence()).select("candidate_id", F.lit(None).cast("string").alias("other"), *[number(c, asks).alias(w) for w, c in zip(words, chunks, strict=True)])
    cast = votes.select("candidate_id", F.when(stranger, F.col("output_model").cast("string")).alias("other"), *[(number(c, casts).bitwiseOR(strange) if w == "w0" else number(c, casts)).alias(w) for w, c in zip(words, chunks, strict=True)])
    each = asked.unionByName(cast).groupBy("candidate_id", "other").agg(*[F.bit_or(w).alias(w) for w in words])
    ones = F.lit(sum(1 << BITS * k for k in range(WIDTH)))
    of = lambda w, bit: F.shiftrightunsigned(F.col(w), bit.bit_length() - 1).bitwiseAND(ones)
    # votes and candidates without an id don't meet
    meets = F.when(F.col("candidate_id").isNotNull(), ones).otherwise(F.lit(0).cast("long"))
    both = lambda w: of(w, ASKED).bitwiseAND(meets)
    total = lambda f: F.coalesce(F.sum(sum((F.bit_count(f(w)) for w in words), F.lit(0)).cast("long")), F.lit(0).cast("long"))
    counts = each.agg(
        total(lambda w: of(w, ASKED)).alias("expected"), total(lambda w: both(w).bitwiseAND(of(w, SEEN))).alias("seen"), total(lambda w: both(w).bitwiseAND(of(w, FOUND))).alias("found"),
        total(lambda w: both(w).bitwiseAND(F.bitwise_not(of(w, SEEN))).bitwiseAND(of(w, ERROR))).alias("errors"), total(lambda w: of(w, ASKED).bitwiseAND(F.bitwise_not(of(w, CAST).bitwiseAND(meets)))).alias("missing"),
        (total(lambda w: of(w, CAST).bitwiseAND(F.bitwise_not(both(w)))) + F.count_if(F.col("w0").bitwiseAND(F.lit(1 << STRANGE)) != 0)).alias("unexpected"),
    )
    eligible = candidates.agg(F.count("*").alias("candidates"), F.count_if(has_evidence()).alias("eligible"))
    return eligible.crossJoin(counts)  # two rows of one each


def score_histogram(scored: DataFrame) -> DataFrame:
    return scored.filter(has_evidence()).groupBy("cross_score").agg(F.count("*").alias("n"))


def threshold_pass_rates(scored: DataFrame, thresholds: list[int]) -> DataFrame:
    """For each threshold the share of eligible candidates that reach it, and the most that it could be once every vote is in."""
    rows = scored.filter(has_evidence()).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    passed, open_ = F.count_if(F.col("cross_score") >= F.col("threshold")), F.count_if(F.col("cross_score").isNull())
    out = rows.groupBy("threshold").agg(F.count("*").alias("eligible"), passed.alias("passed"), open_.alias("incomplete"))
    return out.withColumns({"pass_rate": F.try_divide("passed", "eligible"), "possible_upper_rate": F.try_divide(F.col("passed") + F.col("incomplete"), "eligible")})


def disagreement(answers: DataFrame, order: str) -> DataFrame:
    """Items of a paper on which models differ, by each model's last answer; a missing value is an answer too."""
    last = answers.groupBy("paper_index", "item", "model").agg(F.max(F.struct(F.col(order).alias("o"), F.col("normalized_value").alias("v")))["v"].alias("value"))
    return last.groupBy("paper_index", "item").agg(F.count("*").alias("n_models"), F.count_distinct(F.coalesce("value", F.lit(""))).alias("n_values")).withColumn("disagree", F.col("n_values") > 1)


def outliers(answers: DataFrame, factor: float = 100.0, least_models: int = 2) -> DataFrame:
    """Single numbers further from their item's upper median than factor times it; ranges are no outliers but kind `range`."""
    rows = answers.filter(F.col("scalar_value").isNotNull()).withColumn("x", F.col("scalar_value").try_cast("double"))
    group = ("paper_index", "item")
    # of n numbers the upper median is the one of rank n div 2 + 1; counts of equal numbers keep a group's rows bounded by its different ones
    counts = rows.groupBy(*group, "x").agg(F.count("x").alias("n"), F.collect_set("model").alias("models"))
    ranks = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy(*group).orderBy("x")), "total": F.sum("n").over(Window.partitionBy(*group))})
    middle = F.min(F.when(F.expr("upto >= total div 2 + 1"), F.col("x")))
    told = ranks.groupBy(*group).agg(middle.alias("upper_median"), F.size(F.array_distinct(F.flatten(F.collect_list("models")))).alias("__models"))
    both = rows.join(told, list(group))
    far = (F.col("__models") >= least_models) & (F.abs(F.col("x") - F.col("upper_median")) > factor * F.greatest(F.abs("upper_median"), F.lit(1e-12)))
    warning = F.when(F.col("x").isNull(), "range").when(far, "outlier")
    return both.withColumn("warning", warning).filter("warning is not null").select(*answers.columns, F.when(F.col("x").isNotNull(), F.col("upper_median")).alias("upper_median"), "warning")


def unit_warnings(answers: DataFrame) -> DataFrame:
    """Items of a paper that come with several units."""
    return answers.groupBy("paper_index", "item").agg(F.count_distinct(F.when(F.col("unit_norm") != "", F.col("unit_norm"))).alias("n_units")).filter("n_units > 1")


def vector_states(expected: DataFrame, found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Expected vectors by state: missing, stale, wrong_count, empty, not_finite, zero or valid."""
    told = expected.join(found, keys, "left")
    state = (
        F.when(F.col("vector").isNull() & F.col("fingerprint").isNull(), "missing")
        .when(~F.col("fingerprint").eqNullSafe(F.col("expected_fingerprint")), "stale")
        .when(F.col("vector").isNull() | (F.size("vector") == 0), "empty")
        .when(F.size("vector") != size, "wrong_size")
        .when(F.exists("vector", lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), "not_finite")
        .when(vectors.norm(F.col("vector")) == 0, "zero")
        .otherwise("valid")
    )
    return told.withColumn("state", state).groupBy("state").agg(F.count("*").alias("n"))


def token_audit(papers: DataFrame, full: str = "text", own: str = "body") -> DataFrame:
    """Characters and tokens of whole papers and their bodies, and the share that is kept."""
    sums = papers.select(F.char_length(full).alias("chars"), F.char_length(own).alias("body_chars"), body.token_count(full).alias("tokens"), body.token_count(own).alias("body_tokens"))
    out = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns])
    return out.withColumn("kept_ratio", F.try_divide("body_tokens", "tokens"))


def has_value(c: str):
    return ~text.is_missing(c, vocab.NO_REPORT_VALUE)


def result_kinds(results: DataFrame) -> DataFrame:
    """Published rows by kind: accepted, tied, other values, too few models, or without a value."""
    kind = F.when(F.col("accepted"), "accepted").when(~has_value("scalar_value"), "no_value").otherwise(F.col("gate_reason"))
    return results.withColumn("result_kind", kind).groupBy("result_kind").agg(F.count("*").alias("n"))


def malformed(answers: DataFrame) -> DataFrame:
    """Values that are there and in which no number is found."""
    return answers.filter(has_value("value") & ~numeric.is_meaningless("value") & F.col("scalar_value").isNull())
