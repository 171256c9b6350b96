"""Dual-threshold consensus: verified candidates, one vote for each model, and a unique most frequent value with enough models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from concord.functions import coords, numeric, text, vocab
from concord.functions.columns import computed
from concord.operators import text_votes

BOX = ("paper_index", "question_index", "item_key", "unit", "experimental")


def consensus_threshold(models: list[str], asked: object = None) -> int:
    """Models that a consensus needs: more than half of the pool, or the number asked for if it is one from 1 to all."""
    if not models or len(set(models)) != len(models):
        raise ValueError("the pool of models must be given, each model once")
    least = len(models) // 2 + 1 if asked is None else asked
    if type(least) is not int or not 1 <= least <= len(models):
        raise ValueError(f"the consensus threshold must be an integer from 1 to {len(models)}")
    return least


def verification_thresholds(models: list[str], asked: list[object]) -> list[int]:
    """Thresholds of verifying models, each an integer from 1 to all but the generating one."""
    for x in asked:
        if type(x) is not int or not 1 <= x <= len(models) - 1:
            raise ValueError(f"verification thresholds must be integers from 1 to {len(models) - 1}")
    return list(asked)


def has_evidence(evidence: Column | str = "evidence") -> Column:
    return ~text.is_missing(evidence, vocab.NO_EVIDENCE)


def outside_pool(df: DataFrame, models: list[str]) -> DataFrame:
    """Candidates with evidence whose model isn't in the pool: there must be none."""
    return df.filter(has_evidence() & ~F.coalesce(F.col("model").isin(*models), F.lit(False)))


def verified(df: DataFrame, threshold: int | Column) -> DataFrame:
    """Candidates with evidence that enough models verified; a score that is no number fails."""
    score = F.col("cross_score").cast("double")
    return df.filter(has_evidence() & ~F.isnan(score) & (score >= threshold))


def normalised(df: DataFrame, kind: str, items: list[str] | None = None) -> DataFrame:
    """Candidates with item_key, unit, experimental, scalar_value and normalized_value; those without a value are left out."""
    df = computed(df, item=text.strip(F.col("item").cast("string")))
    if items:
        df = df.filter(F.col("item").isin(*items))
    marked = F.coalesce(text.strip(F.col("experimental").cast("string")), F.lit("")) if "experimental" in df.columns else F.lit("")
    df = computed(df, item_key=text.item_key("item"), experimental=marked, paper_index=text.paper_id("paper_index"))
    if kind == "numeric":
        df = numeric.with_value_unit(df, "value", "unit" if "unit" in df.columns else None)
        return df.filter(F.col("scalar_value").isNotNull() & ~numeric.is_meaningless("scalar_value")).withColumn("unit", F.col("unit_norm")).drop("unit_norm")
    df = text_votes.prepared(df)
    short = coords.interval(F.when(F.col("kind") == "coord", F.col("normalized_value")))
    df = df.withColumn("__i", short)
    shown = coords.interval_format(coords.rounded(F.col("__i.low"), 2), coords.rounded(F.col("__i.high"), 2), 2, 2)
    df = df.withColumn("__s", shown).withColumn("normalized_value", F.when(F.col("kind") == "coord", F.col("__s")).otherwise(F.col("normalized_value")))
    return df.filter("normalized_value <> ''").withColumns({"scalar_value": F.col("normalized_value"), "unit": F.lit(""), "unit_is_explicit": F.lit(False)}).drop("__i", "__s", "interval", "period", "kind")


def boxes(candidates: DataFrame) -> DataFrame:
    """A row for each normalised value of a question's item, unit and experiment: distinct models and candidates.

    Rows are first one a model, so counting models needs no second distinct pass.
    """
    by_model = candidates.groupBy(*BOX, "normalized_value", "model").agg(F.min("item").alias("item"), F.min("scalar_value").alias("scalar_value"), F.bool_or("unit_is_explicit").alias("unit_is_explicit"), F.collect_set(F.when(F.col("candidate_id") != "", F.col("candidate_id"))).alias("ids"))
    return by_model.groupBy(*BOX, "normalized_value").agg(
        F.min("item").alias("item"), F.min("scalar_value").alias("scalar_value"), F.bool_or("unit_is_explicit").alias("unit_is_explicit"), F.count("*").alias("count"),
        F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), "|").alias("support_candidate_ids"),
    )


def gate(found: DataFrame, n_models: int, least: int, verification: int | None = None) -> DataFrame:
    """Boxes with gate_reason, accepted and fraction: ties of the mode, other values and too few models are turned away, in that order."""
    group = Window.partitionBy(*BOX)
    told = found.withColumn("__most", F.max("count").over(group)).withColumn("__ties", F.count_if(F.col("count") == F.col("__most")).over(group))
    reason = (
        F.when((F.col("__ties") > 1) & (F.col("count") == F.col("__most")), "tied_mode")
        .when(F.col("count") != F.col("__most"), "not_mode")
        .when(F.col("__most") < least, "below_consensus_threshold")
        .otherwise("accepted")
    )
    told = told.withColumns({"gate_reason": reason, "fraction": F.col("count") / n_models, "n_models": F.lit(n_models), "consensus_threshold": F.lit(least), "verification_threshold": F.lit(verification).cast("int"), "aggregation_mode": F.lit("dual_threshold")})
    return told.withColumn("accepted", F.col("gate_reason") == "accepted").drop("__most", "__ties")


def confirm(df: DataFrame, models: list[str], verification: int, least: int | None = None, kind: str = "numeric", items: list[str] | None = None) -> DataFrame:
    """Every box of the verified candidates with its gate; the accepted ones are the published results."""
    return gate(boxes(normalised(verified(df, verification), kind, items)), len(models), consensus_threshold(models, least), verification)


def accepted(found: DataFrame) -> DataFrame:
    """Published results of confirm()."""
    return found.filter("accepted").select("paper_index", "question_index", "item", F.col("scalar_value").alias("ensemble_value"), "unit", "unit_is_explicit", F.col("count").alias("vote_count"), "models", "experimental", "support_candidate_ids", F.lit("dual_threshold").alias("method"))


def variants(df: DataFrame, thresholds: list[int]) -> DataFrame:
    """df once for all candidates (variant 00_full, no threshold) and once for each threshold that a candidate's score reaches."""
    score = F.col("cross_score").cast("double")
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: ~F.isnan(score) & (score >= t))
    marks = F.concat(F.array(F.lit(None).cast("int")), F.coalesce(reached, F.array().cast("array<int>")))
    out = df.withColumn("verification_threshold", F.explode(marks))
    return out.withColumn("variant", F.when(F.col("verification_threshold").isNull(), "00_full").otherwise(F.format_string("MiniCrossNN%02d", "verification_threshold")))
