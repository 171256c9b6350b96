"""Published records against a reference set: matched by identity, judged by sets of values.

A record has kind, paper_uid, question, item, variant, round, experiment_id, unit,
value, status (value, not_reported, or a diagnostic) and candidate_set, an array of
(value, unit). Its key is its context with unit and experiment; its context is what
it answers: paper, question, item, variant and round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from concord.functions import numeric, text, vocab
from concord.functions.columns import computed

CONTEXT = ("paper_uid", "question", "item_key", "variant", "round")
KEY = (*CONTEXT, "experiment_id")


def is_blank(c: Column | str) -> Column:
    return text.is_missing(c, vocab.BLANK_RECORD)


def is_true(c: Column | str) -> Column:
    """true, yes or 1 in any case; never null."""
    return F.coalesce(F.lower(text.strip((F.col(c) if isinstance(c, str) else c).cast("string"))).isin("true", "1", "yes", "1.0"), F.lit(False))


def published_pair(value: Column | str, unit: Column | str) -> Column:
    """(value, unit) of a published value whose unit may stand behind its first blank."""
    v, u = (F.col(c) if isinstance(c, str) else c for c in (value, unit))
    head, rest = F.substring_index(v, " ", 1), F.instr(v, " ") > 0
    tail = F.when(rest, F.substring(v, F.instr(v, " ") + 1, F.length(v)))
    return F.struct(F.when(is_blank(u) & rest, head).otherwise(v).alias("value"), F.coalesce(F.when(~is_blank(u), u), tail, F.lit("")).alias("unit"))


def prepared(records: DataFrame) -> DataFrame:
    """records with item_key, the normalised assertions (distinct value and unit) and uncomparable, the reason why a row can't be judged, null if it can."""
    df = computed(records, item_key=text.item_key("item")).withColumn("__own", F.array(F.struct(F.col("value").cast("string").alias("value"), F.col("unit").cast("string").alias("unit"))))
    own = F.when(F.size("candidate_set") > 0, F.col("candidate_set")).otherwise(F.col("__own")) if "candidate_set" in records.columns else F.col("__own")
    df = df.withColumn("__rows", own)
    said = F.filter("__rows", lambda s: ~is_blank(s["value"]))
    number = lambda s: F.regexp_extract(F.replace(s["value"], F.lit(","), F.lit("")), r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*$", 1).try_cast("double")
    as_number = F.transform(said, lambda s: F.struct(number(s).alias("number"), numeric.explicit_unit(s["unit"]).alias("unit")))
    as_number = F.transform(as_number, lambda s: F.struct(numeric.number_text(s["number"]).alias("value"), s["unit"].alias("unit")))
    as_text = F.transform(said, lambda s: F.struct(text.text_key(s["value"]).alias("value"), F.lit("").alias("unit")))
    told = F.filter(F.when(F.col("kind") == "numeric", as_number).otherwise(as_text), lambda s: s["value"].isNotNull() & (s["value"] != ""))
    df = computed(df, assertions=F.array_sort(F.array_distinct(told)))
    asserts = F.coalesce(F.col("status"), F.lit("value")) == "value"
    numeric_kind = asserts & (F.col("kind") == "numeric")
    reason = (
        F.when(numeric_kind & (F.size("assertions") == 0) & F.exists("__rows", lambda s: ~is_blank(s["value"])), "malformed_value")
        .when(numeric_kind & F.exists("__rows", lambda s: is_blank(s["unit"])), "no_unit")
        .when(numeric_kind & is_blank("experiment_id"), "no_experiment")
    )
    return computed(df, status=F.coalesce(F.col("status"), F.lit("value")), uncomparable=reason, experiment_id=F.when(F.col("kind") == "numeric", F.coalesce("experiment_id", F.lit(""))).otherwise(F.lit(""))).drop("__own", "__rows")


def by_key(rows: DataFrame, side: str) -> DataFrame:
    """One row for each key: how many records, their assertions together, and how many are absent, a diagnostic or can't be read."""
    asserts = (F.col("status") == "value") & F.col("uncomparable").isNull()
    return rows.groupBy(*KEY).agg(
        F.count_if(asserts).alias(f"{side}_values"),
        F.count_if(F.col("status") == "not_reported").alias(f"{side}_absent"),
        F.count_if(~F.col("status").isin("value", "not_reported")).alias(f"{side}_diagnostic"),
        F.count_if(F.col("uncomparable") == "malformed_value").alias(f"{side}_malformed"),
        F.count("*").alias(f"{side}_rows"),
        F.array_distinct(F.flatten(F.collect_list(F.when(asserts, F.col("assertions"))))).alias(f"{side}_said"),
    )


def cases(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every key of either side with its reason (of several verdicts, joined by +), and tp, fp, fn, tn and unmatched.

    A reference value is found, contradicted, missed (its key was reached without a
    value, or a value in its context can't be read) or unmatched. A reference absence is
    judged beside it, by what was predicted at its key: an absence confirms it, else a
    value is wrong, else it is unmatched. A reference value that was found, contradicted
    or missed and any reference absence consume their context; a predicted value counts
    as wrong where no reference value has its key and nothing consumed its context. A
    matching key is one true positive and a confirmed absence one true negative,
    whatever their records; errors and misses count records, and so do diagnostic or
    unreadable records of the reference, which are unmatched.
    """
    counts = [f"{s}_{k}" for s in ("gold", "pred") for k in ("values", "absent", "diagnostic", "malformed", "rows")]
    both = by_key(prepared(gold), "gold").join(by_key(prepared(predicted), "pred"), list(KEY), "full_outer").na.fill(0, counts)
    some = lambda name: F.col(name) > 0
    value, absent, alone = some("gold_values"), some("gold_absent"), some("pred_values")
    reached = alone | some("pred_absent") | some("pred_diagnostic")
    within = Window.partitionBy(*CONTEXT)
    told = both.withColumns(
        {"near": F.sum("pred_rows").over(within), "near_malformed": F.sum("pred_malformed").over(within), "taken": F.max((value & reached) | absent).over(within), "known": F.max(value).over(within)}
    )
    consumed = F.col("taken") | (F.col("known") & some("near_malformed"))
    found = (
        F.when(~value, None)
        .when(alone & F.arrays_overlap("gold_said", "pred_said"), "match")
        .when(alone, "value_mismatch")
        .when(reached | some("near_malformed"), "reference_value_not_published")
        .when(some("near"), "prediction_not_comparable")
        .otherwise("no_comparable_prediction")
    )
    absence = F.when(~absent, None).when(some("pred_absent"), "absence_confirmed").when(alone, "value_where_none_is_reported").when(some("pred_diagnostic"), "absence_against_diagnostic").otherwise("absence_unmatched")
    uncovered_ = F.when(~value & alone & ~consumed, "uncovered_prediction")
    unread = F.when(some("gold_diagnostic") | some("gold_malformed"), "unresolved_reference")
    told = told.withColumns({"__value": found, "__absence": absence, "__alone": uncovered_, "__unread": unread})
    told = told.withColumn("reason", F.coalesce(F.nullif(F.concat_ws("+", "__value", "__absence", "__alone", "__unread"), F.lit("")), F.lit("not_judged")))
    number = lambda name, reasons, n: F.when(F.col(name).isin(*reasons), n).otherwise(F.lit(0)).cast("long")
    return told.withColumns(
        {
            "tp": number("__value", ["match"], F.lit(1)),
            "fp": number("__value", ["value_mismatch"], F.col("pred_values")) + number("__absence", ["value_where_none_is_reported"], F.col("pred_values")) + number("__alone", ["uncovered_prediction"], F.col("pred_values")),
            "fn": number("__value", ["value_mismatch", "reference_value_not_published"], F.col("gold_values")),
            "tn": number("__absence", ["absence_confirmed"], F.lit(1)),
            "unmatched": number("__value", ["prediction_not_comparable", "no_comparable_prediction"], F.col("gold_values")) + number("__absence", ["absence_against_diagnostic", "absence_unmatched"], F.col("gold_absent")) + F.col("gold_diagnostic") + F.col("gold_malformed"),
        }
    ).drop("near", "near_malformed", "taken", "known", "gold_said", "pred_said", "gold_malformed", "pred_malformed", "gold_rows", "pred_rows", "__value", "__absence", "__alone", "__unread")


def metrics(judged: DataFrame, *by: str) -> DataFrame:
    """Sums of a case table with precision, recall and f1, null where nothing can be divided."""
    sums = judged.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn", "unmatched")])
    sums = sums.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    return sums.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def uncovered(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predictions at keys that no reference record has."""
    return predicted.join(gold.select(*KEY).distinct(), list(KEY), "left_anti")


def covered_context(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Reference records in whose context anything was predicted."""
    return gold.join(predicted.select(*CONTEXT).distinct(), list(CONTEXT), "left_semi")


def excluded(records: DataFrame) -> DataFrame:
    """Reasons why records can't be judged, and how many each holds."""
    return prepared(records).groupBy(F.coalesce("uncomparable", F.lit("comparable")).alias("reason")).agg(F.count("*").alias("n"))


def one_experiment(experiment: Column | str) -> Column:
    """Aggregate: the only experiment that isn't blank; empty if there are several or none."""
    c = F.col(experiment) if isinstance(experiment, str) else experiment
    found = F.collect_set(F.when(~is_blank(c), text.strip(c.cast("string"))))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise("")


def support(published: DataFrame, candidates: DataFrame) -> DataFrame:
    """Published rows with each candidate that their support list names."""
    named = published.withColumn("candidate_id", F.explode(F.split("support_candidate_ids", r"\|")))
    return named.join(candidates, "candidate_id")


def contributors(published: DataFrame, candidates: DataFrame) -> DataFrame:
    """Published rows with the candidates of their value: of the same item, or of any where the row is pooled over items."""
    names = {"paper_index": "__paper", "question_index": "__question", "item_key": "__item", "normalized_value": "__value"}
    c = candidates.select(*names, "candidate_id").withColumnsRenamed(names)
    on = (F.col("paper_index") == F.col("__paper")) & (F.col("question_index") == F.col("__question")) & (F.col("ensemble_value") == F.col("__value"))
    pooled = F.coalesce(F.col("pooled"), F.lit(False))
    alone = published.filter(~pooled).join(c, on & (F.col("item_key") == F.col("__item")))
    return alone.unionByName(published.filter(pooled).join(c, on)).drop(*names.values())
