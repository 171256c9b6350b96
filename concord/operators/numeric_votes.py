"""Votes on numeric answers: tally, winners, pooled candidates and option summaries.

All take rows of paper_index, question_index, item, value and optionally unit, model
and a confidence; each is one or two grouped passes, whatever the number of papers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from concord.functions import numeric, text, vocab
from concord.functions.columns import computed

KEYS = ("paper_index", "question_index")


def with_items(df: DataFrame, merge_none_mixed: bool = True, equivalence: bool = True, theme: str | None = None) -> DataFrame:
    """df with item_norm, item_equiv and model."""
    df = computed(df, item_norm=text.item_name("item", theme))
    key = text.item_key("item_norm", merge_none_mixed) if equivalence else text.item_base("item_norm") if merge_none_mixed else F.col("item_norm")
    df = computed(df, item_equiv=key)
    return df if "model" in df.columns else df.withColumn("model", F.lit(None).cast("string"))


def without_bad(df: DataFrame) -> DataFrame:
    return df.filter(F.col("item").isNull() | (F.col("item") != vocab.BAD_ITEM))


def named(df: DataFrame, conf_col: str | None = None, merge_none_mixed: bool = True, equivalence: bool = True, drop_bad: bool = True, theme: str | None = None) -> DataFrame:
    """df with item_norm, item_equiv and conf; rows of bad items left out."""
    found = numeric.confidence_column(df, conf_col)
    conf = numeric.confidence(found) if found else F.lit(1.0)
    return computed(with_items(without_bad(df) if drop_bad else df, merge_none_mixed, equivalence, theme), conf=conf)


def counted(df: DataFrame, columns: tuple[str, ...], conf_col: str | None = None, drop_bad: bool = True, **options) -> DataFrame:
    """`named` rows, one for each different combination of the columns with n, its rows, and the sum of their conf.

    Items, numbers and units are read after this grouping, once for each combination
    and not for each row.
    """
    found = numeric.confidence_column(df, conf_col)
    conf = numeric.confidence(found) if found else F.lit(1.0)
    rows = (without_bad(df) if drop_bad else df).groupBy(*[c for c in columns if c in df.columns]).agg(F.count("*").alias("n"), F.sum(conf).alias("conf"))
    return with_items(rows, **options)


def prepared(df: DataFrame, **options) -> DataFrame:
    """`named` rows with the number columns."""
    return with_numbers(named(df, **options))


def with_numbers(rows: DataFrame) -> DataFrame:
    return numeric.with_value_unit(rows, "value", "unit" if "unit" in rows.columns else None)


def valid(df: DataFrame, meaningless: tuple[str, ...] = vocab.MEANINGLESS_NUMERIC) -> DataFrame:
    return df.filter(F.col("scalar_value").isNotNull() & ~numeric.is_meaningless("scalar_value", meaningless))


def representative_items(rows: DataFrame, count: str | None = None) -> DataFrame:
    """paper_index, question_index, item_equiv and item: its most frequent spelling, the least of equals; over all rows, valid or not. A row stands for as many as its count says."""
    counts = rows.groupBy(*KEYS, "item_equiv", "item_norm").agg((F.sum(count) if count else F.count("*")).alias("n"))
    return counts.groupBy(*KEYS, "item_equiv").agg(F.min(F.struct((-F.col("n")).alias("n"), "item_norm"))["item_norm"].alias("item"))


def item_names(df: DataFrame, **options) -> DataFrame:
    """`representative_items` of rows that aren't named yet."""
    return representative_items(counted(df, (*KEYS, "item"), **options), "n")


def null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join in which null keys meet; the keys stay once."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys]
    return left.join(other, on, how).drop(*[f"__r_{c}" for c in keys])


def tally(df: DataFrame, meaningless: tuple[str, ...] = vocab.MEANINGLESS_NUMERIC, **options) -> DataFrame:
    """A row for each value of each item: count of rows, confidence_sum, the sorted models."""
    rows = counted(df, (*KEYS, "item", "value", "unit", "model"), **options)
    boxes = valid(with_numbers(rows), meaningless).groupBy(*KEYS, "item_equiv", "normalized_value").agg(
        F.sum("n").alias("count"), F.sum("conf").alias("confidence_sum"), text.joined_distinct(F.trim(F.col("model").cast("string")), ",").alias("models"),
        F.coalesce(F.min(F.when(F.col("unit_norm") != "", F.col("unit_norm"))), F.lit("")).alias("unit"), F.bool_or("unit_is_explicit").alias("unit_is_explicit"), F.min("scalar_value").alias("scalar_value"),
    )
    return null_safe(boxes, item_names(df, **options), (*KEYS, "item_equiv")).select(*KEYS, "item", "normalized_value", "scalar_value", "unit", "unit_is_explicit", "count", "confidence_sum", "models")


def shown_value() -> Column:
    """A result's value: the number alone if its unit has a column of its own."""
    return F.when(F.col("unit_is_explicit"), F.col("scalar_value")).otherwise(F.col("normalized_value"))


def order_of(prefer: str = "votes", second: str = "confidence", value: str = "normalized_value") -> Column:
    """What the winner has most of; of equals the text that sorts last."""
    first = F.col("count").cast("double") if prefer == "votes" else F.col("confidence_sum")
    return F.struct(first.alias("a"), (F.col("confidence_sum") if second == "confidence" else F.col("count").cast("double")).alias("b"), F.col(value).alias("c"))


RESULT = (*KEYS, "item", "ensemble_value", "unit", "unit_is_explicit", "vote_count", "models")


def winners(boxes: DataFrame, prefer: str = "votes", second: str = "confidence") -> DataFrame:
    """The winning value of each item, of a tally's rows."""
    best = boxes.groupBy(*KEYS, "item").agg(F.max_by(F.struct(*[c for c in boxes.columns if c not in (*KEYS, "item")]), order_of(prefer, second)).alias("w"))
    return best.select(*KEYS, "item", "w.*").select(*KEYS, "item", shown_value().alias("ensemble_value"), "unit", "unit_is_explicit", F.col("count").alias("vote_count"), "models")


def decimal_majority(df: DataFrame, ratio: float = 0.5, by: tuple[str, ...] = ("paper_index",), meaningless: tuple[str, ...] = vocab.MEANINGLESS_NUMERIC) -> DataFrame:
    """For each paper whether at least that share of its valid numbers has two decimals or more; rows of bad items count too."""
    # a number is read once for each different text of a group
    counts = df.groupBy(*dict.fromkeys([*by, "value"])).agg(F.count("*").alias("n"))
    rows = valid(numeric.with_number(counts, "value"), meaningless)
    long = F.sum(F.when(numeric.is_long_decimal("scalar_value"), F.col("n")).otherwise(0))
    return rows.groupBy(*by).agg(F.sum("n").alias("n_values"), long.alias("n_long"), (long / F.sum("n") >= ratio).alias("decimals_majority"))


def pool_of() -> dict[str, Column]:
    """Aggregates of the boxes of one value over several items."""
    split = F.flatten(F.collect_list(F.split("models", ",")))
    return {
        "vote_count": F.sum("count"), "models": F.array_join(F.array_sort(F.filter(F.array_distinct(split), lambda m: m != "")), ","),
        "item": F.coalesce(F.min(F.when(F.trim("item") != "", F.trim("item"))), F.lit("")), "unit": F.coalesce(F.min(F.when(F.col("unit") != "", F.col("unit"))), F.lit("")),
        "unit_is_explicit": F.bool_or("unit_is_explicit"), "scalar_value": F.min("scalar_value"),
    }


def pooled(boxes: DataFrame) -> DataFrame:
    """All candidate values of each question with their votes over all its items, named by the first item."""
    pool = boxes.groupBy(*KEYS, "normalized_value").agg(*[c.alias(n) for n, c in pool_of().items()])
    return pool.select(*KEYS, "item", shown_value().alias("ensemble_value"), "unit", "unit_is_explicit", "vote_count", "models")


def ensemble(df: DataFrame, ratio: float = 0.5, prefer: str = "votes", second: str = "confidence", meaningless: tuple[str, ...] = vocab.MEANINGLESS_NUMERIC, **options) -> DataFrame:
    """Results: pooled candidates for papers of mostly long decimals, else a winner for each item.

    Both come from one grouping of the tally: a pooled row's group is its value, another's its item.
    """
    mode = decimal_majority(df, ratio, meaningless=meaningless).filter("decimals_majority").select("paper_index", "decimals_majority")
    told = null_safe(tally(df, meaningless, **options), mode, ("paper_index",), "left")
    pools = F.coalesce("decimals_majority", F.lit(False))
    told = told.withColumns({"__pools": pools, "__item": F.when(~pools, F.col("item")), "__value": F.when(pools, F.col("normalized_value"))}).drop("decimals_majority")
    best = F.max_by(F.struct("item", "normalized_value", "scalar_value", "unit", "unit_is_explicit", F.col("count").alias("vote_count"), "models"), order_of(prefer, second))
    pool = F.struct(*[c.alias(n) for n, c in pool_of().items()])
    out = told.groupBy(*KEYS, "__pools", "__item", "__value").agg(best.alias("best"), pool.alias("pool"))
    names = ("item", "normalized_value", "scalar_value", "unit", "unit_is_explicit", "vote_count", "models")
    of = lambda n: F.when(F.col("__pools"), F.col("__value") if n == "normalized_value" else F.col(f"pool.{n}")).otherwise(F.col(f"best.{n}")).alias(n)
    return out.select(*KEYS, *[of(n) for n in names]).withColumn("ensemble_value", shown_value()).select(*RESULT)


def value_options(df: DataFrame, topk: int | None = None, prefer: str = "votes", second: str = "confidence", meaningless: tuple[str, ...] = vocab.MEANINGLESS_NUMERIC, **options) -> DataFrame:
    """Every value of each item of a paper: shares, up to five samples, ranks and winners."""
    rows = counted(df, ("paper_index", "item", "value", "unit", "model"), **options)
    counts = counted(df, ("paper_index", "item"), **options).groupBy("paper_index", "item_equiv", "item_norm").agg(F.sum("n").alias("n"))
    names = counts.groupBy("paper_index", "item_equiv").agg(F.min(F.struct((-F.col("n")).alias("n"), "item_norm"))["item_norm"].alias("item"))
    raw = F.trim(F.col("value").cast("string"))
    boxes = valid(with_numbers(rows), meaningless).groupBy("paper_index", "item_equiv", F.col("normalized_value").alias("value_norm")).agg(
        F.sum("n").alias("count"), F.sum("conf").alias("confidence_sum"), text.joined_distinct(F.trim(F.col("model").cast("string")), ",").alias("models"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.when(raw != "", raw))), 1, 5), ", ").alias("raw_samples"),
    )
    group = Window.partitionBy("paper_index", "item_equiv")
    rank = lambda *cols: F.row_number().over(group.orderBy(*cols))
    up, votes, conf = F.col("value_norm").asc(), F.col("count").desc(), F.col("confidence_sum").desc()
    best = order_of(prefer, second, "value_norm")
    out = boxes.withColumns(
        {
            "vote_share": F.col("count") / F.sum("count").over(group),
            "conf_share": F.col("confidence_sum") / F.when(F.sum("confidence_sum").over(group) == 0, 1.0).otherwise(F.sum("confidence_sum").over(group)),
            "rank_by_votes": rank(votes, conf, up), "rank_by_conf": rank(conf, votes, up),
            "is_winner_by_votes": F.col("count") == F.max("count").over(group), "is_winner_by_conf": F.col("confidence_sum") == F.max("confidence_sum").over(group),
            "is_winner": best == F.max(best).over(group),
        }
    )
    if topk:
        shown = Window.partitionBy("paper_index", "item_equiv").orderBy(F.col("is_winner").desc(), "rank_by_votes" if prefer == "votes" else "rank_by_conf")
        out = out.withColumn("__k", F.row_number().over(shown)).filter(F.col("__k") <= topk).drop("__k")
    return null_safe(out, names, ("paper_index", "item_equiv")).drop("item_equiv")


def majorities(df: DataFrame, row_order: str, meaningless: tuple[str, ...] = vocab.MEANINGLESS_NUMERIC, **options) -> DataFrame:
    """Each value of a paper over all its items: distinct models, and `model -> item` of each row in row_order."""
    rows = valid(prepared(df, drop_bad=False, **options), meaningless)
    model = F.trim(F.coalesce(F.col("model").cast("string"), F.lit("")))
    told = F.array_sort(F.collect_list(F.when(model != "", F.struct(F.col(row_order).alias("o"), F.concat(model, F.lit(" -> "), F.col("item_norm")).alias("t")))))
    return rows.groupBy("paper_index", F.col("normalized_value").alias("value_norm")).agg(
        F.count_distinct(F.when(F.col("model").isNotNull(), model)).alias("vote_count"), F.sum("conf").alias("confidence_sum"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("model").isNotNull(), model))), ",").alias("models"),
        F.array_join(F.array_sort(F.collect_set("item_norm")), ",").alias("items"), F.array_join(F.transform(told, lambda s: s["t"]), "; ").alias("source"),
    )
