"""A running sum over one ordered account that no single task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges of the order that an account is parted into at most: the driver sees so many bounds and sums.
RANGES = 200


def running(rows: DataFrame, order: str, *amounts: str, ranges: int = RANGES) -> DataFrame:
    """rows with running_<amount> for each: the sum of the amount up to the row, by order (a number, unique); null amounts count as 0.

    The order's quantiles part it into ranges. A range's rows are summed up in a window
    of their own, and what all ranges before it come to is added, from one sum a range.
    Rows without an order have no place and no sum.
    """
    at = [k / ranges for k in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx(order, at, 10 * ranges).alias("b")).first().b or []
    bounds = sorted(set(bounds))
    # the first bound that is not below a row's place is its range
    part = F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda n, b: n + (b < F.col(order)).cast("int")) if bounds else F.lit(0)
    told = rows.withColumn("__part", F.when(F.col(order).isNotNull(), part))
    sums = {r["__part"]: r for r in told.groupBy("__part").agg(*[F.sum(a).alias(a) for a in amounts]).collect()}
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    added = {}
    for a in amounts:
        kind, before, befores = rows.schema[a].dataType, 0, []
        for k in range(len(bounds) + 1):
            befores.append(before)
            before = before + (sums[k][a] or 0 if k in sums else 0)
        start = F.get(F.array(*[F.lit(b) for b in befores]), F.col("__part"))
        total = F.coalesce(F.sum(a).over(within), F.lit(0).cast(kind))
        added[f"running_{a}"] = F.when(F.col("__part").isNotNull(), start + total)
    return told.withColumns(added).drop("__part")


def slack(cap: float | Column) -> Column:
    """The next double above a positive cost limit: a sum of costs may differ by its last digit."""
    cap = cap if isinstance(cap, Column) else F.lit(float(cap))
    return cap + cap * (0.6 * 2.0**-52)


def run_breaches(attempts: DataFrame, order: str, calls: int | None = None, tokens: int | None = None, cost: float | None = None, ranges: int = RANGES) -> DataFrame:
    """limit_name, the place of the first attempt at which a run is beyond that limit, and what it came to by then.

    A received attempt counts what it used, reserved, dispatched and unknown ones what
    they hold; each of them is a call, a reserved one because it keeps its slot. A limit
    that is null or kept gives no row.
    """
    status = F.col("status")
    held = status.isin("reserved", "dispatched", "unknown")
    spent = lambda name: F.when(status == "received", F.col(f"actual_{name}")).when(held, F.col(f"reserved_{name}"))
    rows = attempts.select(F.col(order).alias("place"), (held | (status == "received")).cast("long").alias("calls"), spent("tokens").cast("long").alias("tokens"), spent("cost").cast("double").alias("cost"))
    limits = [("calls", F.lit(calls)), ("tokens", F.lit(tokens)), ("cost", slack(cost) if cost is not None else None)]
    given = [(n, c) for (n, c), v in zip(limits, (calls, tokens, cost), strict=True) if v is not None]
    if not given:
        return attempts.sparkSession.createDataFrame([], "limit_name string, place long, running double")
    told = running(rows, "place", *[n for n, _ in given], ranges=ranges)
    over = [F.struct(F.lit(n).alias("limit_name"), F.col(f"running_{n}").cast("double").alias("running"), (F.col(f"running_{n}") > cap).alias("over")) for n, cap in given]
    beyond = told.select("place", F.inline(F.array(*over))).filter("over")
    return beyond.groupBy("limit_name").agg(F.min("place").alias("place"), F.min_by("running", "place").alias("running"))
