"""A run's ledger as relations: attempts and their budget, tasks, gates and states, all derived from appended events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ATTEMPTS = 3


def latest(events: DataFrame, *keys: str, order: str = "event_id") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(events.columns)


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def budget_totals(attempts: DataFrame) -> DataFrame:
    """One row: calls, tokens and cost known and held back; total_cost is null unless every call's is known.

    Received attempts count what they used; dispatched and unknown ones hold what was
    reserved; reserved ones hold it without a call; rejected and imported ones cost
    nothing.
    """
    status, cost = F.col("status"), F.col("actual_cost")
    called, held = status.isin("received", "dispatched", "unknown"), status.isin("reserved", "dispatched", "unknown")
    known = status == "received"
    out = attempts.filter("status <> 'imported'").agg(
        F.count_if(called).alias("calls"), F.coalesce(F.sum(F.when(known, F.col("actual_tokens"))), F.lit(0)).alias("known_tokens"), F.coalesce(F.sum(F.when(held, F.col("reserved_tokens"))), F.lit(0)).alias("held_tokens"),
        F.coalesce(F.sum(F.when(known, cost)), F.lit(0.0)).alias("known_cost"), F.coalesce(F.sum(F.when(held, F.col("reserved_cost"))), F.lit(0.0)).alias("held_cost"),
        F.count_if((known & cost.isNull()) | status.isin("dispatched", "unknown")).alias("open_costs"),
    )
    return out.withColumn("total_cost", F.when(F.col("open_costs") == 0, F.col("known_cost")))


def first_breach(spent: DataFrame, cap: float | Column, amount: str, order: str, *by: str) -> DataFrame:
    """Of each key the first row at which its running sum exceeds the cap, with that sum.

    A key's rows are one account; accounts are what is dealt out.
    """
    running = F.sum(amount).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    over = spent.withColumn("running", running).filter(F.col("running") > cap)
    rest = [c for c in over.columns if c not in by]
    return over.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*by, "__r.*")


def over_ceiling(attempts: DataFrame, ceiling: int = ATTEMPTS) -> DataFrame:
    """Requests of a task with as many attempts as are allowed, or more."""
    return attempts.groupBy("task_id", "request_hash").agg(F.count("*").alias("attempts")).filter(F.col("attempts") >= ceiling)


def live(attempts: DataFrame) -> DataFrame:
    """Requests with an attempt that still runs: they must not be sent again."""
    return attempts.filter(F.col("status").isin("reserved", "dispatched")).select("task_id", "request_hash").distinct()


def recovered(attempts: DataFrame) -> DataFrame:
    """Attempts after a crash: sent ones are unknown, others were never sent."""
    return attempts.withColumn("status", F.when(F.col("status") == "dispatched", "unknown").when(F.col("status") == "reserved", "rejected").otherwise(F.col("status")))


def first_responses(attempts: DataFrame, order: str = "created_at") -> DataFrame:
    """The earliest response to each request, for any later request of the same hash."""
    done = attempts.filter("status = 'received'")
    rest = [c for c in done.columns if c != "request_hash"]
    return done.groupBy("request_hash").agg(F.min_by(F.struct(*rest), F.struct(order, "attempt_id")).alias("__r")).select("request_hash", "__r.*")


def retry_class(status: Column, code: Column) -> Column:
    """What a rejection means: try again, stop, or unknown."""
    return F.when((status == "rejected") & (code == 429), "retry").when((status == "rejected") & code.isin(400, 401, 403, 404), "stop").otherwise("unknown")


def open_intervals(starts: DataFrame, finishes: DataFrame, *keys: str, order: str = "event_id") -> DataFrame:
    """Starts behind which no finish of their key comes."""
    ends = finishes.groupBy(*keys).agg(F.max(order).alias("__end"))
    return starts.join(ends, list(keys), "left").filter(F.col("__end").isNull() | (F.col(order) > F.col("__end"))).drop("__end")


def error_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind").startswith("error") | F.get_json_object("payload", "$.error").isNotNull())


def waiting_gates(gates: DataFrame, attempts: DataFrame) -> DataFrame:
    """Gates without a decision whose attempt is still open."""
    return gates.filter("status = 'pending'").join(attempts.filter(F.col("status").isin("unknown", "dispatched")).select(F.col("attempt_id").alias("target")), "target", "left_semi")


def unique_quotes(quotes: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected models with the price of their endpoint, where exactly one is quoted."""
    once = quotes.groupBy("base_url", "model").agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in quotes.columns if c not in ("base_url", "model")]).filter("__n = 1").drop("__n")
    return selected.join(once, ["base_url", "model"])


def damaged(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts whose file is gone or has another digest or size."""
    return receipts.join(files.select("path", F.col("sha256").alias("__sha"), F.col("bytes").alias("__bytes")), "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("__sha")) | ~F.col("bytes").eqNullSafe(F.col("__bytes"))).drop("__sha", "__bytes")


def imported(source: DataFrame, target: DataFrame, spec: str) -> DataFrame:
    """Finished tasks of another run that this one plans too and hasn't begun, at no cost."""
    begun = target.filter("status <> 'planned'").select("task_id")
    new = source.filter("status = 'succeeded'").join(target.select("task_id"), "task_id", "left_semi").join(begun, "task_id", "left_anti")
    return new.withColumns({"status": F.lit("imported"), "actual_cost": F.lit(0.0), "spec_hash": F.lit(spec)})


def deltas(totals: DataFrame, *amounts: str, order: str = "at", by: str = "run_id") -> DataFrame:
    """Differences to the row before."""
    w = Window.partitionBy(by).orderBy(order)
    return totals.withColumns({f"{a}_delta": F.col(a) - F.lag(a, 1, 0).over(w) for a in amounts})
