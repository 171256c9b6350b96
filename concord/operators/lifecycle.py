"""Requests as a fold of appended events: what each attempt came to, which requests may be sent, and what was paid beyond its reservation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from concord.operators.ledger import ATTEMPTS

# Where an event takes an attempt from each state; any other event is refused and changes nothing.
STEPS = {
    ("none", "reserve"): "reserved",
    ("reserved", "dispatch"): "dispatched", ("reserved", "reject"): "rejected", ("reserved", "recover"): "rejected",
    ("dispatched", "receive"): "received", ("dispatched", "fail"): "unknown", ("dispatched", "reject"): "rejected", ("dispatched", "recover"): "unknown",
    ("unknown", "receive"): "received", ("unknown", "release"): "rejected", ("unknown", "hold"): "unknown",
}
BEGUN = ("none", "reserved", "dispatched", "unknown", "received", "rejected")
#: Attempts in these states forbid another one for the same task and request.
BLOCKING = ("reserved", "dispatched", "unknown", "received", "imported")
#: Events of one attempt that are folded at once.
BLOCK = 100_000


def states(events: DataFrame) -> DataFrame:
    """attempt_id, state and refused, the number of events that its state didn't allow.

    events has attempt_id, event_id and kind, with at most one row for an event_id. A
    block of events is a map from the state before it to the state behind it, so an
    attempt's events needn't come together: blocks are folded first, then their maps.
    Null kinds are refused.
    """
    steps = F.create_map(*chain.from_iterable((F.lit(f"{s}>{k}"), F.lit(to)) for (s, k), to in STEPS.items()))
    place = F.create_map(*chain.from_iterable((F.lit(s), F.lit(n)) for n, s in enumerate(BEGUN)))

    def after(told: Column, kind: Column) -> Column:
        to = F.try_element_at(steps, F.concat_ws(">", told["state"], kind))
        return F.struct(F.coalesce(to, told["state"]).alias("state"), (told["refused"] + to.isNull().cast("long")).alias("refused"))

    fresh = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(0).cast("long").alias("refused")) for s in BEGUN])
    told = events.groupBy("attempt_id", F.expr(f"event_id div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("event_id", "kind"))).alias("events"))
    told = told.select("attempt_id", "block", F.aggregate("events", fresh, lambda m, e: F.transform(m, lambda s: after(s, e["kind"]))).alias("map"))
    blocks = told.groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("blocks"))

    def over(now: Column, block: Column) -> Column:
        then = F.get(block["map"], F.element_at(place, now["state"]))
        return F.struct(then["state"].alias("state"), (now["refused"] + then["refused"]).alias("refused"))

    begin = F.struct(F.lit("none").alias("state"), F.lit(0).cast("long").alias("refused"))
    return blocks.select("attempt_id", F.aggregate("blocks", begin, over).alias("end")).select("attempt_id", "end.state", "end.refused")


def admitted(asked: DataFrame, attempts: DataFrame, limit: int = ATTEMPTS) -> DataFrame:
    """asked with verdict: whether a request may get another attempt as the ledger stands: live, ceiling or free.

    Both have task_id and request_hash. Verdicts don't see each other: whoever sends
    takes requests one by one.
    """
    keys = ["task_id", "request_hash"]
    used = attempts.groupBy(*keys).agg(F.count_if(F.col("status").isin(*BLOCKING)).alias("__live"), F.count("*").alias("__used"))
    verdict = F.when(F.col("__live") > 0, "live").when(F.col("__used") >= limit, "ceiling").otherwise("free")
    return asked.join(used, keys, "left").withColumn("verdict", verdict).drop("__live", "__used")


def overshoots(attempts: DataFrame) -> DataFrame:
    """Received attempts that took more tokens or cost than was reserved; a cost may differ by its last binary digit."""
    cost = F.col("reserved_cost")
    # 0.6 units of the last digit round up to the next number, whatever the cost
    more = (F.col("actual_tokens") > F.col("reserved_tokens")) | F.coalesce(F.col("actual_cost") > cost + cost * (0.6 * 2.0**-52), F.lit(False))
    return attempts.filter((F.col("status") == "received") & F.col("actual_tokens").isNotNull() & more)
