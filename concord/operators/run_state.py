"""A run's state as a fold of asked changes: where it stands, what it goes back to, and which changes were refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The states of a run in their order, those that interrupt it, and the one that ends it by failure.
STATES = ("INIT", "PREFLIGHT", "INPUT_READY", "SMOKE", "HUMAN_GATE_SMOKE", "BATCH", "FINAL_QC", "ARCHIVE", "DONE")
INTERRUPTS = ("PAUSED", "RECOVERABLE_ERROR", "HUMAN_GATE")
FATAL = "FATAL_ERROR"

#: Where a run can stand: nowhere yet, in a state, or interrupted on its way from one.
PLACES = [("", None), *((s, None) for s in (*STATES, FATAL)), *((i, s) for i in INTERRUPTS for s in STATES[:-1])]
NUMBER = {p: k for k, p in enumerate(PLACES)}
#: Events of one run that are folded at once.
BLOCK = 10_000


def change(state: str, resume: str | None, to: str | None) -> tuple[str, str | None] | None:
    """Where a change leads, or None if it is refused: forward by one, to failure, into an interrupt, between interrupts and back to where the first one came from."""
    if not state:
        return (STATES[0], None) if to == STATES[0] else None
    if state in INTERRUPTS:
        return (to, resume) if to in INTERRUPTS else (to, None) if to == resume else None
    if state in (FATAL, STATES[-1]):
        return None
    if to in INTERRUPTS:
        return to, state
    return (to, None) if to in (FATAL, STATES[STATES.index(state) + 1]) else None


def _after(place: Column, to: Column) -> Column:
    """The number of the place behind a change, null if it is refused."""
    asked = (*STATES, FATAL, *INTERRUPTS)
    led = [NUMBER[change(*p, s)] if change(*p, s) else None for p in PLACES for s in asked]
    table = F.array(*[F.lit(n).cast("int") for n in led])
    number = F.nullif(F.array_position(F.array(*map(F.lit, asked)), to), F.lit(0)).cast("int")
    return F.get(table, place * len(asked) + number - 1)


def _blocks(events: DataFrame) -> DataFrame:
    """run_id, block, the block's events and the place before it.

    Of a run's first block that is nowhere; any other block first becomes a map from
    each place to the one behind it, and a run's maps are followed one by one.
    """
    asked = events.select("run_id", "event_id", F.coalesce("state", F.lit("")).alias("state"), F.expr(f"event_id div {BLOCK}").alias("block"))
    told = asked.groupBy("run_id", "block").agg(F.array_sort(F.collect_list(F.struct("event_id", "state"))).alias("events"))
    told = told.withColumn("first", F.col("block") == F.min("block").over(Window.partitionBy("run_id")))
    starts = F.when(F.col("first"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(len(PLACES) - 1)))
    led = F.aggregate("events", starts, lambda m, e: F.transform(m, lambda p: F.coalesce(_after(p, e["state"]), p)))
    runs = told.select("run_id", "block", led.alias("map")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("maps"))
    begin = F.struct(F.lit(0).alias("place"), F.array().cast("array<struct<block:bigint,place:int>>").alias("befores"))
    followed = F.aggregate(
        "maps", begin, lambda s, b: F.struct(F.get(b["map"], s["place"]).alias("place"), F.concat(s["befores"], F.array(F.struct(b["block"].alias("block"), s["place"].alias("place")))).alias("befores"))
    )
    befores = runs.select("run_id", F.explode(followed["befores"]).alias("b")).select("run_id", "b.block", F.col("b.place").alias("before"))
    return told.join(befores, ["run_id", "block"])


def _walked(events: DataFrame) -> DataFrame:
    """run_id, block, the place behind it and its refused changes."""
    begin = F.struct(F.col("before").alias("place"), F.array().cast("array<struct<event_id:bigint,state:string,place:int>>").alias("refused"))

    def step(s: Column, e: Column) -> Column:
        to = _after(s["place"], e["state"])
        no = F.array(F.struct(e["event_id"].alias("event_id"), e["state"].alias("state"), s["place"].alias("place")))
        return F.struct(F.coalesce(to, s["place"]).alias("place"), F.when(to.isNull(), F.concat(s["refused"], no)).otherwise(s["refused"]).alias("refused"))

    return _blocks(events).select("run_id", "block", F.aggregate("events", begin, step).alias("end")).select("run_id", "block", "end.place", "end.refused")


def _named(place: Column) -> tuple[Column, Column]:
    states, resumes = (F.array(*[F.lit(p[k]).cast("string") for p in PLACES]) for k in (0, 1))
    return F.nullif(F.get(states, place), F.lit("")), F.get(resumes, place)


def refused(events: DataFrame) -> DataFrame:
    """run_id, event_id, the state asked for and the one that didn't allow it (null at the beginning). events: run_id, event_id (unique in its run) and state; a null or unknown state is refused."""
    rows = _walked(events).select("run_id", F.explode("refused").alias("r"))
    return rows.select("run_id", "r.event_id", "r.state", _named(F.col("r.place"))[0].alias("previous"))


def standing(events: DataFrame) -> DataFrame:
    """run_id, state, resume_state (what an interrupted run goes back to) and refused, the number of refused changes."""
    ends = _walked(events).groupBy("run_id").agg(F.max_by("place", "block").alias("place"), F.sum(F.size("refused")).alias("refused"))
    state, resume = _named(F.col("place"))
    return ends.select("run_id", state.alias("state"), resume.alias("resume_state"), "refused")


def overdue(events: DataFrame, limit: str, clock: Column | None = None) -> DataFrame:
    """attempt_id, dispatched_at, due_at and answered_at of attempts whose answer didn't come within the limit (an interval).

    events: attempt_id, event_id, kind and told_at. An attempt is dispatched by the first
    event behind its reservation that a reservation allows, if it is a dispatch. An
    answer at the due time is in time; answered_at is null where none came. The clock
    is the latest time of all events where none is given.
    """
    order = F.struct("told_at", "event_id")
    rows = events.filter("attempt_id is not null and told_at is not null")
    reserved = rows.filter("kind = 'reserve'").groupBy("attempt_id").agg(F.min(order).alias("r"))
    left = rows.filter(F.col("kind").isin("dispatch", "reject", "recover")).join(reserved, "attempt_id").filter(order > F.col("r"))
    sent = left.groupBy("attempt_id").agg(F.min_by("kind", order).alias("kind"), F.min(order).alias("d")).filter("kind = 'dispatch'").select("attempt_id", "d")
    ends = rows.filter(F.col("kind").isin("receive", "fail", "reject", "recover")).select("attempt_id", order.alias("e"))
    told = sent.join(ends, "attempt_id", "left").groupBy("attempt_id", "d").agg(F.min(F.when(F.col("e") > F.col("d"), F.col("e"))).alias("e"))
    told = told.select("attempt_id", F.col("d.told_at").alias("dispatched_at"), (F.col("d.told_at") + F.expr(f"interval {limit}")).alias("due_at"), F.col("e.told_at").alias("answered_at"))
    late = told.filter(F.col("answered_at").isNull() | (F.col("answered_at") > F.col("due_at")))
    return late.filter(F.col("due_at") < (rows.agg(F.max("told_at")).scalar() if clock is None else clock))
