"""A run's ledger as an append log that several writers share: tasks, gates and reserved attempts.

An append is a Parquet folder and a version file that names it. A writer decides on
the versions that it has read and then claims the next version; of two writers that
read the same versions one gets it, and the other reads again and decides anew. What
nobody claimed is never read. States are folds of the claimed rows; asks that the
ledger doesn't allow are rows too, of kind `refused`, and change nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from concord.functions import text
from concord.operators import lifecycle, running

ROWS = "seq long, kind string, key string, payload string"
#: Rows of a written part and of a version have fewer places than these; a version beyond them is refused as a whole.
PART, SPAN = 10**8, 10**13
TRIES = 10


class Lost(RuntimeError):
    """Another writer has claimed the version."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return at, at.getFileSystem(conf), conf


def head(spark: SparkSession, path: str) -> int:
    """The last claimed version, 0 if there is none."""
    at, fs, _ = _path(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def _claim_linked(to: str, content: bytes) -> bool:
    """Puts a local file there unless one is: a hard link to an existing name fails."""
    os.makedirs(os.path.dirname(to), exist_ok=True)
    part = f"{os.path.dirname(to)}/.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(content)
    try:
        os.link(part, to)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(part)


def _claim_renamed(spark: SparkSession, to: str, content: bytes) -> bool:
    """Puts a file there by a rename that doesn't replace: atomic on HDFS; object stores have no such rename."""
    at, fs, conf = _path(spark, to)
    hadoop = spark._jvm.org.apache.hadoop.fs
    part = hadoop.Path(at.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(content))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(part, at, how)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        fs.delete(part, False)
        return False


def claim(spark: SparkSession, to: str, content: bytes) -> bool:
    """Whether the file is ours now."""
    at, fs, _ = _path(spark, to)
    if fs.getUri().getScheme() == "file":
        return _claim_linked(at.toUri().getPath(), content)
    return _claim_renamed(spark, to, content)


def append(rows: DataFrame, path: str, seen: int) -> int:
    """The version that rows became, behind the version seen; Lost if that is another writer's. No rows make no version."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    numbered = rows.select(F.monotonically_increasing_id().alias("at"), "kind", "key", "payload")
    # these ids are a part's number and 33 bits for the place in it
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    fits = (place < PART) & (part < SPAN // PART)
    seq = F.when(fits, part * F.lit(PART) + place).otherwise(F.raise_error(F.lit("too many rows for a version")).cast("long"))
    to = f"{path}/rows/append={name}"
    numbered.select(seq.alias("seq"), "kind", "key", "payload").write.parquet(to)
    if spark.read.schema(ROWS).parquet(to).isEmpty():
        return seen
    if not claim(spark, f"{path}/versions/{seen + 1:020d}", json.dumps({"version": seen + 1, "append": name}).encode()):
        raise Lost(f"version {seen + 1} of {path} is another writer's")
    return seen + 1


def read(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """version, seq, kind, key and payload of all claimed rows, up to a version."""
    last = head(spark, path) if upto is None else upto
    if not last:
        return spark.createDataFrame([], f"version long, {ROWS}")
    versions = spark.read.schema("version long, append string").json(f"{path}/versions").filter(F.col("version") <= last)
    rows = spark.read.schema(f"{ROWS}, append string").parquet(f"{path}/rows")
    return rows.join(versions, "append").select("version", "seq", "kind", "key", "payload")


def transact(spark: SparkSession, path: str, decide: Callable[[DataFrame], DataFrame], tries: int = TRIES) -> int:
    """Appends what decide makes of the rows so far; where another writer was first, decides again on what is there then."""
    for _ in range(tries):
        seen = head(spark, path)
        try:
            return append(decide(read(spark, path, seen)), path, seen)
        except Lost:
            continue
    raise Lost(f"{path}: lost {tries} times")


def in_order(log: DataFrame) -> DataFrame:
    """All rows, first one first."""
    return log.orderBy("version", "seq")


def _place() -> Column:
    return F.col("version") * SPAN + F.col("seq")


def _last(log: DataFrame, kind: str, schema: str) -> DataFrame:
    """key and the fields of its last payload of a kind."""
    rows = log.filter(F.col("kind") == kind).groupBy("key").agg(F.max_by("payload", _place()).alias("payload"))
    return rows.select("key", F.from_json("payload", schema).alias("p")).select("key", "p.*")


def _asks(asked: DataFrame, key: str, kind: str, refusal: Column, *fields: str) -> DataFrame:
    """A row for each ask: of its kind, or refused with the reason."""
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    refused = F.to_json(F.struct(F.lit(kind).alias("asked"), F.col("__why").alias("reason")))
    rows = asked.withColumn("__why", refusal)
    return rows.select(F.when(F.col("__why").isNull(), kind).otherwise("refused").alias("kind"), F.col(key).alias("key"), F.when(F.col("__why").isNull(), payload).otherwise(refused).alias("payload"))


def _blank(name: str) -> Column:
    return F.coalesce(text.strip(F.col(name)) == "", F.lit(True))


def put_tasks(tasks: DataFrame, path: str) -> int:
    """Plans tasks (task_id, stage, payload): the same one again changes nothing, one of another identity is refused."""

    def decide(log: DataFrame) -> DataFrame:
        known = _last(log, "task_put", "stage string, payload string").select(F.col("key").alias("task_id"), F.struct("stage", "payload").alias("__known"))
        own = F.struct("stage", F.coalesce("payload", F.lit("{}")).alias("payload"))
        asked = tasks.groupBy("task_id").agg(F.collect_set(own).alias("__own")).join(known, "task_id", "left")
        one = F.get("__own", F.lit(0))
        asked = asked.withColumns({"stage": one["stage"], "payload": one["payload"]})
        new = asked.filter(F.col("__known").isNull() | (F.size("__own") > 1) | ~one.eqNullSafe(F.col("__known")))
        why = F.when(_blank("task_id") | _blank("stage"), "no task_id or stage").when(F.col("__known").isNotNull() | (F.size("__own") > 1), "another identity")
        return _asks(new, "task_id", "task_put", why, "stage", "payload")

    return transact(tasks.sparkSession, path, decide)


def finish_tasks(done: DataFrame, path: str) -> int:
    """Ends tasks (task_id, status, artifacts as JSON text, error): unknown ones are refused; every end stays in the log."""

    def decide(log: DataFrame) -> DataFrame:
        known = log.filter("kind = 'task_put'").select(F.col("key").alias("task_id"), F.lit(True).alias("__known")).distinct()
        why = F.when(F.col("__known").isNull(), "unknown task").when(_blank("status"), "no status")
        return _asks(done.join(known, "task_id", "left"), "task_id", "task_finished", why, "status", "artifacts", "error")

    return transact(done.sparkSession, path, decide)


def tasks(log: DataFrame) -> DataFrame:
    """task_id, stage, payload, status (planned until an end is told), artifacts and error."""
    put = _last(log, "task_put", "stage string, payload string")
    ends = _last(log, "task_finished", "status string, artifacts string, error string")
    return put.join(ends, "key", "left").select(F.col("key").alias("task_id"), "stage", "payload", F.coalesce("status", F.lit("planned")).alias("status"), "artifacts", "error")


def open_gates(gates: DataFrame, path: str) -> int:
    """Opens gates (gate_id, gate, target, reason); one without a reason or of a known id is refused."""

    def decide(log: DataFrame) -> DataFrame:
        known = log.filter("kind = 'gate_opened'").select(F.col("key").alias("gate_id"), F.lit(True).alias("__known")).distinct()
        asked = gates.groupBy("gate_id").agg(F.min(F.struct("gate", "target", "reason")).alias("g"), F.count("*").alias("__n")).select("gate_id", "g.*", "__n")
        why = F.when(_blank("gate_id") | _blank("reason"), "a gate needs an id and a reason").when(F.col("__known").isNotNull() | (F.col("__n") > 1), "known gate")
        return _asks(asked.join(known, "gate_id", "left"), "gate_id", "gate_opened", why, "gate", "target", "reason")

    return transact(gates.sparkSession, path, decide)


def approve_gates(decisions: DataFrame, path: str) -> int:
    """Approves gates (gate_id, reason), each once; without a reason, for an unknown gate or a second time it is refused."""

    def decide(log: DataFrame) -> DataFrame:
        now = gates(log).select("gate_id", F.col("status").alias("__status"))
        asked = decisions.groupBy("gate_id").agg(F.min("reason").alias("reason")).join(now, "gate_id", "left")
        why = F.when(F.col("__status").isNull(), "unknown gate").when(F.col("__status") != "pending", "decided before").when(_blank("reason"), "an approval needs a reason")
        return _asks(asked, "gate_id", "gate_approved", why, "reason")

    return transact(decisions.sparkSession, path, decide)


def gates(log: DataFrame) -> DataFrame:
    """gate_id, gate, target, reason, status (pending or approved) and decision."""
    opened = _last(log, "gate_opened", "gate string, target string, reason string")
    told = _last(log, "gate_approved", "reason string").select("key", F.col("reason").alias("decision"), F.lit(True).alias("__told"))
    status = F.when(F.col("__told").isNull(), "pending").otherwise("approved")
    return opened.join(told, "key", "left").select(F.col("key").alias("gate_id"), "gate", "target", "reason", status.alias("status"), "decision")


def tell(events: DataFrame, path: str) -> int:
    """Appends what became of attempts (attempt_id, kind as in lifecycle.STEPS, actual_tokens, actual_cost).

    An attempt has one event an append, since rows of an append have no order; several
    are refused. The fold refuses what an attempt's state doesn't allow.
    """
    payload = F.to_json(F.struct(F.col("actual_tokens").cast("long").alias("tokens"), F.col("actual_cost").cast("double").alias("cost")))
    several = F.count("*").over(Window.partitionBy("attempt_id")) > 1
    reason = F.to_json(F.struct(F.col("kind").alias("asked"), F.lit("several events at once").alias("reason")))
    rows = events.withColumn("__several", several).select(
        F.when(F.col("__several"), "refused").otherwise(F.concat(F.lit("attempt_"), "kind")).alias("kind"), F.col("attempt_id").alias("key"), F.when(F.col("__several"), reason).otherwise(payload).alias("payload")
    )
    return transact(events.sparkSession, path, lambda _: rows)


def attempts(log: DataFrame) -> DataFrame:
    """attempt_id, task_id, request_hash, status, and the tokens and cost that were reserved and used."""
    rows = log.filter(F.col("kind").startswith("attempt_"))
    states = lifecycle.states(rows.select(F.col("key").alias("attempt_id"), _place().alias("event_id"), F.substring("kind", 9, 100).alias("kind")))
    asked = _last(rows, "attempt_reserve", "task_id string, request_hash string, tokens long, cost double").withColumnsRenamed({"tokens": "reserved_tokens", "cost": "reserved_cost"})
    used = _last(rows, "attempt_receive", "tokens long, cost double").withColumnsRenamed({"tokens": "actual_tokens", "cost": "actual_cost"})
    told = states.join(asked.withColumnRenamed("key", "attempt_id"), "attempt_id").join(used.withColumnRenamed("key", "attempt_id"), "attempt_id", "left")
    return told.select("attempt_id", "task_id", "request_hash", F.col("state").alias("status"), "reserved_tokens", "reserved_cost", "actual_tokens", "actual_cost")


def reserve(asked: DataFrame, path: str, calls: int | None = None, tokens: int | None = None, cost: float | None = None) -> int:
    """Reserves attempts (attempt_id, task_id, request_hash, tokens, cost, place) as far as requests and the run's limits allow.

    place is a unique number, the order in which they are asked for. Refused are: a known
    attempt_id; a request that has an attempt which forbids another, has used its
    attempts, or was asked for before in the same batch; without a cost where cost is
    limited; and from the first on that would exceed a limit, all that follow, since a
    run that has met its limit stays stopped.
    """
    spark = asked.sparkSession
    keys = ["task_id", "request_hash"]

    def decide(log: DataFrame) -> DataFrame:
        now = attempts(log)
        first = asked.groupBy(*keys).agg(F.min("place").alias("__first"))
        told = lifecycle.admitted(asked.join(first, keys, "left"), now)
        told = told.join(now.select("attempt_id", F.lit(True).alias("__known")), "attempt_id", "left")
        why = (
            F.when(_blank("attempt_id") | _blank("task_id") | _blank("request_hash") | F.col("place").isNull(), "no attempt_id, task_id, request_hash or place")
            .when(F.col("__known").isNotNull(), "known attempt")
            .when(F.col("verdict") != "free", F.col("verdict"))
            .when(F.col("place") > F.col("__first"), "live")
        )
        if cost is not None:
            why = why.when(F.col("cost").isNull(), "no price")
        told = told.withColumn("__no", why)
        received, held = F.col("status") == "received", F.col("status").isin("reserved", "dispatched", "unknown")
        spent = lambda name: F.coalesce(F.sum(F.when(received, F.col(f"actual_{name}")).when(held, F.col(f"reserved_{name}"))), F.lit(0))
        so_far = now.agg(F.count_if(received | held).alias("calls"), spent("tokens").alias("tokens"), spent("cost").alias("cost")).first()
        sums = told.filter("__no is null").select("place", F.lit(1).cast("long").alias("calls"), F.col("tokens").cast("long").alias("tokens"), F.col("cost").cast("double").alias("cost"))
        sums = running.running(sums, "place", "calls", "tokens", "cost")
        caps = {"calls": calls, "tokens": tokens, "cost": cost}
        over = F.lit(False)
        for name, cap in caps.items():
            if cap is not None:
                over = over | (F.col(f"running_{name}") + F.lit(so_far[name]) > (running.slack(cap) if name == "cost" else cap))
        stop = sums.filter(over).agg(F.min("place")).first()[0]
        refusal = F.coalesce("__no", F.when(F.col("place") >= stop, "limit")) if stop is not None else F.col("__no")
        return _asks(told, "attempt_id", "attempt_reserve", refusal, "task_id", "request_hash", "tokens", "cost")

    return transact(spark, path, decide)


def refusals(log: DataFrame) -> DataFrame:
    """version, key, asked and reason of each ask that wasn't allowed."""
    return log.filter("kind = 'refused'").select("version", "key", F.from_json("payload", "asked string, reason string").alias("p")).select("version", "key", "p.*")
