"""A prefix trie of conversations, built from globally sorted turn arrays.

A conversation is the array of its turns (a digest of role and text, and the
text's length). Arrays are range-sorted over all partitions, so all that begin with
the same turns are neighbours: the conversations of one node are one interval. A
sweep over a partition keeps a stack with a node for each turn of the present
array; the common prefix with the next array says how much of the stack closes, and
a node that closes adds its sums to the one below. What holds a partition's first
or last row may go on beyond it, so these two paths aren't closed but handed on: two
rows for each partition, with the sums that each open node has so far. They are in
the order of the partitions, and the same sweep over them stitches equal prefixes
together; where they are many, they are dealt out by ranges again, and so on until
they fit one task. The names of nodes that were handed on then go back to their
partitions, where their children wait for them by partition and place.

The ids of conversations that end at a node are hashed in ascending order while the
sweep passes over them; ids of a node at a partition's edge are handed on as strings
of bounded length and hashed as a stream.

Defined results: null role or text counts as empty; turns are sorted with null
first, equal turns by digest, and repeated rows stay; rows without conv_id belong to
no conversation and give nothing; no rows give no nodes; further columns are ignored;
the family of a conversation below zero is counted down from -100. A conversation is
one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from concord.llm._common import columns, forget, give_back, written

#: Turns of a shared beginning at most, and how many conversations share one.
MOST_SHARED, FAMILY = 5, 100
#: Handed-on rows that one task stitches at most.
STITCHED = 20_000
#: Ids handed on in one string at most.
IDS = 5_000

TURNS = T.ArrayType(T.StructType().add("digest", "binary").add("chars", "integer"))
#: The sums of an open node so far, without its open child: least member, members, closed children, their leaves and saved tokens; ends: '' none
#: so far, 64 hex digits if complete, else the name of a run of ids handed on.
SUMS = T.ArrayType(T.StructType().add("least", "long").add("convs", "long").add("children", "long").add("leaves", "long").add("saved", "long").add("ends", "string"))
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
#: Where a node is open: the partition's sweep, its first (0) or last (1) path, the depth.
PLACE = ["block", "side", "place"]
KINDS = dict.fromkeys(NODE, "long") | {"ends": "string"} | dict(zip(PLACE, ("string", "integer", "integer"), strict=True))
#: kind: node (closed), open (a path handed on; sums from depth on), ids (part of a run), refer (what node an open one of the level below became).
SCHEMA = T.StructType()
for name, kind in ({"kind": "string", "known": "boolean", "turns": TURNS, "sums": SUMS, "text": "string"} | KINDS | {f"from_{c}": KINDS[c] for c in PLACE}).items():
    SCHEMA = SCHEMA.add(name, kind)
NAMES = SCHEMA.fieldNames()
EMPTY = hashlib.sha256(b"").hexdigest()


class Node:
    __slots__ = ("least", "convs", "children", "leaves", "saved", "ends", "refer", "waiting")

    def __init__(self):
        self.least, self.convs, self.children, self.leaves, self.saved, self.ends, self.refer, self.waiting = None, 0, 0, 0, 0, "", [], []

    def add(self, least, convs, children, leaves, saved, ends) -> None:
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)
        self.convs, self.children, self.leaves, self.saved = self.convs + convs, self.children + children, self.leaves + leaves, self.saved + saved
        # one node's ends lie in a row, so parts that were handed on all have the run's name
        self.ends = ends if len(self.ends) < len(ends) or ends.startswith("run") else self.ends


class Sweep:
    """The stack over sorted arrays of one partition; rows collects what it says. last: nothing lies beyond, so everything closes."""

    def __init__(self, last: bool):
        self.block, self.last, self.rows = uuid.uuid4().hex, last, []
        self.turns, self.stack, self.first = [], [Node()], None

    def say(self, kind: str, **values) -> None:
        self.rows.append({"kind": kind, **values})

    def move(self, turns: list) -> None:
        """Makes turns the present array."""
        common, most = 0, min(len(turns), len(self.turns))
        while common < most and turns[common] == self.turns[common]:
            common += 1
        while len(self.stack) > common + 1:
            self.close()
        self.stack += [Node() for _ in range(len(turns) - common)]
        self.turns = turns
        if self.first is None:  # the array that the partition begins with, and how many of its nodes are still on the stack
            self.first, self.held, self.frozen = turns, len(self.stack), []

    def close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        if not self.last and depth < self.held:
            self.held = depth
            self.frozen.append(node)
        else:
            below = self.stack[-1] if self.stack else None
            saved = node.saved + (max(node.convs, 1) - 1) * (self.turns[depth - 1][1] if depth else 0)
            leaves = node.leaves if node.children else 1
            self.settle(node)
            told = {"conv_id": node.least, "depth": depth, "n_convs": node.convs, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends": node.ends or EMPTY}
            if below is None:
                self.say("node", **told, known=True, parent_conv_id=None)
                return
            below.add(node.least, node.convs, 1, leaves, saved, "")
            if not self.last and depth <= self.held:  # its parent is open at the partition's edge
                self.say("node", **told, known=False, block=self.block, side=0, place=depth - 1)
            else:
                below.waiting.append(told)

    def settle(self, node: Node) -> None:
        """A closed node's name goes to its children and to the partitions where it was open."""
        for told in node.waiting:
            self.say("node", **told, known=True, parent_conv_id=node.least)
        for block, side, place in node.refer:
            self.say("refer", from_block=block, from_side=side, from_place=place, known=True, conv_id=node.least)

    def hand_on(self, turns: list, nodes: list[Node], side: int, depth: int) -> None:
        for k, node in enumerate(nodes):
            for told in node.waiting:
                self.say("node", **told, known=False, block=self.block, side=side, place=depth + k)
            for block, at, place in node.refer:
                self.say("refer", from_block=block, from_side=at, from_place=place, known=False, block=self.block, side=side, place=depth + k)
        sums = [{"least": x.least, "convs": x.convs, "children": x.children, "leaves": x.leaves, "saved": x.saved, "ends": x.ends} for x in nodes]
        self.say("open", block=self.block, side=side, depth=depth, turns=[{"digest": d, "chars": c} for d, c in turns], sums=sums)

    def end(self) -> None:
        if self.last:
            while self.stack:
                self.close()
        elif self.first is not None:
            self.hand_on(self.first, self.stack[: self.held] + self.frozen[::-1], 0, 0)
            if len(self.stack) > self.held:
                self.hand_on(self.turns, self.stack[self.held :], 1, self.held)


def record(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in NAMES} for r in rows], schema=to_arrow_schema(SCHEMA))


def taken(sweep: Sweep, most: int = 0) -> Iterator[pa.RecordBatch]:
    if len(sweep.rows) > most:
        yield record(sweep.rows)
        sweep.rows.clear()


def listed(batch: pa.RecordBatch, at_once: int = 256) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    for k in range(0, batch.num_rows, at_once):
        arrays = batch.column(1).slice(k, at_once)
        turns = list(zip(*(x.to_pylist() for x in arrays.flatten().flatten()), strict=True))
        bounds = (arrays.offsets.to_numpy() - arrays.offsets[0].as_py()).tolist()
        for conv_id, b, e in zip(batch.column(0).slice(k, at_once).to_pylist(), bounds, bounds[1:], strict=False):
            yield conv_id, turns[b:e]


def sweep_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conv_id and turns; arrays that are equal make one run, whose ids are hashed together."""
    sweep, turns, ids, runs = Sweep(last=False), None, [], 0

    def run(edge: bool) -> None:
        nonlocal runs
        sweep.move(turns)
        runs += 1
        if edge or runs == 1:  # it may go on in the partition before or behind: its name is that of its array
            ends = "run" + hashlib.sha256(b"".join(d for d, _ in turns)).hexdigest()
            for k in range(0, len(ids), IDS):
                sweep.say("ids", ends=ends, conv_id=ids[k], text=",".join(map(str, ids[k : k + IDS])))
        else:
            ends = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        sweep.stack[-1].add(ids[0], len(ids), 0, 0, 0, ends)

    for batch in batches:
        for conv_id, array in listed(batch):
            if turns is None or array != turns:
                if turns is not None:
                    run(False)
                turns, ids = array, []
            ids.append(conv_id)
        yield from taken(sweep, 5_000)
    if turns is not None:
        run(True)
    sweep.end()
    yield from taken(sweep)
    give_back()


def stitch(last: bool):
    """The sweep over handed-on paths in the order of the sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, some = Sweep(last), False
        for batch in batches:
            for row in batch.to_pylist():
                some = True
                sweep.move([(t["digest"], t["chars"]) for t in row["turns"]])
                for k, sums in enumerate(row["sums"]):
                    node = sweep.stack[row["depth"] + k]
                    node.add(**sums)
                    node.refer.append((row["block"], row["side"], row["depth"] + k))
            yield from taken(sweep, 5_000)
        if some:
            sweep.end()
        yield from taken(sweep)
        give_back()

    return run


def trie(arrays: DataFrame, partitions: int | None = None, stitched: int = STITCHED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node; arrays: conv_id, turns."""
    spark = arrays.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = written(arrays.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turns").cast(TURNS).alias("turns")), "turns")
    level = first.repartitionByRange(partitions, "turns", "conv_id").sortWithinPartitions("turns", "conv_id").mapInArrow(sweep_arrays, SCHEMA)
    levels = [written(level, "trie")]
    while True:  # eight paths or more go in and two come out; those of equal arrays meet on the same stack, in any order
        paths = levels[-1].filter("kind = 'open'").select("block", "side", "depth", "turns", "sums")
        n = paths.count()
        if n <= stitched:
            levels.append(written(paths.repartition(1).sortWithinPartitions("turns").mapInArrow(stitch(True), SCHEMA), "trie"))
            break
        sorted_paths = paths.repartitionByRange(-(-n // max(stitched // 2, 8)), "turns", "block", "side").sortWithinPartitions("turns", "block", "side")
        levels.append(written(sorted_paths.mapInArrow(stitch(False), SCHEMA), "trie"))
    names = None  # what each open node of the level at hand became
    nodes = []
    for level in reversed(levels):
        told = level.filter("kind = 'node'")
        nodes.append(told.filter("known").select(*NODE))
        refers = level.filter("kind = 'refer'")
        above = [F.col(f"from_{c}").alias(c) for c in PLACE]
        direct = refers.filter("known").select(*above, F.col("conv_id").alias("named"))
        if names is not None:
            nodes.append(told.filter("not known").drop("parent_conv_id").join(names.withColumnRenamed("named", "parent_conv_id"), PLACE).select(*NODE))
            direct = direct.unionByName(refers.filter("not known").join(names, PLACE).select(*above, "named"))
        names = direct
    found = nodes[0]
    for more in nodes[1:]:
        found = found.unionByName(more)
    digests = runs(levels[0].filter("kind = 'ids'").select("ends", "conv_id", "text"))
    ready = found.filter("ends not like 'run%'").withColumnRenamed("ends", "ends_sha256")
    late = found.filter("ends like 'run%'").join(digests, "ends").drop("ends")
    done = written(ready.unionByName(late).select(*NODE[:-1], "ends_sha256"), "nodes")
    forget(first, *levels)
    return done


def runs(ids: DataFrame) -> DataFrame:
    """ends and ends_sha256 of runs of ids whose parts were handed on: a stream over each run's parts in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, out = None, None, []
        for batch in batches:
            for ends, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ends != name:
                    if name is not None:
                        out.append((name, digest.hexdigest()))
                    name, digest = ends, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if name is not None:
            out.append((name, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*out, strict=True)) or ([], []))], names=["ends", "ends_sha256"])

    return ids.repartition("ends").sortWithinPartitions("ends", "conv_id").select("ends", "text").mapInArrow(run, "ends string, ends_sha256 string")


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, in the order of turn."""
    rows = columns(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).alias("chars")).alias("said"))
    ordered = F.sort_array(F.collect_list("said"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first turns of its family's first one (as many as its id's checksum says) in place of its own; and a table to forget."""
    arrays = written(turn_arrays(conversations), "turn-arrays")
    place = F.pmod(F.col("conv_id"), F.lit(FAMILY))
    heads = arrays.filter(place == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    own = arrays.withColumns({"family": F.col("conv_id") - place, "shared": shared})
    head = F.coalesce(F.slice("head", F.lit(1), F.col("shared")), F.array().cast(TURNS))
    rows = own.join(heads, "family", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("shared") + 1, F.size("turns"))).alias("turns"))
    return rows, arrays


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    rows, arrays = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    nodes = trie(rows)
    forget(arrays)
    return nodes


#: The nodes by grouping every prefix; the checksum is worked out bit by bit.
OP11_SQL = """
WITH RECURSIVE told AS (
  SELECT conv_id, list(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS turns,
    list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS chars
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), sums AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS said, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM told
  UNION ALL
  SELECT conv_id, said, k + 1, list_reduce(list_concat([xor(c, ascii(said[k + 1]))], CAST(range(8) AS BIGINT[])), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)
  FROM sums WHERE k < length(said)
), shared AS (
  SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM sums WHERE k = length(said)
), built AS (
  SELECT t.conv_id, list_concat(coalesce(b.turns[1:h], []), t.turns[h + 1:]) AS turns, list_concat(coalesce(b.chars[1:h], []), t.chars[h + 1:]) AS chars
  FROM told t JOIN shared USING (conv_id) LEFT JOIN told b ON b.conv_id = t.conv_id - ((t.conv_id % 100) + 100) % 100
), spots AS (
  SELECT conv_id, turns, d, sha256(array_to_string(turns[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(turns[1:d - 1], ',')) END AS above, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS last
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)
), nodes AS (
  SELECT d, node, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(last) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends_sha256
  FROM spots GROUP BY d, node
), leafless AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.above = n.node) AS n_children FROM nodes n
), under AS (
  SELECT DISTINCT a.d, a.node, b.d AS below_d, b.node AS below FROM spots a JOIN spots b ON a.conv_id = b.conv_id AND a.d <= b.d
), subtrees AS (
  SELECT u.d, u.node, count(*) FILTER (l.n_children = 0) AS n_leaves, sum(l.saved) AS saved_tokens FROM under u JOIN leafless l ON l.d = u.below_d AND l.node = u.below GROUP BY u.d, u.node
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM leafless n JOIN subtrees s ON s.d = n.d AND s.node = n.node LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.above
"""
