"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Every length is an integer of at most `capacity`, so the whole packing problem is
a histogram of at most `capacity` counts, however many documents there are. Only
that histogram reaches the driver: plan() packs it, and the pieces then find their
places by their rank among the pieces of their length. A rank needs no group in
one task: the task that cuts a piece numbers it among its own of that length, and
the tasks' counts are summed before it.

Defined results: a null text counts as empty, so it is the end id alone; a null
doc_id stays null; repeated rows are packed each; no rows give no pieces; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from concord.llm._common import arrow_pass, batch_of, columns, slices, written
from concord.llm.tokens import WordCodec, default_tokenizer, segments

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary, task long, nth long"


def tokenise_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document: its ids (little-endian unsigned 32-bit), the task that cut it and its number there among those of its length."""
    path = tokenizer or default_tokenizer()

    def make():
        codec, task, seen = WordCodec(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def step(batch):
            out = []
            texts = batch.column(1)
            for b, e in slices(texts.to_pylist()):
                ids, counts = codec.encode(texts.slice(b, e - b))
                held = np.full(len(ids) + len(counts), end_id, "<u4")
                ends = np.cumsum(counts + 1)
                held[segments(ends - counts - 1, counts)] = ids
                total, number = counts + 1, -(-(counts + 1) // capacity)
                doc = np.repeat(np.arange(len(total)), number)
                piece = segments(np.zeros(len(total), np.int64), number)
                start = piece * capacity
                length = np.minimum(total[doc] - start, capacity)
                begins = (ends - total)[doc] + start
                data = held.tobytes()
                order = np.argsort(length, kind="stable")
                same = length[order]
                first = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
                sizes = np.diff(np.r_[first, len(same)])
                nth = np.empty(len(same), np.int64)
                nth[order] = segments(seen[same[first]], sizes)
                seen[same[first]] += sizes
                out.append(
                    batch_of(
                        doc_id=batch.column(0).slice(b, e - b).take(pa.array(doc)),
                        piece=piece.astype(np.int32),
                        start=start,
                        length=length,
                        ids=pa.array([data[x:y] for x, y in zip((begins * 4).tolist(), ((begins + length) * 4).tolist(), strict=True)], pa.binary()),
                        task=np.full(len(doc), task, np.int64),
                        nth=nth,
                    )
                )
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return step

    return arrow_pass(columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), make, PIECES)


def reduce_by_dominance(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello and Toth's reduction on a histogram, which it changes: (lengths of a bin, number of such bins), each provably part of a best packing.

    For a longest item j, a set with j is fixed if it dominates all others with j:
    when nothing fits beside j; when only one item fits, with the longest that does;
    when the longest that fits fills the bin; and, when no more than two fit, with the
    best pair or the longest single, if no other pair can exceed it item by item.
    """
    fixed = []
    for j in sorted(left, reverse=True):
        while left.get(j, 0):
            room = capacity - j
            rest = lambda x, n=0: left.get(x, 0) - (x == j) - n  # noqa: E731  how many of x remain beside j and n more
            small = sorted(x for x in left if left[x] > 0 and x <= room)
            small = [x for x in small if rest(x) > 0]
            if not small:
                fixed.append(((j,), left[j] if room < j else 1))
                left[j] -= fixed[-1][1]
                continue
            longest = small[-1]
            three = [x for x in small[:3] for _ in range(min(rest(x), 3))][:3]
            fits = int(np.searchsorted(np.cumsum(three), room, "right"))
            chosen = None
            if longest == room or fits == 1:
                chosen = (j, longest)
            elif fits == 2:
                pairs = [(a, b) for i, b in enumerate(small) for a in small[i:] if a + b <= room and rest(a, a == b) > 0]
                if not pairs:
                    chosen = (j, longest)
                else:
                    second = max(b for _, b in pairs)
                    best = max(pairs, key=lambda p: (p[0] + p[1], p[0]))
                    if longest >= sum(best):
                        chosen = (j, longest)
                    elif best[0] == longest and best[1] == second:
                        chosen = (j, *best)
            if chosen is None:
                break
            need = Counter(chosen)
            many = min(left[x] // n for x, n in need.items())
            if len(chosen) == 3:
                many = 1
            for x, n in need.items():
                left[x] -= n * many
            fixed.append((chosen, many))
    return fixed


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: bins that look alike are filled together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted((x for x in left if left[x] > 0), reverse=True):
        count = left[length]
        while count:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                per, bins, held = capacity // length, None, ()
                room = capacity
            else:
                held, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                per = room // length
            full = count // per if bins is None else min(bins, count // per)
            if full:
                open_bins[room - per * length].append((held + (length,) * per, full))
                count -= full * per
            remain = None if bins is None else bins - full
            if remain == 0:
                continue
            if count and count < per:
                open_bins[room - count * length].append((held + (length,) * count, 1))
                count, remain = 0, None if remain is None else remain - 1
            if remain:
                open_bins[room].append((held, remain))
    return [x for r in sorted(open_bins) for x in open_bins[r]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in order, number of such bins); their number is bounded by the capacity, not by the corpus."""
    left = dict(histogram)
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def place_table(bins: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length and kind of bin: the first rank that goes there, places of that length in a bin, the first sequence and the first offset."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for lengths, many in bins:
        offset = 0
        for length, n in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, ranks[length], n, sequence, offset))
            ranks[length] += n * many
            offset += n * length
        sequence += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "first": table[:, 1], "per": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4]}


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (of tokenise_pieces, with any further columns, read more than once) with sequence_id and offset, without task and nth."""
    spark = pieces.sparkSession
    counts = written(pieces.groupBy("task", "length").count(), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(place_table(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(base.hint("shuffle_hash"), ["task", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("task", "before")
    kept = [c for c in ranked.columns if c != "nth"]
    ranked = ranked.select(*kept, "nth")

    def make():
        p = places.value
        key = (p["length"] << 44) + p["first"]

        def step(batch):
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            at = np.searchsorted(key, (length << 44) + nth, "right") - 1
            far = nth - p["first"][at]
            sequence = p["sequence"][at] + far // p["per"][at]
            offset = p["offset"][at] + far % p["per"][at] * length
            return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(kept).schema)
    return arrow_pass(ranked, make, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The packed corpus: doc_id, piece, start, length, ids, sequence_id, offset."""
    return assign_sequences(written(tokenise_pieces(docs, tokenizer, capacity, end_id), "pack"), capacity)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = written(tokenise_pieces(docs), "pack")
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "nth")
    return assign_sequences(digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
