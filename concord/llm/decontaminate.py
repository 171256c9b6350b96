"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. A document and a benchmark item
that share a seed, a run of MIN_MATCH words, are tiled: again and again the longest
run of words that both have and that no tile covers yet becomes a tile, found by
Running Karp-Rabin (hashes of all runs of a length, the greatest common length by
halving, until none of MIN_MATCH words is left), so passages are caught in any order. The share of the
item's words under tiles is its coverage; a document that covers COVERAGE of any
item is contaminated.

Seeds of a block of items (at most BLOCK words) go to every task; a larger
benchmark is searched block by block, each block in a pass of its own over the
documents, so what is sent never grows and no pair of documents is ever made.

Defined results: null and empty texts share nothing; items of fewer than MIN_MATCH
words share no seed and are never found; of equal runs the first in the document,
then in the item, is marked; items repeated under one item_id count each; a null
doc_id or item_id stays null; repeated rows are searched each; whole texts are
read; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concord.llm._common import arrow_pass, columns

MIN_MATCH, COVERAGE, BLOCK = 5, 0.6, 1_000_000
WORD = re.compile(r"[^\W_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Runs:
    """Karp-Rabin hashes modulo 2**64 of all runs of any length, each length in one sweep."""

    def __init__(self, ids: np.ndarray):
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
            powers = np.cumprod(np.full(len(ids), MULTIPLIER, np.uint64))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers)])
            self.back = np.cumprod(np.full(len(ids), np.uint64(pow(int(MULTIPLIER), -1, 1 << 64)), np.uint64))

    def hashes(self, length: int) -> np.ndarray:
        if len(self.sums) <= length:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length]


def free_runs(marked: np.ndarray, length: int) -> np.ndarray:
    """Where a run of that length begins in which nothing is marked."""
    if len(marked) < length:
        return np.empty(0, np.int64)
    before = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(before[length:] == before[:-length])


def tile(text: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, words) by greedy string tiling.

    -1 in text is a word that no item has.
    """
    tiles: list[tuple[int, int, int]] = []
    in_text, in_item = text < 0, np.zeros(len(item), bool)
    of_text, of_item = Runs(text), Runs(item)

    def shared(length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of unmarked runs of that length that the other may have too."""
        t, i = free_runs(in_text, length), free_runs(in_item, length)
        at_t, at_i = of_text.hashes(length)[t], of_item.hashes(length)[i]
        return t[np.isin(at_t, at_i)], i[np.isin(at_i, at_t)]

    most = min(len(text), len(item))
    while True:
        low, high = least - 1, most  # a common run of some length holds common ones of every lesser length
        while low < high:
            length = (low + high + 1) // 2
            low, high = (length, high) if len(shared(length)[0]) else (low, length - 1)
        if low < least:
            return tiles
        places = defaultdict(list)
        starts, ends = shared(low)
        hashes_t, hashes_i = of_text.hashes(low), of_item.hashes(low)
        for i in ends.tolist():
            places[int(hashes_i[i])].append(i)
        for t in starts.tolist():
            for i in places[int(hashes_t[t])]:
                if in_text[t : t + low].any():
                    break
                if not in_item[i : i + low].any() and np.array_equal(text[t : t + low], item[i : i + low]):
                    tiles.append((t, i, low))
                    in_text[t : t + low] = True
                    in_item[i : i + low] = True
        most = low - 1


class Block:
    """Some benchmark items with the numbers of their words and their seeds."""

    def __init__(self, items: list[tuple[object, str]], least: int):
        self.least, self.names = least, []
        self.vocabulary: dict[str, int] = {}
        self.items: list[np.ndarray] = []
        seeds: list[np.ndarray] = []
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int64)
            if len(ids) >= least:
                self.names.append(name)
                self.items.append(ids)
                seeds.append(Runs(ids).hashes(least))
        flat = np.concatenate([*seeds, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owners = flat[order], owner[order]

    def find(self, text: str | None):
        """(item, coverage, tiles) for each item that shares a seed with the text."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
        if not len(self.seeds) or len(ids) < self.least:
            return
        known = free_runs(ids < 0, self.least)
        if not len(known):
            return
        hashes = np.unique(Runs(ids).hashes(self.least)[known])
        first, last = np.searchsorted(self.seeds, hashes), np.searchsorted(self.seeds, hashes, "right")
        for k in sorted({int(o) for a, b in zip(first, last, strict=True) for o in self.owners[a:b]}):
            tiles = tile(ids, self.items[k], self.least)
            if tiles:
                yield self.names[k], sum(n for _, _, n in tiles) / len(self.items[k]), tiles


def blocks_of(benchmark: DataFrame, most: int = BLOCK):
    """The items in runs of at most `most` words (or one longer item), read a block at a time."""
    held, size = [], 0
    for name, text in columns(benchmark, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long")).orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(text))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((name, text))
        size += n
    if held:
        yield held


MATCHES = "doc_id long, item_id long, coverage double, tiles array<struct<place:int,item_place:int,words:int>>"


def matches(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, block: int = BLOCK) -> DataFrame:
    """A row for each document and item that share a tile: coverage and the tiles, counted in words."""
    rows = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = None
    for items in blocks_of(benchmark, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def make(sent=sent):
            own = Block(sent.value, least)

            def step(batch):
                got = [(d, name, c, [dict(zip(("place", "item_place", "words"), t, strict=True)) for t in tiles]) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for name, c, tiles in own.find(text)]
                if not got:
                    return None
                spans = pa.list_(pa.struct([("place", pa.int32()), ("item_place", pa.int32()), ("words", pa.int32())]))
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.float64(), spans), strict=True)], names=["doc_id", "item_id", "coverage", "tiles"])

            return step

        found = arrow_pass(rows, make, MATCHES)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], MATCHES) if out is None else out


def worst(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """docs's columns, with item_id, coverage and n_tiles of the item that the document covers most (null and 0 without one) and contaminated; the blocks follow one another in narrow passes."""
    drop = [c for c in docs.columns if c.lower() in ("item_id", "coverage", "n_tiles", "contaminated")]
    out = docs.drop(*drop).withColumns({"item_id": F.lit(None).cast("long"), "coverage": F.lit(0.0), "n_tiles": F.lit(0).cast("long")})
    names = out.columns
    text = [c.lower() for c in names].index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for items in blocks_of(benchmark, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def make(sent=sent):
            own = Block(sent.value, least)

            def step(batch):
                item, share, number = (batch.column(len(names) - k).to_pylist() for k in (3, 2, 1))
                for r, t in enumerate(batch.column(text).to_pylist()):
                    for name, c, tiles in own.find(t):
                        if c > share[r]:
                            item[r], share[r], number[r] = name, c, len(tiles)
                return pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(number, pa.int64())], names=names)

            return step

        out = arrow_pass(out, make, fields)
    return out.withColumn("contaminated", F.col("coverage") >= coverage)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return worst(columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), benchmark).drop("text")
