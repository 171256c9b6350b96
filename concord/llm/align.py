"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

A text's bytes, behind one space, get a label each: nothing ends there, a token of
A ends there, one of B, or one of both. A scan with a regular expression takes the
spans up to each label of both, and the labels counted in a span say how many
tokens of A and B make a group. Every label but "nothing" also ends exactly one
pair of overlapping tokens (a link): cut at all ends, a text falls into intervals,
and two overlapping tokens have just one of them in common.

A is a byte-level tokenizer of the tokenizers library, B a SentencePiece model.
Neither reaches across a space that follows a character other than white space
(pieces.cuts), so labels, groups and links are worked out once for each distinct
segment in a bounded store, and a text has those of its segments in a row. Texts
go in blocks of bounded size. How often a pair of ids is linked in the corpus is a
sum over all blocks; each block then gets the sums of its own pairs back.

Defined results: texts that are null, empty, or whose tokens' bytes are not the
text behind a space have no tokens: zeros, and the empty string in place of groups
and digest; rows stay as many as they are, repeated ones and null doc_ids too; no
rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from concord.llm._common import arrow_pass, batch_of, columns, few, forget, slices, written
from concord.llm.pieces import PieceCodec, default_model, distinct_segments
from concord.llm.tokens import segments

#: A block has about so many characters, and one text at least.
BLOCK = 4_000_000
#: Segments that are encoded together.
JOINED = 100
#: Labels: nothing ends at a byte, a token of A, of B, of both.
LABELS = np.frombuffer(b".ABC", np.uint8)
GROUP = re.compile(rb"[^C]*C")


def default_bytes() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level tokenizer writes for each byte: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Alignment of distinct segments; capacity bounds those kept between calls and changes no result."""

    def __init__(self, a: str | None = None, b: str | None = None, capacity: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a or default_bytes())
        self.a.encode_special_tokens = True
        self.b = PieceCodec(b or default_model())
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in letters for c in token):
                self.bytes_a[k] = bytes(letters[c] for c in token)
        self.sizes_a = np.array([len(x) for x in self.bytes_a])
        #: Every id as text with the sign behind it.
        told = [f"{k}{sign}" for n, signs in ((len(self.bytes_a), ",|"), (len(self.b.surfaces), ",;")) for sign in signs for k in range(n)]
        self.shown, self.widths = np.array(told, object), np.array([len(x) for x in told])
        self.capacity, self.store = capacity, {}

    def tokens_a(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A of all segments in a row, and how many each has. Segments that don't end in white space are encoded together, behind one another."""
        joined = [p[0] == " " and not p[-1].isspace() and p[-1] != "▁" for p in parts]
        runs = [list(g) for _, g in groupby(range(len(parts)), lambda k: (joined[k], k // JOINED if joined[k] else -k))]
        found = [x.ids for x in self.a.encode_batch_fast(["".join(map(parts.__getitem__, r)) for r in runs], add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.int64)
        # the bytes up to each token's end say which segment it ends in
        bounds = np.cumsum([len(p.encode()) for p in parts])
        return ids, np.diff(np.searchsorted(np.cumsum(self.sizes_a[ids]), bounds, "right"), prepend=0)

    def labelled(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Labels (0 to 3) of all bytes of the segments given in a row, tokens of A and B in a row, and which segments are told alike by both."""
        raw, (a, n_a), of_b = "".join(parts).encode(), self.tokens_a(parts), self.b.merger.encode(parts, num_threads=1)
        b, good = np.fromiter(chain.from_iterable(of_b), np.int64), [True] * len(parts)
        told_a, told_b = self.bytes_a.__getitem__, self.b.surfaces.__getitem__
        bounds = np.cumsum([len(p.encode()) for p in parts])
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.b.sizes[b])
        n_b = np.cumsum(np.fromiter(map(len, of_b), np.int64, len(of_b)))
        if not (b"".join(map(told_a, a.tolist())) == raw == b"".join(map(told_b, b.tolist())) and np.isin(bounds, ends_a).all() and (ends_b[n_b - 1] == bounds).all()):
            of_a = [x.ids for x in self.a.encode_batch_fast(parts, add_special_tokens=False)]
            good = [b"".join(map(told_a, x)) == p.encode() == b"".join(map(told_b, y)) for p, x, y in zip(parts, of_a, of_b, strict=True)]
            a, b = (np.fromiter(chain.from_iterable(x for x, ok in zip(ids, good, strict=True) if ok), np.int64) for ids in (of_a, of_b))
            raw = "".join(p for p, ok in zip(parts, good, strict=True) if ok).encode()
            ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.b.sizes[b])
        labels = np.zeros(len(raw), np.uint8)
        labels[ends_a - 1] |= 1
        labels[ends_b - 1] |= 2
        return labels, a, b, good

    def aligned(self, parts: list[str]) -> list[tuple | None]:
        """Of each segment: groups as text, links as pairs of ids, and numbers of tokens of A, of B and of groups; None where the bytes differ."""
        labels, a, b, good = self.labelled(parts)
        ends_a, ends_b, text = np.cumsum(labels & 1, dtype=np.int64), np.cumsum(labels >> 1, dtype=np.int64), LABELS[labels].tobytes()
        spans = np.array([m.end() for m in GROUP.finditer(text)], np.int64)
        # a group's tokens of A, then those of B: its last of A is followed by a bar, its last of B by a semicolon, all others by commas
        last_a, last_b = ends_a[spans - 1], ends_b[spans - 1]
        n_a, n_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        code_a, code_b = a.copy(), b + 2 * len(self.bytes_a)
        code_a[last_a - 1] += len(self.bytes_a)
        code_b[last_b - 1] += len(self.b.surfaces)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(last_b - n_b, n_a)] = code_a
        order[np.arange(len(b)) + np.repeat(last_a, n_b)] = code_b
        shown, widths = "".join(self.shown[order].tolist()), np.cumsum(self.widths[order])
        at = np.flatnonzero(labels)
        links = (a[ends_a[at] - (labels[at] & 1)] << 32 | b[ends_b[at] - (labels[at] >> 1)]).astype("<u8").tobytes() if len(at) else b""
        ends = np.cumsum([len(p.encode()) for p, ok in zip(parts, good, strict=True) if ok]).astype(np.int64)
        if not len(ends):
            return [None] * len(parts)
        per = [np.diff(x, prepend=0).tolist() for x in (ends_a[ends - 1], ends_b[ends - 1], np.searchsorted(spans, ends, "right"))]
        text_ends, link_ends = widths[ends_a[ends - 1] + ends_b[ends - 1] - 1].tolist(), (np.searchsorted(at, ends) * 8).tolist()
        rows = zip([0, *text_ends], text_ends, [0, *link_ends], link_ends, *per, strict=False)
        told = ((shown[i : j - 1], links[k:m], n_a, n_b, n) for i, j, k, m, n_a, n_b, n in rows)
        return [next(told) if ok else None for ok in good]

    def known(self, parts: list[str]) -> list[tuple | None]:
        if len(self.store) > self.capacity:
            self.store.clear()
        new = [p for p in parts if p not in self.store]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.store.update(zip(some, self.aligned(some), strict=True))
        return list(map(self.store.__getitem__, parts))

    def texts(self, texts: list[str | None]) -> tuple[list[tuple | None], list[np.ndarray | None]]:
        """What known() tells of the distinct segments, and each text's segments by number; None for a text without tokens."""
        source = [(t or "").encode() for t in texts]
        plain = [bool(t) and (self.b.plain(t) or self.b.normal(t)[0] == b" " + t) for t in source]
        parts, index, counts = distinct_segments([b" " + t if ok else b"" for t, ok in zip(source, plain, strict=True)], self.b.cut)
        told = self.known(parts)
        bad = np.array([x is None for x in told], bool)
        bounds = np.cumsum([0, *counts]).tolist()
        rows = [index[b:e] for b, e in zip(bounds[:-1], bounds[1:], strict=True)]
        some = bad.any()
        return told, [None if not ok or some and bad[x].any() else x for x, ok in zip(rows, plain, strict=True)]


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, labels (a letter for each byte of the text behind a space: . A B C), groups (`a1,a2|b1;a3|b2`: ids of A and B)."""

    def make():
        aligner = Aligner(a, b)

        def step(batch):
            labels, groups = [], []
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts, BLOCK):
                told, rows = aligner.texts(texts[i:j])
                for t, row in zip(texts[i:j], rows, strict=True):
                    labels.append("" if row is None else LABELS[aligner.labelled([" " + t])[0]].tobytes().decode())
                    groups.append("" if row is None else ";".join(told[k][0] for k in row))
            return batch_of(doc_id=batch.column(0), labels=pa.array(labels, pa.string()), groups=pa.array(groups, pa.string()))

        return step

    return arrow_pass(columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), make, "doc_id long, labels string, groups string")


#: kind 1 is a block: its distinct pairs (first), how often each is linked there (second), each segment's links as places among them
#: (third) and how many it has (fourth); kind 2 is a document: its segments as places among those of the block (first).
BLOCKS = "block long, kind int, first binary, second binary, third binary, fourth binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def blocks(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    def make():
        aligner, n = Aligner(a, b), 0

        def block(ids, texts):
            nonlocal n
            told, rows = aligner.texts(texts)
            number, n = (TaskContext.get().partitionId() << 32) + n, n + 1
            told = [x or ("", b"", 0, 0, 0) for x in told]
            shown, sums = [x[0] for x in told], np.array([[x[2], x[3], x[4], len(x[1]) // 8] for x in told], np.int64).reshape(-1, 4)
            used = [x for x in rows if x is not None]
            held = np.bincount(np.concatenate(used), minlength=len(told)) if used else np.zeros(len(told), np.int64)
            pairs, places = np.unique(np.frombuffer(b"".join(x[1] for x in told), "<u8"), return_inverse=True)
            n_pairs = np.zeros(len(pairs), np.int64)
            np.add.at(n_pairs, places, np.repeat(held, sums[:, 3]))
            out = [(number, 1, pairs.tobytes(), n_pairs.astype("<i8").tobytes(), places.astype("<u4").tobytes(), sums[:, 3].astype("<u4").tobytes(), None, None, None, None, None, None)]
            for doc_id, row in zip(ids, rows, strict=True):
                if row is None:
                    out.append((number, 2, b"", None, None, None, doc_id, 0, 0, 0, 0, ""))
                else:
                    digest = hashlib.sha256(";".join([shown[k] for k in row.tolist()]).encode()).hexdigest()
                    out.append((number, 2, row.astype("<u4").tobytes(), None, None, None, doc_id, *sums[row].sum(axis=0).tolist(), digest))
            return out

        def step(batch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [r for b, e in slices(texts, BLOCK) for r in block(ids[b:e], texts[b:e])]
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 5, pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        return step

    return arrow_pass(columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), make, BLOCKS)


def pairs_of(told: DataFrame) -> DataFrame:
    """block, place, a, b, n: the distinct pairs of each block."""

    def make():
        def step(batch):
            parts = []
            for number, pairs, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.frombuffer(pairs, "<u8")
                parts.append((np.full(len(ids), number), np.arange(len(ids), dtype=np.int32), (ids >> 32).astype(np.int32), (ids & 0xFFFFFFFF).astype(np.int32), np.frombuffer(n, "<i8")))
            return batch_of(**dict(zip(("block", "place", "a", "b", "n"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

        return step

    return arrow_pass(told.filter("kind = 1").select("block", "first", "second"), make, "block long, place int, a int, b int, n long")


def link_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold each pair of ids."""
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0")


def scored(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text; what the corpus says of its links comes from all texts."""
    told = written(blocks(docs, a, b), "alignments")
    pairs = pairs_of(told)
    counts = written(link_counts(pairs), "links")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    judged = counts.join(few(best), "b").select("a", "b", F.col("n").alias("count"), (F.col("n") == F.col("most")).alias("best"))
    back = pairs.drop("n").join(judged, ["a", "b"]).select("block", F.lit(0).alias("kind"), "place", "count", "best")
    rows = back.unionByName(told.drop("second"), allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "place")

    def make():
        state = {"block": None}

        def step(batch):
            block, kind = (batch.column(k).to_numpy() for k in (0, 1))
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(block)]
            ids, out = [], []
            for i, j in zip(edges, edges[1:], strict=False):
                if block[i] != state["block"]:
                    state.update(block=block[i], count=[], best=[], place=[])
                part = batch.slice(i, j - i)
                if kind[i] == 0:
                    state["place"].append(part.column(2).to_numpy())
                    state["count"].append(part.column(3).to_numpy())
                    state["best"].append(part.column(4).to_numpy(zero_copy_only=False))
                elif kind[i] == 1:
                    places, sizes = (np.frombuffer(part.column(k)[0].as_py(), "<u4").astype(np.int64) for k in (6, 7))
                    n = len(part.column(5)[0].as_py()) // 8
                    values = np.zeros((2, n), np.int64)
                    if state["place"]:
                        at = np.concatenate(state["place"])
                        values[0, at], values[1, at] = np.concatenate(state["count"]), np.concatenate(state["best"])
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    state["sums"] = np.diff(np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(values[:, places], axis=1)], axis=1)[:, ends], axis=1)
                    state.update(count=[], best=[], place=[])
                else:
                    ids.append(part)
                    for row in part.column(5).to_pylist():
                        at = np.frombuffer(row, "<u4")
                        out.append((int(state["sums"][1][at].sum()), int(state["sums"][0][at].sum())))
            if not ids:
                return None
            docs = pa.Table.from_batches(ids).combine_chunks().to_batches()[0]
            named = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            return batch_of(**named, n_best=[x for x, _ in out], count_sum=[x for _, x in out], groups_sha256=docs.column("groups_sha256"))

        return step

    rows = rows.select("block", "kind", "place", "count", "best", "first", "third", "fourth", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    done = written(arrow_pass(rows, make, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), "aligned")
    forget(told, counts)
    return done


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
