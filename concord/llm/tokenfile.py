"""Token ids in files of independent zstandard frames with a seek table.

A shard is a file in the public seekable zstandard format, so any zstandard tool
can decompress it: one frame for each document, in ascending doc_id order, then a
skippable frame with the doc_ids, then a skippable frame that is the seek table
(compressed size, decompressed size and checksum of each frame, its number of
frames and a magic number at the very end). A reader takes the end of the file,
then only the frames of the documents that it wants, and checks each against the
low 32 bits of its XXH64.

Defined results: a null text counts as empty, so it is the end id alone; null
doc_ids come first; rows of equal doc_id go by text; no rows give no shards;
further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from concord.llm._common import arrow_pass, batch_of, columns, new_path, slices, written
from concord.llm.tokens import WordCodec, default_tokenizer

#: Fixed values of the seekable zstandard format.
SKIPPABLE_IDS, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
NO_ID = -(1 << 63)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes a shard beside its name and moves it there at the end, so that a repeated task replaces it whole."""

    def __init__(self, uri: str, width: int = 4, level: int = 1):
        import zstandard

        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False).compress
        self.kind = {2: "<u2", 4: "<u4"}[width]
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_all([doc_id], ids, np.array([len(ids)]))

    def add_all(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """A frame for each document; ids holds those of all of them in a row."""
        import xxhash

        data = memoryview(ids.astype(self.kind).tobytes())
        ends = (np.cumsum(counts) * int(self.kind[-1])).tolist()
        frames, digest, pack, b = [], xxhash.xxh64_intdigest, self.pack, 0
        for e in ends:
            own = data[b:e]
            frame = pack(own)
            frames.append(frame)
            self.entries.append((len(frame), e - b, digest(own) & 0xFFFFFFFF))
            b = e
        self.out.write(b"".join(frames))
        self.docs.extend(NO_ID if d is None else d for d in doc_ids)

    def close(self) -> None:
        import xxhash

        own = struct.pack("<B", int(self.kind[-1])) + np.array(self.docs, "<i8").tobytes()
        own += struct.pack("<I", xxhash.xxh64_intdigest(own) & 0xFFFFFFFF)
        table = np.array(self.entries, ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_MAGIC)
        for magic, body in ((SKIPPABLE_IDS, own), (SKIPPABLE_SEEK, table)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)
        self.out.close()
        self.fs.move(self.part, self.path)


class ShardReader:
    """Random access by position or doc_id; frames that nobody asks for are never read."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{uri}: no seek table")
        at = size - 9 - frames * ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(frames * ENTRY.itemsize, at), ENTRY)
        self.begins = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        own = self.file.read_at(at - 8 - int(self.begins[-1]), int(self.begins[-1]))
        import xxhash
        import zstandard

        self.unpack = zstandard.ZstdDecompressor().decompress
        if struct.unpack("<II", own[:8]) != (SKIPPABLE_IDS, len(own) - 8) or struct.unpack("<I", own[-4:])[0] != xxhash.xxh64_intdigest(own[8:-4]) & 0xFFFFFFFF:
            raise ValueError(f"{uri}: its list of documents is damaged")
        self.kind = f"<u{own[8]}"
        self.docs = np.frombuffer(own[9:-4], "<i8")

    def __len__(self) -> int:
        return len(self.entries)

    def doc_id(self, i: int) -> int | None:
        return None if self.docs[i] == NO_ID else int(self.docs[i])

    def _data(self, i: int, frame) -> bytes:
        """A frame's bytes, held against its checksum."""
        import xxhash

        data = self.unpack(frame, max_output_size=int(self.entries["size"][i]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.entries["check"][i]:
            raise ValueError(f"{self.path}: frame {i} is damaged")
        return data

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self._data(i, self.file.read_at(int(self.entries["packed"][i]), int(self.begins[i]))), self.kind).astype("<u4")

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """ids of each document of that doc_id; the doc_ids ascend, so two searches find them."""
        wanted = NO_ID if doc_id is None else doc_id
        return [self.ids(i) for i in range(*np.searchsorted(self.docs, [wanted, wanted + 1]))]

    def runs(self, block: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """All frames in order, by reads of about `block` bytes: first and last frame of a run, all their ids in a row and how many each has."""
        i = 0
        while i < len(self):
            e = max(i + 1, int(np.searchsorted(self.begins, self.begins[i] + block, "right")) - 1)
            data = memoryview(self.file.read_at(int(self.begins[e] - self.begins[i]), int(self.begins[i])))
            at = (self.begins[i : e + 1] - self.begins[i]).tolist()
            held = b"".join([self._data(k, data[at[k - i] : at[k - i + 1]]) for k in range(i, e)])
            yield i, e, np.frombuffer(held, self.kind).astype("<u4"), self.entries["size"][i:e].astype(np.int64) // int(self.kind[-1])
            i = e

    def scan(self, block: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """All frames in order, one at a time."""
        for i, e, ids, counts in self.runs(block):
            ends = np.cumsum(counts)
            for k in range(i, e):
                yield k, ids[int(ends[k - i] - counts[k - i]) : int(ends[k - i])]


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Encodes docs into shards below folder, in ascending doc_id order over all shards; a row for each shard: shard, uri, n_docs, n_ids."""
    path, spark = tokenizer or default_tokenizer(), docs.sparkSession
    rows = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def make():
        codec = WordCodec(path)
        shard = TaskContext.get().partitionId()
        uri, state = f"{folder}/shard-{shard:06d}.zst", {"ids": 0}

        def step(batch):
            if batch is None:
                if "writer" not in state:
                    return None
                state["writer"].close()
                return batch_of(shard=[shard], uri=[uri], n_docs=[len(state["writer"].entries)], n_ids=[state["ids"]])
            writer = state.setdefault("writer", None) or ShardWriter(uri, 2 if len(codec.ends) <= 1 << 16 and end_id < 1 << 16 else 4)
            state["writer"] = writer
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for b, e in slices(texts.to_pylist()):
                ids, counts = codec.encode(texts.slice(b, e - b))
                writer.add_all(doc_ids[b:e], np.insert(ids, np.cumsum(counts), end_id), counts + 1)
                state["ids"] += len(ids) + e - b
            return None

        return step

    return written(arrow_pass(ordered, make, "shard long, uri string, n_docs long, n_ids long", finish=True), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document of the shards from their files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    spark = shards.sparkSession
    listed = sorted(shards.select("shard", "uri", "n_ids").collect())  # a row for each file
    begins, n = [], 0
    for shard, uri, ids in listed:
        begins.append((uri, n))
        n += ids
    todo = spark.createDataFrame(begins or [("", 0)], "uri string, start long").filter("uri <> ''").repartition(max(1, len(begins)), "uri")

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(uri)
                for i, e, ids, counts in reader.runs():
                    ends = np.cumsum(counts)
                    offsets = np.r_[0, ends * 4].astype(np.int32)
                    own = pa.Array.from_buffers(pa.binary(), e - i, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                    docs = pa.array(reader.docs[i:e], pa.int64(), mask=reader.docs[i:e] == NO_ID)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(start + ends - counts), pa.array(counts), own], names=["doc_id", "start", "n_tokens", "ids"])
                    start += int(ends[-1])

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_file(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = read_shards(write_shards(docs, new_path(spark, "token-files")))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
