r"""SentencePiece encoding that keeps source positions, and decoding.

A text is normalised by the longest prefix that the model's compiled character map
knows at each place (a double-array trie of byte strings; one character goes
through as it is where none fits), and every normalised byte remembers the source
byte that its rule began at. Pieces tile the normalised text, so their lengths and
that alignment give each piece's span of source bytes, as the library has it: of a
character that falls back to bytes the last byte's piece has the whole span.

Normalised texts are cut where a space follows anything else, since no piece of
the model reaches across such a place (the vocabulary is checked for that); each
distinct segment is merged once by the library, with its own normaliser taken out,
while it stays in a bounded store.

Defined results: a null text counts as empty and has no pieces; rows stay as many
as they are, repeated ones and null doc_ids too; no rows give no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concord.llm._common import arrow_pass, batch_of, columns, slices
from concord.llm.tokens import segments

MARK = "▁".encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer's message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, message[at : at + size]
        at += size


def field(number: int, value: int | bytes) -> bytes:
    """A field of a message; whole numbers are small here."""

    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


class CharacterMap:
    """A compiled character map: a 4-byte size, that many bytes of double-array units, then the replacements, each closed by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """What replaces the longest known string that begins at `at`, and that string's length."""
        units, found = self.units, None
        # a unit holds its label in 8 bits, a leaf flag, and the distance to its children
        node = units[0] >> 10 << ((units[0] >> 9 & 1) << 3)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != data[k]:
                break
            node ^= unit >> 10 << ((unit >> 9 & 1) << 3)
            if unit >> 8 & 1:
                begin = units[node] & 0x7FFFFFFF
                found = self.replacements[begin : self.replacements.index(b"\0", begin)], k + 1 - at
        return found


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a space follows a character that is neither white space nor U+2581."""
    at = np.flatnonzero((data[1:] == 32) & (data[:-1] > 32)) + 1
    last, second, third = data[at - 1], data[at - 2], data[at - 3]  # a place before the beginning only matters if it is part of a character
    blank = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    blank |= (third == 0xE1) & (second == 0x9A) & (last == 0x80)
    blank |= (third == 0xE2) & (second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    blank |= (third == 0xE2) & ((second == 0x81) & (last == 0x9F) | (second == 0x96) & (last == 0x81))
    blank |= (third == 0xE3) & (second == 0x80) & (last == 0x80)
    return at[~(blank & (last >= 0x80))]


def distinct_segments(parts: list[bytes], cut: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Segments of texts: the distinct ones, the number of each in a row over all texts, and how many each text has; with cut, texts are parted at cuts()."""
    data, offsets = b"".join(parts), np.cumsum([0, *map(len, parts)])
    bounds = np.union1d(offsets, cuts(np.frombuffer(data, np.uint8))) if cut and len(data) > 3 else np.unique(offsets)
    whole = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype("<i8").tobytes()), pa.py_buffer(data)).dictionary_encode()
    places = np.searchsorted(bounds, offsets)
    return whole.dictionary.to_pylist(), whole.indices.to_numpy(), np.diff(places)


class PieceCodec:
    """Pieces of texts with their source spans; capacity bounds the segments kept between calls and changes no result."""

    def __init__(self, path: str, capacity: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = f.read()
        self.library = SentencePieceProcessor(model_proto=model)
        parts = list(fields(model))
        spec = dict(fields(next((v for k, v in parts if k == 3), b"")))
        trainer = dict(fields(next((v for k, v in parts if k == 2), b"")))
        if trainer.get(24) or not spec.get(5, 1):
            raise ValueError("models that mark spaces behind words or not at all are not supported")
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        own = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 1)
        self.merger = SentencePieceProcessor(model_proto=b"".join(field(k, v) for k, v in parts if k == 1 or k == 2) + field(3, own))
        listed = [dict(fields(v)) for k, v in parts if k == 1]
        names, kinds = [p.get(1, b"") for p in listed], np.array([p.get(3, 1) for p in listed])
        self.cut = not any(MARK in n.removeprefix(MARK).lstrip(MARK) for n in names)
        own_symbols = sorted((n.replace(MARK, b" ") for n, k in zip(names, kinds, strict=True) if k == 4), key=len, reverse=True)
        self.symbols = re.compile(b"|".join(map(re.escape, own_symbols))) if own_symbols else None
        self.surfaces = [bytes([int(n[3:5], 16)]) if k == 6 else n.replace(MARK, b" ") for n, k in zip(names, kinds, strict=True)]
        self.sizes = np.array([len(s) for s in self.surfaces])
        #: The byte that a piece stands for, or -1.
        self.byte = np.array([s[0] if k == 6 else -1 for s, k in zip(self.surfaces, kinds, strict=True)])
        self.unknown = self.library.unk_id()
        self.capacity, self.store = capacity, {}

    def normal(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, with spaces for marks, and for each place in it (its end too) the source byte that its rule began at."""
        out, source, at, squeezed = bytearray(), [], 0, self.squeeze

        def rule(at: int) -> tuple[bytes, int]:
            if self.symbols and (m := self.symbols.match(text, at)):
                return m.group(), len(m.group())
            if self.map and (found := self.map.longest(text, at)):
                return found
            size = 1 if text[at] < 0xC0 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
            return text[at : at + size], size

        while self.squeeze and at < len(text):
            shown, size = rule(at)
            if shown != b" ":
                break
            at += size
        if at == len(text):
            return b"", np.zeros(1, np.int64)
        if self.prefix:
            out += b" "
            source.append(at)
        while at < len(text):
            shown, size = rule(at)
            if squeezed:
                shown = shown.lstrip(b" ")
            if shown:
                squeezed = self.squeeze and shown.endswith(b" ")
                shown = shown.replace(MARK, b" ")
                out += shown
                source += [at] * len(shown)
            elif not self.squeeze:
                squeezed = False
            at += size
        while self.squeeze and out.endswith(b" "):
            out.pop()
            at = source.pop()
        return bytes(out), np.array([*source, at], np.int64)

    def plain(self, text: bytes) -> bool:
        """Whether the normalised text is the text itself behind a space."""
        return self.map is None and self.symbols is None and self.prefix and not self.squeeze and MARK not in text

    def merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of normalised segments in a row, the bytes that each covers, and how many each segment has."""
        found = self.merger.encode(parts, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        sizes, byte = self.sizes[ids], self.byte[ids]
        if (byte >= 0).any():
            inner = (byte >= 0x80) & (byte < 0xC0)
            ends = (byte >= 0) & ~np.append(inner[1:], False)
            heads = np.maximum.accumulate(np.where((byte >= 0) & ~inner, np.arange(len(ids)), 0))
            sizes = np.where(byte < 0, sizes, np.where(ends, np.arange(len(ids)) - heads + 1, 0))
        if (ids == self.unknown).any():  # a model without bytes: the piece is the text that it stands for
            starts = np.cumsum(counts) - counts
            for k in np.unique(np.searchsorted(np.cumsum(counts), np.flatnonzero(ids == self.unknown), "right")):
                sizes[starts[k] : starts[k] + counts[k]] = [len(p.replace("▁", " ").encode()) for p in self.merger.encode(parts[k], out_type=str)]
        return ids, sizes, counts

    def stored(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """merged(), each segment from the store if it has it."""
        if len(self.store) > self.capacity:
            self.store.clear()
        store = self.store
        got = list(map(store.get, parts))
        if new := [k for k, x in enumerate(got) if x is None]:
            ids, sizes, counts = self.merged([parts[k] for k in new])
            ids, sizes, ends = ids.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            for k, b, e in zip(new, [0, *ends], ends, strict=False):
                got[k] = store[parts[k]] = (ids[b:e], sizes[b:e])
        ids, sizes = (b"".join(x[k] for x in got) for k in (0, 1))
        return np.frombuffer(ids, "<u4"), np.frombuffer(sizes, "<u4"), np.fromiter((len(x[0]) for x in got), np.int64, len(got)) // 4

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts in a row: pieces, where each begins and ends in its text's bytes, and how many each text has."""
        source = [(t or "").encode() for t in texts]
        odd = {k: self.normal(t) for k, t in enumerate(source) if t and not self.plain(t)}
        parts = [odd[k][0] if k in odd else b" " + t if t else t for k, t in enumerate(source)]
        known, index, per_text = distinct_segments(parts, self.cut)
        pool, sizes, counts = self.stored(known)
        places = segments((np.cumsum(counts) - counts)[index], counts[index])
        ids, sizes = pool[places], sizes[places].astype(np.int64)
        tokens = np.diff(np.concatenate([[0], np.cumsum(counts[index])])[np.concatenate([[0], np.cumsum(per_text)])])
        ends = np.cumsum(sizes)
        offsets = np.cumsum([0, *map(len, parts)])
        if len(ends) and ends[-1] != offsets[-1]:
            raise AssertionError("pieces don't tile the text")
        ends = ends - np.repeat(offsets[:-1], tokens)
        starts, firsts = ends - sizes, np.cumsum(tokens) - tokens
        shown = [np.maximum(x - 1, 0) for x in (starts, ends)]
        for k, (_, origin) in odd.items():
            here = slice(firsts[k], firsts[k] + tokens[k])
            for a, x in zip(shown, (starts, ends), strict=True):
                a[here] = origin[x[here]]
        return ids, shown[0], shown[1], tokens


def each_text(docs: DataFrame, model: str | None, schema: str, shown) -> DataFrame:
    """doc_id and what shown(codec, ids, starts, ends) gives for each text."""
    path = model or default_model()

    def make():
        codec = PieceCodec(path)

        def step(batch):
            texts, out = batch.column(1).to_pylist(), []
            for b, e in slices(texts):
                ids, starts, ends, counts = codec.encode(texts[b:e])
                bounds = np.cumsum([0, *counts])
                out += [shown(codec, ids[i:j], starts[i:j], ends[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            return batch_of(doc_id=batch.column(0), **dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

        return step

    names = [c.split()[0] for c in schema.split(", ")]
    return arrow_pass(columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), make, f"doc_id long, {schema}")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, starts and ends: the pieces of each whole text and the source bytes (from, up to) that each stands for."""
    return each_text(docs, model, "ids array<int>, starts array<int>, ends array<int>", lambda codec, ids, starts, ends: (ids.tolist(), starts.tolist(), ends.tolist()))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are no pieces."""
    path = model or default_model()

    def make():
        library = PieceCodec(path).library
        return lambda batch: batch_of(doc_id=batch.column(0), text=pa.array([library.decode(x or []) for x in batch.column(1).to_pylist()], pa.string()))

    return arrow_pass(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def op13_pieces(spark, sf_dir: str) -> DataFrame:
    """Digests of each text's pieces and of what they decode to; n_bytes is where the last piece's source span ends."""

    def shown(codec, ids, starts, ends):
        listed = ids.tolist()
        told, decoded = ",".join(map(str, listed)), codec.library.decode(listed)
        return len(listed), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int(ends[-1]) if len(listed) else 0

    return each_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), None, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long", shown)
