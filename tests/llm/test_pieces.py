import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from concord.llm import pieces  # noqa: E402
from concord.llm.pieces import PieceCodec, default_model, field, fields  # noqa: E402

ODD = ["", None, " ", "   ", "a", " a  b ", "▁", "x▁ y▁▁ z ▁", "a\x00b", "é　 ß\U0001f600𝕏 ́", "<s> <0x41></s>", "\n \n  x\t y", "x" * 5000, "日本語 テキスト  a  b  c", "the cat. " * 500, "​ ﻿ ±½ ﬁ Ａ"]
LETTERS = "abcdetho é𝕏ß ▁\n\t 　  .,'<>0日😀́ﬁＡ½"


def texts(n, seed=1):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choices(LETTERS, k=rng.randrange(50))) for _ in range(n)]


def of_library(library, text):
    """Pieces and spans in bytes, from the library's own whole-text encoding."""
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def of_codec(codec, many):
    ids, starts, ends, counts = codec.encode(many)
    rows = list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True))
    bounds = np.cumsum([0, *counts]).tolist()
    return [rows[b:e] for b, e in zip(bounds, bounds[1:])]


def test_pieces_and_spans_are_the_library_s():
    from sentencepiece import SentencePieceProcessor

    library, many = SentencePieceProcessor(model_file=default_model()), texts(3000)
    want = [of_library(library, t or "") for t in many]
    codec = PieceCodec(default_model(), capacity=100)
    for _ in range(2):
        assert of_codec(codec, many) == want


def double_array(rules):
    """A double array of the keys of rules (bytes to bytes), placed by trying, and the replacements."""
    texts, begins = b"", {}
    for key, to in rules.items():
        begins[key] = len(texts)
        texts += to + b"\0"
    units, taken = [0] * 4096, {0}

    def place(prefix, node):
        below = sorted({k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in rules else []) + below
        base = next(b for b in range(1, 4096) if all((node ^ b ^ c) not in taken for c in labels))
        taken.update(node ^ base ^ c for c in labels)
        units[node] |= base << 10 | (256 if prefix in rules else 0)
        if prefix in rules:
            units[node ^ base] = begins[prefix] | 1 << 31
        for c in below:
            units[node ^ base ^ c] = c
            place(prefix + bytes([c]), node ^ base ^ c)

    place(b"", 0)
    blob = np.array(units, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + texts


@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("symbol", [None, "ab▁c"])
def test_longest_prefix_of_a_compiled_map(tmp_path, squeeze, prefix, symbol):
    rules = {"ﬁ": "fi", "Ａ": "A", "½": "1/2", "a": "e", "ab": "xyz ", "abc": " ", "　": " ", " ": "", "é": "é", "é": "é", "\t": " ", "\n": " ", "日": "日本", "d": "▁"}
    blob = double_array({k.encode(): v.encode() for k, v in rules.items()})
    model = open(default_model(), "rb").read()
    spec = field(1, b"own") + field(2, blob) + field(3, prefix) + field(4, squeeze) + field(5, 1)
    parts = [(k, v) for k, v in fields(model) if k in (1, 2)]
    if symbol:
        parts.insert(0, (1, field(1, symbol.encode()) + field(3, 4)))
        first = next(k for k, (n, v) in enumerate(parts) if n == 1 and dict(fields(v)).get(3) == 2)
        parts.insert(0, parts.pop(first))
    path = tmp_path / "own.model"
    path.write_bytes(b"".join(field(k, v) for k, v in parts) + field(3, spec))
    from sentencepiece import SentencePieceProcessor

    library, codec, many = SentencePieceProcessor(model_file=str(path)), PieceCodec(str(path)), texts(800, 3)
    assert codec.cut == (symbol is None)
    for text, got in zip(many, of_codec(codec, many), strict=True):
        assert got == of_library(library, text or ""), repr(text)


def test_spans_are_the_pieces_bytes_and_decode_goes_back(spark, documents):
    rows = [(k, t) for k, t in enumerate(texts(200))] + [(None, "no id"), (3, "twice"), (3, "twice")]
    encoded = pieces.encode(documents(rows))
    codec = PieceCodec(default_model())
    got = sorted((r.doc_id, list(r.ids), list(r.starts), list(r.ends)) for r in encoded.collect() if r.doc_id is not None and r.doc_id != 3)
    by_id = dict(rows)
    for doc_id, ids, starts, ends in got:
        text = (by_id[doc_id] or "").encode()
        if "▁".encode() not in text:
            for i, b, e in zip(ids, starts, ends, strict=True):
                if codec.byte[i] < 0:
                    assert codec.surfaces[i] == (b" " if b == 0 else b"") + text[b:e] or codec.surfaces[i] == text[b:e]
        assert not ids or (starts[0] == 0 and ends[-1] == len(text) and all(x <= y for x, y in zip(ends, ends[1:])))
    back = sorted((r.doc_id, r.text) for r in pieces.decode(encoded).collect() if r.doc_id is not None and r.doc_id != 3)
    assert back == sorted((k, (t or "").replace("▁", " ")) for k, t in by_id.items() if k is not None and k != 3)
    assert encoded.count() == len(rows) and pieces.encode(documents([])).count() == 0


def test_op13_digests_against_the_library(spark):
    import hashlib

    from sentencepiece import SentencePieceProcessor

    folder = "/root/testdata/sf0.001"
    library = SentencePieceProcessor(model_file=default_model())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)), len((r.text or "").encode()) if ids else 0)
    assert {r.doc_id: tuple(r)[1:] for r in pieces.op13_pieces(spark, folder).collect()} == want
