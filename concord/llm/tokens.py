"""Token ids of whole texts by a public tokenizer, fast enough for a corpus.

The tokenizer's own splitting never reaches across ASCII white space, and
neither its normal form nor its lower-casing looks across it, so a text's ids
are the ids of its words in a row. Arrow finds the distinct words of a batch,
each is encoded once, and numpy puts the texts together from those.

Words of Latin letters with signs behind them are encoded many at a time, their
letters joined by spaces; a token that ends a word tells where each ends. Any
other word goes through the library alone. tests/llm/test_tokens_packing.py holds both
against plain encoding of whole texts.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters whose lower case and normal form are one code point each, then signs: no quote, which may begin a
#: contraction, and no < or >, which may be part of a special token.
PLAIN = r"^(?P<letters>[a-zA-Zß-öø-ÿÀ-ÖØ-Þ]*)(?P<signs>[!-&(-/:;=?@\[-`{-~]*)$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def segments(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the segments given, one segment after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class WordCodec:
    """ids of texts, with a bounded store of the letter runs seen.

    capacity bounds the runs kept between calls; it doesn't change any result.
    """

    def __init__(self, path: str, capacity: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.capacity = capacity
        self.runs: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _library(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_runs(self, runs: list[str], at_once: int = 1000) -> None:
        """Each run is one piece to the tokenizer, so its ids are those up to the next that ends a word."""
        for at in range(0, len(runs), at_once):
            part = runs[at : at + at_once]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                data, b = ids.tobytes(), 0
                for run, e in zip(part, (ends * 4).tolist(), strict=True):
                    self.runs[run] = data[b:e]
                    b = e
            else:  # a tokenizer without word ends
                self.runs.update(zip(part, self._library(part), strict=True))

    def _pool(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct runs in a row, and how many each has."""
        if len(self.runs) > self.capacity:
            self.runs.clear()
        self.runs[""] = b""
        listed = runs.to_pylist()
        got = list(map(self.runs.get, listed))
        new = [i for i, x in enumerate(got) if x is None]
        self._learn_runs([listed[i] for i in new])
        for i in new:
            got[i] = self.runs[listed[i]]
        return np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct words in a row, and how many each has."""
        split = pc.extract_regex(words, PLAIN)
        plain, parts = split.is_valid().to_numpy(zero_copy_only=False), []
        if len(at := np.flatnonzero(plain)):
            letters, signs = split.take(pa.array(at)).flatten()
            both = pa.concat_arrays([pc.utf8_lower(letters), signs]).dictionary_encode()
            pool, lengths = self._pool(both.dictionary)
            starts, index = np.cumsum(lengths) - lengths, both.indices.to_numpy().reshape(2, -1)
            pairs = index.T.ravel()
            parts.append((at, pool[segments(starts[pairs], lengths[pairs])], lengths[index].sum(axis=0)))
        other = np.flatnonzero(~plain)
        for b in range(0, len(other), 10_000):
            got = self._library(words.take(pa.array(other[b : b + 10_000])).to_pylist())
            parts.append((other[b : b + 10_000], np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4))
        if len(parts) == 1:
            return parts[0][1:]
        order = np.argsort(np.concatenate([x[0] for x in parts])) if parts else np.empty(0, int)
        pool = np.concatenate([x[1] for x in parts]) if parts else np.empty(0, "<u4")
        lengths = np.concatenate([x[2] for x in parts]) if parts else np.empty(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        return pool[segments(starts[order], lengths[order])], lengths[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and how many each text has; a null text has none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten().cast(pa.large_string()).dictionary_encode()
        pool, lengths = self._words(words.dictionary.cast(pa.string()))
        starts, index = np.cumsum(lengths) - lengths, words.indices.to_numpy()
        counts = lengths[index]
        bounds = np.concatenate([[0], np.cumsum(counts)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return pool[segments(starts[index], counts)], np.diff(bounds)

    def encode_list(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
        return [data[b:e] for b, e in zip([0, *ends], ends, strict=False)]
