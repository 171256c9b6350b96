"""Language identification by rank-order n-gram profiles.

A profile is the list of a text's or language's most frequent n-grams of one to
three characters, most frequent first; letters are lower-cased and every run of
other characters is one blank. A document goes to the language whose profile is
nearest by the out-of-place distance: how far each of its n-grams stands from its
place there, an n-gram that isn't there counting as the whole profile's length.

Counts of one and two characters follow from those of three, so a text is sorted
once. Profiles are counted over all training rows; only languages x profile length
n-grams reach the driver.

Defined results: null text or a text without a letter is `und` with score 0; a
null lang trains nothing; without any training row everything is `und`; equal
distances go to the language that sorts first; null doc_ids count as held in for
learning only if crc32 of them says so, which it doesn't; repeated rows count each;
whole texts are read; further columns are ignored.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from concord.llm._common import arrow_pass, batch_of, columns

LENGTH = 400
BITS = 21  # of a code point


@functools.cache
def letters() -> np.ndarray:
    """For each code point: itself if it is a letter or a mark on one, else a blank."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    kept = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in points), bool, len(points))
    return np.where(kept, points, np.uint32(32))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct packed trigrams of the text and their counts; None if it has no letter."""
    points = letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = points == 32
    points = points[~(blank & np.r_[False, blank[:-1]])].astype(np.uint64)
    if len(points) < 3:
        return None
    packed = np.sort(points[:-2] << np.uint64(2 * BITS) | points[1:-1] << np.uint64(BITS) | points[2:])
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    return packed[first], np.diff(np.r_[first, len(packed)])


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def grams(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of one to three characters from trigrams, none of blanks alone; shorter ones are packed with their first character above zero bits."""
    two, one = (keys >> np.uint64(BITS)) << np.uint64(BITS), (keys >> np.uint64(2 * BITS)) << np.uint64(2 * BITS)
    keys, counts = merged(np.concatenate([keys, two, one]), np.tile(counts, 3))
    kept = keys != np.uint64(32 << 2 * BITS)
    return keys[kept], counts[kept]


def ranked(keys: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, ties by the n-gram itself."""
    if len(keys) > 4 * length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:length]


def learn(docs: DataFrame, length: int = LENGTH, most_languages: int = 2000) -> dict[str, np.ndarray]:
    """Profiles by lang from all rows with a lang; a corpus of more languages than most_languages is refused."""

    def make():
        held: dict[str, list] = {}
        size = [0]

        def flush():
            rows = [(lang, *grams(*merged(*(np.concatenate(x) for x in zip(*parts, strict=True))))) for lang, parts in held.items()]
            held.clear()
            size[0] = 0
            if not rows:
                return None
            return batch_of(
                lang=pa.array([lang for lang, keys, _ in rows for _ in range(len(keys))], pa.string()),
                gram=np.concatenate([k for _, k, _ in rows]).astype(np.int64),
                n=np.concatenate([c for _, _, c in rows]).astype(np.int64),
            )

        def step(batch):
            if batch is None:
                return flush()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (got := trigrams(text)) is not None:
                    parts = held.setdefault(lang, [])
                    parts.append(got)
                    size[0] += len(got[0])
                    if len(parts) == 500:
                        parts[:] = [merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
            size[0] = sum(len(p[0]) for parts in held.values() for p in parts)
            return flush() if size[0] > 4_000_000 else None

        return step

    rows = columns(docs, "lang", "text").filter("lang is not null and text is not null")
    counted = arrow_pass(rows, make, "lang string, gram long, n long", finish=True).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = counted.withColumn("place", place).filter(F.col("place") <= length)
    if found.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    profiles: dict[str, list] = {}
    for lang, gram, _ in sorted(found.select("lang", "gram", "place").collect(), key=lambda r: (r.lang, r.place)):
        profiles.setdefault(lang, []).append(gram)
    return {lang: np.array(x, np.uint64) for lang, x in profiles.items()}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], length: int = LENGTH):
        self.names, self.length = sorted(profiles), length
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names])) if profiles else np.empty(0, np.uint64)
        self.places = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for k, n in enumerate(self.names):
            self.places[k, np.searchsorted(self.grams, profiles[n])] = np.arange(len(profiles[n]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how near: 1 less its distance as a share of the greatest possible."""
        got = trigrams(text) if text else None
        if got is None or not self.names:
            return "und", 0.0
        own = ranked(*grams(*got), self.length)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        there = self.places[:, at]
        away = np.where(there < 0, self.length, np.abs(there - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.length * len(own)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], length: int = LENGTH) -> DataFrame:
    """doc_id, lang_pred and score of each document."""

    def make():
        model = Profiles(profiles, length)

        def step(batch):
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            return batch_of(doc_id=batch.column(0), lang_pred=pa.array([x for x, _ in got], pa.string()), score=pa.array([s for _, s in got], pa.float64()))

        return step

    rows = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_pass(rows, make, "doc_id long, lang_pred string, score double")


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.filter(fold(4) != 2))
    return identify(docs, profiles).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
