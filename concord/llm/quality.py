"""Quality rules: base counts of words, signs and repetition, then distribution divergence.

A language's reference is how its documents' characters fall into CLASSES and its
words into its COMMON most frequent words and all others, counted over all rows of
that lang that are plain prose: at least MIN_N_WORDS words, at most PLAIN_SYMBOLS of
the characters signs and at most PLAIN_UPPER of them capitals. A document is compared
with every reference by Jensen-Shannon distance (base 2, so from 0 to 1) and passes
if one language is within both limits. Short texts differ by chance: the characters
are only compared from MIN_CHARS on, the words from MIN_WORDS on, and the words'
limit depends on their number and on the reference (see word_limits). The document's own
lang isn't used for that.

References are exact counts: a word of a share of at least COMMON_SHARE among a
language's words has that share in one hand-over of counts at least, so the words
frequent in one are all the candidates there are; a second pass counts just those.

Defined results: null and empty texts have no words and fail the base rules;
without any reference the base rules decide alone; a null doc_id stays null;
repeated rows are judged each; whole texts are read; further columns are ignored.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from concord.llm._common import WORD_SEPARATORS, arrow_pass, batch_of, columns, slices

SYMBOLS = "#*$%&|<>"
MIN_N_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
COMMON, COMMON_SHARE = 40, 0.002
PLAIN_SYMBOLS, PLAIN_UPPER = 0.01, 0.15
MIN_CHARS, MIN_WORDS = 120, 40
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.165, 0.5
#: The words' limit is at least this share of the distance of a text without common words; chance allows SPREAD deviations.
UNCOMMON_SHARE, SPREAD = 0.8, 4
#: Numbers of words for which chance is drawn, and draws of each.
LENGTHS, DRAWS = (40, 55, 75, 100, 140, 200, 400, 1000, 4000), 400
CLASSES = ("lower", "upper", "digit", "space", "stop", "quote", "bracket", "sign", "other")
#: Beyond CLASSES: signs of SYMBOLS, and white space that doesn't part words.
SYMBOL, WIDE_SPACE = len(CLASSES), len(CLASSES) + 1


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point."""

    def kind(c: str) -> int:
        if c in SYMBOLS:
            return SYMBOL
        if c in WORD_SEPARATORS:
            return CLASSES.index("space")
        if c.isspace():
            return WIDE_SPACE
        if c.isupper():
            return CLASSES.index("upper")
        if c.isalpha():
            return CLASSES.index("lower")
        if c.isdigit():
            return CLASSES.index("digit")
        for name, members in (("stop", ".,;:!?"), ("quote", "\"'’‘“”«»-–"), ("bracket", "()[]{}")):
            if c in members:
                return CLASSES.index(name)
        return CLASSES.index("sign" if c.isascii() else "other")

    return np.fromiter((kind(chr(i)) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


class Counted:
    """Words and characters of a run of texts, all at once."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        n = len(self.texts)
        points = class_table()[np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        self.lengths = np.fromiter(map(len, self.texts), np.int64, n)
        fine = np.bincount(np.repeat(np.arange(n), self.lengths) * (WIDE_SPACE + 1) + points, minlength=n * (WIDE_SPACE + 1)).reshape(n, -1)
        self.n_symbols = fine[:, SYMBOL]
        self.word_chars = self.lengths - fine[:, CLASSES.index("space")]
        self.classes = fine[:, : len(CLASSES)].copy()
        self.classes[:, CLASSES.index("sign")] += fine[:, SYMBOL]
        self.classes[:, CLASSES.index("space")] += fine[:, WIDE_SPACE]
        split = pc.ascii_split_whitespace(pa.array(self.texts, pa.large_string()))
        flat = split.flatten().cast(pa.large_string())
        doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
        kept = np.flatnonzero(pc.binary_length(flat).to_numpy())
        words = flat.take(pa.array(kept)).dictionary_encode()
        self.doc, self.word, self.dictionary = doc[kept], words.indices.to_numpy().astype(np.int64), words.dictionary
        self.n_words = np.bincount(self.doc, minlength=n)

    def folded(self) -> tuple[np.ndarray, list[str]]:
        """The words lower-cased and without signs around them, as numbers and by number."""
        plain = pc.utf8_trim(pc.utf8_lower(self.dictionary), characters='!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’–…¡¿').dictionary_encode()
        return plain.indices.to_numpy()[self.word].astype(np.int64), plain.dictionary.to_pylist()

    def n_repeat_words(self, window: int = WINDOW) -> np.ndarray:
        """Words in runs of `window` words found twice or more in their text; runs are told apart by 64-bit hashes."""
        n, size = len(self.texts), len(self.word)
        if size < window:
            return np.zeros(n, np.int64)
        with np.errstate(over="ignore"):
            z = (self.word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            last = size - window + 1
            key = (self.doc[:last].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            for k in range(window):
                key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + z[k : last + k]
        at = np.flatnonzero(self.doc[:last] == self.doc[window - 1 :])
        order = at[np.argsort(key[at], kind="stable")]
        same = (key[order[1:]] == key[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])
        hit = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
        edge = np.zeros(size + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        return np.bincount(self.doc[np.cumsum(edge[:size]) > 0], minlength=n)

    def n_dup_lines(self) -> list[int]:
        out = []
        for text in self.texts:
            lines = [x for x in text.split("\n") if x.strip(WORD_SEPARATORS)]
            out.append(len(lines) - len(set(lines)))
        return out

    def plain(self) -> np.ndarray:
        """Which texts are plain prose."""
        return (self.n_words >= MIN_N_WORDS) & (self.n_symbols <= PLAIN_SYMBOLS * self.lengths) & (self.classes[:, CLASSES.index("upper")] <= PLAIN_UPPER * self.lengths)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q, base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = np.where(p > 0, p * np.log2(p / m), 0), np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(0, (left.sum(axis=-1) + right.sum(axis=-1)) / 2))


def word_limits(share: np.ndarray) -> np.ndarray:
    """The greatest word distance to a reference for each of LENGTHS: what chance explains, or a share of the distance of a text without common words where that is more."""
    draw = np.random.default_rng(1)
    none = distance(np.r_[np.zeros(len(share) - 1), 1.0], share)
    chance = [distance(draw.multinomial(n, share, DRAWS) / n, share) for n in LENGTHS]
    return np.minimum(MAX_WORD_DISTANCE, np.maximum(UNCOMMON_SHARE * none, [d.mean() + SPREAD * d.std() for d in chance]))


def by_lang(batch: pa.RecordBatch):
    """For each run of texts: what is counted of it, each text's language as a number, and the languages."""
    langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for b, e in slices(texts):
        names = sorted(set(langs[b:e]))
        number = {x: k for k, x in enumerate(names)}
        counted = Counted(texts[b:e])
        yield counted, np.array([number[x] for x in langs[b:e]]), names


def candidates():
    held: dict[str, Counter] = {}

    def flush():
        out = [(lang, w) for lang, c in held.items() for total in [sum(c.values())] for w, n in c.items() if w and n >= COMMON_SHARE * total]
        held.clear()
        return batch_of(lang=pa.array([x for x, _ in out], pa.string()), word=pa.array([x for _, x in out], pa.string())) if out else None

    def step(batch):
        if batch is None:
            return flush()
        for counted, lang, names in by_lang(batch):
            word, listed = counted.folded()
            use = counted.plain()[counted.doc]
            pairs = np.bincount(lang[counted.doc[use]] * len(listed) + word[use], minlength=len(names) * len(listed)).reshape(len(names), -1)
            for k, name in enumerate(names):
                some = np.flatnonzero(pairs[k])
                # a word too rare in all of these texts to be frequent is one that the next hand-over can still name
                held.setdefault(name, Counter()).update(dict(zip([listed[i] for i in some], pairs[k][some].tolist(), strict=True)))
        return flush() if sum(map(len, held.values())) > 300_000 else None

    return step


def references(docs: DataFrame, most_languages: int = 2000) -> dict[str, tuple[np.ndarray, dict[str, int]]]:
    """lang: characters by class, and counts of the common words and (as "") of all others."""
    rows = columns(docs, "lang", "text").filter("lang is not null and text is not null")
    found = arrow_pass(rows, candidates, "lang string, word string", finish=True).distinct()
    wanted: dict[str, list] = {}
    if rows.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    for lang, word in found.collect():  # at most 1 / COMMON_SHARE words of a language and hand-over
        wanted.setdefault(lang, []).append(word)

    def exact():
        words: dict[str, Counter] = {}
        kinds: dict[str, np.ndarray] = {}

        def step(batch):
            if batch is None:
                out = [(lang, "w", w, n) for lang, c in words.items() for w, n in c.items()] + [(lang, "c", str(k), int(n)) for lang, x in kinds.items() for k, n in enumerate(x)]
                if not out:
                    return None
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "word", "n"])
            for counted, lang, names in by_lang(batch):
                word, listed = counted.folded()
                number, plain = {w: i for i, w in enumerate(listed)}, counted.plain()
                for k, name in enumerate(names):
                    mine = plain & (lang == k)
                    n = np.bincount(word[mine[counted.doc]], minlength=len(listed))
                    own = words.setdefault(name, Counter())
                    for w in wanted.get(name, ()):
                        if w in number:
                            own[w] += int(n[number[w]])
                    own[""] += int(n.sum())
                    kinds[name] = kinds.get(name, 0) + counted.classes[mine].sum(axis=0)
            return None

        return step

    counts = arrow_pass(rows, exact, "lang string, kind string, word string, n long", finish=True).groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    out: dict[str, tuple[np.ndarray, dict[str, int]]] = {}
    sums: dict[str, tuple[np.ndarray, Counter]] = {}
    for lang, kind, word, n in counts.collect():  # classes and candidates of each language
        chars, words = sums.setdefault(lang, (np.zeros(len(CLASSES)), Counter()))
        if kind == "c":
            chars[int(word)] += n
        else:
            words[word] += n
    for lang, (chars, words) in sums.items():
        total = words[""]
        common = sorted((w for w in words if w and words[w] >= COMMON_SHARE * total), key=lambda w: (-words[w], w))[:COMMON]
        if total and chars.sum():
            out[lang] = chars, {**{w: words[w] for w in common}, "": total - sum(words[w] for w in common)}
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double, nearest string"


def judge(docs: DataFrame, refs: dict[str, tuple[np.ndarray, dict[str, int]]]) -> DataFrame:
    """The counts, base_failed, kept, the two distances to the nearest reference (0 where the text is too short to tell) and its language."""
    shares = [(lang, chars / chars.sum(), [w for w in words if w], np.array([words[w] for w in words]) / sum(words.values())) for lang, (chars, words) in sorted(refs.items())]
    limits = [word_limits(share) for *_, share in shares]

    def make():
        def step(batch):
            out = []
            texts = batch.column(1).to_pylist()
            for b, e in slices(texts):
                c = Counted(texts[b:e])
                n = e - b
                word, listed = c.folded()
                number = {w: i for i, w in enumerate(listed)}
                far = np.full(n, np.inf)
                kind, words, nearest = np.zeros(n), np.zeros(n), np.full(n, -1)
                own = c.classes / np.maximum(1, c.classes.sum(axis=1, keepdims=True))
                for k, (_, chars, common, share) in enumerate(shares):
                    place = np.full(len(listed) + 1, len(common))
                    for i, w in enumerate(common):
                        if w in number:
                            place[number[w]] = i
                    there = np.bincount(c.doc * (len(common) + 1) + place[word], minlength=n * (len(common) + 1)).reshape(n, -1)
                    d_kind = np.where(c.lengths >= MIN_CHARS, distance(own, chars), 0)
                    d_word = np.where(c.n_words >= MIN_WORDS, distance(there / np.maximum(1, c.n_words)[:, None], share), 0)
                    d = np.maximum(d_kind / MAX_CLASS_DISTANCE, d_word / np.interp(c.n_words, LENGTHS, limits[k]))
                    better = d < far
                    far[better], kind[better], words[better], nearest[better] = d[better], d_kind[better], d_word[better], k
                repeated = c.n_repeat_words()
                failed = (c.n_words < MIN_N_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * c.n_words)
                kept = ~failed & ((far <= 1) | (nearest < 0))
                names = np.array([*(x[0] for x in shares), None], object)
                out.append(
                    batch_of(
                        doc_id=batch.column(0).slice(b, n), n_words=c.n_words, word_chars=c.word_chars, n_symbols=c.n_symbols, n_dup_lines=pa.array(c.n_dup_lines(), pa.int64()), n_repeat_words=repeated,
                        base_failed=failed, kept=kept, class_distance=kind, word_distance=words, nearest=pa.array(names[nearest], pa.string()),
                    )
                )
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return step

    rows = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_pass(rows, make, SCHEMA)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, references(docs))
