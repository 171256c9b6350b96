import random

import numpy as np
import pytest

from concord.llm import decontaminate as d


def plain_tiles(text, item, least):
    """Brute force: the longest match of unmarked words, first in text and then item, again and again."""
    in_text, in_item, out = [w < 0 for w in text], [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while t + n < len(text) and i + n < len(item) and text[t + n] == item[i + n] and not in_text[t + n] and not in_item[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, t, i)
        n, t, i = best
        if n < least:
            return out
        out.append((t, i, n))
        for k in range(n):
            in_text[t + k] = in_item[i + k] = True


def test_tiles_are_those_of_brute_force():
    rng = random.Random(4)
    for _ in range(600):
        least, words = rng.choice([2, 3, 5]), rng.choice([2, 4, 12])
        item = [rng.randrange(words) for _ in range(rng.randrange(1, 30))]
        text = [rng.randrange(-1, words) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            b = rng.randrange(len(item))
            at = rng.randrange(len(text) + 1)
            text[at:at] = item[b : b + rng.randrange(1, 20)]
        want = plain_tiles(text, item, least)
        got = d.tile(np.array(text, np.int64), np.array(item, np.int64), least)
        assert got == want, (text, item, least)


ITEM = "The quick brown fox jumps over the lazy dog while seven grey geese fly south for the long cold winter"
OTHER = "completely different words about rivers and mountains in the far north of an unknown land"


@pytest.fixture()
def tables(spark, documents):
    words = ITEM.split()
    reordered = " ".join(words[10:] + ["and", "so"] + words[:10])
    rows = [(1, f"{OTHER} {ITEM.upper()}! {OTHER}"), (2, OTHER), (3, reordered), (4, None), (5, ""), (6, f"{OTHER} {' '.join(words[:7])}"), (7, f"{OTHER} " * 3000 + ITEM), (1, ITEM), (None, ITEM)]
    bench = spark.createDataFrame([(10, ITEM, "x"), (11, None, "x"), (12, "", "x"), (13, "too short", "x"), (10, OTHER + " entirely", "x"), (None, "nothing of this is anywhere else at all", "x")], "item_id long, text string, doc_id string")
    return documents(rows), bench


@pytest.mark.parametrize("block", [1_000_000, 1])
def test_worst(tables, block):
    got = sorted(((r.doc_id, r.contaminated, r.item_id, round(r.coverage, 2)) for r in d.worst(*tables, block=block).collect()), key=str)
    whole = round(14 / 15, 2)
    want = [(1, True, 10, 1.0), (1, True, 10, 1.0), (2, True, 10, round(15 / 16, 2)), (3, True, 10, 1.0), (4, False, None, 0.0), (5, False, None, 0.0), (6, True, 10, round(15 / 16, 2)), (7, True, 10, 1.0), (None, True, 10, 1.0)]
    assert got == sorted(want, key=str), whole


def test_matches(tables, spark):
    docs, bench = tables
    rows = d.matches(docs, bench).filter("doc_id = 3").collect()
    assert [(r.item_id, [t.words for t in r.tiles]) for r in rows] == [(10, [10, 10])]
    assert d.matches(docs, bench.limit(0)).count() == 0 and d.worst(docs.limit(0), bench).count() == 0
    assert d.worst(docs, bench.limit(0)).filter("contaminated").count() == 0
