import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from concord.llm import trie


def plain(conversations):
    """The nodes of {conv_id: [(role, text), ...]} by the definitions alone: (conv_id, depth) to the other columns."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[c] for c in children[p])
    return {
        (min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    }


def nodes(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def rows_of(conversations):
    return [(c, k, role, text) for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]


def rebuild(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = conversations.get(c - c % 100, [])[:h] + turns[h:]
    return out


def invented(rng, n, words, most):
    """Conversations of few different turns, so that many share a beginning and many are equal."""
    return {c: [(rng.choice("ua"), rng.choice(words)) for _ in range(rng.randrange(most))] for c in rng.sample(range(10 * n), n)}


@pytest.mark.parametrize("partitions,stitched", [(1, 100), (7, 100), (30, 12)])
@pytest.mark.parametrize("seed", [1])
def test_nodes_against_the_definitions(spark, monkeypatch, partitions, stitched, seed):
    monkeypatch.setattr(trie, "IDS", 3)
    rng = random.Random(seed)
    told = invented(rng, 300, ["x", "yy", "日本"], 5)
    told |= {c: [("u", "same"), ("a", "again")] for c in range(5000, 5120)}  # one group of copies over several partitions
    told |= {6000: [("u", str(k)) for k in range(200)], 6001: [("u", str(k)) for k in range(150)]}
    digest = lambda t: hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).digest()[:16]
    arrays = spark.createDataFrame([(c, [(digest(t), len(t[1])) for t in turns]) for c, turns in told.items()], f"conv_id long, turns {trie.TURNS.simpleString()}")
    assert nodes(trie.trie(arrays, partitions, stitched)) == plain(told)


def test_rebuilt_conversations(spark):
    rng = random.Random(3)
    told = {c: turns or [("u", "")] for c, turns in invented(rng, 60, ["x", "yy", "z"], 9).items()} | {100: [("u", "one"), ("a", "two")], 7_000_000_001: [("u", "far")]}
    df = spark.createDataFrame(rows_of(told), "conv_id long, turn long, role string, text string").repartition(3)
    rows, _ = trie.rebuilt(df)
    got = {r.conv_id: [t.chars for t in r.turns] for r in rows.collect()}
    assert got == {c: [len(t) for _, t in turns] for c, turns in rebuild(told).items()}
    assert nodes(trie.trie(rows)) == plain(rebuild(told))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, depth string, turns string, block long"
    rows = [(1, None, None, None), (1, 0, "u", "b"), (1, 0, "u", "b"), (2, 5, "", ""), (None, 0, "u", "lost"), (3, 0, "u", "x" * 100_000)]
    df = spark.createDataFrame([r + (None, None, None) for r in rows], schema)
    assert {r.conv_id: [t.chars for t in r.turns] for r in trie.turn_arrays(df).collect()} == {1: [0, 1, 1], 2: [0], 3: [100_000]}
    told = {1: [("", ""), ("u", "b"), ("u", "b")], 2: [("", "")], 3: [("u", "x" * 100_000)]}
    assert nodes(trie.trie(trie.turn_arrays(df))) == plain(told)
    assert trie.trie(trie.turn_arrays(df.limit(0))).count() == 0
    # a role's end is no part of its text
    two = spark.createDataFrame([(1, 0, "a", "bc"), (2, 0, "ab", "c")], "conv_id long, turn long, role string, text string")
    assert trie.trie(trie.turn_arrays(two)).count() == 3


def test_op11_against_the_definitions(spark):
    folder = "/root/testdata/sf0.001"
    told = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn is not None, r.turn or 0)):
        told[r.conv_id].append((r.role or "", r.text or ""))
    assert nodes(trie.op11_prefix_trie(spark, folder)) == plain(rebuild(told))
