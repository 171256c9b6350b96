import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from concord.llm import decontaminate, line_dedup, near_dup, packing, toxicity


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_groups(rows, percent=85):
    """Brute force over all pairs: doc_id -> component."""
    sets = [(d, plain_set(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d, _ in sets}


def copies(seed, n=12, groups=6):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 8, 40, 160, 700]))]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
            rows.append((len(rows) * 3 % 101 + 1000 * g, " ".join(words)))
    return rows


ODD = [(7000, None), (7001, ""), (7002, " \n"), (7003, "A b C"), (7004, "a B c"), (None, "a b c"), (7005, "É b c d e"), (7006, "é b c d e"), (7003, "A b C"), (7007, "long " * 30_000)]


@pytest.mark.parametrize("bounds", [(1500, 1_500_000), (5, 300)])
def test_groups_are_those_of_brute_force(spark, documents, bounds):
    rows = copies(1) + ODD
    want = plain_groups(rows)
    got = near_dup.group(documents(rows), most_classes=bounds[0], most_shingles=bounds[1]).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(plain_set(t))) for d, t in rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert near_dup.group(documents([])).count() == 0


def test_a_chain_of_links_is_one_component(spark, documents):
    words = [f"w{k}" for k in range(100)]
    rows = [(500 - k, " ".join([f"y{j}" for j in range(k)] + words[k:])) for k in range(0, 60, 2)]
    want = plain_groups(rows)
    assert len(set(want.values())) == 1
    assert {r.doc_id: r.component_id for r in near_dup.group(documents(rows)).collect()} == want


def plain_superminhash(items, m, seed=1):
    """A shingle at a time, with its own permutation, to the last round."""
    mask, out = (1 << 64) - 1, [None] * m
    mix = lambda x: int(near_dup.mix(np.array([x & mask], np.uint64))[0])
    golden = int(near_dup.GOLDEN)
    for item in items:
        state, places = mix(int(item) + seed * golden), list(range(m))
        for j in range(m):
            state = (state + golden) & mask
            drawn = mix(state)
            k = j + ((mix(drawn ^ golden) >> 32) * (m - j) >> 32)
            places[j], places[k] = places[k], places[j]
            value = j << 48 | drawn >> 16
            if out[places[j]] is None or value < out[places[j]]:
                out[places[j]] = value
    return out


def test_signatures_with_early_stop_are_those_without():
    rng = np.random.default_rng(9)
    sizes = np.array([1, 2, 7, 40, 300])
    items = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    got = near_dup.superminhash(items, sizes, 16)
    at = 0
    for row, n in zip(got, sizes):
        assert row.tolist() == plain_superminhash(items[at : at + n], 16)
        at += n


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(10)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 1 << 63, 40).astype(np.uint64)])
    s = near_dup.superminhash(np.concatenate([a, b]), np.array([400, 400]), 1600)
    assert abs((s[0] == s[1]).mean() - 360 / 440) < 0.04


def test_shingles():
    texts = [t for _, t in ODD + copies(2)]
    _, sizes = near_dup.shingle_sets(pa.array(texts, pa.string()))
    assert sizes.tolist() == [len(plain_set(t)) for t in texts]


def test_shingles_of_a_slice_are_those_of_its_texts(spark, documents):
    texts = ["E f", "Gg h i j", "K", None, "", *[t for _, t in ODD + copies(2)]]
    whole = pa.array(texts, pa.string())
    for b, n in ((0, 4), (1, 2), (2, 9), (5, len(texts) - 5)):
        got, want = near_dup.shingle_sets(whole.slice(b, n)), near_dup.shingle_sets(pa.array(texts[b : b + n], pa.string()))
        assert all(np.array_equal(x, y) for x, y in zip(got, want)) and want[1].tolist() == [len(plain_set(t)) for t in texts[b : b + n]]


def test_groups_of_many_slices_are_those_of_brute_force(spark, documents):
    rows = copies(3) + ODD
    want = plain_groups(rows)
    got = near_dup.group(documents(rows).coalesce(1), most_chars=500).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(plain_set(t))) for d, t in rows)
    assert all(r.component_id == want.get(r.doc_id) for r in got)


LICENSE = "All rights reserved by the owner of page {n}."


def line_rows():
    rng = random.Random(11)
    prose = lambda: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(6, 20)))
    rows = []
    for i in range(12):
        rows.append((i, "\n".join([prose(), LICENSE.format(n=i), "", prose(), "same old line here again"])))
    whole = "\n".join(prose() for _ in range(5))
    rows += [(100 + i, whole) for i in range(9)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, LICENSE.format(n=5)), (None, rows[0][1]), (0, rows[0][1]), (204, "x " * 50_000)]


def test_line_dedup(spark, documents):
    rows = line_rows()
    got = line_dedup.dedup_lines(documents(rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "text", "lang", "piece", "n_lines", "n_dropped"}
    for r in got:
        if r.doc_id is not None and r.doc_id < 100:
            assert r.n_dropped == 2 and r.n_lines == 4 and "reserved" not in r.text and "same old" not in r.text and r.text.count("\n") == 2
        elif r.doc_id is not None and 100 <= r.doc_id < 200:
            assert r.n_dropped == 0 and r.n_lines == 5
    odd = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got if r.doc_id and r.doc_id >= 200}
    assert odd[200] == (None, 0, 0) and odd[201] == ("", 0, 0) and odd[202] == ("\n\n", 0, 0) and odd[203] == ("", 1, 1) and odd[204][1:] == (1, 0)
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_line_dedup_is_its_sql(spark, documents):
    docs = documents([r for r in line_rows() if r[0] != 204])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(line_dedup.OP10_SQL).fetchall()
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_line_dedup_of_odd_rows_is_its_sql(spark, documents):
    rows = footer_rows()[0] + leaf_rows() + [(900, "  spaced\tline of five   tokens \r\n\n x"), (901, " spaced line of five tokens"), (902, "\x0bspaced line of five tokens "), (902, "\x0bspaced line of five tokens ")]
    docs = documents(rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(line_dedup.OP10_SQL).fetchall())


def leaf_rows():
    """Two kinds of messages of one leaf (as many tokens, the same first three), each with a field of letters, among other lines of that leaf."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for i in range(6):
        rows.append((300 + i, "\n".join([" ".join(word() for _ in range(9)), f"we send you a paper copy of {word()} by the post today", f"we send you news each week on {word()} from our own desk", "we send you " + " ".join(word() for _ in range(9))])))
    return rows


def test_two_templates_of_one_leaf_are_both_generalised(spark, documents):
    got = line_dedup.dedup_lines(documents(leaf_rows())).collect()
    assert {(r.n_lines, r.n_dropped) for r in got} == {(4, 2)} and not any("paper copy" in r.text or "news each" in r.text for r in got)


def test_stages_keep_columns_of_any_name(spark, documents, tmp_path):
    names = ["score", "n_lines", "n_dropped", "item_id", "coverage", "n_tiles", "contaminated", "__row", "__kept", "rest", "kept", "place"]
    rows = [(k, f"document {k} says " + " ".join(f"w{k}x{j}" for j in range(20)), *[f"{k} {c}" for c in names]) for k in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows


def test_line_dedup_has_no_python(spark, documents):
    plan = line_dedup.dedup_lines(documents(line_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_against_brute_force(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.learned(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    own = toxicity.Model(*model)
    clean = docs.toPandas()
    clean = clean[[own.score(t) < 0.5 for t in clean.text]]
    con = duckdb.connect()
    con.register("documents", clean)
    lined = con.execute(line_dedup.OP10_SQL).df()
    component = plain_groups(list(zip(lined.doc_id.tolist(), lined.text.tolist())), corpus_pipeline.NEAR_PERCENT)
    first = lined[[component[d] == d for d in lined.doc_id.tolist()]]
    items = [[w for w in decontaminate.words_of(t)] for t in pd.read_parquet(f"{source}/benchmark.parquet").text]

    def covered(text):
        words = decontaminate.words_of(text)
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        best = 0.0
        for item in items:
            if any(tuple(item[i : i + 5]) in runs for i in range(len(item) - 4)):
                ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
                tiles = decontaminate.tile(np.array([ids.get(w, -1) for w in words]), np.array([ids[w] for w in item]))
                best = max(best, sum(n for *_, n in tiles) / len(item))
        return best

    left = first[[covered(t) < decontaminate.COVERAGE for t in first.text]]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for doc_id, text in zip(left.doc_id.tolist(), left.text.tolist()):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        for k, b in enumerate(range(0, len(ids), 2048)):
            want[doc_id, k, np.array(ids[b : b + 2048], "<u4").tobytes()] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own_places in places.values():
        at = 0
        for offset, length in sorted(own_places):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_take_odd_rows(spark, documents, tmp_path):
    rows = [(1, "some words that stand here alone", "en"), (1, "some words that stand here alone", "en"), (2, None), (3, ""), (None, "some words that stand here alone"), (4, "x y " * 20_000)]
    docs = documents(rows)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table, n in ((docs, 5), (docs.limit(0), 0)):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            if k < 4:
                assert now.columns == docs.columns
            if k == 3:
                assert now.count() == n
        assert {r.doc_id for r in now.collect()} == ({1, 2, 3, 4, None} if n else set())


def footer_rows():
    """Two- and three-line footers at the end of short and long texts, and a group of near copies that hold the first."""
    rng = random.Random(21)
    prose = lambda n=1: [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12)) for _ in range(n)]
    two, three = ["this page is given to you as it stands today", "write to the keeper of the archive"], ["first of the three lines of terms", "the middle one has always the same lines around", "and here the terms have their end"]
    rows = [(i, "\n".join(prose(3) + two)) for i in range(8)] + [(20 + i, "\n".join(prose(4) + three)) for i in range(4)] + [(40 + i, "\n".join(prose(5) + three + prose(2))) for i in range(4)]
    base = prose(10)
    for i in range(40):
        own = list(base)
        own[i % 10] = prose()[0]
        rows.append((100 + i, "\n".join(own + two)))
    return rows, two + three, base


def test_line_dedup_drops_whole_footers_and_keeps_near_copies(spark, documents):
    rows, gone, base = footer_rows()
    want = {d: "\n".join(x for x in t.split("\n") if x not in gone) for d, t in rows}
    got = line_dedup.dedup_lines(documents(rows)).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert {r.n_dropped for r in got if r.doc_id < 8} == {2} and {r.n_dropped for r in got if 20 <= r.doc_id < 100} == {3}


def test_pipeline_groups_copies_from_80_percent_on(spark, documents):
    rng = random.Random(31)
    rows = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(60)]
        other = list(words)
        other[20 + g] = "changed"
        other[59] = "end"
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(other))]
    rng.shuffle(rows)
    a, b = (plain_set(dict(rows)[d]) for d in (0, 1))
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    kept = corpus_pipeline.one_of_each_group(spark, documents(rows), "").collect()
    want = plain_groups(rows, 80)
    assert {r.doc_id for r in kept} == {d for d in want if want[d] == d} == {10 * g for g in range(6)}
    assert sum(r.kept for r in near_dup.group(documents(rows)).collect()) == 12


def test_rows_of_a_large_bucket_grow_with_its_members(spark):
    for n in (400, 1600):
        members = spark.range(n).selectExpr("7L AS key", "id AS rep", "id * 31 AS set_a", "10L AS n", "id AS component")
        heads = near_dup.head_blocks(members, 20, 10_000).collect()
        assert n < len(heads) <= n + near_dup.PIVOTS * n // 20 and {r.rep for r in heads} == set(range(n))
        # one component but for three members: a row each, and those three against all parts
        joined = members.selectExpr("key", "rep", "set_a", "n", "if(rep < 3, rep, 3L) AS component")
        rest = near_dup.rest_blocks(joined, 20, 10_000).collect()
        assert len(rest) <= n + 4 * (n // 20 + 1)
        met = {}
        for r in rest:
            met.setdefault(r.block, {0: set(), 1: set()})[r.side].add(r.rep)
        pairs = {(a, b) for m in met.values() for a in m[0] | m[1] for b in m[0] | m[1] if (a in m[0]) != (b in m[0]) or not m[1] or not m[0]}
        assert all((a, b) in pairs or (b, a) in pairs for a in range(3) for b in range(3, n))


@pytest.mark.parametrize("few", [8, 1])
def test_no_link_of_a_leaf_with_many_families_is_lost(spark, documents, monkeypatch, few):
    """Forty families of twelve lines that all share the leaf and the last three words; any two lines of a family agree in exactly 0.8."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    free = lambda f, k: [f"w{chr(97 + f % 26)}{chr(97 + f // 26)}{chr(97 + k)}{c}" for c in "xyz"]
    lines = [(f, " ".join(["all", "begin", "alike", *[f"f{chr(97 + f % 26)}{chr(97 + f // 26)}{chr(97 + j)}" for j in range(6)], *free(f, k), "and", "end", "so"])) for f in range(40) for k in range(12)]
    word = lambda n, j: "q" + "".join(chr(97 + x) for x in (n % 26, n // 26, j % 26, j // 26))
    rows = [(n, " ".join(word(n, j) for j in range(40)) + "\n" + line) for n, (_, line) in enumerate(lines)]
    got = line_dedup.dedup_lines(documents(rows)).collect()
    assert sum(r.n_dropped for r in got) == 480 and all("begin" not in r.text for r in got)


def test_no_link_of_lines_that_share_two_segments_with_many_is_lost(spark, documents, monkeypatch):
    """Sixty families of three lines that share with each other only segments that all lines share."""
    monkeypatch.setattr(line_dedup, "FEW", 1)
    monkeypatch.setattr(line_dedup, "SIDE", 50, raising=False)
    name = lambda *n: "".join(chr(97 + x % 26) + chr(97 + x // 26) for x in n)
    free = lambda f, k: [f"l{name(f, k, i)}" if i in (1, 4, 8, 12, 17) else f"f{name(f, i)}" if i in (0, 2, 5, 9, 10, 18) else f"c{name(i)}" for i in range(24)]
    lines = [" ".join(["all", "begin", "alike", *free(f, k)]) for f in range(60) for k in range(3)]
    rows = [(n, " ".join(f"q{name(n, j)}" for j in range(60)) + "\n" + line) for n, line in enumerate(lines)]
    got = line_dedup.dedup_lines(documents(rows)).collect()
    assert [r.n_dropped for r in got] == [1] * 180 and not any("begin" in r.text for r in got)


def test_no_link_of_texts_that_share_a_heavy_line_with_many_is_lost(spark, documents):
    """Sixty pairs of texts of one kind by a short line; all of them share a long one, which alone makes no two of one kind."""
    name = lambda *n: "".join(chr(97 + x % 26) + chr(97 + x // 26) for x in n)
    line = lambda kind, n, size: " ".join(f"{kind}{name(n, j)}" for j in range(size))
    rows = [(2 * p + k, "\n".join([line("a", 0, 60), line("b", p, 10), line("u", 2 * p + k, 30)])) for p in range(60) for k in range(2)]
    rows += [(1000 + p, line("b", p, 10) + "\n" + line("z", p, 200)) for p in range(60)]
    got = line_dedup.dedup_lines(documents(rows)).collect()
    assert {(r.doc_id < 1000, r.n_dropped) for r in got} == {(True, 1), (False, 0)}
