import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from concord.llm import packing, tokenfile  # noqa: E402
from concord.llm._common import new_path  # noqa: E402
from concord.llm.tokens import WordCodec, default_tokenizer  # noqa: E402

ODD = ["", None, "<|endoftext|> a<|endoftext|>b", "don't x'S <b>Été,É", "日本語 ẞ İstanbul Å é a b c ª1²½ ǅ", " \n", "x" * 5000, "The cat. the CAT! " * 900, "ça\x0bva\x85bien oui"]
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(1, "twice"), (1, "twice"), (None, "no id"), (1, None)]


def plain_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_codec_is_the_tokenizer():
    rng = random.Random(1)
    letters = "abcdeéüßÀZQ \n\t.,'’-<>|#0129ıſKΣσ日本🙂́ "
    texts = ODD + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)]
    codec = WordCodec(default_tokenizer(), capacity=50)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_list(texts)] == plain_ids(texts)


def test_token_file_round_trip(spark, documents):
    folder = new_path(spark, "test")
    shards = tokenfile.write_shards(documents(ROWS), folder, shards=3)
    got = [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfile.read_shards(shards).collect()]
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (doc_id, _), ids in zip(rows, plain_ids([t for _, t in rows])):
        want.append((doc_id, start, len(ids) + 1, ids + [1]))
        start += len(ids) + 1
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_file_reads_only_what_is_asked_for_and_sees_damage(tmp_path):
    import zstandard

    uri = f"file://{tmp_path}/a.zst"
    writer = tokenfile.ShardWriter(uri)
    docs = {None: [1], 3: [5, 6, 70000], 9: list(range(1000))}
    for k, v in docs.items():
        writer.add(k, np.array(v, "<u4"))
    writer.close()
    data = (tmp_path / "a.zst").read_bytes()
    reader = tokenfile.ShardReader(uri)
    assert [x.tolist() for x in reader.find(3)] == [docs[3]] and reader.find(4) == [] and [x.tolist() for x in reader.find(None)] == [[1]]
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == np.concatenate([np.array(v, "<u4") for v in docs.values()]).tobytes()
    bad = bytearray(data)
    bad[reader.begins[1] + reader.entries["packed"][1] - 1] ^= 255
    (tmp_path / "b.zst").write_bytes(bad)
    damaged = tokenfile.ShardReader(f"file://{tmp_path}/b.zst")
    assert damaged.ids(0).tolist() == [1] and len(damaged.ids(2)) == 1000
    with pytest.raises(Exception):
        damaged.ids(1)


def test_token_file_of_nothing(spark, documents):
    assert tokenfile.read_shards(tokenfile.write_shards(documents([]), new_path(spark, "test"))).count() == 0


def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack(spark, documents, capacity):
    rows = packing.pack(documents(ROWS), capacity=capacity).collect()
    want = Counter()
    for (doc_id, _), ids in zip(ROWS, plain_ids([t for _, t in ROWS])):
        ids = ids + [0]
        for k, b in enumerate(range(0, len(ids), capacity)):
            part = ids[b : b + capacity]
            want[doc_id, k, b, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == want
    check_packing(rows, capacity)


def test_pack_nothing(spark, documents):
    assert packing.pack(documents([])).count() == 0


def fewest(items, capacity):
    """Brute force: the fewest bins, by trying every set with the longest item."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for n in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in chosen) <= capacity:
                best = min(best, 1 + fewest([x for i, x in enumerate(rest) if i not in chosen], capacity))
    return best


def test_dominance_keeps_a_best_packing():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([10, 13, 20])
        items = sorted((rng.randint(max(1, capacity // rng.choice([3, 4, 9])), capacity) for _ in range(rng.randint(1, 7))), reverse=True)
        left = Counter(items)
        fixed = packing.reduce_by_dominance(left, capacity)
        used = Counter(x for lengths, n in fixed for x in lengths for _ in range(n))
        assert used + Counter({k: v for k, v in left.items() if v}) == Counter(items)
        assert all(sum(lengths) <= capacity for lengths, _ in fixed)
        rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(items, capacity), (items, capacity, fixed)


def test_plan_is_best_fit_decreasing_and_near_the_bound():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 50, 2048])
        items = [min(capacity, max(1, int(rng.lognormvariate(0, 1) * capacity / rng.choice([3, 8, 30])))) for _ in range(rng.randint(1, 400))]
        bins = packing.plan(Counter(items), capacity)
        assert Counter(x for lengths, n in bins for x in lengths for _ in range(n)) == Counter(items)
        assert all(sum(lengths) <= capacity and n > 0 for lengths, n in bins)
        one_by_one = []
        for x in sorted(items, reverse=True):
            at = min((b for b in one_by_one if b + x <= capacity), key=lambda b: capacity - b, default=None)
            if at is not None:
                one_by_one.remove(at)
            one_by_one.append((at or 0) + x)
        alone = packing.best_fit(Counter(items), capacity)
        assert sorted(sum(lengths) for lengths, n in alone for _ in range(n)) == sorted(one_by_one)
        assert sum(n for _, n in bins) <= len(one_by_one) + 1
