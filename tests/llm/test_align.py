import hashlib
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

from concord.llm import align  # noqa: E402
from concord.llm.pieces import default_model  # noqa: E402

ODD = ["", None, " ", "a", " a  b ", "▁", "x▁ y", "a\n  b \n c", "a\x00b", "é　 ß\U0001f600𝕏 ́ b", "<|endoftext|> a<|endoftext|>b <s>", "don't 's we'LL", "x" * 3000, "日本語 テキスト", "the cat. " * 300, "a  b\x85 c\xa0 d\x1c e", "tab\t tab"]
LETTERS = "abcdetho' é𝕏ß \n\t 　  .,'<>0123日😀́\xa0 \x85"


def texts(n, seed=1):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choices(LETTERS, k=rng.randrange(50))) for _ in range(n)]


def plain(many):
    """Tokens of whole texts as (id, from, up to), groups and links, by the libraries and the definitions alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(align.default_bytes()), sentencepiece.SentencePieceProcessor(model_file=default_model())
    a.encode_special_tokens = True
    letters, out = align.byte_letters(), []
    for t in many:
        whole = b" " + (t or "").encode()
        told = [[(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids], [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(t))]] if t else [[], []]
        if not t or any(b"".join(x for _, x in y) != whole for y in told):
            out.append(None)
            continue
        spans = []
        for y in told:
            at, found = 0, []
            for i, x in y:
                found.append((i, at, at + len(x)))
                at += len(x)
            spans.append(found)
        both, at = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}), [0, 0]
        groups, links, first = [], [], 0
        for end in both:
            members = []
            for k, y in enumerate(spans):
                begin = at[k]
                while at[k] < len(y) and y[at[k]][2] <= end:
                    at[k] += 1
                members.append(",".join(str(i) for i, _, _ in y[begin : at[k]]))
            groups.append("|".join(members))
        for i, s, e in spans[0]:
            while spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        out.append((len(spans[0]), len(spans[1]), groups, links))
    return out


def expected(many):
    told = plain(many)
    counts = Counter(x for y in told if y for x in y[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for y in told:
        if y is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            yield y[0], y[1], len(y[2]), len(y[3]), sum(counts[x] == best[x[1]] for x in y[3]), sum(counts[x] for x in y[3]), hashlib.sha256(";".join(y[2]).encode()).hexdigest()


def test_groups_and_corpus_counts_against_the_definitions(spark, documents, monkeypatch):
    many = texts(600)
    monkeypatch.setattr(align, "BLOCK", 900)  # several blocks
    got = {r.doc_id: tuple(r)[1:] for r in align.scored(documents([(k, t) for k, t in enumerate(many)]).repartition(3)).collect()}
    want = dict(enumerate(expected(many)))
    assert got == want


def test_labels_and_groups_of_whole_texts(spark, documents):
    many = [t for t in texts(150, 5) if not t or len(t) < 500]
    told = plain(many)
    for r in align.align(documents([(k, t) for k, t in enumerate(many)])).collect():
        want = told[r.doc_id]
        assert r.groups == ("" if want is None else ";".join(want[2]))
        assert len(r.labels) == (0 if want is None else len(many[r.doc_id].encode()) + 1)
        if want:
            assert (sum(r.labels.count(c) for c in "AC"), sum(r.labels.count(c) for c in "BC"), r.labels.count("C")) == (want[0], want[1], len(want[2]))


def test_store_bound_changes_nothing(spark):
    small, large, many = align.Aligner(capacity=5), align.Aligner(), texts(200, 7)
    for part in (many[:90], many[90:]):
        (t1, r1), (t2, r2) = small.texts(part), large.texts(part)
        assert t1 == t2 and [None if x is None else x.tolist() for x in r1] == [None if x is None else x.tolist() for x in r2]


def test_repeated_rows_null_ids_and_no_rows(spark, documents):
    rows = [(1, "one two"), (1, "one two"), (None, "one two"), (2, None)]
    got = sorted(((r.doc_id or 0, r.n_links, r.count_sum) for r in align.scored(documents(rows)).collect()))
    n = len(plain(["one two"])[0][3])
    assert got == sorted([(1, n, 3 * n), (1, n, 3 * n), (0, n, 3 * n), (2, 0, 0)])
    assert align.scored(documents([])).count() == 0


def test_op12_against_the_definitions(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in align.op12_alignment(spark, folder).collect()}
    assert got == dict(zip([k for k, _ in rows], expected([t for _, t in rows]), strict=True))
