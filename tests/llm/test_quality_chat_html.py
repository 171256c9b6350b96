import hashlib
import math
import random
import time
import re
from collections import Counter
from xml.etree import ElementTree

import numpy as np

from concord.llm import chat, html_text, quality

PROSE = "The cat and the dog went to the old house by the river, and in the evening they sat down with a cup of tea. "
SIGNS = " ".join(f"wo{k}rd### &&& $$$" for k in range(90))


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_counts_are_those_of_brute_force():
    rng = random.Random(5)
    texts = [None, "", " \n\t", PROSE * 400, "a b c d e " * 2, "x\x85y z\u00a0w \x1c q"] + ["".join(rng.choices("ab \n\té#|,", k=rng.randrange(80))) for _ in range(800)]
    c = quality.Counted(texts)
    repeated, dup = c.n_repeat_words(), c.n_dup_lines()
    for i, t in enumerate(texts):
        n, chars, symbols, d, r, _ = plain_base(t)
        assert (c.n_words[i], c.word_chars[i], c.n_symbols[i], dup[i], repeated[i]) == (n, chars, symbols, d, r), repr(t)


def test_quality_rules(spark, documents):
    prose = [(i, " ".join(random.Random(i).sample(PROSE.split() * 9, 150)), "en") for i in range(30)]
    rows = prose + [(100, SIGNS, "en"), (101, None, None), (102, "", "en"), (103, "one two", None), (104, PROSE * 9, "en"), (0, prose[0][1], "en"), (None, prose[1][1], None), (105, PROSE.upper() + " ".join(f"W{k}!!" for k in range(80)), "en")]
    docs = documents(rows)
    got = {(r.doc_id, r.n_words): r for r in quality.judge(docs, quality.references(docs)).collect()}
    assert len(quality.judge(docs, quality.references(docs)).collect()) == len(rows)
    for doc_id, text, *_ in rows:
        n, chars, symbols, dup, repeated, failed = plain_base(text)
        r = got[doc_id, n]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (chars, symbols, dup, repeated, failed)
        assert r.kept == (not failed and doc_id not in (100, 105)), r
    assert quality.references(docs.limit(0)) == {} and quality.judge(docs.limit(0), {}).count() == 0
    alone = {r.doc_id: r.kept for r in quality.judge(docs.filter("doc_id >= 100"), {}).collect()}
    assert alone == {100: True, 101: False, 102: False, 103: False, 104: False, 105: True}


def test_text_without_common_words_is_rejected(spark, documents):
    rng = random.Random(8)
    prose = [(i, " ".join(random.Random(i).sample(PROSE.split() * 9, 90 + 2 * i)), "en") for i in range(30)]
    sizes = [len(w) for w in PROSE.split()]
    letters = [x for x in PROSE.lower() if x.isalpha()]
    junk = [(1000 + n, " ".join("".join(rng.choices(letters, k=rng.choice(sizes))) + "." * (k % 12 == 11) for k in range(n)), None) for n in (150, 600, 5000)]
    refs = quality.references(documents(prose))
    got = {r.doc_id: r for r in quality.judge(documents(prose + junk), refs).collect()}
    for doc_id, *_ in prose:
        assert got[doc_id].kept
    for doc_id, *_ in junk:
        assert not got[doc_id].base_failed and got[doc_id].class_distance <= quality.MAX_CLASS_DISTANCE and not got[doc_id].kept


def test_word_limits_are_below_a_text_without_common_words():
    share = np.array([0.32 / 40] * 40 + [0.68])
    none = quality.distance(np.r_[np.zeros(40), 1.0], share)
    assert none < quality.MAX_WORD_DISTANCE
    assert (quality.word_limits(share)[2:] < none).all()


def test_distance_is_symmetric_and_bounded():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.0, 1.0])
    assert quality.distance(p, q)[0] == 1 and quality.distance(p, p[0])[0] == 0


PARTS = ["\\", "#", "### ", "</turn>", "</turn>\n", "<", ": ", ":", "a", "Assistant", " ", "\n", "é", "user"]


def test_chat_reads_back_whatever_is_said():
    rng = random.Random(6)
    said = []
    for _ in range(20_000):
        role, text = ("".join(rng.choices(PARTS, k=rng.randrange(n))) for n in (5, 9))
        turn, b, e = chat.render(role, text)
        assert [t[:2] for t in chat.parse(turn)] == [(role, text)] and chat.UNESCAPE.sub(r"\1", turn[b:e]) == text
        assert "### " not in re.sub(r"(?s)\\.", "~", turn[b:e]) and "</turn>\n" not in turn[b:e].replace("\\</turn>", "")
        said.append((role, text, turn))
    assert [t[:2] for t in chat.parse("".join(t for _, _, t in said[:500]))] == [s[:2] for s in said[:500]]


def test_chat_table(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\### b"), (1, 1, "assistant", "a\\### b"), (2, None, None, None), (2, 0, "assistant", ""), (None, 3, "system", "x" * 9000), (-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, None, -7}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        told = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render(x[2], x[3])[0]) for x in own)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a> menu</nav>
<div class="cookie-notice">We use cookies</div><div id="main"><h2>News &amp; more</h2><p>First <b>bo</b>ld   line, with a good deal of text in it.<br>Next line<p>Second paragraph with <a href="x">a link</a> &lt;in&gt; it and more words still.
<ul><li>One<li>Two</ul>{more}</div><aside>About us</aside><div class="comments"><p>First!</p></div><form><p>Your mail</p></form><script>if (a < b) "</p>"</script><footer>&copy; us</footer></body></html>"""


def test_main_text():
    want = "News & more First bold line, with a good deal of text in it. Next line Second paragraph with a link <in> it and more words still. One Two"
    assert html_text.main_text(PAGE.replace("{more}", "")) == want
    more = "".join(f"<p>Paragraph {k} of a very long page.</p>" for k in range(3000))
    assert html_text.main_text(PAGE.replace("{more}", more)).startswith(want + " Paragraph 0") and html_text.main_text(PAGE.replace("{more}", more)).endswith("Paragraph 2999 of a very long page.")
    for empty in (None, "", "<p>", "<script>x", "<!-- only"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("just text &eacute;") == "just text é"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "v", "", "x")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert sorted((r.page_id or 0, len(r.text) > 0) for r in rows) == [(0, False), (1, True), (1, True), (2, False)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_of_any_names():
    article = "<p>" + "A sentence of the article that is read whole. " * 6 + "</p>"
    want = ("A sentence of the article that is read whole. " * 6).strip()
    for names in ("post legal", "content search-results-story", "entry social", "page has-menu"):
        inner = f"<main>{article}</main>" if "has-menu" in names else article
        assert html_text.main_text(f'<html><body><div class="{names}">{inner}</div><div class="footer"><p>Site line</p></div></body></html>') == want, names
    page = f'<head><title>T</title><body><div class="sidebar layout"><article>{article}</article></div><div class="post comments"><article class="comment">{article * 9}</article></div><div title="class=ad">'
    assert html_text.main_text(page) == want
    for names in ("comment post", "content sidebar", "post-comments", "legal", "notice text"):
        assert html_text.main_text(f'<body><div><p>{want}</p></div><div class="{names}"><p>Not this one</p></div>') == want, names


def test_pages_in_linear_time():
    for piece in ('<p title="', "<p title='\"", "<p ", "<p", "<!", "</", "<script", "<!-", "<span>", "<a><b></i>", '<p "\'>', "<p><span>", "</script "):
        page = f"<body><p>start</p>{piece * 60_000}"
        begin = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - begin < 5, piece
    page = "<span>" * 30_000 + "</i>" * 30_000 + "<p>x</p>" * 30_000
    begin = time.process_time()
    assert html_text.main_text(page).startswith("x x") and time.process_time() - begin < 5


def plain_main_text(body):
    """The method by recursion over an ElementTree without articles or class names, the formula written out."""

    def nodes(x):
        return [x, *(y for child in x for y in nodes(child))]

    def chars(x, in_link=False, only_links=False):
        in_link = in_link or x.tag == "a"
        own = [(x.text, in_link)] + [(c.tail, in_link) for c in x]
        return sum(len("".join((t or "").split())) for t, linked in own if linked or not only_links) + sum(chars(c, in_link, only_links) for c in x)

    def density(x):
        c, lc, t, lt = chars(x), chars(x, only_links=True), max(len(nodes(x)) - 1, 1), max(sum(y.tag == "a" for y in nodes(x)[1:]), 1)
        if not c:
            return 0.0
        base = c / max(c - lc, 1) * lc + chars(body, only_links=True) / max(chars(body), 1) * c + math.e
        return c / t * max(0.0, math.log(c / max(lc, 1) * t / lt) / math.log(math.log(base)) if math.log(base) > 1 else math.log(max(c / max(lc, 1) * t / lt, 1)))

    every = nodes(body)
    above = {c: x for x in every for c in x}
    best = max(every, key=lambda x: (sum(density(c) for c in x), density(x), -every.index(x)))
    path = [best]
    while path[-1] is not body:
        path.append(above[path[-1]])
    least = min(density(x) for x in path)
    chosen = set(every) if best is body else {y for x in every if x is not body and (x is best or density(x) >= least > 0) for y in nodes(x)}
    out = []

    def read(x):
        out.append((x in chosen, x.text or ""))
        for c in x:
            read(c)
            out.append((x in chosen, c.tail or ""))

    read(body)
    return [t.strip() for keep, t in out if keep and t.strip()]


def test_main_text_is_that_of_brute_force():
    rng = random.Random(9)

    def grow(x, depth):
        x.text = " ".join(rng.choices(["word", "another", "é", "longer-one"], k=rng.choice((0, 1, 3, 30))))
        for _ in range(rng.randrange(4) if depth else 0):
            # links and bold text within blocks only, as pages have them
            grow(ElementTree.SubElement(x, rng.choice(("div", "section", "ul")) if depth > 1 else rng.choice(("b", "i"))), depth - 1)
            if depth > 1 and rng.random() < 0.5:
                ElementTree.SubElement(x, "a").text = rng.choice(("link", "a link of many words here"))

    shorter = 0
    for k in range(300):
        body = ElementTree.Element("body")
        grow(body, 4)
        want = plain_main_text(body)
        got = html_text.main_text(f"<html>{ElementTree.tostring(body, 'unicode', short_empty_elements=False)}</html>")
        assert "".join(got.split()) == "".join("".join(want).split()), k
        shorter += len(got.split()) < len(" ".join(body.itertext()).split())
    assert shorter > 30
