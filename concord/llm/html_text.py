"""Main text of web pages by composite text density.

For every node of the DOM: characters, tags, and both within links give the
composite density (characters a tag, weighed down by links, as published for
content extraction via text density). A node's density sum is that of its
children's densities. The node of the greatest sum is selected; the threshold is
the least density on its path up to the body, and a node outside the selected
subtree is content too if its density reaches that. Elements that are never
content (menus, forms, scripts, adverts ...) by tag, role, id or class are taken
out before anything is counted. Words of a class are the weakest of those signs:
an element is left in if it holds <main> or the page's only <article>, and words
of AMBIGUOUS alone don't take out what another name calls content ("post legal").
A selected node within <article> or <main> stands for that whole element.

Defined results: null, empty or text-less html gives the empty text; unclosed
tags, comments and quotes are read as browsers do in the common cases; the whole
page is read however long, in time that grows with its length also where quotes
or tags are never closed; rows are independent, so repeated rows, null ids and
further columns change nothing.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concord.llm._common import arrow_pass, batch_of, columns

# Fixed values of HTML: elements without content, of raw text, of their own block, and those that another start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",)}
SCOPE = frozenset("html body table td th ul ol dl article section div main aside".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
IN_HEAD = frozenset("title meta link base script style noscript template".split())
# Elements, roles and words of id or class that are never content.
NEVER = frozenset("head nav header footer aside form script style noscript template svg canvas iframe object embed button select textarea input label dialog menu noembed noframes audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar "
    "comment comments respond disqus reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations "
    "toolbar pagination pager skip search form hidden copyright legal disclaimer tags".split()
)
#: Words of names that also stand beside content, and words that alone make a name one of content.
AMBIGUOUS = frozenset("legal search tags social share sharing copyright disclaimer login skip".split())
CONTENT = frozenset("article post story content entry main body text".split())
REMARKS = frozenset("comment comments reply replies respond disqus".split())
NOTHING_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

OPENING = re.compile(r"""<(?:!--|[!?]|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<plain>[^<>"']*+)>)?|/)""")
COMMENT_END = re.compile(r"--!?>")
QUOTE_OR_END = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?P<name>[^\s"'>/=]+)(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s"'>]+)))?|"[^"]*"|'[^']*'""")
SPACE = re.compile(r"\s+")

KEPT, BY_NAME, TAKEN_OUT = 0, 1, 2


def standing(tag: str, attrs: str) -> int:
    """KEPT, BY_NAME if only words of class or id speak against an element, else TAKEN_OUT."""
    if tag in NEVER:
        return TAKEN_OUT
    if not attrs or tag in ("body", "html", "main"):
        return KEPT
    names = []
    for m in ATTRIBUTE.finditer(attrs):
        name, value = (m["name"] or "").lower(), (m["a"] or m["b"] or m["c"] or "").lower()
        if name in ("class", "id"):
            names += [set(re.findall(r"[a-z]+", x)) for x in value.split()]
        elif tag != "article" and (name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and NOTHING_SHOWN.search(value)):
            return TAKEN_OUT
    told = set().union(*names) & (REMARKS if tag == "article" else WORDS)
    if told <= AMBIGUOUS and any(x and x <= CONTENT for x in names):
        return KEPT
    return BY_NAME if told else KEPT


def marks(source: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """Begin, end, whether it ends an element, tag and attributes of each piece of markup; comments have no tag.

    A start of raw text is followed by what comes behind its end tag. Quotes that
    are never closed are remembered, so no part of a page is read again for each tag.
    """
    last, at, never_closed = source.rfind(">"), 0, set()

    def end_of(i: int) -> int:
        """Where the tag that is open at i ends, quoted signs aside; 0 if a quote in it is never closed."""
        passed = []
        while (m := QUOTE_OR_END.search(source, i)) and m.start() not in never_closed:
            if m[0] == ">":
                return m.end()
            passed.append(m.start())
            i = source.find(m[0], m.end()) + 1
            if not i:
                break
        never_closed.update(passed)
        return 0

    while m := OPENING.search(source, at):
        begin, tag, attrs = m.start(), m["tag"], m["plain"]
        if m[0] == "<!--":
            if source.startswith((">", "->"), m.end()):
                at = source.index(">", begin) + 1
            else:
                at = end.end() if (end := COMMENT_END.search(source, m.end())) else len(source)
            yield begin, at, False, None, ""
            continue
        if begin > last:  # nothing behind this is ever closed: it is text
            return
        at = m.end() if attrs is not None else tag and end_of(m.end())
        if not at:
            at = source.index(">", begin) + 1
            yield begin, at, False, None, ""
            continue
        tag = tag.lower()
        if attrs is None:
            attrs = source[m.end() : at - 1]
        if not m["end"] and tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = source.find(">", end.end()) + 1 if end else 0
            at = at or len(source)
        yield begin, at, bool(m["end"]), tag, attrs


class Page:
    """The DOM as lists by node: tag, parent and standing, and texts as (node, text) in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.standing, self.texts = ["html"], [-1], [KEPT], []
        stack, at, self.open = [0], 0, {"html": 1}
        skip = None  # depth of the stack below an element that is taken out
        for begin, end, ends, tag, attrs in marks(source):
            if at < begin and skip is None:
                self.texts.append((stack[-1], source[at:begin]))
            at = end
            if tag is None:
                continue
            if ends:
                if tag != "html" and self.open.get(tag):
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == tag:
                            self._cut(stack, k)
                            break
                        if self.tag[stack[k]] in ("td", "th", "table") and tag in ("p", "b", "i", "span", "a", "li"):
                            break
                if skip is not None and len(stack) <= skip:
                    skip = None
                continue
            if tag in ("html", "body") and (tag == "html" or "body" in self.tag):
                continue
            self._imply(stack, tag)
            if skip is not None and len(stack) <= skip:
                skip = None
            how = TAKEN_OUT if skip is not None else standing(tag, attrs)
            if how == TAKEN_OUT and tag in VOID:
                continue
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.standing.append(how)
            node = len(self.tag) - 1
            if tag == "br" and how == KEPT:
                self.texts.append((node, " "))
            if tag in VOID or tag in RAW or attrs.endswith("/") and tag in ("svg", "path"):
                continue
            if how == TAKEN_OUT and skip is None:
                skip = len(stack)
            stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1
        if at < len(source) and skip is None:
            self.texts.append((stack[-1], source[at:]))
        self._take_out()

    def _cut(self, stack: list[int], k: int) -> None:
        """Ends the open elements from the k-th on."""
        for i in stack[k:]:
            self.open[self.tag[i]] -= 1
        del stack[k:]

    def _take_out(self) -> None:
        """Settles which nodes are out, and drops their texts."""
        n, out = len(self.tag), [s == TAKEN_OUT for s in self.standing]
        articles = [i for i in range(n) if self.tag[i] == "article" and self.standing[i] == KEPT]
        main = [i for i in range(n) if self.tag[i] == "main" and not out[i]]
        holds = set()
        for i in main + (articles if len(articles) == 1 else []):
            while i != -1 and i not in holds:
                holds.add(i)
                i = self.parent[i]
        for i in range(1, n):
            out[i] = out[i] or out[self.parent[i]] or self.standing[i] == BY_NAME and i not in holds
        self.out, self.texts = out, [x for x in self.texts if not out[x[0]]]

    def _imply(self, stack: list[int], tag: str) -> None:
        """Ends the elements that the start of this one ends."""
        if self.tag[stack[-1]] == "head" and tag not in IN_HEAD:
            self._cut(stack, len(stack) - 1)
        closes = ("p",) if tag in CLOSES_P else ()
        for wanted in (closes, CLOSES.get(tag, ())):
            if not any(map(self.open.get, wanted)):
                continue
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name in wanted:
                    self._cut(stack, k)
                    break
                if name in SCOPE:
                    break


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Composite density of each node and the sum over its children."""
    n = len(page.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    for node, text in page.texts:
        size = len("".join(text.split()))
        chars[node] += size
        if in_link[node]:
            links[node] += size
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i] + (not page.out[i])
        link_tags[p] += link_tags[i] + (page.tag[i] == "a" and not page.out[i])
    all_links, all_chars = links[0], max(chars[0], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, lc, t, lt = chars[i], links[i], max(tags[i], 1), max(link_tags[i], 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + all_links / all_chars * c + math.e)
            density[i] = c / t * max(0.0, math.log(c / max(lc, 1) * t / lt) / math.log(base) if base > 1 else math.log(max(c / max(lc, 1) * t / lt, 1)))
        if i:
            total[page.parent[i]] += density[i]
    return density, total


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    n = len(page.tag)
    density, total = densities(page)
    body = page.tag.index("body") if "body" in page.tag else 0
    inside = [i == body for i in range(n)]
    for i in range(body + 1, n):
        inside[i] = inside[page.parent[i]]
    best = max((i for i in range(n) if inside[i]), key=lambda i: (total[i], density[i], -i))
    threshold, lifted, i = density[best], None, best
    while i != -1:
        threshold = min(threshold, density[i])
        if page.tag[i] in ("article", "main"):
            lifted = i
        if i == body:
            break
        i = page.parent[i]
    chosen = [False] * n
    for i in range(n):
        chosen[i] = inside[i] and (i == (best if lifted is None else lifted) or i > 0 and chosen[page.parent[i]] or lifted is None and i not in (0, body) and density[i] >= threshold > 0)
    if best == body and lifted is None:
        chosen = inside
    block = list(range(n))
    for i in range(1, n):
        if page.tag[i] not in BLOCK:
            block[i] = block[page.parent[i]]
    blocks: list[tuple[int, list[str]]] = []
    # a block within a block ends what stands before it, so what follows it is a block of its own
    for node, text in page.texts:
        if chosen[node]:
            if blocks and blocks[-1][0] == block[node]:
                blocks[-1][1].append(text)
            else:
                blocks.append((block[node], [text]))
    shown = (SPACE.sub(" ", entities.unescape("".join(parts))).strip() for _, parts in blocks)
    return " ".join(x for x in shown if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of each page."""

    def make():
        def step(batch):
            return batch_of(page_id=batch.column(0), url=batch.column(1), text=pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string()))

        return step

    rows = columns(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return arrow_pass(rows, make, "page_id long, url string, text string")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
