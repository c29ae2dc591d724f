"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf path of block elements; a path's step is
the element's name with its class and id (without digits), so the paragraphs of one container share a
path. Per path the lengths and the punctuation of its blocks are summed. The two ratios (letters and
marks a block) are smoothed with those of all paths of the same container, fused by multiplication and
weighed by features: paths under an article or main element weigh more, those under an element whose
class or id speaks against it weigh less, links count against a path. The path with most fused text
sets the bar; paths that reach SHARE of its ratio are content, wherever they lie. A container with
CONTAINER of its letters in content paths gives its other paths too (headings, lists, captions), but
for those that are mostly links or spoken against; parts of an article follow it.

What is never article text is left out whatever its ratio: scripts, styles, forms, and elements or
roles that are menus, banners, footers, sidebars or dialogs.

Character references are decoded; white space inside a block becomes one space; blocks are trimmed
and joined by newlines in page order. Null and empty pages give the empty text; so do pages without
text. Unclosed elements, stray end tags and cut-off pages are read as browsers do, in time that
grows with the page's length alone. Ties share their fate, as equal ratios meet one bar. Repeated rows
are read once each; other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.cluster import bounded

#: A path is content from this share of the heaviest path's fused ratio.
SHARE = 0.4
#: A container gives all its paths from this share of its letters in content paths.
CONTAINER = 0.3
#: A path's own part in its smoothed ratios; the container's is the rest.
OWN = 0.7
#: Weights of paths under an article or main element, and under one that its names speak against.
ARTICLE, AGAINST = 4.0, 0.02

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=[\s/>]|$)", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = set(
    "head script style noscript template nav aside footer form button select textarea input label fieldset dialog menu iframe object svg math canvas "
    "audio video title option datalist".split()
)
_REGION = {"article", "main"}
#: Elements that belong to the text of the container around them.
_PROSE = set("address blockquote center dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre summary ul".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of a class or id that speak against an element.
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login register sidebar aside rail widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs crumbs pagination pager paging share sharing social follow related recommended recommendations suggested more-stories "
    "comment comments commentlist disqus respond reply replies discussion footer masthead topbar toolbar toc tags skip copyright legal disclaimer "
    "search searchbox form outbrain taboola teaser trending".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "option", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: What an element's start closes, as groups of names: the nearest of the group that is open inside the group's fence.
_GROUPS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_FENCES = {"table": (0, 3, 4), "td": (0,), "th": (0,), "tr": (4,), "caption": (0,), "ul": (1,), "ol": (1,), "menu": (1,), "dl": (2,), "select": (5,)}
_MARKS = re.compile(r"[.,;:!?。，、；：！？…]")
_SPACE = re.compile(r"\s+")


class Page:
    """A page's text blocks with their paths. Paths are numbers; a path comes after the one it extends."""

    def __init__(self, page: str):
        self.parent, self.prose, self.against, self.article = [-1], [False], [False], [False]
        self.known: dict[tuple, int] = {}
        self.texts: list[tuple[int, int, bool, str]] = []  # block, path, in a link, text
        self.block = 0
        self._read(page)

    def _step(self, path: int, tag: str, names: str, against: bool, article: bool) -> int:
        key = (path, tag, names)
        if key not in self.known:
            self.known[key] = len(self.parent)
            self.parent.append(path)
            self.prose.append(tag in _PROSE)
            self.against.append(against)
            self.article.append(article or self.article[path])
        return self.known[key]

    def _read(self, page: str) -> None:
        root = ("", False, 0, False, (-1,) * 6)  # tag, hidden here or above, path, in a link, where what may be closed is open
        stack = [root]
        open_tags: dict[str, int] = {}

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                tag = stack.pop()[0]
                open_tags[tag] -= 1
                if tag in _BLOCK:
                    self.block += 1

        def say(text: str) -> None:
            _, hidden, path, link, _ = stack[-1]
            if text and not hidden:
                self.texts.append((self.block, path, link, html.unescape(text)))

        at, n = 0, len(page)
        while at < n:
            start = page.find("<", at)
            if start < 0:
                say(page[at:])
                return
            say(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            if page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                say(page[start + 9 : n if end < 0 else end])
                at = n if end < 0 else end + 3
                continue
            closes = page.startswith("/", start + 1)
            name = _NAME.match(page, start + 1 + closes)
            if not name:
                if closes or page[start + 1 : start + 2] in ("!", "?"):  # a declaration or a broken end tag
                    end = page.find(">", start)
                    at = n if end < 0 else end + 1
                else:
                    say("<")
                    at = start + 1
                continue
            end = _tag_end(page, name.end())
            if end < 0:  # the page's end cuts the tag off
                return
            tag, rest, at = name[0].lower(), page[name.end() : end], end + 1
            if closes:
                if open_tags.get(tag):
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    pop_to(depth)
                elif tag == "p":
                    self.block += 1
                continue
            if tag in _VOID:
                if tag == "br":
                    say(" ")
                elif tag == "hr":
                    self.block += 1
                continue
            if tag == "body" and len(stack) > 1:
                pop_to(2 if stack[1][0] == "html" else 1)
            if tag in _CLOSES_P and stack[-1][4][0] >= 0:
                pop_to(stack[-1][4][0])
            if tag in _GROUPS and stack[-1][4][_GROUPS[tag]] >= 0:
                pop_to(stack[-1][4][_GROUPS[tag]])
            _, hidden, path, link, nearest = stack[-1]
            inside = self.article[path]
            names, against, article, off = _features(tag, rest)
            hidden = hidden or off or tag in _NEVER or tag == "header" and not inside
            if tag in _BLOCK:
                self.block += 1
                path = self._step(path, tag, names, against, article)
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                if not hidden:
                    say(page[at : close.start() if close else n])
                at = close.end() if close else n
                continue
            if not (rest.endswith("/") and tag in ("path", "circle", "rect")):
                if tag in _GROUPS or tag in _FENCES:
                    fenced = _FENCES.get(tag, ())
                    nearest = tuple(-1 if k in fenced else x for k, x in enumerate(nearest))
                    if tag in _GROUPS:
                        k = _GROUPS[tag]
                        nearest = (*nearest[:k], len(stack), *nearest[k + 1 :])
                stack.append((tag, hidden, path, link or tag == "a", nearest))
                open_tags[tag] = open_tags.get(tag, 0) + 1


def _tag_end(page: str, at: int) -> int:
    """Where the tag that is open at `at` ends; -1 if the page ends before."""
    while True:
        stop = _STOP.search(page, at)
        if not stop:
            return -1
        if stop[0] == ">":
            return stop.start()
        at = page.find(stop[0][-1], stop.end()) + 1
        if not at:
            return -1


def _features(tag: str, rest: str) -> tuple[str, bool, bool, bool]:
    """(class and id without digits, whether they speak against the element, is it an article, is it never shown or text)."""
    names, against, article, off = "", False, tag in _REGION, False
    if rest and not rest.isspace():
        for name, *values in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
            if name in ("class", "id"):
                names += " " + re.sub(r"\d+", "", value)
                if tag not in ("html", "body", "article", "main"):
                    against = against or any(w in _WORDS or not _WORDS.isdisjoint(re.split(r"[-_]+", w)) for w in value.split())
            elif name == "role":
                off = off or value in _ROLES
                article = article or value in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                off = True
    return names, against, article, off


def content_paths(page: Page) -> list[bool]:
    """For each path of `page` whether it is content."""
    n = len(page.parent)
    letters, links, marks, blocks, last = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n
    for block, path, link, text in page.texts:
        own = sum(map(len, text.split()))
        if own:
            letters[path] += own
            links[path] += own if link else 0
            marks[path] += len(_MARKS.findall(text))
            if block != last[path]:
                blocks[path] += 1
                last[path] = block
    used = [k for k in range(n) if letters[k]]
    content = [False] * n
    if not used:
        return content
    home = [0] * n  # the container of a path
    for k in range(1, n):
        home[k] = home[page.parent[k]] if page.prose[k] else k
    sums = [[0, 0, 0] for _ in range(n)]  # of a container: letters, marks, blocks
    for k in used:
        own = sums[home[k]]
        own[0] += letters[k]
        own[1] += marks[k]
        own[2] += blocks[k]

    def fused(against: list[bool]) -> list[float]:
        out = [0.0] * n
        for k in used:
            all_letters, all_marks, all_blocks = sums[home[k]]
            length = OWN * letters[k] / blocks[k] + (1 - OWN) * all_letters / all_blocks
            stops = OWN * marks[k] / blocks[k] + (1 - OWN) * all_marks / all_blocks
            weight = (ARTICLE if page.article[k] else 1.0) * (AGAINST if against[k] else 1.0) * (1 - 0.9 * links[k] / letters[k])
            out[k] = length * (0.5 + stops) * weight
        return out

    def under(spoken: list[bool]) -> list[bool]:
        out = spoken[:]
        for k in range(1, n):
            out[k] = out[k] or out[page.parent[k]]
        return out

    against = under(page.against)
    ratio = fused(against)
    top = max(used, key=lambda k: (letters[k] * ratio[k], -k))
    if against[top]:  # names around the heaviest path say nothing against it
        spoken, k = page.against[:], top
        while k > 0:
            spoken[k], k = False, page.parent[k]
        against = under(spoken)
        ratio = fused(against)
        top = max(used, key=lambda k: (letters[k] * ratio[k], -k))
    bar = SHARE * ratio[top]
    inside = [0] * n  # a container's letters in content paths
    for k in used:
        if ratio[k] >= bar:
            content[k] = True
            inside[home[k]] += letters[k]
    whole = [False] * n
    for k in range(n):
        if home[k] == k and not against[k]:
            around = home[page.parent[k]] if k else 0
            whole[k] = sums[k][0] > 0 and inside[k] >= CONTAINER * sums[k][0] or k > 0 and whole[around] and page.article[around]
    for k in used:
        content[k] = content[k] or whole[home[k]] and not against[k] and 2 * links[k] <= letters[k]
    return content


def main_text(page: str | None) -> str:
    """The page's article text."""
    read = Page(page or "")
    content = content_paths(read)
    blocks: dict[int, list[str]] = {}
    for block, path, _, text in read.texts:
        if content[path]:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) -> page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
