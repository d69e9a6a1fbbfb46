"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements whose content is no markup and no text of the page.
RAW = frozenset("script style textarea title noscript iframe template svg math select object".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_QUOTES = re.compile(r"[\"'>]")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PARTS = re.compile(r"[^a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Parts that may hold an article, so that the selection may narrow down to them.
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
#: Elements, values of `role`, and words of a class or id that state that a part is no article text.
DROPPED = frozenset("aside button dialog fieldset footer form head header input menu nav search".split())
ROLES = frozenset("banner navigation complementary contentinfo search form menu menubar toolbar dialog alert alertdialog".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs captcha comment comments commentlist cookie cookies consent disclaimer disqus footer gdpr header login masthead"
    " menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar"
    " sidenav signup social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
#: Words that say where or in what form a part stands, but not what it is.
PLACES = frozenset("a area bar block body bottom box container content entries entry form global group inner item items left links list main outer page panel post posts right row section site slot the thread top unit user wrap wrapper".split())
#: Start tags that end an open element of the second kind, unless one of the third is nearer.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}


def _marked(value: str) -> bool:
    """Whether a name in a class or id consists of marks, and of words of place besides."""
    for name in value.split():
        parts = [p for p in _PARTS.split(name) if p]
        if any(p in MARKS for p in parts) and all(p in MARKS or p in PLACES for p in parts):
            return True
    return False


def _dropped(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name == "style" and _HIDDEN.search(value) or name in ("class", "id") and tag not in ("html", "body", "main") and _marked(value):
            return True
    return False


def tags(html: str) -> Iterator[tuple[str, str, str]]:
    """(text before it, name in lower case with its slash if it is an end tag, attributes) of each tag; last (text, "", "").

    Comments, declarations and RAW elements are left out. Every search either moves on to what it found or is not made again,
    so that the time is linear: a tag with a quote that is never closed, and each one after it, ends at its first '>'; what
    follows a last, unfinished tag is dropped.
    """
    at = done = 0
    last = {c: html.rfind(c) for c in "\"'>"}
    quoted = True
    text: list[str] = []
    while (at := html.find("<", at)) >= 0:
        m = _NAME.match(html, at + 1)
        if not m:
            kind = html[at + 1 : at + 2]
            if not kind or kind not in "!?/":
                at += 1
                continue
            text.append(html[done:at])
            mark = "-->" if html.startswith("!--", at + 1) else "]]>" if html.startswith("![CDATA[", at + 1) else ">"
            stop = html.find(mark, at + 2)
            at = done = stop + len(mark) if stop >= 0 else len(html)
            continue
        text.append(html[done:at])
        stop, to = -1, m.end()
        while quoted and to <= last[">"]:
            q = _QUOTES.search(html, to)
            if not q:
                break
            if q[0] == ">":
                stop = q.start()
                break
            close = html.find(q[0], q.end()) if q.end() <= last[q[0]] else -1
            if close < 0:
                break
            to = close + 1
        if stop < 0:
            quoted = False
            stop = html.find(">", m.end()) if m.end() <= last[">"] else -1
            if stop < 0:
                at = done = len(html)
                break
        name, attrs = m[0].lower(), html[m.end() : stop]
        at = done = stop + 1
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            at = done = end.end() if end else len(html)
            continue
        yield "".join(text), name, attrs
        text.clear()
    yield "".join(text) + html[done:], "", ""


class Page:
    """The block elements of a page as arrays over nodes in page order, and its text blocks."""

    def __init__(self, html: str):
        self.tag, self.kind, self.parent, self.drop = ["html"], [""], [-1], [False]
        self.chars, self.links, self.tags, self.link_tags = [0], [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        run: list[str] = []
        linked = 0
        stack = [("html", 0)]  # (tag, node) of open blocks and dropped parts; other elements leave no trace but in the counts
        places: dict[str, list[int]] = defaultdict(list)  # tag -> places in the stack
        anchor = 0  # depth of the stack where a link was opened, 0: none is open

        def flush() -> None:
            nonlocal linked
            if run:
                text = _SPACE.sub(" ", unescape("".join(run))).strip()
                run.clear()
                if text:
                    node = stack[-1][1]
                    self.blocks.append((node, text))
                    self.chars[node] += len(text)
                    self.links[node] += min(linked, len(text))
            linked = 0

        def pop(to: int) -> None:
            nonlocal anchor
            flush()
            while len(stack) > to:
                places[stack.pop()[0]].pop()
            if anchor > len(stack):
                anchor = 0

        def top(kinds: tuple[str, ...]) -> int:
            return max((places[t][-1] for t in kinds if places[t]), default=0)

        for text, name, attrs in tags(html):
            if text:
                run.append(text)
                if anchor:
                    linked += len(text.strip())
            if not name:
                continue
            if name[0] == "/":
                tag = name[1:]
                if tag == "a":
                    anchor = 0
                if places[tag]:
                    pop(places[tag][-1])
                elif tag in BLOCK:
                    flush()
                continue
            self.tags[stack[-1][1]] += 1
            if name == "a":
                self.link_tags[stack[-1][1]] += 1
                anchor = len(stack)
            elif name == "br":
                run.append(" ")
            block = name in BLOCK
            if name in VOID:
                if block:
                    flush()
                continue
            if block:
                if name == "html":
                    continue
                if k := top(("head",)):
                    pop(k)
                if (k := top(("p",))) > top(("table", "button")):
                    pop(k)
                flush()
            if name in CLOSES and (k := top(CLOSES[name])) > top(SCOPES[name]):
                pop(k)
            if not block and attrs.endswith("/"):
                continue
            drop = _dropped(name, attrs) if attrs or block else name in DROPPED
            if block or drop:
                flush()
                self.tag.append(name)
                self.kind.append(f"{name} {attrs.strip()}" if "class" in attrs else name)
                self.parent.append(stack[-1][1])
                self.drop.append(drop)
                for column in (self.chars, self.links, self.tags, self.link_tags):
                    column.append(0)
                places[name].append(len(stack))
                stack.append((name, len(self.tag) - 1))
        flush()

    def densities(self) -> tuple[list[bool], list[int], list[float], list[float]]:
        """For each node whether it is left out, its characters, its density and its children's densities' sum."""
        n = len(self.tag)
        gone = [False] * n
        for i in range(1, n):
            gone[i] = self.drop[i] or gone[self.parent[i]]
        self.totals = totals = [list(x) for x in (self.chars, self.links, self.tags, self.link_tags)]
        for column in totals:
            for i in range(n):
                if gone[i]:
                    column[i] = 0
            for i in range(n - 1, 0, -1):
                column[self.parent[i]] += column[i]
        c = totals[0]
        body = next((i for i in range(n) if self.tag[i] == "body" and c[i]), 0)
        self.body, self.share = body, totals[1][body] / max(c[body], 1)
        d = [self.density(*(column[i] for column in totals)) for i in range(n)]
        sums = [0.0] * n
        for i in range(n - 1, 0, -1):
            sums[self.parent[i]] += d[i]
        return gone, c, d, sums

    def density(self, c: int, lc: int, t: int, lt: int) -> float:
        """Composite text density: characters per tag times the logarithm of (c / lc * t / lt), to the base ln(c / (c - lc) * lc + share * c + e)."""
        if c <= 0:
            return 0.0
        lc, t, lt, rest = max(lc, 1), max(t, 1), max(lt, 1), max(c - lc, 1)
        ratio = c / lc * t / lt
        return c / t * max(0.0, log(ratio) / log(log(c / rest * lc + self.share * c + e)))

    def main(self) -> list[str]:
        """The blocks of the selected subtree, without its dropped parts; see `extract`."""
        n = len(self.tag)
        gone, c, d, sums = self.densities()
        body, totals = self.body, self.totals
        best = max((i for i in range(body, n) if not gone[i]), key=lambda i: (sums[i], -i), default=body)
        if not sums[best]:
            best = body
        path = [best]
        while path[-1] != body and self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        threshold = min(d[i] for i in path)
        children: dict[int, list[int]] = defaultdict(list)
        for i in range(1, n):
            if c[i] and not gone[i]:
                children[self.parent[i]].append(i)

        def belongs(x: int) -> bool:
            """Whether the rest of x's parent is of one text with x."""
            p = self.parent[x]
            rest = [column[p] - column[x] for column in totals]
            rest[2] -= 1  # x's own tag
            if rest[0] <= 0 or self.density(*rest) >= threshold:
                return True
            if self.tag[p] == "article" and d[p] >= d[body]:
                return True
            same = self.kind[x] not in ("div", "td")  # without a class these are of no kind
            return not self.chars[p] and all(i == x or self.tag[i] in HEADINGS or same and self.kind[i] == self.kind[x] for i in children[p])

        start = best
        while best != body and belongs(best):
            best = self.parent[best]
        if best == start:
            while children[best]:
                x = max(children[best], key=lambda i: (c[i], -i))
                if self.tag[x] not in CONTAINERS or 2 * c[x] < c[best] or belongs(x):
                    break
                best = x
        kept = [False] * n
        for i in range(best, n):
            kept[i] = i == best or kept[self.parent[i]] and not gone[i]
        return [text for i, text in self.blocks if kept[i]]


def main_text(html: str | None) -> str:
    """The page's main text, its blocks joined by line breaks; empty if there is none."""
    return "\n".join(Page(html).main()) if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [main_text(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html).

    Parts whose element, role, class or id states that they are no article text (navigation, headers, footers, asides, forms,
    adverts, notices, comments; see DROPPED, ROLES, MARKS) count for nothing. For every other block element the characters per
    tag are computed and adjusted by its links. The element whose children's densities add up highest is selected; the least
    density on its path to the body is the threshold. The selection grows to the parent while the rest of the parent reaches the
    threshold, or is headings and parts of the selected one's kind, or belongs to an article element at least as dense as the body; if it
    didn't grow, it narrows down to a child of most of the characters while the rest around the child does not. All blocks of the selection are kept.
    Null and empty pages give an empty text; repeated rows are extracted each; an empty table gives no rows; other columns
    are ignored; the time is linear in a page's length however broken it is.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
