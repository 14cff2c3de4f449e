"""Main text of web pages by consensus paths of a host.

Pass one scores the containers of each page and votes for the generalised
tag-class path of the best ones; Spark sums the votes by host. Pass two extracts
each page again below its host's winning path (its own best container where the
path doesn't occur), without boilerplate subtrees.

Tags and names of classes only hint at boilerplate: a subtree with a hint is left out unless
the page's weight says that the article is in it. Parsing and scoring take time linear in the page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import joinable, slices, small_batches, table
from .urls import host_of

# Element names of HTML and words of class or id attributes.
RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes".split())
MEDIA = frozenset("audio video canvas object svg math select picture map".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINER = frozenset("html article body center dd div main section td blockquote".split())
SKIP = frozenset("nav footer aside form menu search dialog button head label".split())
MAIN = frozenset("article main body html".split())
SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"p": BLOCK - {"p"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": set()}
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer cookie cookies consent notice gdpr popup modal overlay comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended newsletter subscribe subscription signup login widget toolbar pagination pager masthead "
    "copyright topbar skip".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
#: Beside these a word of NOISE describes a layout or a state. Fixed values.
STATES = frozenset("has no with without is not hide show js open opened closed enabled disabled on off active inactive allowed page layout body full".split())

#: A tag whose quoted values hold no < or >; else the beginning of a comment, or of anything that may be a tag.
TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/><\"']*+)((?:[^<>\"']*+(?:\"[^\"<>]*+\"|'[^'<>]*+'))*+[^<>\"']*+)>|(!--|[!?])|(?=/?[a-zA-Z])|(/)(?=[^a-zA-Z]))")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/><\"']*+)")
STOP = re.compile(r"[>\"']")
ANGLE = re.compile(r"[<>]")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([a-zA-Z-]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?+")
WORDS = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"\d+")
INNER_SPACE = re.compile(r"\s+")
#: How far up an element that ends its like (a list item, a cell) is looked for.
NEAR = 64
#: A container goes with its only heavy child from this share of its weight.
HEAVY = 0.8

HINT, HEADER, FALLBACK = 1, 2, 3  # kinds of hint; FALLBACK: what is inside media, if the element is closed


def _noisy(name: str) -> bool:
    """Whether a class or id says boilerplate: its first or last word does, and none is a layout or a state."""
    words = [w for w in WORDS.split(name) if w]
    return bool(words) and (words[0] in NOISE or words[-1] in NOISE) and STATES.isdisjoint(words)


def _attributes(tag: str, attributes: str) -> tuple[str, int]:
    """(generalised key, hint) of an element."""
    names: set[str] = set()
    hint = 0
    for m in ATTRIBUTE.finditer(attributes):
        a, v = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if a == "class":
            names.update(DIGITS.sub("", v).split())
        if a in ("class", "id") and tag not in ("body", "html"):
            for name in v.split():
                if _noisy(name):
                    hint = HINT
                elif not hint and (name == "header" or name in ("site-header", "page-header")):
                    hint = HEADER
        elif a == "role" and v in NOISE_ROLES or a == "hidden" or a == "aria-hidden" and v == "true" or a == "style" and "display:none" in v.replace(" ", ""):
            hint = HINT
    return ".".join([tag, *sorted(names)]), hint


class Page:
    """Elements in page order as columns (parent, tag, path of containers, hint, closed) and the blocks of text:
    (nearest element, text, characters inside links)."""

    def __init__(self, html: str | None):
        self.parent, self.tag, self.path, self.hint, self.closed = [-1], ["html"], [xxhash.xxh64_intdigest("html") >> 1], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        stack, opened = [(0, "html", False)], {"html": 1}  # (element, tag, inside a link)
        inner = 0  # further elements of the same name inside the innermost one, where that is inline
        link, linked, text = False, 0, []
        last_end, dead, gap = html.rfind(">"), set(), (0, -1, None)

        def end_of_tag(at: int) -> int:
            """The > that ends a tag with < or > in quotes. Openings of quotes that lead nowhere are remembered."""
            nonlocal gap
            seen: list[int] = []
            while at <= last_end:
                if not gap[0] <= at <= gap[1]:
                    m = STOP.search(html, at)
                    gap = (at, m.start(), m[0])
                where, what = gap[1:]
                if what == ">":
                    return where
                if where in dead:
                    break
                seen.append(where)
                close = html.find(what, where + 1)
                if close < 0:
                    break
                at = close + 1
            dead.update(seen)
            return -1

        def flush() -> None:
            nonlocal linked
            if text:
                s = INNER_SPACE.sub(" ", "".join(text)).strip()
                if s:
                    self.blocks.append((stack[-1][0], s, linked))
                text.clear()
            linked = 0

        def pop_to(k: int) -> None:
            nonlocal link, inner
            for _, t, _ in stack[k:]:
                opened[t] -= 1
            link = stack[k][2]
            del stack[k:]
            inner = 0

        def push(tag: str, attributes: str, hint: int) -> None:
            nonlocal inner
            up = stack[-1][0]
            key, more = _attributes(tag, attributes) if "=" in attributes or "hidden" in attributes else (tag, 0)
            if tag in SKIP:
                hint = HINT
            elif tag == "header":
                hint = HEADER
            self.parent.append(up)
            self.tag.append(tag)
            self.path.append(xxhash.xxh64_intdigest(f"{self.path[up]}/{key}") >> 1 if tag in CONTAINER else self.path[up])
            self.hint.append(hint or more)
            self.closed.append(False)
            stack.append((len(self.tag) - 1, tag, link))
            opened[tag] = opened.get(tag, 0) + 1
            inner = 0

        def add(piece: str) -> None:
            nonlocal linked
            if "&" in piece:
                piece = unescape(piece)
            text.append(piece)
            if link:
                linked += len(piece)

        at = 0
        while (m := TAG.search(html, at)) is not None:
            if m.start() > at:
                add(html[at : m.start()])
            at, ends, tag, attributes = m.end(), m[1], m[2], m[3]
            if tag is None:
                if m[4] == "!--":
                    e = COMMENT_END.search(html, at - 2)
                    at = e.end() if e else len(html)
                    continue
                if m[4] or m[5]:
                    at = html.find(">", at) + 1 or len(html)
                    continue
                name = NAME.match(html, at)
                e = end_of_tag(name.end())
                if e < 0:  # never ended: up to the next angle, if that is an end or there is none
                    angle = ANGLE.search(html, name.end())
                    if angle is not None and angle[0] == "<":
                        text.append("<")
                        continue
                    e = angle.start() if angle else len(html)
                ends, tag, attributes, at = name[1], name[2], html[name.end() : e], min(e + 1, len(html))
            tag = tag.lower()
            if tag == "br":
                text.append(" ")
            elif ends:
                if tag == "a":
                    link = False
                elif tag in BLOCK:
                    flush()
                    if opened.get(tag):
                        k = len(stack) - 1
                        while stack[k][1] != tag:
                            k -= 1
                        if k:
                            self.closed[stack[k][0]] = True
                            pop_to(k)
                elif stack[-1][1] == tag:
                    if inner:
                        inner -= 1
                    else:
                        flush()
                        self.closed[stack[-1][0]] = True
                        pop_to(len(stack) - 1)
            elif tag in RAW:
                if not attributes.rstrip().endswith("/") or tag in ("script", "style", "textarea", "title"):
                    e = re.compile(f"</{tag}(?=[\\s/>])[^>]*", re.I).search(html, at)
                    at = min(e.end() + 1, len(html)) if e else len(html)
            elif tag in VOID:
                if tag == "hr":
                    flush()
            elif tag in BLOCK:
                flush()
                if tag not in ("html", "body") or not opened.get(tag):
                    near = max(1, len(stack) - NEAR)
                    for names, stops in ((SAME["p"], STOPS["p"]), (SAME.get(tag), STOPS.get(tag))):
                        for k in range(len(stack) - 1, near - 1, -1) if names and (tag != "p" or names is SAME["p"]) else ():
                            if stack[k][1] in names:
                                pop_to(k)
                                break
                            if stack[k][1] in stops:
                                break
                    push(tag, attributes, 0)
            elif tag == "a":
                link = True
            elif stack[-1][1] == tag:
                inner += not attributes.endswith("/")
            elif tag in MEDIA:
                if not attributes.endswith("/"):
                    flush()
                    push(tag, attributes, FALLBACK)
            elif tag in SKIP:
                flush()
                push(tag, attributes, HINT)
            elif attributes and ("class" in attributes or "hidden" in attributes or "style" in attributes or "id" in attributes) and _attributes(tag, attributes)[1] == HINT:
                flush()
                push(tag, attributes, HINT)
        if at < len(html):
            add(html[at:])
        flush()

    def sums(self, dropped: list[bool]) -> list[float]:
        """Weight of each element: characters of its kept blocks, of which those in links count against."""
        w = [0.0] * len(self.tag)
        for node, s, linked in self.blocks:
            if not dropped[node]:
                w[node] += max(0.0, len(s) - 2.0 * linked)
        for i in range(len(w) - 1, 0, -1):
            w[self.parent[i]] += w[i]
        return w

    def boilerplate(self, inside: int = -1) -> list[bool]:
        """Elements that are left out. Of those with a hint these stay: one with half the page's weight (four fifths, if it
        has no h1 and others do), and what holds the heaviest article or main of the page, if that is a quarter of it.
        A header stays within an article, and below the element `inside`."""
        n, hint, tag = len(self.tag), self.hint, self.tag
        dropped = [False] * n
        for i in range(1, n):
            dropped[i] = dropped[self.parent[i]] or hint[i] == FALLBACK and self.closed[i]
        if not any(h in (HINT, HEADER) for h in hint):
            return dropped
        weight = self.sums(dropped)
        headed, holds = [t == "h1" for t in tag], [False] * n
        mains = [i for i in range(n) if tag[i] in ("article", "main")]
        if mains:
            top = max(mains, key=lambda i: (weight[i], -i))
            holds[top] = weight[top] >= 0.25 * weight[0]
        for i in range(n - 1, 0, -1):
            headed[self.parent[i]] |= headed[i]
            holds[self.parent[i]] |= holds[i]
        within = [False] * n
        for i in range(1, n):
            up = self.parent[i]
            dropped[i] = dropped[i] or dropped[up]
            within[i] = within[up] or tag[i] in ("article", "main") or i == inside
            if hint[i] in (HINT, HEADER) and not dropped[i] and not holds[i] and not (hint[i] == HEADER and within[up]):
                half = weight[i] >= (0.5 if headed[i] or not headed[0] else 0.8) * weight[0] > 0
                dropped[i] = not (half and not (mains and holds[0]))
        return dropped

    def chain(self, dropped: list[bool]) -> list[int]:
        """The containers that hold the article, from the root down while one child holds most of what is below."""
        w = self.sums(dropped)
        if w[0] <= 0:
            return []
        heavy = [0] * len(w)
        for i in range(len(w) - 1, 0, -1):
            k = heavy[self.parent[i]]
            if not k or w[i] >= w[k]:
                heavy[self.parent[i]] = i
        out, i = [0], 0
        while (k := heavy[i]) and w[k] >= HEAVY * w[i]:
            i = k
            if self.tag[i] in CONTAINER:
                out.append(i)
        return out

    def best(self, dropped: list[bool], chain: list[int]) -> int:
        """Index in the chain of the container that is the article: the outermost article element; else the outermost one
        with a heading or a share of the text of its own, that is, not in containers below it; else the tightest."""
        for k, i in enumerate(chain):
            if self.tag[i] == "article":
                return k
        at, own, heading, total = {i: k for k, i in enumerate(chain)}, [0.0] * len(chain), [False] * len(chain), 0.0
        near = list(range(len(self.tag)))
        for i in range(1, len(near)):
            near[i] = i if self.tag[i] in CONTAINER else near[self.parent[i]]
        for node, s, linked in self.blocks:
            if not dropped[node]:
                gain = max(0.0, len(s) - 2.0 * linked)
                total += gain
                k = at.get(near[node])
                if k is not None:
                    own[k] += gain
                    heading[k] |= self.tag[node] in ("h1", "h2") and gain > 0
        for k, i in enumerate(chain):
            if heading[k] or own[k] >= (0.02 if self.tag[i] not in ("html", "body") else 0.1) * total:
                return k
        return len(chain) - 1

    def scored(self) -> tuple[list[bool], list[tuple[int, float]]]:
        """(boilerplate, containers of the article with their scores, the best first)."""
        dropped = self.boilerplate()
        chain = self.chain(dropped)
        if chain and HEADER in self.hint and self.tag[chain[-1]] not in ("html", "body"):
            dropped = self.boilerplate(chain[-1])
            chain = self.chain(dropped)
        if not chain:
            return dropped, []
        k, w = self.best(dropped, chain), self.sums(dropped)
        order = sorted(range(len(chain)), key=lambda j: (abs(j - k), -j))
        return dropped, [(chain[j], math.log1p(w[chain[j]]) * 0.5 ** abs(j - k)) for j in order]

    def below(self, hits: list[bool], dropped: list[bool]) -> str:
        """The kept blocks below the elements that are hits."""
        for i in range(1, len(hits)):
            hits[i] = hits[i] or hits[self.parent[i]]
        return "\n".join(s for node, s, _ in self.blocks if hits[node] and not dropped[node])


def votes(html: str | None) -> list[tuple[int, float]]:
    page = Page(html)
    return [(page.path[i], s) for i, s in page.scored()[1]]


def extract(html: str | None, path: int | None) -> str:
    """The blocks below the containers of this path, or below the page's own best one."""
    page = Page(html)
    dropped, found = page.scored()
    if not found:
        return ""
    out = page.below([t in CONTAINER and p == path for t, p in zip(page.tag, page.path)], dropped) if path is not None else ""
    return out or page.below([i == found[0][0] for i in range(len(page.tag))], dropped)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path (a hash of its keys) with most votes on each host; ties go to the smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows: dict[tuple[str, int], float] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p, s in votes(html):
                    rows[host, p] = rows.get((host, p), 0.0) + s
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.int64()), pa.array([round(s, 3) for s in rows.values()], pa.float64())],
                ["host", "path", "score"],
            )

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path long, score double")
    sums = cast.groupBy("host", "path").agg(F.sum(F.col("score").cast("decimal(28,3)")).alias("score"))  # exact: any order of adding
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("m")).select("host", F.col("m.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages; other columns aren't read.

    Null or empty html, and pages without article text, give an empty text. Null urls share
    the empty host. Repeated rows are extracted each, rows of null page_id too. Ties of votes go to the smaller
    path, ties of weight to the first element. Pages of any length are parsed whole, in time linear in it.
    """
    winners = joinable(host_paths(pages), "host-paths")
    own = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = [extract(h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return own.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
