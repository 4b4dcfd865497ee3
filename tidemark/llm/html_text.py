"""Main text of web pages by consensus of each host's pages.

Every page scores its containers by the running text they hold; Spark adds the scores up per host and
generalised path of tags and classes (without digits), and the host's best path wins. Pages are then
extracted again from the containers on the winning path; a page without one uses its own best container.
These are lifted to the article or main around them, or to containers that have text of their own beside them.

What is not article is known by its element or by the words of its classes, id and role. Such an element is
taken for a frame of the page, and kept, if it holds most of the running text: where all else is less than a
paragraph and none of it is of an article element, or, for a form or an element that also has an article's class,
more than half. Class names that
tell a state ("has-sidebar", "no-comments", "ad-free") say nothing about an element.

Defined cases: null html is empty and gives an empty text; a null url is the host ''; a page without
running text gives an empty text; an attribute's quote that is never closed ends with its tag; markup cut
off at the end of the page is left out; ties between paths go to the smaller hash; repeated rows and null ids
are extracted each and vote each; an empty table gives an empty result. Other columns are not read. Time is
linear in a page's length and depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import BROADCAST_ROWS, Scratch

# Element names of HTML, and common class and id words of what is not an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: These run to their end tag or the end of the page; of SKIPPED, which close with what holds them, nothing is read.
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("noscript template svg iframe object select".split())
#: Elements that do not end an open head.
IN_HEAD = frozenset("base head html link meta noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div td body blockquote".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("nav footer button menu head dialog".split())
BAD = frozenset(
    "ad ads adv advert advertisement advertising adbox sponsor sponsored promo promotion comment comments disqus reply replies respond sidebar share sharing social related recommended cookie cookies consent gdpr popup modal newsletter subscribe breadcrumb breadcrumbs pagination pager complementary".split()
)
DOUBTFUL = frozenset("header masthead footer nav navbar navigation menu menubar banner notice notices alert widget toolbar login search topbar copyright contentinfo tags meta skip".split())
GOOD = frozenset("article content post entry story main body text".split())
#: With one of these a class name tells a state or a setting.
STATE = frozenset("allow allowed closed disabled enabled free has hide is no non not off on open show with without".split())

#: How surely an element is not article; a WEAK one is a frame if it holds half of the running text, a STRONG one if
#: it holds nine tenths and all else is less than a paragraph of so many code points.
WEAK, STRONG, HARD = 1, 2, 3
PARAGRAPH = 140
#: Parts of a host's pages where winning paths are too many to be broadcast.
SALTS = 64
#: What a block gives to the container it lies in, and how much less to each one above; below LEAST no more.
FADE, LEAST = 0.6, 1e-3

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_OPENS = re.compile(r"<[a-zA-Z!/?]")
_QUOTE = re.compile(r"=\s*[\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


def _tokens(html: str) -> Iterator[tuple[str, str, str, bool]]:
    """Text, then the tag after it, its attributes and whether it is an end tag; the last has no tag."""
    at = start = 0
    last, broken, find = html.rfind(">"), False, html.find
    while 0 <= (i := find("<", at)) <= last:
        end_tag = html.startswith("/", i + 1)
        if m := _NAME.match(html, i + 1 + end_tag):
            stop, broken = _tag_end(html, m.end(), broken)
            tag = m[0].lower()
            yield html[start:i], tag, html[m.end() : stop - 1], end_tag
            if tag in RAW and not end_tag:
                close = _ENDS[tag].search(html, stop)
                stop = close.end() if close else len(html)
        elif html.startswith("!--", i + 1):
            yield html[start:i], "", "", False
            stop = find("-->", i + 2)
            stop = stop + 3 if stop >= 0 else len(html)
        elif html[i + 1 : i + 2] in ("!", "?", "/"):
            yield html[start:i], "", "", False
            stop = find(">", i) + 1
        else:
            at = i + 1
            continue
        at = start = stop
    cut = _OPENS.search(html, start)
    yield html[start : cut.start() if cut else len(html)], "", "", False


def _tag_end(html: str, at: int, broken: bool) -> tuple[int, bool]:
    """Behind the tag's >, outside of quotes; if quotes do not close, once for all they are not looked at any more."""
    first = gt = html.find(">", at)
    quote = None if broken or gt < 0 else _QUOTE.search(html, at, gt)
    while quote:
        close = html.find(html[quote.end() - 1], quote.end())
        gt = html.find(">", close + 1) if close >= 0 else -1
        if gt < 0:
            return first + 1, True
        quote = _QUOTE.search(html, close + 1, gt)
    return (gt + 1 if gt >= 0 else len(html)), broken


class Node:
    """An open or closed element that is a block, or flagged as not article."""

    __slots__ = ("article", "box", "direct", "guard", "hard", "head", "held", "high", "key", "low", "out", "outer", "p", "parent", "scope", "score", "select", "strength", "tag")

    def __init__(self, tag: str, name: str, strength: int, parent: Node | None) -> None:
        container = tag in CONTAINER or parent is None
        self.tag, self.parent, self.strength = tag, parent, strength
        self.key = xxhash.xxh3_64_intdigest(name, seed=parent.key) if container and parent else parent.key if parent else 0
        self.box = self if container else parent.box
        self.hard = strength == HARD or bool(parent and parent.hard)
        self.outer = parent.guard if parent else None  # the flagged element around it
        self.guard = self if strength in (WEAK, STRONG) else self.outer
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.p = self if tag == "p" else None if container else parent.p
        self.head = self if tag == "head" else parent and parent.head
        self.select = self if tag == "select" else parent and parent.select
        self.out, self.scope, self.held = False, 0.0, 0.0
        self.score, self.direct, self.low, self.high = 0.0, 0.0, -1, -1


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attrs)} if attrs else {}


def _strength(tag: str, attrs: dict[str, str], parent: Node) -> int:
    if tag in NEVER or tag in SKIPPED:
        return HARD
    out = STRONG if tag == "aside" or tag == "header" and not parent.article else WEAK if tag == "form" else 0
    if not attrs or tag in ("html", "body"):
        return out
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(attrs.get("style", "")):
        return max(out, STRONG)
    bad = doubtful = good = False
    for token in " ".join(attrs[k] for k in ("class", "id", "role") if k in attrs).split():
        words = {w.lower() for w in _WORD.findall(token)}
        if words & STATE:
            continue
        bad |= not words.isdisjoint(BAD)
        doubtful |= not words.isdisjoint(DOUBTFUL)
        good |= not words.isdisjoint(GOOD) and words.isdisjoint(BAD)
    return max(out, (WEAK if good else STRONG) if bad else STRONG if doubtful and not good else 0)


def _name(tag: str, attrs: dict[str, str]) -> str:
    """Tag and classes, digits left out, classes in order."""
    classes = {c for x in attrs.get("class", "").split() if (c := re.sub(r"\d+", "", x).strip("-_"))}
    return ".".join([tag, *sorted(classes)])


def _clean(raw: str) -> str:
    return " ".join(unescape(raw).split())


class Page:
    """Blocks of running text and the containers that hold them."""

    def __init__(self, html: str) -> None:
        self.root = node = Node("html", "html", 0, None)
        self.nodes, self.flagged, self._blocks = [node], [], []  # in the order of their beginning
        self._text: list[tuple[str, Node | None]] = []
        self._links = anchor = 0
        self._marked = False  # an article or main has text of its own
        opened: dict[str, int] = {}  # open elements of each name
        ends: dict[str, int] = {}  # last end tag of each skipped element

        def up_to(stop: Node) -> Node:
            at = node
            while at is not stop:
                opened[at.tag] -= 1
                at = at.parent
            return stop

        for text, tag, attrs, is_end in _tokens(html):
            if text:
                if node.tag == "head" and not text.isspace():
                    node = up_to(node.parent)
                if not node.hard:
                    self._text.append((text, node.guard))
                    if anchor:
                        self._links += len(text)
            if not tag:
                continue
            if tag in BLOCK:
                self._close(node)
            elif tag == "br":
                self._text.append((" ", node.guard))
            if is_end:
                if tag == "a":
                    anchor = max(0, anchor - 1)
                if opened.get(tag):
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    node = up_to(up.parent)
                continue
            if node.head and (node.tag == "head" and tag not in IN_HEAD or tag == "body"):
                node = up_to(node.head.parent)
            if tag in VOID or tag in RAW or tag == "html":
                continue
            if tag in SKIPPED and tag != "select":  # a select ends where a block begins
                if tag not in ends:
                    ends[tag] = max((e.start() for e in re.finditer(rf"</{tag}\b", html, re.I)), default=-1)
                if ends[tag] < 0 or attrs.endswith("/"):  # never closed
                    continue
            elif tag in BLOCK and tag != "hr" and node.select and node.tag in ("select", "option", "optgroup"):
                node = up_to(node.select.parent)
            if tag == "a":
                anchor += 1
            if tag in ENDS_P and node.p:
                node = up_to(node.p.parent)
            if attrs.endswith("/") and tag not in BLOCK:
                continue
            held = _attributes(attrs)
            strength = _strength(tag, held, node)
            if tag in BLOCK or strength:
                node = Node(tag, _name(tag, held) if tag in CONTAINER else "", strength, node)
                opened[tag] = opened.get(tag, 0) + 1
                if node.box is node:
                    self.nodes.append(node)
                if node.guard is node:
                    self.flagged.append(node)
        self._close(node)
        self._resolve()

    def _close(self, node: Node) -> None:
        if self._text:
            parts: list[list] = []
            for raw, guard in self._text:
                if parts and parts[-1][0] is guard:
                    parts[-1][1].append(raw)
                else:
                    parts.append([guard, [raw]])
            if node.article and node.guard is None and node.tag not in HEADINGS:
                self._marked = self._marked or any(raw.strip() for _, own in parts for raw in own)
            self._blocks.append((node.box, [(guard, "".join(raw)) for guard, raw in parts], self._links))
            self._links, self._text = 0, []

    def _resolve(self) -> None:
        """Tell frames from what is not article, then texts and scores of what is left."""
        total = 0.0
        for _, parts, links in self._blocks:
            text = sum(len(raw) for _, raw in parts)
            for guard, raw in parts:
                worth = len(raw.strip()) * max(0.0, 1 - 2 * links / max(text, 1))
                total += worth
                if guard:
                    guard.held += worth
        beside = total - sum(f.held for f in self.flagged)
        for f in reversed(self.flagged):
            if f.outer:
                f.outer.held += f.held
        for f in self.flagged:
            scope = f.outer.scope if f.outer else total
            most = f.held > 0.5 * scope if f.strength == WEAK else f.held > 0.9 * scope and beside < PARAGRAPH and not self._marked
            f.out = bool(f.outer and f.outer.out) or not most
            f.scope = f.held
        self.blocks: list[str] = []
        for box, parts, links in self._blocks:
            text = _clean("".join(raw for guard, raw in parts if not (guard and guard.out)))
            if not text:
                continue
            worth, share, up = max(0.0, len(text) - 2.0 * links), 1.0, box
            box.direct += worth
            while up is not None and share > LEAST:
                up.score += worth * share * (1.25 if up.tag in ("article", "main") else 1.0)
                share *= FADE
                up = up.parent and up.parent.box
            if box.low < 0:
                box.low = len(self.blocks)
            box.high = len(self.blocks)
            self.blocks.append(text)
        for n in reversed(self.nodes):
            if n.parent and n.low >= 0:
                up = n.parent.box
                up.low, up.high = n.low if up.low < 0 else min(up.low, n.low), max(up.high, n.high)

    def votes(self) -> list[tuple[int, int]]:
        """Each path's millionths of the page's score."""
        total = sum(n.score for n in self.nodes)
        held: dict[int, float] = {}
        for n in self.nodes:
            if n.score > 0:
                held[n.key] = held.get(n.key, 0.0) + n.score
        return [(k, round(1e6 * v / total)) for k, v in held.items()]

    def _around(self, parent: Node | None) -> tuple[Node | None, Node | None, list[Node]]:
        """Above a container: the article; else the outermost main, or container with text of its own; and its frames."""
        best, frames = None, []
        while parent is not None:
            if parent.tag == "article":
                return parent, None, []
            if parent.tag == "body" or parent.parent is None:
                frames.append(parent)
            elif parent.tag == "main" or parent.tag in CONTAINER and parent.direct > 0:
                best = parent
            parent = parent.parent
        return None, best, frames

    def _lifted(self, node: Node, known: dict) -> Node:
        """The article or main around a container, else the outermost container that has text of its own
        beside it. The body, which frames the page, counts only if its own text outweighs the container's."""
        if node.parent not in known:
            known[node.parent] = self._around(node.parent)
        article, best, frames = known[node.parent]
        if article:
            return article
        best = best or node
        for frame in frames:
            if frame.direct > best.score:
                best = frame
        return best

    def text(self, key: int | None) -> str:
        chosen = [n for n in self.nodes if n.key == key and n.low >= 0] if key is not None else []
        if not sum(n.score for n in chosen):
            best = max(self.nodes, key=lambda n: n.score)
            chosen = [best] if best.low >= 0 else []
        known: dict = {}
        out: list[str] = []
        at = 0
        for low, high in sorted({(n.low, n.high) for n in (self._lifted(n, known) for n in chosen)}):
            out += self.blocks[max(low, at) : high + 1]
            at = max(at, high + 1)
        return "\n".join(out)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


def paths(pages: DataFrame) -> DataFrame:
    """The winning path of every host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[str, int], int] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, share in Page(html or "").votes():
                    path -= (path >> 63) << 64
                    held[host, path] = held.get((host, path), 0) + share
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), pa.array(held.values(), pa.int64())], ["host", "path", "votes"])

    votes = pages.mapInArrow(run, "host string, path long, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    least = votes.groupBy("host").agg(F.max("votes").alias("votes"))
    return votes.join(least, ["host", "votes"]).groupBy("host").agg(F.min("path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of().alias("host"))
    winning = Scratch(pages.sparkSession, "paths").save(paths(rows.select("host", "html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html or "").text(path if path is None else path & (1 << 64) - 1) for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if winning.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(winning), "host", "left")
    else:  # a host's pages are dealt over SALTS tasks
        salted = winning.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return found.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
