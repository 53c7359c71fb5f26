"""Main texts of web pages by consensus of a host's pages.

A page is read into nested elements, of which some are clutter by their tag, class or role: menus, adverts, forms, comments
by readers. Each element that can hold an article is scored by the characters of its sentences, clutter and lists of links
left out. From the body the text is followed inwards, to the landmark that holds most of it and on to the one child
that does, while nothing but other containers is left behind; a container that is wider by one level has half the score. An element
is named by its generalised path, tags with their classes from the body down, digits written as one sign. Pages vote for
their paths, each with the share of its best score; votes are summed for each host by Spark, before they are shuffled. Then
every page is read again and what lies under its host's winning path is its main text, so that a page whose boilerplate is
longer than its article is read as its host's others are. A page without that path is taken by its own best element.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parchment.llm.common import hot_keys, spread_join

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video head title".split())
#: Of these everything up to the closing tag is raw, tags too.
OPAQUE = frozenset("script style title textarea iframe noscript".split())
#: Elements that never belong to an article.
CLUTTERED = frozenset("nav footer aside form button select textarea dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that can hold an article.
CONTAINER = frozenset("body article main section div td center".split())
#: An opening tag on the left ends the open elements on the right, up to the nearest one of the third set.
LIST, ROW = frozenset(["ul", "ol", "menu"]), frozenset(["tr", "table"])
ENDS = {"li": (frozenset(["li"]), LIST), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), ROW), "th": (frozenset(["td", "th"]), ROW), "option": (frozenset(["option"]), frozenset(["select"]))}
#: Words in an element's class or id that make it clutter.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored promo promotion banner cookie cookies cookiebar consent gdpr notice notices notification alert popup modal overlay toast paywall newsletter subscribe subscription signup login social share sharing sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar footer copyright comment comments commentlist disqus replies respond related recommended recommendations trending skip".split()
)
#: The same for elements that are clutter outside an article only.
HEADS = frozenset(["header", "masthead"])
#: The same for an article or main element itself.
LESSER = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended teaser".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert tablist".split())
LANDMARK = frozenset(["main", "article"])
#: Share of a container's characters that its child, or a landmark in it, must have to be the narrower place of its text.
MOST = 0.5
#: What a page's best path gets as a vote; others get their share of it.
VOTE = 1000
#: Levels after which paths grow no more.
DEEP = 256
#: What may stand in a head.
HEAD = frozenset("meta link base title style script noscript template".split())

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"[0-9]+")


class Element:
    """One element: tag, generalised path, and its text parts and elements in order."""

    __slots__ = ("tag", "path", "parts", "clutter", "head", "landmark", "chars", "own", "linked")

    def __init__(self, tag: str, path: str, clutter: bool, head: bool = False):
        self.tag, self.path, self.clutter, self.head = tag, path, clutter, head
        self.parts: list[str | Element] = []
        self.landmark = False
        self.chars = self.own = self.linked = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _is_clutter(tag: str, a: dict[str, str]) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in CLUTTERED or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return not _words(a).isdisjoint(LESSER if tag in LANDMARK else WORDS)


def _words(a: dict[str, str]) -> set[str]:
    return {w.lower() for w in _TOKEN.findall(f"{a.get('class', '')} {a.get('id', '')}")}


def _closing(page: str, lower: str, tag: str, at: int) -> int:
    """Where the closing tag of raw content that starts at `at` ends."""
    while True:
        at = lower.find(f"</{tag}", at)
        if at < 0:
            return len(page)
        at += len(tag) + 2
        if at >= len(page) or not (page[at].isalnum() or page[at] == "-"):
            stop = page.find(">", at)
            return len(page) if stop < 0 else stop + 1


def parse(page: str) -> Element:
    """The page's elements. Tags that are missing, doubled or crossed are put right as browsers do, more simply."""
    root = Element("html", "", False)
    stack = [root]
    lower = page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), page)
    at, last = 0, page.rfind(">")

    def close(k: int) -> None:
        del stack[k:]

    def say(text: str) -> None:
        if text:
            stack[-1].parts.append(html.unescape(text))

    while at < len(page):
        m = _TAG.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag == "html":
            continue
        if tag not in HEAD and len(stack) > 1 and stack[1].tag == "head":
            close(1)
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in ENDS:
            ended, within = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    close(k)
                    break
                if stack[k].tag in within or stack[k].tag in CONTAINER:
                    break
        if tag == "body" and any(e.tag == "body" for e in stack):
            continue
        a = _attributes(rest)
        top = stack[-1]
        step = ".".join([tag, *sorted(set(_DIGITS.sub("#", a.get("class", "")).split()))])
        path = top.path if len(stack) > DEEP else f"{top.path}>{step}" if top.path else step
        e = Element(tag, path, tag in RAW or _is_clutter(tag, a), tag == "header" or tag not in ("html", "body", *LANDMARK) and not _words(a).isdisjoint(HEADS))
        top.parts.append(e)
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        if tag in OPAQUE:
            at = _closing(page, lower, tag, at)
            continue
        stack.append(e)
    return root


def _walk(root: Element) -> list[tuple[Element, Element | None]]:
    """All elements with their parents, parents first, without recursion."""
    out, todo = [], [(root, None)]
    while todo:
        e, parent = todo.pop()
        out.append((e, parent))
        todo.extend((p, e) for p in reversed(e.parts) if isinstance(p, Element))
    return out


def measure(root: Element) -> list[tuple[Element, Element | None]]:
    """Fills in chars (of sentences), own (of these, outside other containers) and linked (of links) of all elements.

    A main element, or an article that holds most of all articles' text, is a landmark: what holds one isn't clutter, unless
    its tag says so. Headers are clutter outside main and article elements.
    """
    every = _walk(root)
    size = {id(e): 0 for e, _ in every}
    for e, parent in reversed(every):
        size[id(e)] += 0 if e.tag in RAW else sum(len(p) for p in e.parts if isinstance(p, str))
        if parent is not None:
            size[id(parent)] += size[id(e)]
    articles = [e for e, _ in every if e.tag == "article" and not e.clutter]
    total = max((size[id(e)] for e in articles), default=0)
    inside: set[int] = set()
    for e, parent in every:
        if parent is not None and (id(parent) in inside or parent.tag in LANDMARK):
            inside.add(id(e))
        e.landmark = not e.clutter and (e.tag == "main" or e.tag == "article" and size[id(e)] == total)
    for e, parent in reversed(every):
        if e.landmark and parent is not None:
            parent.landmark = True
        if e.head and id(e) not in inside:
            e.clutter = True
        if e.landmark and (e.tag == "form" or e.tag not in CLUTTERED and e.tag not in RAW):
            e.clutter = False
    for e, parent in reversed(every):
        if e.tag not in RAW:
            found = sum(len(p.strip()) for p in e.parts if isinstance(p, str))
            e.chars, e.own = e.chars + found, e.own + found
        if e.tag == "a":
            e.linked = e.chars
        if e.clutter or e.tag in ("ul", "ol", "li", "div", "p", "td") and 2 * e.linked > e.chars:
            e.chars = e.own = e.linked = 0
        if parent is not None and parent.tag not in RAW:
            parent.chars += e.chars
            parent.linked += e.linked
            if e.tag not in CONTAINER:
                parent.own += e.own
    return every


def _inside(e: Element) -> list[Element]:
    """The nearest containers below an element, outside clutter, in page order."""
    out, todo = [], [p for p in reversed(e.parts) if isinstance(p, Element)]
    while todo:
        x = todo.pop()
        if x.clutter:
            continue
        if x.tag in CONTAINER:
            out.append(x)
        else:
            todo.extend(p for p in reversed(x.parts) if isinstance(p, Element))
    return out


def _titled(e: Element) -> bool:
    todo = [e]
    while todo:
        x = todo.pop()
        if x.tag == "h1":
            return True
        todo.extend(p for p in x.parts if isinstance(p, Element))
    return False


def scores(every: list[tuple[Element, Element | None]]) -> dict[str, float]:
    """The score of each path on the way from the body to the place of the page's text; none on a page without text."""
    at = every[0][0]
    way = [at] if at.chars else []
    landmarks = [e for e, _ in every if e.landmark and e.tag in LANDMARK and e.chars]
    while way:
        inner = [e for e in _inside(at) if e.chars]
        mark = next((e for e in inner if e.landmark and e.chars >= MOST * at.chars), None) if landmarks else None
        if mark is None:
            if at.tag == "article" and at.landmark or at.own or not inner:
                break
            mark = max(inner, key=lambda e: e.chars)
            if mark.chars < MOST * at.chars or any(_titled(e) for e in inner if e is not mark):
                break
        at = mark
        way.append(at)
    return {e.path: e.chars * 0.5 ** (len(way) - 1 - k) for k, e in enumerate(way) if e.path}


def best_path(of: dict[str, float]) -> str | None:
    """The path with the highest score; of equal ones the longest, then the first by letters."""
    return min(of, key=lambda p: (-of[p], -p.count(">"), p)) if of else None


def _found(root: Element, path: str | None) -> list[Element]:
    """The outermost elements of a path outside clutter, in page order."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.clutter:
            continue
        if e.path == path:
            out.append(e)
        else:
            todo.extend(p for p in reversed(e.parts) if isinstance(p, Element))
    return out


def blocks(e: Element) -> list[str]:
    """The texts of an element's blocks in page order, clutter left out, white space inside them as one space."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    todo: list = [iter(e.parts)]
    within = [True]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
            if within.pop():
                end()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        else:
            block = part.tag in BLOCK
            if block:
                end()
            if not part.clutter and part.tag not in RAW:
                todo.append(iter(part.parts))
                within.append(block)
    return out


def main_text(page: str | None, path: str | None) -> str:
    """The main text under a path; where the page has none there, under its own best path, else its body's."""
    root = parse(page or "")
    every = measure(root)
    found = _found(root, path) if path else []
    text = "\n\n".join(b for e in found for b in blocks(e))
    if not text:
        own = best_path(scores(every))
        text = "\n\n".join(b for e in (_found(root, own) if own else [root]) for b in blocks(e))
    return text


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths, shares = [], [], []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            of = scores(measure(parse(page)))
            most = max(of.values(), default=0)
            for path, score in of.items():
                hosts.append(host)
                paths.append(path)
                shares.append(int(VOTE * score / most))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.int64())], names=["host", "path", "votes"])


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path): the path that most of a host's pages vote for; of equal ones the longer, then the first by letters.

    pages: (host, html). Hosts whose pages have no text to vote with are not there.
    """
    votes = pages.filter("host <> '' and html is not null").select("host", "html").mapInArrow(_votes, "host string, path string, votes long")
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    depth = F.length("path") - F.length(F.replace("path", F.lit(">"), F.lit("")))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -depth, "path")).alias("path"))


def host_of(url):
    """The host of a URL: after the first "://" up to "/", "?", "#" or the end, lower-cased; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame, url: str = "url", page: str = "html", text: str = "text", path: str = "path") -> DataFrame:
    """pages with `text`, their main text, and `path`, that of their host's consensus.

    Pages without a host, and those of a host without a vote, are judged alone (path null). Null, empty and broken pages have
    an empty text; pages of any length are read whole. Repeated rows are judged alike, ids don't count, and other columns are
    handed on, but for old ones called text and path. An empty table gives an empty one.
    """
    rows = pages.drop(text, path).select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"))
    given = rows.select("host", F.col("row")[page].cast("string").alias("html"))
    # Pages of one host are dealt over several tasks. Each host, also one without votes, has a row to be joined with.
    counts = given.groupBy("host").agg(F.count("*").alias("n"))
    paths = counts.select("host").join(consensus(given), "host", "left")
    joined = spread_join(rows, paths, "host", hot_keys(counts, "host"), ["row"]).select("row.*", F.col("path").alias(path))
    at, under = joined.columns.index(page), joined.columns.index(path)

    def read(batches):
        for b in batches:
            found = [main_text(p, w) for p, w in zip(b.column(at).to_pylist(), b.column(under).to_pylist(), strict=True)]
            yield b.append_column(text, pa.array(found, pa.string()))

    return joined.mapInArrow(read, StructType([*joined.schema, StructField(text, StringType())]))
