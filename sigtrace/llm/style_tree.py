"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree whose nodes are element paths (tags with their
classes).  Every page votes once at each node with two values: the sequences of its children's
tags (presentation) and its text (content) there.  The importance of a node is the larger
normalised entropy of the two over the host's pages: a menu or notice that is alike on all
pages has little, an article much.  Votes are counted by (host, path, value) with map-side
combine, so no host is gathered anywhere; the low nodes of a host are one small row, joined to
its pages by host (Spark broadcasts it where its size allows).

From each page the branches of low importance at a node seen on ``MIN_PAGES`` pages or more are
removed, whatever their tag.  Headings and the parts of lists and tables stay with the varied
branch they stand in (below ``body``, where every branch stands), inline elements with their
block.  Where ``html`` or ``body`` is low itself, the pages are copies and the tree tells nothing.
Name lists decide what the tree cannot: ``NOISE_TAGS`` and hidden elements are removed; a word of
``NOISE_WORDS`` in a class, id or role, or a form, removes what it holds except ``article`` and
``main`` and branches whose content varies, if these have no such name of their own.  Where a page
has ``article`` or ``main`` elements that are not low, only they count as page text; low ones
(copies of an article are still articles) are kept where less than them would be left.

Cases: null or empty html gives an empty text; a null url is a host of its own name; broken
markup is read as far as it goes; repeated rows each get a row and count as pages of their
host; very long pages are worked on whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.llm.common import text_groups, written

MIN_PAGES = 5
LOW = 0.3

_TOKEN = re.compile(
    r"<!--.*?(?:--\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template svg iframe object select".split())
NOISE_TAGS = frozenset("head nav footer aside button script style noscript template svg iframe object select textarea dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul br option summary caption".split()
)
#: Low only directly in ``body``: elsewhere they stay with the branch they stand in.
HELD = frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption".split())
#: Parts of a sentence: they have no node of their own.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var".split()
)
MAIN = frozenset(("article", "main"))
#: Words in a class, id or role that name noise.
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dropdown "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related reply replies "
    "responses share sharing sidebar signup social sponsor sponsored subscribe toolbar widget alert complementary contentinfo search login".split()
)
#: Elements that an opening tag ends when they are on top.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def path_id(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Element:
    __slots__ = ("tag", "path", "children", "text", "noise", "named", "main", "copy")

    def __init__(self, tag: str, path: str, noise: bool, named: bool, main: bool, copy: bool):
        self.tag, self.path, self.noise, self.named, self.main, self.copy = tag, path, noise, named, main, copy
        self.children: list[str] = []
        self.text: list[str] = []


def _attributes(rest: str) -> tuple[str, bool, bool]:
    """The class part of a node's path, whether an attribute names noise, and whether one hides the element."""
    classes, named, hidden = "", False, False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        else:
            if name == "class":
                classes = "." + ".".join(sorted(value.split()))
            named |= not NOISE_WORDS.isdisjoint(_NAME.findall(value))
    return classes, named, hidden


class Page:
    """One pass over a page: its blocks of text, and what it shows at each node.

    ``low`` has the nodes of low importance, ``varied`` those below a name whose content varies.
    """

    def __init__(self, html: str, low: frozenset[int] = frozenset(), varied: frozenset[int] = frozenset(), votes: bool = False):
        self.blocks: list[str] = []  # text of the page in order, " " where a block ends
        self.main_blocks: list[str] = []
        self.copies: list[str] = []  # text of low articles
        self.whole: list[str] = []  # blocks and copies
        self.has_main = False
        self.shown: dict[int, tuple[list[str], list[str]]] = {}
        self.below_name: set[int] = set()
        self._read(html, low, varied, votes)

    def votes(self) -> Iterator[tuple[int, bool, int, int]]:
        """(path, below a name, kind, value) of the page's one vote of each kind at each node."""
        for at, values in self.shown.items():
            for kind, value in enumerate(values):
                yield at, at in self.below_name, kind, path_id("\0".join(value))

    def _read(self, html: str, low: frozenset[int], varied: frozenset[int], votes: bool) -> None:
        root = Element("", "", False, False, False, False)
        stack = [root]
        ids: dict[str, int] = {}

        def node(path: str) -> int:
            if path not in ids:
                ids[path] = path_id(path)
            return ids[path]

        def close() -> None:
            e = stack.pop()
            if votes and not e.noise and e.tag not in INLINE:
                text = " ".join("".join(e.text).split())
                if text:
                    at = node(e.path)
                    tags, texts = self.shown.setdefault(at, ([], []))
                    tags.append(" ".join(e.children)), texts.append(text)
                    if stack[-1].named:
                        self.below_name.add(at)
                    stack[-1].text += (" ", text, " ") if e.tag in BLOCKS else (text,)
            elif votes and not e.noise:
                stack[-1].text += e.text
            if e.tag in BLOCKS:
                self._write(e, " ")

        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            if not m:
                self._text(stack[-1], html[at:], votes)
                break
            if m.start() > at:
                self._text(stack[-1], html[at : m.start()], votes)
            at = m.end()
            tag = m["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"]:
                if any(e.tag == tag for e in stack):
                    while stack[-1].tag != tag:
                        close()
                    close()
                elif tag in BLOCKS:
                    self._write(stack[-1], " ")
                continue
            if tag in BLOCKS:
                if tag not in VOID and stack[-1].tag == "p":
                    close()
                while stack[-1].tag in _ENDS.get(tag, ()):
                    close()
                self._write(stack[-1], " ")
                if votes:
                    stack[-1].text.append(" ")
            top = stack[-1]
            top.children.append(tag)
            if tag in VOID or m["rest"].endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(html, at)
                at = end.start() if end else size
                stop = html.find(">", at)
                at = stop + 1 if stop >= 0 else size
                continue
            classes, named, hidden = _attributes(m["rest"])
            path = f"{top.path}/{tag}{classes}"
            inner, page = tag in MAIN, tag in ("html", "body")
            named |= tag == "form"
            noise = not (page or inner) and (hidden or tag in NOISE_TAGS or (tag == "header" and not top.main))
            copy = top.copy
            if low and not copy and node(path) in low:
                if page:
                    low = frozenset()
                elif inner:
                    copy = True
                elif tag not in HELD or top.tag in ("", "html", "body"):
                    noise = True
            if page or (inner and not top.named):
                named = top.named
            elif top.named and not named:
                named = not (inner or (varied and node(path) in varied))
            e = Element(tag, path, top.noise or noise, named, top.main or inner, copy)
            self.has_main |= inner and not (e.noise or named or copy)
            stack.append(e)
        while len(stack) > 1:
            close()

    def _write(self, e: Element, text: str) -> None:
        if e.noise or e.named:
            return
        self.whole.append(text)
        if e.copy:
            self.copies.append(text)
        else:
            self.blocks.append(text)
            if e.main:
                self.main_blocks.append(text)

    def _text(self, e: Element, raw: str, votes: bool) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._write(e, text)
        if votes:
            e.text.append(text)

    def text(self) -> str:
        if self.has_main:
            return _joined(self.main_blocks)
        rest = _joined(self.blocks)
        return _joined(self.whole) if len(_joined(self.copies)) > len(rest) else rest


def _joined(blocks: list[str]) -> str:
    return " ".join("".join(blocks).split())


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)", 1))


def importance(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, below_name, pages, importance, variety) of every node; variety is the entropy of its content alone."""

    def voted(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_groups(batches):
            row, path, below, kind, value = [], [], [], [], []
            for i, t in enumerate(texts):
                for p, n, k, v in Page(t, votes=True).votes():
                    row.append(i), path.append(p), below.append(n), kind.append(k), value.append(v)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), pa.array(path, pa.int64()), pa.array(below, pa.bool_()), pa.array(kind, pa.int32()), pa.array(value, pa.int64())], ["host", "path", "below", "kind", "value"])

    rows = pages.select(_host(F.col(url)).alias("host"), F.col(html).cast("string").alias("h"))
    votes = rows.mapInArrow(voted, "host string, path long, below boolean, kind int, value long")
    counts = votes.groupBy("host", "path", "kind", "value").agg(F.count("*").cast("double").alias("n"), F.max("below").alias("below"))
    nodes = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max("below").alias("below"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    return nodes.groupBy("host", "path").agg(
        F.max("below").alias("below_name"), F.max("m").alias("pages"), F.max(entropy).alias("importance"), F.max(F.when(F.col("kind") == 1, entropy)).alias("variety")
    )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """(page_id, url, text) of every page."""
    poor, rich = F.col("importance") < low, F.col("below_name") & (F.col("variety") >= low)
    nodes = importance(pages, url, html).where((F.col("pages") >= min_pages) & (poor | rich))
    held = nodes.groupBy("host").agg(F.collect_list(F.when(poor, F.col("path"))).alias("low"), F.collect_list(F.when(rich, F.col("path"))).alias("varied"))
    by_host = written(held, "style-tree-low")

    def extracted(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_groups(batches, 4):
            out = []
            for t, poor, rich in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                varied = frozenset(rich or ())
                text = Page(t, frozenset(poor or ()), varied).text()
                # a page of nothing but low nodes shows what its site shows everywhere: then that is its text
                out.append(text or (Page(t, varied=varied).text() if poor else ""))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["p", "u", "text"])

    rows = pages.select(F.col(page_id).alias("p"), F.col(url).alias("u"), _host(F.col(url)).alias("host"), F.col(html).cast("string").alias("h"))
    joined = rows.join(by_host, "host", "left").select("p", "u", "low", "varied", "h")
    kinds = dict(rows.dtypes)
    return joined.mapInArrow(extracted, f"p {kinds['p']}, u {kinds['u']}, text string").withColumnsRenamed({"p": "page_id", "u": "url"})
