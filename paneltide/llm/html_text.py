"""HTML extraction (operator 1) with a site style tree.

1. Every page is parsed into its DOM. A node's *presentation* is its path of tags and
   classes; its *content* is a digest of the text below it.
2. The DOMs of one host are merged: for each (host, path) the tree holds how often each
   content occurs over the host's distinct pages. The same is done over all hosts.
3. The importance of a node is the normalised entropy of its content: near 1 where every
   page says something else, near 0 where pages repeat themselves. It is taken over the
   host and over all sites, and the larger one counts, so a host of few or similar pages
   is judged by how such nodes behave elsewhere (a node seen on fewer than ``MIN_PAGES``
   distinct pages in all has importance 1). Nodes whose presentation names a role
   that is never main text (menus, site headers and footers, sidebars, notices, adverts,
   forms, scripts, styles, reader comments) have importance 0. A class or id names a role
   by its last word, but not after has-, no- and the like, and never for body, main,
   article or an element around them; those are judged by their entropy.
4. Branches of importance below ``threshold`` are removed from each page; what is left is
   the page's text: white space inside a block becomes one blank, blocks are trimmed and
   joined in page order by one line feed, empty ones vanish. Character references are
   decoded.

Only hashes of (host, path, content) are shuffled, combined per task first; a host with a
third of all pages is many such rows, never one group. The removed paths of a host come
back by an equi-join that broadcasts only below the session's size threshold.

Defined cases: null or empty html: empty text. Null url: such pages form one host.
Malformed markup: an unclosed tag ends with its parent, a stray end tag is ignored, a tag
cut off by the end of the page is dropped. Repeated pages count once in the style tree
and are each extracted. Extra columns are ignored by :func:`extract`.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

THRESHOLD = 0.3
MIN_PAGES = 8  # fewer contents than this say nothing about a node

# Elements by role.
NOISE_TAGS = set(
    "head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu".split()
)
RAW_TAGS = set("script style textarea title noscript template iframe".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
MAIN_TAGS = {"article", "main"}
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent notice notices newsletter subscribe signup login share sharing social comment comments disqus related popup modal "
    "overlay widget pagination pager toolbar complementary contentinfo search hidden".split()
)
#: before a role word: the name says what a node has or lacks, not what it is
OTHER_WORDS = set("no non not has have with without".split())
#: elements whose names, and those of the elements around them, give no role
TEXT_TAGS = MAIN_TAGS | {"body"}
#: not main text unless inside the article
OUTER_WORDS = {"header", "masthead", "topbar"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(?=/?[A-Za-z])[^<>]*\Z", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^A-Za-z0-9]+")


def _id(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _role(name: str) -> str:
    """What a class or id says a node is: its last word, or none after has-, no- and the like."""
    words = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
    return words[-1] if words and OTHER_WORDS.isdisjoint(words[:-1]) else ""


class Page:
    """Nodes (parent, path, role) and blocks of text pieces of one page."""

    __slots__ = ("parent", "path", "noise", "blocks")

    def __init__(self, source: str):
        self.parent, self.path, self.noise = [-1], [""], [False]
        self.blocks: list[list[tuple[int, str]]] = []
        stack: list[tuple[str, int]] = [("", 0)]  # open elements: tag, node
        block: list[tuple[int, str]] = []
        main = 0  # open article elements
        by_tag, by_name, text_tag = [False], [False], [False]
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            text = source[at : m.start() if m else n]
            if text:
                block.append((stack[-1][1], html_lib.unescape(text)))
            if m is None:
                break
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            inline = tag in INLINE_TAGS
            if tag == "br":
                block.append((stack[-1][1], " "))
                continue
            if not inline and block:
                self.blocks.append(block)
                block = []
            if m.group(1):  # end tag
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        main -= sum(t in MAIN_TAGS for t, _ in stack[k:])
                        del stack[k:]
                        break
                    if inline and stack[k][0] not in INLINE_TAGS:
                        break
                continue
            if not inline:  # a block element ends an open paragraph, an item the item before
                closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p" or stack[k][0] in closes:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE_TAGS:
                        break
            node = stack[-1][1]
            attrs = m.group(3)
            words: list[str] = []
            roles: set[str] = set()
            if attrs and attrs.strip(" /\n\t"):
                for name, a, b, c in _ATTR.findall(attrs):
                    name = name.lower()
                    if name in ("class", "id", "role"):
                        words += [w for w in _SPLIT.split((a or b or c).lower()) if w and not w.isdigit()]
                        roles.update(_role(x) for x in (a or b or c).lower().split())
                    elif name == "hidden":
                        words.append("hidden")
                        roles.add("hidden")
            if not inline or words:
                style = ".".join([tag, *sorted(set(words))])
                self.parent.append(node)
                self.path.append(f"{self.path[node]}/{style}")
                by_tag.append(tag in NOISE_TAGS or (main == 0 and tag == "header"))
                by_name.append(not NOISE_WORDS.isdisjoint(roles) or (main == 0 and not OUTER_WORDS.isdisjoint(roles)))
                text_tag.append(tag in TEXT_TAGS)
                node = len(self.path) - 1
            if tag in VOID_TAGS:
                continue
            if tag in RAW_TAGS:  # the content is no markup: up to the end tag, as one text
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                stop = end.start() if end else n
                if tag == "title" and source[at:stop].strip():
                    self.blocks.append([(node, html_lib.unescape(source[at:stop]))])
                at = stop
            stack.append((tag, node))
            main += tag in MAIN_TAGS
        if block:
            self.blocks.append(block)
        for k in range(len(text_tag) - 1, 0, -1):  # an element around a text element counts as one
            if text_tag[k]:
                text_tag[self.parent[k]] = True
        for k in range(1, len(self.path)):
            self.noise.append(self.noise[self.parent[k]] or by_tag[k] or (by_name[k] and not text_tag[k]))

    def contents(self) -> dict[tuple[str, bool], str]:
        """Text below each path of the page (all nodes of a path together)."""
        below: dict[int, list[str]] = {}
        for block in self.blocks:
            for node, text in block:
                text = " ".join(text.split())
                while text and node > 0:
                    below.setdefault(node, []).append(text)
                    node = self.parent[node]
        out: dict[tuple[str, bool], list[str]] = {}
        for node in sorted(below):
            out.setdefault((self.path[node], self.noise[node]), []).extend(below[node])
        return {k: "\n".join(v) for k, v in out.items()}

    def text(self, removed: set[int]) -> str:
        """Blocks without the branches whose path ids are removed."""
        gone = [False] * len(self.path)
        ids: dict[str, bool] = {}
        for k in range(1, len(self.path)):
            p = self.path[k]
            if p not in ids:
                ids[p] = _id(p) in removed
            gone[k] = gone[self.parent[k]] or ids[p]
        out = []
        for block in self.blocks:
            line = " ".join("".join(t for node, t in block if not gone[node]).split())
            if line:
                out.append(line)
        return "\n".join(out)


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host = _id(host_of(url))
            contents = Page(source or "").contents()
            whole = _id("\n".join(v for _, v in sorted(contents.items())))
            for (path, noise), text in contents.items():
                for c, v in zip(cols, (host, _id(path), _id(text), whole, noise)):
                    c.append(v)
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "path", "content", "page", "noise"])


def _entropy(counts: DataFrame, *key: str) -> DataFrame:
    """(key, n, entropy): normalised entropy of ``count`` over the contents of a key."""
    n = F.sum("count").cast("double")
    plain = F.log(n) - F.sum(F.col("count") * F.log("count")) / n
    return counts.groupBy(*key).agg(n.alias("n"), F.when(n >= MIN_PAGES, plain / F.log(n)).alias("entropy"), F.max("noise").alias("noise"))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, n, importance) for every node of the merged DOMs (hashed names)."""
    rows = pages.select("url", "html").mapInArrow(_nodes, "host bigint, path bigint, content bigint, page bigint, noise boolean")
    counts = rows.distinct().groupBy("host", "path", "content").agg(F.count("*").alias("count"), F.max("noise").alias("noise"))
    counts = materialise(counts, "html-counts")
    site = _entropy(counts, "host", "path")
    every = counts.groupBy("path", "content").agg(F.sum("count").alias("count"), F.max("noise").alias("noise"))
    every = _entropy(every, "path").select("path", F.col("entropy").alias("all_sites"))
    return site.join(every, "path").select(
        "host", "path", "n", F.when(F.col("noise"), 0.0).otherwise(F.coalesce(F.greatest("entropy", "all_sites"), F.lit(1.0))).alias("importance")
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(s or "").text(set(r or ())) for s, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = [_id(host_of(u)) for u in batch.column(1).to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array(hosts, pa.int64())], names=[*batch.schema.names, "host"])


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text) for each row of ``pages(page_id, url, html)``."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    low = style_tree(own).where(F.col("importance") < threshold)
    removed = low.groupBy("host").agg(F.collect_set("path").alias("removed")).withColumnRenamed("host", "r_host")
    hosted = own.mapInArrow(_hosts, "page_id bigint, url string, html string, host bigint")
    joined = hosted.join(removed, F.col("host") == F.col("r_host"), "left").select("page_id", "url", "html", "removed")
    return joined.mapInArrow(_apply, "page_id bigint, url string, text string")
