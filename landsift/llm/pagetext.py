"""The main text of web pages, by paths that the pages of a host agree on.

First pass: each page is read into elements; what is a menu, header, footer, sidebar, notice, advert, form, script, style or
comment, by tag, role, class or id, is set aside, and each container that is left is scored by the text of its blocks, less their
links. The best containers of a page, and those within a tenth of the best, vote for their path: the tags, and the classes without digits, of the
container and the three elements around it. Spark sums the votes by host and path. Second pass: each page is read
again, and its text is that of the elements at the host's most voted path that the page has; a page that has none
of its host's leading paths falls back on its own best container.

Votes are summed up in each batch and before the shuffle, and the leading paths of a host are picked by a rank that is limited before
the shuffle too, so a hot host is no hot task. The paths are broadcast while they have at most ``most_broadcast`` bytes; beyond that only those of hosts with many pages
are, and the other pages are joined by host.

Rows: null html is empty and has the text ''; a null url is the host ''. Repeated rows and ids are answered each; an empty table
gives no row. Other columns aren't read, so names can't clash. Pages of any length are read whole; a task holds a batch of about
4 MB, or one longer page. White space is what Unicode calls so, no-break spaces included.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsift.llm.common import slices, stored, told

#: Leading paths kept of a host; a page without any of them is read by its own best container.
LEADING = 16
_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)>|(!--)|[!?/])")
_TAIL = re.compile(r"<[A-Za-z/!?]")
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Classes that say how an element is laid out, not what it is.
_MANNER = re.compile(r"(?<!\S)(?:with|without|has|no|is)[-_]\S+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are never part of an article.
ASIDE = frozenset("nav footer aside button select textarea datalist label legend input script style noscript template title iframe object svg canvas video audio dialog menu noembed noframes".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status tablist".split())
#: Words in classes and ids of such elements: whole words, and word parts that stand for nothing else.
ASIDE_WORDS = frozenset("ad ads adbox adslot nav navi header footer foot aside notice notices alert form search login signin signup share sharing social related recommended popup modal toolbar promo pager skip respond replies responses copyright gdpr consent tracking outbrain taboola".split())
ASIDE_PARTS = re.compile(r"sidebar|navbar|navigation|topnav|subnav|menu|masthead|footer|breadcrumb|comment|disqus|advert|adsense|sponsor|cookie|newsletter|subscri|pagination|banner|widget|siteheader|pageheader")
#: What holds comments never wraps the article, even if each comment is an article element.
COMMENTS = re.compile(r"comment|disqus|replies|responses")
GOOD_WORDS = frozenset("article content post entry story main text body page".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body blockquote center div main section td".split())
#: A start tag ends open elements of these tags, up to the nearest element of the second set.
_P_ENDS = frozenset(BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "legend"})
_CELL = frozenset(("table", "td", "th", "caption", "button", "object"))
_ENDS = {
    "li": (("li",), frozenset(("ul", "ol", "menu")) | _CELL),
    "dt": (("dt", "dd"), frozenset(("dl",)) | _CELL),
    "dd": (("dt", "dd"), frozenset(("dl",)) | _CELL),
    "td": (("td", "th"), frozenset(("tr", "table"))),
    "th": (("td", "th"), frozenset(("tr", "table"))),
    "tr": (("tr", "td", "th"), frozenset(("table",))),
    "tbody": (("tbody", "thead", "tfoot"), frozenset(("table",))),
    "thead": (("tbody", "thead", "tfoot"), frozenset(("table",))),
    "tfoot": (("tbody", "thead", "tfoot"), frozenset(("table",))),
    "option": (("option",), frozenset(("select", "datalist"))),
} | {t: (("p",), _CELL) for t in _P_ENDS}


class Page:
    """The elements of a page, numbered as they open, and its pieces of text as (element, block, text)."""

    def __init__(self, html: str):
        self.tags, self.up, self.last, self.labels = ["body"], [0], [0], ["body"]
        self.soft, self.hard, self.wraps = [False], [False], [False]
        self.pieces: list[tuple[int, int, str]] = []
        self._read(html)
        for k in range(len(self.tags) - 1, 0, -1):  # elements close after all that they hold
            self.last[self.up[k]] = max(self.last[self.up[k]], self.last[k])
            self.wraps[self.up[k]] |= self.wraps[k]
        # what wraps the article isn't beside it, whatever its name
        self.out = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            self.out[k] = self.out[self.up[k]] or self.hard[k] or (self.soft[k] and not self.wraps[k])
            if self.tags[k] in HEADINGS and self.out[k] and self._in_article_header(k):
                self.out[k] = False

    def _in_article_header(self, k: int) -> bool:
        """Whether only headers stand between a heading and the article around it."""
        k = self.up[k]
        seen = False
        while k and (self.tags[k] == "header" or (self.tags[k] in ("div", "hgroup") and not seen)):
            if self.hard[k] or (self.soft[k] and self.tags[k] != "header"):
                return False
            seen |= self.tags[k] == "header"
            k = self.up[k]
        return seen and self.tags[k] in ("article", "main", "section") and not self.out[k]

    def _open(self, tag: str, said: str, parent: int) -> int:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(said)} if said else {}
        k = len(self.tags)
        names = _MANNER.sub("", f"{found.get('class', '')} {found.get('id', '')}") if found else ""
        words = [w.lower() for w in _PARTS.findall(names)]
        role = found.get("role", "").lower()
        style = found.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
        named = bool(words) and (any(w in ASIDE_WORDS for w in words) or bool(ASIDE_PARTS.search(names.lower())))
        self.tags.append(tag)
        self.up.append(parent)
        self.last.append(k)
        self.hard.append(tag in ASIDE or hidden or role in ASIDE_ROLES or (named and bool(COMMENTS.search(names.lower()))))
        self.soft.append(tag in ("form", "header") or named)
        self.wraps.append(tag in ("main", "h1") and not (tag == "h1" and self._headed(parent)) or role == "main" or (tag == "article" and not named))
        name = found.get("class") or (f"#{found['id']}" if found.get("id") else "")
        self.labels.append(f"{tag}.{'.'.join(sorted(set(re.sub(r'[0-9]+', '', name).lower().split())))}"[:80] if name else tag)
        return k

    def _headed(self, k: int) -> bool:
        while k:
            if self.tags[k] == "header" or self.soft[k] and self.tags[k] != "form":
                return True
            k = self.up[k]
        return False

    def _read(self, html: str) -> None:
        stack, open_, block, at = [0], Counter(("body",)), 0, 0
        ended = html.rfind(">") + 1  # no tag ends after it
        tail = _TAIL.search(html, ended)
        end = tail.start() if tail else len(html)
        while at < end:
            m = _TAG.search(html, at, ended)
            stop = m.start() if m else end
            if stop > at:
                text = html[at:stop]
                self.pieces.append((stack[-1], block, unescape(text) if "&" in text else text))
            if not m:
                break
            at = m.end()
            if m[7]:  # a comment
                found = html.find("-->", at - 2)
                at = found + 3 if found >= 0 else end
                continue
            tag = m[2] or m[5]
            if not tag:  # a declaration
                found = html.find(">", at)
                at = found + 1 if found >= 0 else end
                continue
            tag, said = tag.lower(), m[3] or m[6] or ""
            if tag in ("html", "head", "body"):
                continue
            if tag in BLOCKS:
                block += 1
            if m[1] or m[4]:
                self._close(tag, stack, open_)
                continue
            if tag == "br":
                self.pieces.append((stack[-1], block, " "))
                continue
            if tag in _ENDS and any(open_[t] for t in _ENDS[tag][0]):
                closed, bound = _ENDS[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    t = self.tags[stack[depth]]
                    if t in closed:
                        self._cut(stack, open_, depth)
                        if closed != ("tr", "td", "th") or t == "tr":
                            break
                    elif t in bound:
                        break
            k = self._open(tag, said, stack[-1])
            if tag in RAW:
                found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = found.end() if found else end
            elif tag not in VOID and not said.endswith("/"):
                stack.append(k)
                open_[tag] += 1

    def _cut(self, stack: list[int], open_: Counter, depth: int) -> None:
        for k in stack[depth:]:
            open_[self.tags[k]] -= 1
        del stack[depth:]

    def _close(self, tag: str, stack: list[int], open_: Counter) -> None:
        if not open_[tag]:
            return
        for depth in range(len(stack) - 1, 0, -1):
            t = self.tags[stack[depth]]
            if t == tag:
                return self._cut(stack, open_, depth)
            if t in BLOCKS and tag not in BLOCKS or t in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def path(self, k: int) -> str:
        """The labels of an element and of the three around it."""
        found = [self.labels[k]]
        while k and len(found) < 4:
            k = self.up[k]
            found.append(self.labels[k])
        return ">".join(reversed(found))

    def depth(self, k: int) -> int:
        n = 0
        while k:
            k, n = self.up[k], n + 1
        return n

    def scores(self) -> dict[int, int]:
        """What the blocks of each container are worth: their text, less twice their links and 25 a block that is no heading."""
        linked = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            linked[k] = self.tags[k] == "a" or linked[self.up[k]]
        own, blocks = Counter(), {}
        for k, block, text in self.pieces:
            if not self.out[k] and (size := len(text) if not text.isspace() else 0):
                own[k] += -2 * size if linked[k] else size
                blocks.setdefault(block, k)
        for k in blocks.values():
            own[k] -= 0 if self.tags[k] in HEADINGS else 25
        for k in range(len(self.tags) - 1, 0, -1):
            if own[k]:
                own[self.up[k]] += own[k]
        found = {}
        for k, tag in enumerate(self.tags):
            if tag in CONTAINERS and own[k] > 0 and not self.out[k]:
                better = {"article": 15, "main": 14, "body": 9, "td": 9}.get(tag) or (13 if GOOD_WORDS & set(_PARTS.findall(self.labels[k])[1:]) else 10)
                found[k] = own[k] * better
        return found

    def best(self) -> dict[int, int]:
        """The best container and those within a tenth of it, with 1,000 for the best; where none is worth anything, the page."""
        scores = self.scores()
        top = max(scores.values(), default=0)
        return {k: 1000 * s // top for k, s in scores.items() if 10 * s >= 9 * top} or {0: 0}

    def at(self, path: str) -> list[int]:
        """The outermost elements at a path."""
        found, free = [], 0
        for k, label in enumerate(self.labels):
            if k >= free and path.endswith(label) and not self.out[k] and self.path(k) == path:
                found.append(k)
                free = self.last[k] + 1
        return found

    def text(self, containers: list[int]) -> str:
        """The blocks of the containers in page order, joined by two line feeds."""
        spans = [(k, self.last[k]) for k in containers]
        blocks: dict[int, list[str]] = {}
        for k, block, text in self.pieces:
            if not self.out[k] and any(a <= k <= b for a, b in spans):
                blocks.setdefault(block, []).append(text)
        return "\n\n".join(b for b in (" ".join("".join(b).split()) for b in blocks.values()) if b)

    def main(self, paths: list[str]) -> str:
        """The text at the first path that the page has, or else of its own best container."""
        for path in paths:
            if found := self.at(path):
                return self.text(found)
        best = self.best()
        return self.text([max(best, key=lambda k: (best[k], k))])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        votes: Counter = Counter()
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html or "")
            seen: dict[tuple[str, int], int] = {}
            for k, share in page.best().items():
                key = (page.path(k), page.depth(k))
                seen[key] = max(seen.get(key, 0), share)
            for (path, depth), share in seen.items():
                if share:
                    votes[host, path, depth] += share
        hosts, paths, depths = zip(*votes, strict=True) if votes else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(depths, pa.int64()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "depth", "votes"])


def votes(pages: DataFrame) -> DataFrame:
    """host, path, depth and votes: what the pages of each host say of where their text is."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_votes, "host string, path string, depth bigint, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.max("depth").alias("depth"))


def leading(voted: DataFrame, most: int = LEADING) -> DataFrame:
    """host and its most voted paths, the first first."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("depth"), "path"))
    first = voted.withColumn("rank", rank).where(F.col("rank") <= most)
    return first.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [Page(html).main(paths or []) if html else "" for html, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, most_broadcast: int = 16 << 20) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    paths = stored(leading(votes(pages)), "page-paths")
    rows = pages.withColumn("host", host_of(F.col("url")))
    size = paths.agg(F.coalesce(F.sum(F.length("host") + F.length(F.concat_ws("", "paths")) + 100), F.lit(0))).first()[0]
    if size <= most_broadcast:
        joined = rows.join(F.broadcast(paths), "host", "left_outer")
    else:
        counted = rows.groupBy("host").agg(F.count(F.lit(1)).alias("size")).join(paths, "host", "left_outer")
        joined = told(rows, stored(counted, "page-hosts"), ["host"])
    found = joined.select("page_id", "url", "html", "paths").mapInArrow(_texts, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
