"""Main text of web pages by consensus paths of each host.

Every page is read into a flat list of elements and text runs.  Elements that
are never article text (menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are marked by tag, role and
class words.  The page's containers are scored by the unmarked text that they
hold, less what stands in links, and the best one votes for its generalised
path: tags and class words from the root, digits replaced.  Spark adds up the
votes of each host, and every page is read again at its host's winning path
(or at its own best container where the page has no such path).

Defined results: null and empty html have an empty text.  A null url is a host
of its own, and so is a url without a host.  Repeated rows are treated alike;
votes of equal size go to the path that sorts first.  An empty table gives an
empty result.  Columns besides the named ones are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside, map_arrow, prepare, stored

_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of these kinds, up to a container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
         "tfoot": {"tr", "td", "th", "tbody"}, "thead": {"caption"}}
_CONTAINERS = _BLOCK - {"p"}
_HOLDERS = frozenset("ul ol dl menu table select body html div article main section aside".split())
_DROP = frozenset("head nav footer aside form button select svg canvas object audio video map menu dialog "
                  "search".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu "
                        "menubar toolbar".split())
_DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar "
    "footer cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription signup comment comments commentlist reply replies disqus discussion respond related "
    "recommended recommendations share sharing social widget widgets toolbar pagination pager login "
    "copyright disclaimer skip".split())
_MAIN_WORDS = frozenset("article content post entry story main body text".split())
_KEPT_TAGS = frozenset("html body main article".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|"
    r"<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<([A-Za-z][^\s/>]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"""([A-Za-z:_-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=4096)
def _look(tag: str, attrs: str) -> tuple[bool, str, bool]:
    """Whether an element is dropped by itself, its part of a path, and
    whether it is a sign of the article."""
    a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    names = " ".join((a.get("class", ""), a.get("id", "")))
    words = {w.lower() for w in _WORD.findall(names)}
    words |= {w.lower() for w in re.findall("[A-Z]?[a-z]+", names)}
    drop = (tag in _DROP or a.get("role", "").lower() in _DROP_ROLES or "hidden" in a
            or a.get("aria-hidden") == "true"
            or "display:none" in a.get("style", "").replace(" ", "").lower()
            or bool(words & _DROP_WORDS) and (tag not in _KEPT_TAGS or "comment" in words))
    general = ".".join(sorted(re.sub(r"[0-9]+", "#", w) for w in a.get("class", "").split()))
    label = (tag + ("." + general if general else "")).replace(">", "_")
    return drop, label, tag in ("article", "main", "h1") or a.get("role", "").lower() == "main"


class Page:
    """Elements in page order (tag, parent, end) and text runs with their
    element; ``breaks`` are the run numbers before which a block ends."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end = ["html"], [-1], [0]
        self.label, self.drop, self.keep = ["html"], [False], [False]
        self.texts: list[tuple[int, str]] = []
        self.breaks: set[int] = set()
        self.links: list[bool] = []
        self._open, self._link = [0], 0
        self._count: Counter = Counter()  # open elements of each tag
        self._read(source)
        while self._open:
            self._close()
        self._mark()

    def _start(self, tag: str, attrs: str) -> None:
        drop, label, keep = _look(tag, attrs)
        if tag == "header" and not (self._count["article"] or self._count["main"]):
            drop = True
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.end.append(0)
        self.label.append(label)
        self.drop.append(drop)
        self.keep.append(keep)
        if tag in _BLOCK:
            self.breaks.add(len(self.texts))
        self._open.append(len(self.tag) - 1)
        self._count[tag] += 1
        self._link += tag == "a"

    def _close(self) -> None:
        i = self._open.pop()
        self._count[self.tag[i]] -= 1
        self.end[i] = len(self.tag)
        self._link -= self.tag[i] == "a"
        if self.tag[i] in _BLOCK:
            self.breaks.add(len(self.texts))

    def _close_to(self, tags: set[str], stop: frozenset) -> None:
        """Close the innermost open element of ``tags`` unless one of ``stop``
        lies in between."""
        if not any(self._count[t] > 0 for t in tags):
            return
        for at in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[at]]
            if tag in tags:
                while len(self._open) > at:
                    self._close()
                return
            if tag in stop:
                return

    def _text(self, s: str) -> None:
        if s:
            self.texts.append((self._open[-1], html.unescape(s) if "&" in s else s))
            self.links.append(self._link > 0)

    def _read(self, source: str) -> None:
        at, low = 0, None
        while True:
            m = _TAG.search(source, at)
            if not m:
                self._text(source[at:])
                return
            self._text(source[at:m.start()])
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                if tag == "br":
                    self._text(" ")
                elif tag == "p" and not self._count["p"]:
                    self.breaks.add(len(self.texts))
                elif tag not in ("html", "body"):
                    stop = frozenset() if tag in _BLOCK else _CONTAINERS
                    self._close_to({tag}, stop)
                continue
            tag = (m[2] or m[4] or "").lower()
            attrs = m[3] if m[2] else m[5]
            if not tag:
                continue
            if tag in ("html", "body") and tag in self.tag:
                continue
            if tag == "br":
                self._text(" ")
            elif tag in _VOID:
                if tag == "hr":
                    self.breaks.add(len(self.texts))
            elif tag in _RAW:
                if not attrs.rstrip().endswith("/"):
                    if low is None:
                        low = source.lower() if len(source.lower()) == len(source) else source
                    end = low.find("</" + tag, at)
                    at = len(source) if end < 0 else end
                    stop = source.find(">", at)
                    at = len(source) if stop < 0 else stop + 1
            else:
                if tag in _BLOCK:
                    self._close_to({"p"}, _CONTAINERS)
                if tag in _ENDS:
                    self._close_to(_ENDS[tag], _HOLDERS - _ENDS[tag])
                self._start(tag, attrs)
                if tag in ("svg", "math") and attrs.rstrip().endswith("/"):
                    self._close()

    def _mark(self) -> None:
        n = len(self.tag)
        holds = self.keep[:]
        for i in range(n - 1, 0, -1):  # an article inside keeps a form or a class name from dropping it
            if holds[i] and self.drop[i] and self.tag[i] not in ("nav", "footer", "aside", "header", "head") \
                    and not self.keep[i]:
                self.drop[i] = False
            if holds[i] and not self.drop[i]:
                holds[self.parent[i]] = True
        for i in range(1, n):
            self.drop[i] = self.drop[i] or self.drop[self.parent[i]]

    def path(self, i: int) -> str:
        out = []
        while i > 0:
            out.append(self.label[i])
            i = self.parent[i]
        return ">".join(reversed(out))

    def at_path(self, path: str) -> list[int]:
        """The undropped elements at a path that are not inside one another."""
        h = 0
        for label in path.split(">"):
            h = xxhash.xxh64_intdigest(label, h)
        chain, out = [0] * len(self.tag), []
        for i in range(1, len(self.tag)):
            chain[i] = xxhash.xxh64_intdigest(self.label[i], chain[self.parent[i]])
            if chain[i] == h and not self.drop[i]:
                out.append(i)
        return out

    def weights(self) -> list[int]:
        """Characters of text in each element that are neither dropped nor linked."""
        w = [0] * len(self.tag)
        for (i, s), link in zip(self.texts, self.links):
            if not self.drop[i]:
                w[i] += -len(s) if link else len("".join(s.split()))
        for i in range(len(w) - 1, 0, -1):
            w[self.parent[i]] += max(w[i], 0)
        return w

    def best(self) -> int:
        """The container that holds the page's main text (0: the whole page)."""
        return self.choose(self.weights())[0]

    def choose(self, w: list[int]) -> tuple[int, bool]:
        """The best container by the elements' weights, and whether its own
        tag or class says that it is the main text."""
        total = max(w[0], 1)
        free = [i for i in range(1, len(w)) if not self.drop[i]]
        for tag, share in (("article", 0.25), ("main", 0.25)):
            some = [i for i in free if self.tag[i] == tag and w[i] >= share * total]
            if some:
                return max(some, key=lambda i: (w[i], -i)), True
        boxes = [i for i in free if self.tag[i] in ("div", "section", "td", "center")]
        named = [i for i in boxes if w[i] >= 0.5 * total
                 and {x.lower() for x in _WORD.findall(self.label[i].partition(".")[2])} & _MAIN_WORDS]
        if named:
            return max(named, key=lambda i: (w[i], -i)), True
        most = [i for i in boxes if w[i] >= 0.85 * total]
        return max(most, default=0), False  # the innermost starts last

    def text(self, roots: list[int]) -> str:
        """The blocks of undropped text inside ``roots``."""
        spans = [(r, self.end[r]) for r in roots] or [(0, len(self.tag))]
        blocks, now, k = [], [], 0
        for n, (i, s) in enumerate(self.texts):
            if n in self.breaks:
                blocks.append("".join(now))
                now = []
            while k < len(spans) and i >= spans[k][1]:
                k += 1
            if k < len(spans) and spans[k][0] <= i and not self.drop[i]:
                now.append(s)
        blocks.append("".join(now))
        return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


#: Share of a marked container's text that the host's path must hold.
SHARE = 0.5


def best_path(source: str) -> tuple[str, int]:
    """The generalised path of a page's best container and its weight."""
    page = Page(source)
    i = page.best()
    return page.path(i), max(page.weights()[i], 0)


def main_text(source: str, path: str | None) -> str:
    """The text at ``path``, the host's.  The page's own best container is
    taken instead if the page has no such path, or if that container is marked
    as main text and the path holds less than ``SHARE`` of its text: then the
    page has another template than its host's most pages."""
    page = Page(source)
    w = page.weights()
    best, marked = page.choose(w)
    roots = page.at_path(path) if path else []
    if not roots or marked and sum(max(w[i], 0) for i in roots) < SHARE * w[best]:
        roots = [best] if best else []
    return page.text(roots)


def host(url: str):
    """The host of a url column, lower case; null if it has none."""
    found = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*+://(?:[^/?#@]*+@)?([^/?#:]++)", 1))
    return F.when(found != "", found)


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path, votes): the path with the most votes of each host, the one
    that sorts first on ties.  Pages without a host are of no common origin and
    don't vote."""
    prepare(pages.sparkSession)

    def make():
        def run(b):
            found = [best_path(x or "") for x in b.column("html").to_pylist()]
            return [pa.array([p for p, _ in found], pa.string()), pa.array([w for _, w in found], pa.int64())]

        return run

    src = pages.select(host(url).alias("host"), F.col(source).cast("string").alias("html")).filter("host is not null")
    votes = map_arrow(src, make, [("path", "string"), ("weight", "long")], ["host"])
    votes = votes.filter("path <> '' and weight > 0").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    # most votes first, then the path that sorts first
    first = F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("first")
    return votes.groupBy("host").agg(first).select("host", F.col("first.path").alias("path"),
                                                   (-F.col("first.v")).alias("votes"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    paths = stored(host_paths(pages, url, source), "host-paths").select(
        F.col("host").alias("path_host"), "path")
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(url).alias("host"),
                       F.col(source).cast("string").alias("html"))
    joined = beside(src, paths, F.col("host").eqNullSafe(F.col("path_host")))

    def make():
        return lambda b: [pa.array([main_text(x or "", p) for x, p in zip(
            b.column("html").to_pylist(), b.column("path").to_pylist())], pa.string())]

    out = map_arrow(joined.select("page_id", "url", "html", "path"), make, [("text", "string")], ["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))
