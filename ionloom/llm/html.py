"""HTML extraction: page structure as a prior, and a suffix array per host that judges every block by repetition.

A page is read into blocks. Elements, roles and class names give each a zone: ``main`` (inside article or main),
``chrome`` (menus, headers, footers, sidebars, notices, adverts, forms, comments), ``weak`` (inside the main zone, with a
class name that only hints at chrome) and ``open`` (none of these). Chrome is never part of the text. Everything else
is judged by the suffix array of its host, whose streams hold the tokens of all zones:

* A suffix has names for its first 1, 2, 4, 8, ... tokens, each made from two of the length before (Karp, Miller and Rosenberg
  1972). Suffixes of one name at ``depth`` stand together in the suffix order; the pages in such a run are counted.
* A run is boilerplate where enough of the host's distinct pages share it: ``share`` of them (three, or two of two) in open and
  weak blocks, ``main_share`` and ``main_pages`` in the main zone, so that passages which some articles quote stay.
* Whole blocks of ``block_run`` tokens at least are judged in the same way, also where they are shorter than ``depth``.
* Covered tokens go, unique runs stay. A page of which more than ``copy`` would go (or a main zone of which more than
  ``main_copy`` would) is a near copy of others and stays whole.

Pages with equal content outside chrome have one fingerprint and count as one page of their host.

The array is sparse where it can be. Of any ``depth - anchor + 1`` neighbouring suffixes only the one with the least name at
``anchor`` tokens is dealt at first; every run of ``depth`` tokens holds such an anchor at the same place on all its pages. Only
around anchors that enough pages share are all suffixes dealt and counted at ``depth``. The result is that of the whole array.
Counts are by name with partial sums, so neither a host nor a name of any size is gathered in one task.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .urls import host_of


@dataclass(frozen=True)
class HtmlParams:
    depth: int = 24
    anchor: int = 12
    block_run: int = 5
    share: float = 0.2
    main_share: float = 0.5
    main_pages: int = 8
    copy: float = 0.8
    main_copy: float = 0.5


MAIN, CHROME, WEAK, OPEN = "main", "chrome", "weak", "open"
#: Of each repeated name so many rows are joined, so that pages that share it are dealt to as many tasks.
SALTS = 8
CACHE = 200_000
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?|<[!?/][^>]*+>?""", re.S)
ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
#: Elements whose text is never read, and those of them that hold no elements.
RAW = frozenset("script style noscript template textarea title svg iframe select object canvas audio video annotation annotation-xml".split())
PLAIN = frozenset("script style textarea title iframe noscript".split())
#: Elements that end a block where they begin and end.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
SPACE = frozenset("br td th wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles of chrome.
CHROME_TAGS = frozenset("nav footer aside form menu button dialog label input fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class names and ids. A name says chrome if all its parts are chrome words or parts of layout, one
#: a chrome word at least; with a chrome or doubtful word beside other words it is a hint.
CHROME_WORDS = frozenset("nav navbar navigation menu masthead footer sidebar aside ad ads advert adverts advertisement adsense adslot banner promo sponsor sponsored cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login related recommended sharing social comment comments disqus notice notices alert alerts disclaimer breadcrumb breadcrumbs pagination pager copyright outbrain taboola".split())
DOUBTFUL_WORDS = frozenset("promotion recommendations share respond reply replies widget toolbar search form".split())
LAYOUT_WORDS = frozenset("box bar list section area block container wrapper inner outer top bottom left right header main primary secondary site page user reader item items body content unit slot module buttons links icons thread posts post".split())
ITEMS = frozenset("li dt dd tr option".split())
WRAPPERS = frozenset("nav form header menu label button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TELLING = re.compile("class|id|role|hidden|style", re.I)
#: Where the text of an unclosed script or style ends at the latest.
RESUME = re.compile(r"</?(?:body|html|head|article|main|div|p|section|header|footer|nav|h[1-6])\b", re.I)


def _said(name: str) -> str:
    """What one class name or id says: chrome, weak or nothing."""
    parts = {w for w in re.split(r"[^a-z]+", name) if w}
    if parts & CHROME_WORDS and parts <= CHROME_WORDS | DOUBTFUL_WORDS | LAYOUT_WORDS:
        return CHROME
    return WEAK if parts & (CHROME_WORDS | DOUBTFUL_WORDS) else ""


@lru_cache(maxsize=8192)
def _kind(tag: str, attrs: str) -> str:
    """``chrome``, ``weak``, ``header`` (only its headings count, and only in the article), ``main`` or nothing."""
    if tag in CHROME_TAGS:
        return CHROME
    said, role = set(), ""
    for k, a, b, c in ATTR.findall(attrs) if attrs else ():
        v, k = (a or b or c).lower(), k.lower()
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v):
            return CHROME
        if k == "role":
            role = v
        elif k in ("class", "id"):
            said.update("header" if n == "header" else "comment" if n in ("comment", "comments", "reply") else _said(n) for n in v.split())
    if role in CHROME_ROLES:
        return CHROME
    if tag == "article" and "comment" in said:
        return CHROME
    if tag in ("article", "main") or role == "main":
        return MAIN
    if tag == "header":
        return "header"
    if tag in ("html", "body", "head"):
        return ""
    if CHROME in said or "comment" in said:
        return CHROME
    return "header" if "header" in said else WEAK if WEAK in said else ""


class RawEnds:
    """Where reading goes on after the start tag of an element whose text is not read; all ends of one element name are found in one pass.

    Nested elements of the same name are counted: the end is where the balance of start and end tags after the start first falls
    below nothing, the next smaller value of the running balance. Without an end tag only a script or style takes text with it, up
    to the next tag of the page's structure; of the others the tag alone goes.
    """

    def __init__(self, page: str):
        self.page = page
        self.known: dict[str, tuple[list[int], list[int], list[int]]] = {}

    def _events(self, tag: str) -> tuple[list[int], list[int], list[int]]:
        """(starts, ends, where the balance first falls below that before the event, or -1) of the element's tags."""
        starts, ends, balance = [], [], [0]
        for m in re.compile(rf"<(/?){tag}\b[^>]*>?", re.I).finditer(self.page):
            starts.append(m.start())
            ends.append(m.end())
            opens = not m[1] and tag not in PLAIN and not m[0].endswith("/>")
            balance.append(balance[-1] + (opens - bool(m[1])))
        falls, waiting = [-1] * len(balance), []
        for j, v in enumerate(balance):
            while waiting and balance[waiting[-1]] > v:
                falls[waiting.pop()] = j - 1
            waiting.append(j)
        return starts, ends, falls

    def after(self, tag: str, attrs: str, at: int) -> int:
        if attrs.rstrip().endswith("/") and tag not in ("script", "style", "textarea", "title"):
            return at
        if tag not in self.known:
            self.known[tag] = self._events(tag)
        starts, ends, falls = self.known[tag]
        fall = falls[bisect_left(starts, at)]
        if fall >= 0:
            return ends[fall]
        if tag in ("script", "style"):
            m = RESUME.search(self.page, at)
            return m.start() if m else len(self.page)
        return at


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each non-empty block in page order; white space inside is one space, references decoded."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    here: list[str] = []
    deep = {MAIN: 0, CHROME: 0, WEAK: 0, "header": 0, "": 0}
    heading = 0

    def flush() -> None:
        if here:
            if text := " ".join(entities.unescape("".join(here)).split()):
                shut = deep[CHROME] or deep["header"] and not (deep[MAIN] and heading)
                zone = (WEAK if deep[MAIN] else "hint") if deep[WEAK] else MAIN if deep[MAIN] else OPEN
                out.append((CHROME if shut else zone, text))
            here.clear()

    page = page or ""
    raw, opened = RawEnds(page), Counter()
    at, end = 0, len(page)

    def shut_last() -> str:
        t, kind = stack.pop()
        deep[kind] -= 1
        opened[t] -= 1
        return t

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            here.append(page[at:])
            break
        if m.start() > at:
            here.append(page[at : m.start()])
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if tag in SPACE:
            here.append(" ")
            continue
        if m[1]:
            open_ = opened[tag] > 0
            if tag in BLOCK or open_:
                flush()
            while open_:
                open_ = shut_last() != tag
            if tag in HEADINGS:
                heading = 0
            continue
        if tag in RAW:
            at = raw.after(tag, m[3], at)
            continue
        kind = _kind(tag, m[3] if TELLING.search(m[3]) else "")
        if tag in BLOCK or kind:
            flush()
        # Elements whose end tag may be missing: a head ends at the body, paragraphs and items at the next of their kind, and
        # an article is not part of a menu or form that is still open.
        while stack and (tag == "body" and opened["head"] or tag in BLOCK and stack[-1][0] == "p" or tag in ITEMS and stack[-1][0] == tag):
            shut_last()
        if kind == MAIN:
            for i, (t, k) in enumerate(stack):
                if k and t in WRAPPERS:
                    deep[k] -= 1
                    stack[i] = (t, "")
        if tag in HEADINGS:
            heading = 1
        if tag not in VOID and (kind or tag in BLOCK and tag not in ("p", "li", "hr", "tr", "dt", "dd") and tag not in HEADINGS):
            stack.append((tag, kind))
            deep[kind] += 1
            opened[tag] += 1
    flush()
    # Outside a main zone a hint is enough; without one it is judged like open text.
    hint = CHROME if any(z == MAIN for z, _ in out) else WEAK
    return [(hint if z == "hint" else z, t) for z, t in out]


_tokens: dict[str, int] = {}


def _token(t: str) -> int:
    if len(_tokens) >= CACHE:
        _tokens.clear()
    h = _tokens[t] = xxhash.xxh64_intdigest(t)
    return h


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def suffix_names(tokens: list[str], lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length the names of the first so many tokens of every suffix that is that long, by doubling."""
    get = _tokens.get
    double = [np.fromiter([get(t) or _token(t) for t in tokens], np.uint64, len(tokens))]
    while 2 ** len(double) <= max(lengths):
        last, step = double[-1], 2 ** (len(double) - 1)
        double.append(_joined(last[:-step], last[step:]) if len(last) > step else last[:0])
    out = []
    for length in lengths:
        n, at, name = len(tokens) - length + 1, 0, None
        if n <= 0:
            out.append(double[0][:0])
            continue
        for bit in range(len(double) - 1, -1, -1):
            if length >> bit & 1:
                part = double[bit][at : at + n]
                name, at = part if name is None else _joined(name, part), at + 2**bit
        out.append(name)
    return out


def anchors(names: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least name of some ``width`` neighbouring ones (of equal ones the first)."""
    if len(names) < width:
        return np.empty(0, np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(names, width).argmin(axis=1) + np.arange(len(names) - width + 1))


class Stream:
    """A page's blocks and the names of its suffixes and whole blocks, all of them names within its host."""

    def __init__(self, page: str | None, host: str, p: HtmlParams):
        self.blocks, self.p = blocks_of(page), p
        self.tokens = [text.split() for _, text in self.blocks]
        own = np.uint64(xxhash.xxh64_intdigest(host))
        flat = [t for ts in self.tokens for t in ts]
        self.short, self.long = (_joined(n, own) for n in suffix_names(flat, (p.anchor, p.depth)))
        keys = np.array([xxhash.xxh64_intdigest(text, seed=1) if len(t) >= p.block_run else 0 for t, (_, text) in zip(self.tokens, self.blocks, strict=True)], np.uint64)
        self.whole = np.where(keys > 0, _joined(keys, own), np.uint64(0))

    @property
    def mark(self) -> int:
        """The page's fingerprint: its content outside chrome."""
        return xxhash.xxh64_intdigest("\n".join(t for z, t in self.blocks if z != CHROME)) >> 1

    def dealt(self) -> np.ndarray:
        """Names at the anchors, and of whole blocks."""
        at = anchors(self.short, self.p.depth - self.p.anchor + 1)
        return np.unique(np.concatenate([self.short[at], self.whole[self.whole > 0]])).view(np.int64)

    def around(self, hot: np.ndarray) -> np.ndarray:
        """Names at ``depth`` of all suffixes near the anchors that are in ``hot``."""
        reach = self.p.depth - self.p.anchor
        at = np.flatnonzero(np.isin(self.short, hot.view(np.uint64)))
        near = np.unique((at[:, None] + np.arange(-reach, reach + 1)).ravel()) if len(at) else at
        return np.unique(self.long[near[(near >= 0) & (near < len(self.long))]]).view(np.int64)

    def text(self, low: np.ndarray, high: np.ndarray) -> tuple[str, int, int]:
        """The text, the number of tokens that went as repeated, and that of repeated tokens in any zone. ``low`` and ``high`` are the names that pass the
        bars of open text and of the main zone."""
        n, depth = sum(map(len, self.tokens)), self.p.depth
        cover = {}
        for name, repeated in (("low", low.view(np.uint64)), ("high", high.view(np.uint64))):
            c = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(np.isin(self.long, repeated))
            np.add.at(c, at, 1)
            np.add.at(c, at + depth, -1)
            cover[name] = np.cumsum(c)[:n] > 0
            starts = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).astype(int)
            for i in np.flatnonzero(np.isin(self.whole, repeated) & (self.whole > 0)):
                cover[name][starts[i] : starts[i + 1]] = True
        zone = np.repeat([z for z, _ in self.blocks], [len(t) for t in self.tokens]) if n else np.empty(0, str)
        gone = np.where(zone == MAIN, cover["high"], cover["low"]) & (zone != CHROME)
        if gone[zone == MAIN].sum() > self.p.main_copy * (zone == MAIN).sum():
            gone[zone == MAIN] = False
        if gone.sum() > self.p.copy * (zone != CHROME).sum():
            gone[:] = False
        out, at = [], 0
        for (z, _), tokens in zip(self.blocks, self.tokens, strict=True):
            keep = gone[at : at + len(tokens)]
            at += len(tokens)
            if z != CHROME and (left := [t for t, g in zip(tokens, keep, strict=True) if not g]):
                out.append(" ".join(left))
        return "\n\n".join(out), int(gone.sum()), int(cover["low"].sum())


def _numbers(cells) -> np.ndarray:
    return np.empty(0, np.int64) if cells is None else np.asarray(cells, np.int64)


def plain_text(page: str | None) -> str:
    """The text of a page of which nothing is repeated."""
    return "\n\n".join(t for z, t in blocks_of(page) if z != CHROME)


#: Sides of at most so many values (numbers of 8 bytes), summed first, are broadcast.
FEW_VALUES = 500_000


def _few(df: DataFrame, values: Column) -> bool:
    """Whether the rows of a materialised frame hold few ``values`` together."""
    return (df.agg(F.sum(values.cast("bigint"))).first()[0] or 0) <= FEW_VALUES


def _small(df: DataFrame, *lists: str) -> DataFrame:
    """``df`` materialised, to be broadcast if its rows and ``lists`` hold few values."""
    df = cut(df)
    return F.broadcast(df) if _few(df, sum((F.size(c) for c in lists), F.lit(len(df.columns)))) else df


def extract_text(pages: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """page_id, url, text, n_chars, n_removed (tokens that the suffix array took away), n_repeated (those it marked, in any
    zone) of every row of ``pages``.

    Null or empty html: empty text. Null urls share the empty host. Null ids stay; ids pass unchanged, whatever their type.
    Repeated rows give equal results and count as one page. Other columns of ``pages`` play no part. Empty table: no rows.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(F.col("page_id").cast("string").alias("id"), "url", "html", host_of(F.col("url")).alias("host")).withColumn("row", F.xxhash64("id", "url", "html"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [Stream(page, host, p) for host, page in zip(b["host"], b["html"], strict=True)]
            out = [(r, xxhash.xxh64_intdigest(h) >> 1, s.mark, s.dealt()) for r, h, s in zip(b["row"], b["host"], got, strict=True) if s.blocks]
            yield pd.DataFrame(out, columns=["row", "host", "mark", "names"])

    def deepen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"row": b["row"], "names": [Stream(page, h, p).around(np.asarray(x, np.int64)) for h, page, x in zip(b["host"], b["html"], b["names"], strict=True)]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(plain_text(page), 0, 0) if low is None else Stream(page, h, p).text(np.asarray(low, np.int64), np.asarray(high, np.int64)) for h, page, low, high in zip(b["host"], b["html"], b["low"], b["high"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": [t for t, _, _ in got], "n_removed": [n for _, n, _ in got], "n_repeated": [n for _, _, n in got]})

    # Small rows from here on: a quarter of a page's suffixes as numbers, and its fingerprint. uid tells equal rows apart.
    dealt = rows.select("row", "host", "html").mapInPandas(spread, "row bigint, host bigint, mark bigint, names array<bigint>")
    dealt = cut(dealt.withColumn("uid", F.monotonically_increasing_id()))
    first = dealt.groupBy("host", "mark").agg(F.min("uid").alias("first"), F.count("*").alias("n"))
    hosts = _small(first.groupBy("host").agg(F.count("*").alias("pages")))
    # Of pages with one fingerprint all but the first are left out of the counts.
    copies = _small(dealt.select("host", "mark", "uid").join(first.where("n > 1"), ["host", "mark"]).where("uid <> first").select("uid"))

    def held(df: DataFrame) -> DataFrame:
        """row, low, high of each row of ``df`` (row, host, uid, names) with names that enough distinct pages of its host hold."""
        counted = df.join(copies, "uid", "left_anti").select("host", F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.min("host").alias("host"))
        n, pages = F.col("n"), F.col("pages")
        bar = F.greatest(F.lit(2), F.least(F.lit(3), pages), pages * p.share)
        high = (n >= p.main_pages) & (n >= pages * p.main_share)
        repeated = cut(counted.where("n > 1").join(hosts, "host").where(n >= bar).select("name", high.alias("high")))
        own = df.select("row", F.explode("names").alias("name"), F.pmod("uid", F.lit(SALTS)).cast("int").alias("salt"))
        if _few(repeated, F.lit(2)):
            met = own.join(F.broadcast(repeated), "name")
        else:
            met = own.join(repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["name", "salt"])
        return met.groupBy("row").agg(F.collect_set("name").alias("low"), F.collect_set(F.when(F.col("high"), F.col("name"))).alias("high"))

    hot = _small(held(dealt), "low", "high")
    deep = rows.select("row", "host", "html").join(hot.select("row", F.col("low").alias("names")), "row").select("row", "host", "html", "names").mapInPandas(deepen, "row bigint, names array<bigint>")
    deep = cut(deep.dropDuplicates(["row"]).join(dealt.groupBy("row", "host").agg(F.min("uid").alias("uid")), "row"))
    runs = held(deep)
    both = lambda c: F.array_union(F.col(c), F.coalesce(F.col(f"r_{c}"), F.array().cast("array<bigint>"))).alias(c)
    marks = _small(hot.join(runs.select("row", F.col("low").alias("r_low"), F.col("high").alias("r_high")), "row", "left").select("row", both("low"), both("high")), "low", "high")
    out = rows.join(marks, "row", "left").select("id", "url", "host", "html", "low", "high").mapInPandas(finish, "id string, url string, text string, n_removed bigint, n_repeated bigint")
    return out.select(F.col("id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_removed", "n_repeated")
