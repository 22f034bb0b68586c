"""Main text of web pages: what a page shares with the page of the nearest URL is template, the rest is text.

Pages are put in order of host and path; each is compared with the neighbour whose path is closer, by the longest common
subsequence of text lines, and shared lines are deleted. Neighbours are the nearest pages on either side whose lines differ, so
copies of a page do not delete each other. Two things the comparison alone gets wrong are settled by the markup: lines inside
navigation, forms, adverts and the like are never text, also where the neighbour has others, and lines inside an article are
always text and no template, also where the neighbour quotes the same passage. All other lines go by the comparison, on pages
with an article as well.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, flag_ids, id_filter

# Fixed values of the markup rules.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "textarea", "title", "svg", "math", "noframes")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "data", "output")
SKIPPED = ("nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "fieldset")
MAIN = ("article", "main")
SKIPPED_WORDS = ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
                 "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
                 "pagination", "pager", "popup", "promo", "promotion", "recommended", "related", "responses", "share", "sharing", "sidebar", "social",
                 "sponsor", "sponsored", "subscribe", "toc", "toolbar", "widget", "complementary", "contentinfo", "search", "login", "signup")
HEADER_WORDS = ("header", "masthead")
MAIN_WORDS = ("main", "main-content", "content-main", "main-article", "main-body", "main-text", "main-column")
# A class, id or role counts as a whole: one of the words above, or one of them between these.
BEFORE = ("site", "page", "main", "global", "primary", "secondary", "top", "bottom", "post", "article", "entry", "user", "mobile", "sticky", "floating", "google", "wp-block",
          "block")
AFTER = ("area", "bar", "block", "box", "button", "buttons", "container", "form", "icons", "inner", "item", "items", "label", "links", "list", "overlay", "panel",
         "placeholder", "posts", "section", "slot", "title", "top", "unit", "wrap", "wrapper")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NUMBER = re.compile(r"(?:-?[0-9]+(?:x[0-9]+)?)+$")


def _compounds(words: tuple[str, ...], ends: tuple[str, ...]) -> frozenset[str]:
    return frozenset("-".join(filter(None, (x, w, y))) for x in ("", *BEFORE) for w in words for y in ("", *ends))


_SKIPPED_NAMES = _compounds(SKIPPED_WORDS, (*AFTER, *SKIPPED_WORDS))
_HEADER_NAMES = _compounds(HEADER_WORDS, AFTER)


def _zone(tag: str, attributes: str, inside: int) -> int:
    """0 page, 1 article, 2 never text, 3 no text but for articles in it; ``inside`` is the zone around the element."""
    if inside == 2:
        return 2
    names = set()
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            names.update(_NUMBER.sub("", x) for x in (m[1] or m[2] or m[3] or "").lower().replace("_", "-").split())
        if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes, re.I) and "aria-hidden" not in attributes:
            return 2
    if tag in SKIPPED:
        return 2
    if tag in MAIN and inside != 1:  # a name around or on an article does not make it less of one
        return 1
    if tag not in ("html", "body", "main") and not names.isdisjoint(_SKIPPED_NAMES):
        return 2 if inside == 1 else 3
    if inside == 0 and tag == "header":
        return 2
    if inside == 0 and tag != "html" and tag != "body" and not names.isdisjoint(_HEADER_NAMES):
        return 3
    return 1 if inside == 0 and tag != "body" and not names.isdisjoint(MAIN_WORDS) else inside


def lines(page: str | None) -> list[tuple[str, int]]:
    """Text lines of a page in order, with their zone; lines that are never text are left out."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    zone = at = 0
    page = page or ""

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and zone < 2:
                out.append((text, zone))
            parts.clear()

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        if m[2] is None or not m[4]:  # comment, declaration, or a tag the page breaks off in
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if stack and stack[-1][0] == tag:
                    flush()
                    stack.pop()
                    zone = stack[-1][1] if stack else 0
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    zone = stack[-1][1] if stack else 0
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            if close is None:
                at = len(page)
            else:
                end = page.find(">", close.end() - 1)
                at = len(page) if end < 0 else end + 1
            continue
        if tag in VOID:
            parts.append(" " if tag == "br" else "")
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            inner = _zone(tag, m[3], zone)
            if inner != zone:  # an inline element of its own kind, such as a sponsored span
                flush()
                stack.append((tag, inner))
                zone = inner
            continue
        flush()
        if stack and stack[-1][0] == "p":
            stack.pop()
            zone = stack[-1][1] if stack else 0
        zone = _zone(tag, m[3], zone)
        stack.append((tag, zone))
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    where: dict[int, list[int]] = {}
    for j in range(lo, len(b) - hi):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []  # last place in b of the best chain of each length
    chains: list[tuple] = []
    for i in range(lo, len(a) - hi):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    middle, link = [], chains[-1] if chains else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(lo), *reversed(middle), *range(len(a) - hi, len(a))]


def _near(path: str, before: str | None, after: str | None) -> int:
    """-1 or 1 for the neighbour whose path is closer, 0 if there is none."""
    def shared(other: str) -> int:
        n = next((i for i, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))
        return n
    if before is None or after is None:
        return -1 if before is not None else 1 if after is not None else 0
    return -1 if shared(before) >= shared(after) else 1


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path
    except ValueError:
        return "", url or ""


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return df.withColumn("key", F.xxhash64("page_id", "url", "html")).withColumn("key2", F.hash("html", "page_id"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """(key, key2, shared): places, among a page's lines outside articles, of those it shares with the page of the nearest URL.

    Only hashes of lines are sorted by URL, in ranges, so that a large host is spread over many tasks. Pages of one host that
    follow each other with equal lines are one run, and a run's neighbours are the page before and the page after it; the outer
    two runs at each end of a range are shown to the other ranges by one page each.
    """
    @F.pandas_udf("host string, path string, whole long, hashes array<long>")
    def view(urls: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for u, t in zip(urls, texts):
            found = lines(t)
            whole = xxhash.xxh3_64_intdigest("\n".join(f"{z}{x}" for x, z in found)) - (1 << 63)
            out.append((*_place(u), whole, [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x, z in found if z == 0]))
        return pd.DataFrame(out, columns=["host", "path", "whole", "hashes"])

    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select("key", "key2", view("url", "html").alias("v")).select("key", "key2", "v.*")
    rows = cut_lineage(rows.repartitionByRange(n, "host", "path", "key", "key2").sortWithinPartitions("host", "path", "key", "key2"))

    def outer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: list[tuple] = []  # first page of the first and of the second run
        last: list[tuple] = []  # last page of the last run but one and of the last
        for pdf in parts:
            for row in pdf[["host", "path", "whole", "hashes"]].itertuples(index=False, name=None):
                if len(first) < 2 and (not first or not _same(first[-1], row)):
                    first.append(row)
                last = [*last[-1:], row] if last and not _same(last[-1], row) else [*last[:-1], row]
        me = TaskContext.get().partitionId()
        out = [(me, end, at, *row) for end, side in ((0, first), (1, last)) for at, row in enumerate(side)]
        yield pd.DataFrame(out, columns=["part", "end", "at", "host", "path", "whole", "hashes"])

    # four rows per range at most
    ends = rows.mapInPandas(outer, "part int, end int, at int, host string, path string, whole long, hashes array<long>").collect()
    ends = sorted((r.part, r.end, r.at, r.host, r.path, r.whole, list(r.hashes)) for r in ends)
    share = pages.sparkSession.sparkContext.broadcast(ends)

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        me = TaskContext.get().partitionId()
        before = [x[3:] for x in share.value if x[0] < me and x[1] == 1]
        after = [x[3:] for x in share.value if x[0] > me and x[1] == 0]
        last = run = None  # page before the run; a page of the run
        held: list[tuple] = []  # keys and path of the run's pages
        out: list[tuple] = []

        def work(following):
            a = last if last and last[0] == run[0] else None
            b = following if following and following[0] == run[0] else None
            common: dict[int, list[int]] = {}
            for key, key2, path in held:
                side = _near(path, a and a[1], b and b[1])
                if side and side not in common:
                    common[side] = common_lines(list(run[3]), list((a if side < 0 else b)[3]))
                if side and common[side]:
                    out.append((key, key2, common[side]))

        for pdf in parts:
            for key, key2, *row in pdf[["key", "key2", "host", "path", "whole", "hashes"]].itertuples(index=False, name=None):
                if run is None:
                    last = next((x for x in reversed(before) if not _same(x, row)), None)
                elif not _same(run, row):
                    work(row)
                    last, held = run, []
                run = row
                held.append((key, key2, row[1]))
            yield pd.DataFrame(out, columns=["key", "key2", "shared"])
            out.clear()
        if run is not None:
            work(next((x for x in after if not _same(x, run)), None))
            yield pd.DataFrame(out, columns=["key", "key2", "shared"])

    return cut_lineage(rows.mapInPandas(compare, "key long, key2 int, shared array<int>").dropDuplicates(["key", "key2"]))


def _same(a: tuple, b: tuple) -> bool:
    """Whether two (host, path, hash of all lines, ...) are of one host and have equal lines."""
    return a[0] == b[0] and a[2] == b[2]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The text is the lines of articles and, of the lines outside, those that the nearest page with other lines does not share;
    where a host has no such page all of them stay. A null page is empty and has the empty text; a null url counts as a host of
    its own kind. Repeated rows each give a row. Broken markup is read as far as it goes; whole pages of any length are read.
    Extra columns are not read; an empty table gives no rows. Only pages with deleted lines are joined, all others are worked on
    where they are read.
    """
    rows = _keyed(pages, id_col, url_col, html_col)
    masks = shared_lines(rows)

    @F.pandas_udf("string")
    def text(texts: pd.Series, shared: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(texts, shared):
            gone = set() if gone is None else set(np.asarray(gone).tolist())
            outside = count()
            out.append(" ".join([x for x, z in lines(t) if z == 1 or next(outside) not in gone]))
        return pd.Series(out, dtype=object)

    rows = flag_ids(rows, id_filter(masks, F.col("key")), F.col("key"))
    plain = rows.filter(~F.col("_maybe")).select("page_id", "url", text("html", F.lit(None).cast("array<int>")).alias("text"))
    hit = rows.filter("_maybe").join(masks, ["key", "key2"], "left").select("page_id", "url", text("html", "shared").alias("text"))
    return plain.unionByName(hit).withColumn("n_chars", F.length("text").cast("long"))
