"""Main text of web pages by differencing pages of neighbouring URLs.

A page is cut into blocks of text. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms, comments and
hidden parts are marked by their elements. Within each host the pages are ordered by the path of their URL, and each is
aligned with its neighbours there by the longest common subsequence of lines; lines that they share belong to the site and
are deleted. Near copies of an article stand on one host, and differencing them would delete the article itself: a neighbour
that has at least half of the characters inside a page's article (or main) elements deletes nothing there. A page with such an element
gives what is left of its lines, and what is left outside only if that is longer than the article, which then is a teaser;
a page without gives what neither its elements nor its neighbours mark.

Defined results: null or empty html gives the empty text; a null URL has no neighbours; repeated rows: rows with the same
page_id are not each other's neighbours; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul noscript template button select".split())
#: Elements with an end tag that HTML doesn't let one leave out: only these are followed as containers.
_NEST = set("address article aside blockquote details dialog div dl fieldset figure footer form header hgroup main menu nav ol section table ul noscript template button select span svg object video audio canvas head".split())
_SKIP = set("nav footer aside form noscript template button select svg object video audio canvas dialog menu head".split())
_WORDS = set("ad ads advert adverts advertisement advertising banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices popup modal promo promotion sponsor sponsored share sharing social related comment comments reply replies disqus newsletter subscribe pagination pager copyright masthead toolbar widget skip".split())
_OWN = set("article post entry content story main".split())
_CUT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)}


def _boilerplate(name: str, raw: str, in_main: bool) -> bool:
    if name in _SKIP or (name == "header" and not in_main):
        return True
    if not raw or raw.isspace():
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if a.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert"):
        return True
    words = {w for k in ("class", "id") for w in _CUT.split(a.get(k, "").lower()) if w}
    return bool(words & _WORDS) or ("header" in words and not in_main and not words & _OWN)


def blocks(page: str | None) -> tuple[list[tuple[str, int]], bool]:
    """(text, zone) of each block in page order: 0 boilerplate by its elements, 1 other, 2 in an article; whether there is an article."""
    out: list[tuple[str, int]] = []
    if not page:
        return out, False
    stack: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    skip = main = 0
    found = False

    def flush() -> None:
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, 0 if skip else 2 if main else 1))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, raw = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if name in _BLOCK:
                flush()
            if name in _NEST and any(x[0] == name for x in stack):
                flush()
                while True:
                    x = stack.pop()
                    skip -= x[1]
                    main -= x[2]
                    if x[0] == name:
                        break
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name == "br":
            text.append(" ")
        if name in _BLOCK:
            flush()
        if name in _VOID or raw.endswith("/") and name not in _BLOCK:
            continue
        if name == "body":
            while stack and stack[-1][0] == "head":
                skip -= stack.pop()[1]
        if name in _NEST:
            is_main = name in ("article", "main")
            b = _boilerplate(name, raw, bool(main))
            if b or is_main:
                flush()
            found |= is_main and not b and not skip
            stack.append((name, b, is_main))
            skip += b
            main += is_main
        elif name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "section") and raw.strip() and _boilerplate(name, raw, bool(main)):
            # to the element's end tag or the next block
            flush()
            end = re.compile(rf"</?(?:{name}|{'|'.join(sorted(_BLOCK))})\b", re.I).search(page, at)
            at = end.start() if end else n
    flush()
    return out, found


def lcs(a: list[str], b: list[str]) -> list[int]:
    """Indices of the lines of a in a longest common subsequence with b; rows of bits, read back from the last."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def shared(lines: list[str], neighbours: list[list[str]]) -> set[int]:
    """Indices of the lines shared with a neighbour."""
    return {i for other in neighbours for i in lcs(lines, other)}


def own_text(lines: list[str], zones: list[int], neighbours: list[tuple[list[str], list[int]]]) -> str:
    """What a page's elements and its neighbours leave of it. zones: as blocks() has them, without 2 if there is no article."""
    inside = {i for i, z in enumerate(zones) if z == 2}
    article = sum(len(lines[i]) for i in inside)
    gone: set[int] = set()
    for other, kinds in neighbours:
        # a page without an article may be a plain copy of the neighbour's
        common = shared(lines, [other if inside else [t for t, z in zip(other, kinds) if z != 2]])
        if 2 * sum(len(lines[i]) for i in common & inside) >= article:
            common -= inside
        gone |= common
    outside = {i for i, z in enumerate(zones) if z == 1} - gone
    left = inside - gone
    if not inside or sum(len(lines[i]) for i in outside) > article:
        left |= outside
    return "\n".join(lines[i] for i in sorted(left))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    import pyarrow as pa

    bound_batches(pages.sparkSession, 500)

    address = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 0)
    place = (F.lower(F.regexp_extract(address, r"//([^/?#]*)", 1)).alias("host"), F.regexp_extract(address, r"//[^/?#]*(.*)$", 1).alias("path"))
    # ranges by their first and last keys, one row a range; only URLs are read for that
    key = F.struct("host", "path", "page_id")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as Spark would join ranges of so few bytes
    ranged = pages.select(*place, "page_id").repartitionByRange(n, "host", "path", "page_id")
    ends = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).select("lo.*", *[F.col(f"hi.{c}").alias(f"{c}2") for c in ("host", "path", "page_id")]).collect()
    order = lambda host, path, page_id: (host, path, page_id is not None, page_id or 0)
    los, his = (sorted(order(*r[i : i + 3]) for r in ends) for i in (0, 3))

    def parse(batches):
        for b in batches:
            rows = [[] for _ in range(8)]
            for page_id, url, h, host, path in zip(*(c.to_pylist() for c in b.columns)):
                k = order(host, path, page_id)
                part = bisect_right(los, k) - 1
                own, found = blocks(h)
                lines, zones = [t for t, _ in own], [z if found else min(z, 1) for _, z in own]
                # a range's first and last page go to the ranges beside it too
                beside = [part - 1] * (k == los[part] and part > 0) + [part + 1] * (k == his[part] and part + 1 < len(los))
                for to in [part, *beside]:
                    for column, x in zip(rows, (page_id, url, lines, zones, host, path, to, to != part)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds)], ["page_id", "url", "lines", "zones", "host", "path", "part", "beside"])

    kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.string(), pa.string(), pa.int32(), pa.bool_()]
    parsed = pages.select("page_id", "url", "html", *place).mapInArrow(parse, "page_id long, url string, lines array<string>, zones array<tinyint>, host string, path string, part int, beside boolean")
    ordered = parsed.repartitionById(max(1, len(los)), "part").sortWithinPartitions("part", "host", "path", "page_id")

    def difference(batches):
        def rows():
            for b in batches:
                yield from b.select(["page_id", "url", "lines", "zones", "host", "part", "beside"]).to_pylist()

        def text(before, row, after):
            near = [(x["lines"], x["zones"]) for x in (before, after) if x and x["part"] == row["part"] and row["host"] and x["host"] == row["host"] and x["page_id"] != row["page_id"]]
            return own_text(row["lines"], row["zones"], near)

        done: list[tuple] = []
        before = row = None
        for after in rows():
            if row is not None and not row["beside"]:
                done.append((row["page_id"], row["url"], text(before, row, after)))
            before, row = row, after
            if len(done) >= 500:
                yield _out(pa, done)
                done = []
        if row is not None and not row["beside"]:
            done.append((row["page_id"], row["url"], text(before, row, None)))
        if done:
            yield _out(pa, done)

    return ordered.mapInArrow(difference, "page_id long, url string, text string, n_chars long")


def _out(pa, rows: list[tuple]):
    ids, urls, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
