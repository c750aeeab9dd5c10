"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines of text, one per block element, without what its
markup names as furniture (menus, headers, footers, adverts, forms, comments,
scripts). Each page is then paired with the page of the same host that lies
nearest to it by URL path, and the lines of the two are aligned by a longest
common subsequence: lines in common come from the site's template, not from the
article, and are deleted.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.llm.batches import map_columns
from duskveil.plans.ordering import freeze_order, neighbours
from duskveil.plans.scratch import stash

#: Elements whose content is never text of a page.
RAW = {"script", "style", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "audio", "video"}
#: Elements that are furniture wherever they stand.
FURNITURE = {
    "head", "title", "nav", "footer", "aside", "menu", "dialog", "form", "button", "select", "textarea",
    "datalist", "fieldset", "label", "option",
}
#: Elements that are furniture outside the article.
OUTSIDE = {"header", "hgroup"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements without an end tag.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
#: Elements that do not begin a new line of text.
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr",
}
#: Words of a class, id or role that mark furniture.
MARKED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "promotion", "banner", "nav", "navbar", "navigation", "menu", "menus", "sidebar", "aside", "breadcrumb",
    "breadcrumbs", "footer", "foot", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share",
    "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "disqus", "reply",
    "replies", "respond", "pagination", "pager", "widget", "widgets", "skip", "toolbar", "search", "form",
    "copyright", "legal", "disclaimer", "contentinfo", "complementary", "toc", "tags", "hidden",
}
#: The same outside the article, where an article's own head may stand.
MARKED_OUTSIDE = {"header", "masthead", "topbar", "head", "top", "logo"}

#: A pair that shares more than this part of its characters is a copy, not a template.
COPY_SHARE = 0.5
#: Bits of a table of one alignment; beyond that it is cut in halves.
TABLE_BITS = 64_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)")


class Line:
    """One block of text: ``main`` inside an article, ``linked`` characters of links,
    ``heading`` or not, ``marked`` as furniture by its tags and attributes."""

    __slots__ = ("text", "main", "linked", "heading", "marked")

    def __init__(self, text: str, main: bool, linked: int, heading: bool, marked: bool):
        self.text, self.main, self.linked, self.heading, self.marked = text, main, linked, heading, marked

    @property
    def furniture_like(self) -> bool:
        """Mostly links, or neither a heading nor anything that ends a sentence."""
        if 2 * self.linked > len(self.text):
            return True
        return not self.heading and not _SENTENCE_END.search(self.text)


def _furniture(tag: str, attributes: str, inside: bool) -> bool:
    if tag in FURNITURE or (tag in OUTSIDE and not inside):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    marks = []
    for name, *quoted in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(quoted)
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and _NO_DISPLAY.search(value):
            return True
        if name in ("class", "id", "role"):
            marks.append(value)
    for mark in marks:
        words = {w.lower() for w in _PARTS.split(mark) if w}
        if words & MARKED or (not inside and words & MARKED_OUTSIDE):
            return tag not in MAIN or bool(words & {"comment", "comments", "related", "ad", "ads", "promo"})
    return False


def page_lines(page: str | None) -> list[Line]:
    """All lines of a page in order. Marked are those in elements that name furniture
    and, where there is an article, those outside it."""
    page = page or ""
    lines: list[Line] = []
    words: list[str] = []
    linked = inside = anchors = 0
    heading = False
    dropped, depth = "", 0  # the furniture that is open, and how often its tag is nested in it
    at = 0

    def close_line() -> None:
        nonlocal linked, heading
        text = _SPACE.sub(" ", references.unescape("".join(words))).strip()
        if text:
            lines.append(Line(text, inside > 0 and not dropped, linked, heading, bool(dropped)))
        words.clear()
        linked, heading = 0, False

    while at < len(page):
        match = _TOKEN.search(page, at)
        end = match.start() if match else len(page)
        if end > at:
            words.append(page[at:end])
            if anchors:
                linked += end - at
        if not match:
            break
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(match[1]), match[3]
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if dropped:
            # furniture that is never closed ends with the article or the next paragraph's start
            if tag not in INLINE:
                close_line()
            elif tag in ("br", "td", "th"):
                words.append(" ")
            if tag in MAIN and not closing and not _furniture(tag, attributes, False):
                dropped = ""
            elif tag == dropped or (dropped == "p" and tag not in INLINE):
                depth += -1 if closing or dropped == "p" else 1
                if depth == 0:
                    close_line()
                    was, dropped = dropped, ""
                    if was == tag and closing:
                        continue
                else:
                    continue
            elif tag == "body" and (closing or dropped in ("head", "title")):
                dropped = ""
            else:
                continue
        if tag not in INLINE:
            close_line()
        elif tag in ("br", "td", "th"):
            words.append(" ")
        if closing:
            inside -= tag in MAIN and inside > 0
            anchors -= tag == "a" and anchors > 0
            continue
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if _furniture(tag, attributes, inside > 0):
            close_line()
            dropped, depth = tag, 1
            continue
        inside += tag in MAIN
        anchors += tag == "a"
        heading = heading or tag in HEADINGS
    close_line()
    if any(line.main for line in lines):
        for line in lines:
            line.marked = not line.main
    return lines


def line_digest(line: Line) -> int:
    return int.from_bytes(hashlib.blake2b(line.text.encode(), digest_size=8).digest(), "little", signed=True)


def common_lines(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    inner_a, inner_b = a[start : len(a) - end], b[start : len(b) - end]
    in_b = set(inner_b)
    places = [i for i, x in enumerate(inner_a) if x in in_b]
    in_a = {inner_a[i] for i in places}
    found = _align([inner_a[i] for i in places], [x for x in inner_b if x in in_a])
    inner = [start + places[i] for i in found]
    return [*range(start), *inner, *range(len(a) - end, len(a))]


def _rows(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Bit rows of the alignment table: bit j of row i is 0 where the length of the
    best match of a[:i] grows between b[:j] and b[: j + 1]."""
    full = (1 << len(b)) - 1
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    row, rows = full, [full]
    for x in a:
        hits = row & where.get(x, 0)
        row = ((row + hits) | (row - hits)) & full
        rows.append(row)
    return rows


def _align(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        ahead = _lengths(a[:half], b)
        behind = _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: ahead[j] + behind[j])
        return _align(a[:half], b[:cut]) + [half + i for i in _align(a[half:], b[cut:])]
    rows = _rows(a, b)
    found = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:  # column j - 1 adds nothing to a[:i]
            j -= 1
        elif rows[i - 1] >> (j - 1) & 1 == 0 and _same(rows, i, j):
            i -= 1
        else:
            found.append(i - 1)
            i, j = i - 1, j - 1
    return found[::-1]


def _same(rows: list[int], i: int, j: int) -> bool:
    """Whether a[:i] and a[: i - 1] match equally long with b[:j]."""
    mask = (1 << j) - 1
    return (rows[i] & mask).bit_count() == (rows[i - 1] & mask).bit_count()


def _lengths(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Length of the best match of ``a`` with each ``b[:j]``."""
    full = (1 << len(b)) - 1
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    row = full
    for x in a:
        hits = row & where.get(x, 0)
        row = ((row + hits) | (row - hits)) & full
    out = [0]
    for bit in bin(row | 1 << len(b))[:2:-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def template_lines(own: dict, others: list[dict], copy_share: float = COPY_SHARE) -> list[int]:
    """Places of the lines of a page that the nearest page shares.

    ``others`` holds the pages before and after in URL order. Nearest is the
    longer common path; then the one before. A page that shares over
    ``copy_share`` of the unmarked text is a copy and gives no evidence; the other
    one is asked. Prose and headings inside an article stay: only lines there that
    look like furniture can go.
    """
    near = [o for o in others if o and o["host"] == own["host"]]
    near.sort(key=lambda o: -_common(own["path"], o["path"]))
    for other in near:
        if not other["lines"]:
            continue
        shared = common_lines(own["lines"], other["lines"])
        if sum(own["sizes"][i] for i in shared) <= copy_share * sum(own["sizes"]):
            return [i for i in shared if own["loose"][i]]
    return []


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^#]*)", 1)


def _cut_pages(pages: DataFrame, lists: bool) -> DataFrame:
    """``key, host, path, group, lines, sizes, loose, marked`` of every page; ``sizes`` are
    the characters of the lines that are not marked, ``group`` tells a host's pages
    with other lines apart."""

    def make():
        def run(keys, hosts, paths, pages):
            cut = [page_lines(p) for p in pages]
            marked = [[lists and x.marked for x in own] for own in cut]
            digests = [[line_digest(x) for x in own] for own in cut]
            return [
                keys,
                hosts,
                paths,
                [
                    hashlib.blake2b(f"{host}\n{own}".encode(), digest_size=16).hexdigest()
                    for host, own in zip(hosts, digests)
                ],
                digests,
                [[0 if m else len(x.text) for x, m in zip(own, ms)] for own, ms in zip(cut, marked)],
                [[not x.main or x.furniture_like for x in own] for own in cut],
                marked,
            ]

        return run

    schema = (
        "key string, host string, path string, group string, lines array<bigint>, sizes array<int>, "
        "loose array<boolean>, marked array<boolean>"
    )
    return map_columns(pages.select("key", "host", "path", "html"), make, schema)


def differences(pages: DataFrame, lists: bool = True, copy_share: float = COPY_SHARE) -> DataFrame:
    """``key``, the digest of a page's url and html, with the places of its lines that
    go because the nearest page has them (``shared``) and because its markup alone
    names them furniture (``listed``), and its number of ``lines``.

    The alignment sees every line of a page; the lists decide about what it
    leaves, on pages alone on their host and for furniture that differs from page
    to page. Without ``lists`` the alignment decides alone. Pages of a host with
    the same lines are aligned as one, so that each meets a page that differs.
    """
    cut = stash(_cut_pages(pages, lists))
    fields = ["host", "path", "lines", "sizes", "loose", "marked"]
    first = cut.groupBy("group").agg(F.min_by(F.struct(*fields), F.struct("path", "key")).alias("page"))
    ordered = freeze_order(
        first.select("group", "page.*"), [F.col("host"), F.col("path"), F.col("group")]
    )
    met = neighbours(ordered, [F.col(f) for f in fields])

    def make():
        def run(groups, *columns):
            *own, before, after = columns
            rows = [dict(zip(fields, values)) for values in zip(*own)]
            shared = [template_lines(r, [b, a], copy_share) for r, b, a in zip(rows, before, after)]
            listed = [
                [i for i, m in enumerate(r["marked"]) if m and i not in gone]
                for r, gone in zip(rows, map(set, shared))
            ]
            return [groups, shared, listed, [len(r["lines"]) for r in rows]]

        return run

    found = map_columns(
        met.select("group", *fields, "__before", "__after"), make,
        "group string, shared array<int>, listed array<int>, lines int",
    )
    return cut.select("key", "group").distinct().join(stash(found), "group").drop("group")


def main_text(pages: DataFrame, lists: bool = True, copy_share: float = COPY_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, in whole.

    The text joins the lines by one newline, empty if there are none; a null or
    empty ``html`` has none, a null ``url`` belongs to no host and path. Equal
    rows are one page when pages are paired, and all get its text. No pages
    give no rows; other columns are not read. ``lists`` and ``copy_share`` as in
    ``differences``.

    What is ordered and compared are digests of lines. The pages themselves
    move once at most, to meet the lines they share; what the lists say is read
    off the page again.
    """
    url, page = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    keyed = pages.select(
        "page_id",
        "url",
        page.alias("html"),
        F.md5(F.concat_ws("\n", url, page)).alias("key"),
        _host(url).alias("host"),
        _path(url).alias("path"),
    )
    gone = differences(keyed, lists, copy_share).where(F.size("shared") > 0).select("key", "shared")

    def make_text():
        def run(ids, urls, pages, drops):
            texts = []
            for page, drop in zip(pages, drops):
                out = set(drop or ())
                own = [x.text for i, x in enumerate(page_lines(page)) if i not in out and not (lists and x.marked)]
                texts.append("\n".join(own))
            return [ids, urls, texts, [len(t) for t in texts]]

        return run

    joined = keyed.join(stash(gone), "key", "left").select("page_id", "url", "html", "shared")
    return map_columns(joined, make_text, "page_id bigint, url string, text string, n_chars bigint")
