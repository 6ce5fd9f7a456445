"""Main text of web pages by differencing each page with its neighbour by URL.

Pages are ordered by host and URL path; a page's partner is the neighbour in
its task with the longer common path prefix (the one before on a tie).  Both
pages are read as lines (one per block of markup), the lines are aligned by
their longest common subsequence, and shared lines are deleted: what two near
pages of a site have in common is the site's frame.

What the markup itself says is used beside that.  Regions marked as menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or
comments never become lines of the text.  Where a page marks its article
(``article`` or ``main``) the text comes from there, and such lines are safe
from the deletion: two near pages can quote the same passage, or be copies.
Where a page has no such mark and everything would go, as for copies, the
lines stay.

The order is a range partitioning of (host, path, id), so a host that holds
many pages is spread over tasks; at the edge of a task's range a page pairs
with its other neighbour.  A task holds three pages at a time.

Defined cases: a null or empty page has an empty text; a null URL has an empty
host and path and pairs with its like; repeated pages pair with each other; a
page without neighbour loses no line; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthaudit.functions.shipping import ship_package
from synthaudit.llm.common import schema_of

# fixed values: element names of the HTML standard
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FRAME = {"nav", "header", "footer", "aside", "menu", "form", "button", "select", "textarea", "input", "fieldset",
         "script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "dialog",
         "audio", "video"}
CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "article", "section", "main", "blockquote", "pre", "h1", "h2", "h3",
            "h4", "h5", "h6", "form", "nav", "header", "footer", "aside", "hr", "figure", "address", "fieldset"}
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog",
               "menu", "menubar", "toolbar", "status"}
#: words of a class or id that mark a region which is no part of an article
FRAME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored",
               "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
               "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "nav",
               "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside",
               "widget", "header", "masthead", "footer", "colophon", "copyright", "share", "sharing", "social",
               "related", "recommended", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply",
               "reactions", "toolbar", "search", "pagination", "pager", "skip", "hidden", "form"}
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_frame(tag: str, attrs: dict, in_article: bool) -> bool:
    if tag in FRAME:
        return not (tag == "header" and in_article)
    if tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in FRAME_ROLES:
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
        return True
    named = " ".join(_CAMEL.sub(" ", attrs.get(k) or "") for k in ("class", "id"))
    return not FRAME_WORDS.isdisjoint(_WORDS.findall(named.lower()))


class _Lines(HTMLParser):
    """``lines``: (text, in the frame, in a marked article) per block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, bool, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []       # tag, in the frame, in an article
        self.text: list[str] = []

    def _state(self) -> tuple[bool, bool]:
        return self.open[-1][1:] if self.open else (False, False)

    def _break(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        if line:
            self.lines.append((line, *self._state()))

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._break()
        if tag in CLOSES_P:
            self._close_one("p", {"article", "section", "div", "main", "td", "th", "li", "body", "table", "blockquote"})
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            peers = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
                     "td": {"td", "th"}, "th": {"td", "th"}}[tag]
            for peer in peers:
                self._close_one(peer, {"ul", "ol", "dl", "select", "table", "tbody", "thead", "menu"} | ({"tr"} - {tag}))
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        frame, article = self._state()
        own = {k: v or "" for k, v in attrs}
        frame = frame or _is_frame(tag, own, article)
        article = article or tag in ("article", "main") or own.get("role") in ("main", "article")
        self.open.append((tag, frame, article))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)
        else:
            self.handle_starttag(tag, attrs)           # HTML ignores the slash

    def _close_one(self, tag: str, barrier: set) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._break()
                del self.open[k:]
                return
            if self.open[k][0] in barrier:
                return

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._break()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if any(t not in INLINE for t, _, _ in self.open[k:]):
                    self._break()
                del self.open[k:]
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return                                  # a stray end of inline markup closes no block

    def handle_data(self, data):
        if data:
            self.text.append(data)

    def done(self) -> list[tuple[str, bool, bool]]:
        self.close()
        self._break()
        return self.lines


def page_lines(html: str | None) -> list[tuple[str, bool, bool]]:
    reader = _Lines()
    reader.feed(html or "")
    return reader.done()


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by
    bit-parallel rows (one big integer per line of ``a``)."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = set(range(lead)) | set(range(len(a) - tail, len(a)))
    a, b = a[lead:len(a) - tail], b[lead:len(b) - tail]
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    rows, row, full = [], (1 << len(b)) - 1, (1 << len(b)) - 1
    for line in a:                 # a zero bit j: the subsequence grows at b[j]
        match = row & where.get(line, 0)
        row = ((row + match) | (row - match)) & full
        rows.append(row)
    length = lambda i, j: j - ((rows[i - 1] & ((1 << j) - 1)).bit_count()) if i and j else 0
    i, j = len(a), len(b)
    while i and j:
        here = length(i, j)
        if not here:
            break
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.add(lead + i)
    return found


def main_text(lines: list[tuple[str, bool, bool]], partner: list[tuple[str, bool, bool]] | None) -> str:
    shared = common_lines([x[0] for x in lines], [x[0] for x in partner]) if partner else set()
    body = [(k, text, article) for k, (text, frame, article) in enumerate(lines) if not frame]
    if any(article for _, _, article in body):
        return "\n".join(text for _, text, article in body if article)
    own = [text for k, text, _ in body if k not in shared]
    return "\n".join(own or [text for _, text, _ in body])


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def _paired(pages: Iterator[tuple]) -> Iterator[tuple[dict, str]]:
    """Each page of an ordered stream with the text that its nearer neighbour leaves."""
    before, here = None, None
    for after in pages:
        if here is not None:
            yield here[0], _difference(before, here, after)
        before, here = here, after
    if here is not None:
        yield here[0], _difference(before, here, None)


def _difference(before, here, after) -> str:
    near = [p for p in (before, after) if p is not None and p[1] == here[1]]
    partner = max(near, key=lambda p: _near(p[2], here[2]), default=None)      # the first on a tie
    return main_text(here[3], partner[3] if partner else None)


def _compress_rows(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            b = batch.slice(i, 256)
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), b.column("host"), b.column("path"),
                 pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary()),
                 pa.array([len(x) for x in raw], pa.int64())],
                names=["page_id", "url", "host", "path", "blob", "size"])


def _extract_rows(batches):
    def pages():
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for r in batch.slice(i, 64).to_pylist():
                    html = pa.decompress(r["blob"], decompressed_size=r["size"], codec="zstd", asbytes=True) if r["size"] else b""
                    yield (r["page_id"], r["url"]), r["host"], r["path"], page_lines(html.decode("utf-8", "replace"))

    ids, urls, texts, held = [], [], [], 0
    for (page, url), text in _paired(pages()):
        ids.append(page)
        urls.append(url)
        texts.append(text)
        held += len(text)
        if held > 1 << 22:
            yield ids, urls, texts
            ids, urls, texts, held = [], [], [], 0
    yield ids, urls, texts


def _text_rows(kind):
    def run(batches):
        for ids, urls, texts in _extract_rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(urls, pa.string()),
                                              pa.array(texts, pa.string())], names=["page_id", "url", "text"])
    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for each row of ``pages``."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(pages.sparkSession)
    kind = pages.schema["page_id"].dataType
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"),
                        F.lower(F.substring_index(bare, "/", 1)).alias("host"),
                        F.regexp_replace(bare, r"^[^/]*", "").alias("path"),
                        F.col("html").cast("string").alias("html"))
    # compressed before they move: pages are the bulk of the data
    packed = rows.mapInArrow(_compress_rows, schema_of(("page_id", kind), ("url", "string"), ("host", "string"),
                                                       ("path", "string"), ("blob", "binary"), ("size", "long")))
    keys = ["host", "path", "page_id"]
    return packed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        _text_rows(to_arrow_type(kind)), schema_of(("page_id", kind), ("url", "string"), ("text", "string")))
