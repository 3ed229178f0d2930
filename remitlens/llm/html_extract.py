"""Main text of web pages: named page furniture and the templates of a site are cut out of the element tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import digest, look_up, staged, text_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><]*)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/><]*)[^><]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DIGIT = re.compile(r"[0-9]")
NAME_PARTS = re.compile(r"[a-z0-9]+")
INNER = re.compile(r"[-_]+")

#: elements whose content isn't markup; none of it is text of the page
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
         "caption", "figure", "figcaption"}
#: a start tag that ends an open element of the same family
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "audio", "video", "canvas"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: words of class and id names that mark furniture
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
         "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
         "breadcrumbs", "footer", "masthead", "comment", "comments", "disqus", "replies", "share", "sharing", "social", "related", "toolbar", "pagination", "pager"}


#: words that say where or what kind of box a name means, and nothing of what it holds
PLACES = {"site", "page", "global", "main", "top", "bottom", "left", "right", "header", "wrapper", "wrap", "container", "box", "bar", "block", "area", "list", "item", "items",
          "widget", "banner", "button", "buttons", "link", "links", "inner", "outer", "primary", "secondary", "content", "section", "panel", "slot", "unit"}


@dataclass
class Frame:
    tag: str
    at: int
    skip: bool
    main: bool
    prose: bool
    exact: xxhash.xxh64 = field(default_factory=xxhash.xxh64)
    shape: xxhash.xxh64 = field(default_factory=xxhash.xxh64)
    link_chars: int = 0
    chars: int = 0


@dataclass
class Subtree:
    at: int
    to: int
    exact: int
    shape: int
    main: bool
    prose: bool
    links: bool
    block: bool


@dataclass
class Page:
    """Pieces of text in page order (a block break is None) and the element subtrees over them."""

    pieces: list[str | None] = field(default_factory=list)
    kept: list[bool] = field(default_factory=list)
    in_main: list[bool] = field(default_factory=list)
    subtrees: list[Subtree] = field(default_factory=list)

    @property
    def has_main(self) -> bool:
        return any(self.in_main)

    def candidates(self) -> Iterator[tuple[int, Subtree]]:
        """Hashes that may show a template. Prose of the main part is never one, however often a site repeats it, nor is an inline
        element: links and bold words belong to the text they stand in. A subtree's shape, its
        tags and names without its text, counts outside the main part, or where it is mostly links on a page without one."""
        main = self.has_main
        for s in self.subtrees:
            if not s.block:
                continue
            if not (s.main and s.prose):
                yield s.exact, s
            if (main and not s.main) or (not main and s.links):
                yield s.shape, s

    def text(self, templates: set[int] = frozenset()) -> str:
        kept, main = list(self.kept), self.has_main
        for value, s in self.candidates() if templates else ():
            if value in templates:
                kept[s.at : s.to] = [False] * (s.to - s.at)
        return " ".join("".join(" " if p is None else p for p, k, m in zip(self.pieces, kept, self.in_main) if p is None or (k and (m or not main))).split())


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" \t\n\r\f/") else {}


def _marks(name: str) -> bool:
    """Whether a whole class or id name means furniture: one of NAMES, alone or with words for places ("site-footer", but not "related-work")."""
    parts = set(INNER.split(name)) - {""}
    return bool(parts & NAMES) and parts <= NAMES | PLACES


def _is_furniture(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_main):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    if tag in ("html", "body", "main", "article") and not NAMES & {"comment", "comments", "replies"} & set(NAME_PARTS.findall(attrs.get("class", "").lower())):
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    marks = [_marks(name) for name in names if not set(INNER.split(name)) <= PLACES]
    # within the main part only an element that has no other name: what a writer calls "social history" is text
    return bool(marks) and (all(marks) if in_main else any(marks))


def read_page(html: str) -> Page:
    """The pieces and subtrees of a page, in one pass. Open elements end as a browser ends them; stray end tags are ignored."""
    page, stack, open_tags, at = Page(), [Frame("", 0, False, False, False)], {}, 0

    def text(source: str) -> None:
        if source:
            top = stack[-1]
            said = unescape(source) if "&" in source else source
            page.pieces.append(said)
            page.kept.append(not top.skip)
            page.in_main.append(top.main and not top.skip)
            top.exact.update(" ".join(said.split()).encode("utf-8", "surrogatepass"))
            top.chars += len(said)
            if "a" in open_tags and open_tags["a"] > 0:
                top.link_chars += len(said)

    def brk() -> None:
        page.pieces.append(None)
        page.kept.append(True)
        page.in_main.append(False)

    def close() -> None:
        f = stack.pop()
        open_tags[f.tag] -= 1
        if f.tag not in INLINE:
            brk()
        exact, shape, up = f.exact.digest(), f.shape.digest(), stack[-1]
        up.exact.update(exact)
        up.shape.update(shape)
        up.chars += f.chars
        up.link_chars += f.link_chars
        if f.chars and not f.skip:
            page.subtrees.append(Subtree(f.at, len(page.pieces), f.exact.intdigest() >> 1, f.shape.intdigest() >> 1, f.main, f.prose, 2 * f.link_chars > f.chars, f.tag not in INLINE))

    def close_to(tags: set[str], within: set[str] | None) -> None:
        """End the innermost open element of ``tags``, unless one of ``within`` (None: any block) lies between."""
        if not any(open_tags.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    close()
                return
            if stack[k].tag not in INLINE if within is None else stack[k].tag in within:
                return

    size = len(html)
    while at < size:
        m = TOKEN.search(html, at)
        text(html[at : m.start() if m else size])
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, ends = tag.lower(), m["end"] or m["end2"]
        inline = tag in INLINE
        if ends:
            if tag == "br":
                brk()
            elif inline:
                close_to({tag}, None)
            else:
                close_to({tag}, {"article", "main", "body", "html"} - {tag} if tag in ("p", "li", "div", "section") else set())
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            brk()
            continue
        if tag in VOID:
            if not inline:
                brk()
            continue
        if not inline:
            brk()
            close_to({"p"}, {"article", "main", "body", "html", "div", "section", "td", "th", "li", "blockquote"})
            if tag in ENDS:
                close_to(ENDS[tag], {"ul", "ol", "dl", "table", "select", "article", "main"})
        top = stack[-1]
        attrs = _attributes(m["attrs"] or "")
        main = top.main or ((tag in ("article", "main") or attrs.get("role") == "main") and not top.skip)
        skip = top.skip or _is_furniture(tag, attrs, top.main)
        if m["attrs"] and m["attrs"].endswith("/") and inline:
            continue
        frame = Frame(tag, len(page.pieces), skip, main, top.prose or tag in PROSE or (inline and top.main))
        name = " ".join((tag, attrs.get("class", ""), attrs.get("id", ""))).encode("utf-8", "surrogatepass")
        frame.exact.update(name)
        frame.shape.update(name)
        stack.append(frame)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    while len(stack) > 1:
        close()
    return page


def subtree_rows(page: Page) -> list[tuple[int, int]]:
    """Each candidate hash of a page once, with a sketch of all other text on the page: the sum of the hashes of its pieces outside the subtree.

    Furniture and the values of digits don't count, so copies that differ in a date or a counter have one sketch."""
    sums, total = [0], 0
    for p, k in zip(page.pieces, page.kept):
        if p and k and (words := DIGIT.sub("0", " ".join(p.split()))):
            total += xxhash.xxh64_intdigest(words.encode("utf-8", "surrogatepass"))
        sums.append(total)
    out = {}
    for value, s in page.candidates():
        out.setdefault(value, (total - sums[s.to] + sums[s.at]) & ((1 << 63) - 1))
    return list(out.items())


def main_text(pages: DataFrame, min_pages: float = 10.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url, ``text`` and ``n_chars`` (code points) of every row of ``pages``.

    The text is that of the page's articles or main part (without one: of the body) less furniture told by tag, role, class or id, and less subtrees
    that recur on ``min_pages`` pages of the host, copies of a page (equal outside the subtree but for digits and furniture) counting as one. White space is joined, blocks are joined by
    a space. A null or empty html gives an empty text; a null url is the host ''; repeated rows come back as often as they came;
    other columns are ignored; no rows give no rows.
    """
    html = text_of(html_col)
    host = F.lower(F.coalesce(F.try_parse_url(F.col(url_col), F.lit("HOST")), F.lit("")))
    keyed = pages.select(host.alias("host"), digest(host, html).alias("key"), html.alias("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, html in enumerate(batch.column("html")):
                if rows := subtree_rows(read_page(html.as_py())):
                    same = lambda c: pa.array([batch.column(c)[k].as_py()] * len(rows), batch.schema.field(c).type)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same("host"), same("key"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                                                     ["host", "key", "value", "sketch"])

    seen = staged(keyed.mapInArrow(hashes, "host string, key binary, value bigint, sketch bigint"))
    kinds = seen.groupBy("host", "value", "sketch").agg(F.count("*").alias("c"))
    templates = staged(kinds.groupBy("host", "value").agg(F.sum("c").alias("n"), F.count("*").alias("pages"))
                       .where(F.col("pages") >= min_pages).select("host", "value", "n"))
    on_page = staged(look_up(seen.select("host", "value", "key"), templates, ["host", "value"], "inner", spread="key").groupBy("key").agg(
        F.collect_set("value").alias("templates"), F.count("*").alias("n")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), digest(host, html).alias("key"), F.xxhash64(id_col).alias("spread"))
    met = look_up(rows, on_page, ["key"], "left", spread="spread").select("id", "url", "html", "templates")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read_page(h.as_py()).text(set(t.as_py() or ())) for h, t in zip(batch.column("html"), batch.column("templates"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    types = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    out = met.mapInArrow(extract, f"id {types['id']}, url {types['url']}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
