"""Raw HTML pages -> title, main text, links, metadata.

*Main text.*  A page is a row of blocks: what stands between the starts and ends of block
elements.  A block is furniture if it lies in an element of navigation (:data:`FURNITURE`,
by tag, role, class or id), or if more than half of its characters are links; cells of
tables and headings outside furniture are always kept.  If an article or main element holds
a quarter of what is left, only what lies in one counts.  A page of furniture alone gives
all its text: recall comes first.

*Malformed pages.*  Any string parses: unknown declarations are comments, and if the parser
gives up, what it read so far stands and ``parse_error`` is in the metadata."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.shipping import ship_package

LINKS, BLOCKS = 500, 20
_text, _texts = T.StringType(), T.ArrayType(T.StringType())
PAGE = T.StructType([T.StructField("title", _text), T.StructField("text", _text), T.StructField("links", _texts), T.StructField("metadata", T.MapType(_text, _text)), T.StructField("json_ld", _texts)])
#: Elements whose text is not shown.
SILENT = ("script", "style", "noscript", "template", "svg")
#: Elements that end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags, roles, and words of classes and ids, of what surrounds a page's content.
FURNITURE = frozenset("nav navigation menu footer aside sidebar banner breadcrumb breadcrumbs cookie cookies consent newsletter subscribe share sharing social related advert advertisement ads ad promo sponsored pagination pager".split())
CONTENT = ("article", "main")


class Forgiving(HTMLParser):
    """A parser that reads any string: unknown marked sections are comments."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.failed = False

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def read(self, html: str) -> None:
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError, IndexError, OverflowError, RecursionError):
            self.failed = True


class _Page(Forgiving):
    def __init__(self) -> None:
        super().__init__()
        self.silent, self.linked, self.within = 0, 0, ""
        self.title, self.hrefs, self.meta, self.scripts = None, [], {}, []
        self.open: list[tuple[str, bool, bool]] = []  # tag, furniture, content
        #: Finished blocks: text, characters in links, furniture, content, always kept.
        self.blocks: list[tuple[str, int, bool, bool, bool]] = []
        self.parts: list[str] = []
        self.in_links = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tags = {t for t, _, _ in self.open}
            kept = bool(tags & {"td", "th", "h1", "h2", "h3"})
            self.blocks.append((text, self.in_links, any(f for _, f, _ in self.open), any(c for _, _, c in self.open), kept))
        self.parts, self.in_links = [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in BLOCK:
            self._flush()
        if tag in SILENT:
            self.silent += 1
            if tag == "script" and (a.get("type") or "").strip().lower() == "application/ld+json":
                self.within = "ld"
                self.scripts.append("")
        elif tag == "title" and self.title is None and not self.silent:
            self.within, self.title = "title", ""
        elif tag == "a":
            self.linked += 1
            if a.get("href") is not None:
                self.hrefs.append(a["href"])
        elif tag == "meta" and a.get("content") and (name := a.get("property") or a.get("name")):
            self.meta[name.casefold()] = a["content"]  # the last one counts
        elif tag == "link" and "canonical" in (a.get("rel") or "").lower().split() and a.get("href"):
            self.meta.setdefault("canonical", a["href"])
        if tag in BLOCK and tag not in VOID:
            words = {tag, (a.get("role") or "").lower(), *re.split(r"[\s_-]+", f"{a.get('class') or ''} {a.get('id') or ''}".lower())}
            self.open.append((tag, not words.isdisjoint(FURNITURE), tag in CONTENT or (a.get("role") or "").lower() == "main"))

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._flush()
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "a":
            self.linked = max(0, self.linked - 1)
        if tag in SILENT or tag == "title":
            self.within = ""
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:  # what was left open inside ends, too
                pass

    def handle_data(self, data):
        if self.within == "ld":
            self.scripts[-1] += data
        elif self.within == "title":
            self.title += data
        elif not self.silent:
            self.parts.append(data)
            if self.linked:
                self.in_links += len(" ".join(data.split()))

    def main_text(self) -> str:
        self._flush()
        kept = [b for b in self.blocks if not b[2] and (b[4] or 2 * b[1] <= len(b[0]))]
        inside = [b for b in kept if b[3]]
        size = lambda blocks: sum(len(b[0]) for b in blocks)
        if inside and 4 * size(inside) >= size(kept):
            kept = inside
        return "\n".join(b[0] for b in kept or self.blocks)


def _loaded(block: str) -> list:
    """The values of a JSON-LD block; a list counts as its members."""
    try:
        value = json.loads(block)
    except (ValueError, RecursionError):
        return []
    return value if isinstance(value, list) else [value]


def _is_event(value) -> bool:
    return isinstance(value, dict) and str(value.get("@type") or "").casefold() == "event"


def parse(html: str | None, base: str | None) -> tuple:
    page = _Page()
    page.read(html or "")
    if "canonical" in page.meta:
        page.meta["canonical"] = _joined(base, page.meta["canonical"]) or page.meta["canonical"]
    links = dict.fromkeys(u for h in page.hrefs if (u := _joined(base, h)).startswith(("http://", "https://")))
    items = [v for s in page.scripts for v in _loaded(s)]
    title = " ".join((page.title or "").split())
    if event := next(filter(_is_event, items), None):
        page.meta["event_json_ld"] = json.dumps(event, ensure_ascii=False, separators=(",", ":"))
        title = title or str(event.get("name") or "")
    if page.failed:
        page.meta["parse_error"] = "true"
    return title or None, page.main_text(), list(links)[:LINKS], page.meta, [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in items[:BLOCKS]]


def _joined(base: str | None, href: str) -> str:
    try:
        return urljoin(base or "", href.strip())
    except ValueError:
        return ""


def _text_only(value):
    """Lone surrogates, which escapes can make, as question marks."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode()
    if isinstance(value, dict):
        return {_text_only(k): _text_only(v) for k, v in value.items()}
    return [_text_only(v) for v in value] if isinstance(value, list) else value


def parse_html(html: Column, base: Column) -> Column:
    """Everything that a page's markup says, in one pass; an event among its JSON-LD
    blocks is ``event_json_ld`` of the metadata, and names a page without a title."""
    ship_package()
    return _parse_html(html, base)


@F.pandas_udf(PAGE)
def _parse_html(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([list(map(_text_only, parse(h, b))) for h, b in zip(html, base, strict=True)], columns=["title", "text", "links", "metadata", "json_ld"])


def title_of(html: Column) -> Column:
    """Title by pattern alone, for pages that are known to be plain."""
    return F.nullif(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def hrefs_of(html: Column) -> Column:
    """Distinct quoted href values in order, by pattern alone."""
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)), 1, LINKS)


def usable(text: Column, metadata: Column, links: Column, topic: Column, action: Column) -> Column:
    """Enough text, or an event block, or a topic with something to do about it."""
    form = F.exists(links, lambda u: u.contains("forms.gle") | u.contains("docs.google.com/forms"))
    return (F.char_length(F.trim(text)) >= 400) | F.coalesce(metadata["event_json_ld"].isNotNull(), F.lit(False)) | (topic & (action | form))


def failure_of(status: Column) -> Column:
    return F.when(status == 401, "AUTH_REQUIRED").when(status == 403, "FORBIDDEN").when(status == 404, "NOT_FOUND").when(status == 429, "RATE_LIMITED").when(status >= 500, "SERVER_ERROR")


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def social_image(metadata: Column) -> Column:
    """The first web address among the image members of a page's metadata."""
    named = F.array(*(metadata[k] for k in ("og:image", "og:image:secure_url", "twitter:image", "twitter:image:src")))
    return F.get(F.filter(named, lambda u: F.coalesce(F.lower(u).rlike("^https?://"), F.lit(False))), 0)
