"""Pages and feeds: RSS, sitemaps, links, article pages, listings, dates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Month names, the patterns of article ids in addresses, words of logos.
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
ID_PATTERNS = [r"/doc/(\d+)", r"/materials/(\d+)", r"/news/\d{8}/(\d+)", r"/text/[^/]+/\d{4}/\d{2}/\d{2}/(\d+)/?", r"/(\d{5,})/?$", r"-(\d{6,})\.html?", r"/(\d{6,})\.html?"]


def id_from_url(url: Column) -> Column:
    """The first article id that a pattern finds in an address without its query."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.coalesce(*[F.nullif(F.regexp_extract(bare, p, 1), F.lit("")) for p in ID_PATTERNS])


def title_from_slug(url: Column) -> Column:
    """The last part of an address's path as words."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1)
    words = F.trim(F.translate(F.regexp_replace(F.regexp_replace(last, r"-\d{6,}$", ""), r"^\d+$", ""), "-", " "))
    return F.coalesce(F.nullif(words, F.lit("")), F.nullif(last, F.lit("")), url)


def parse_time(c: Column) -> Column:
    """ISO or RFC 822 times; the name of the weekday is not read."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")))


def parse_ru_date(c: Column) -> Column:
    """D3: DD.MM.YYYY [HH:MM], "21 сентября 2026[, HH:MM]", else D2."""
    dotted = r"(\d{2})\.(\d{2})\.(\d{4})(?:\s+(\d{2}):(\d{2}))?"
    named = r"(?u)(\d{1,2})\s+([А-Яа-яЁё]+)\s+(\d{4})(?:\s*,?\s*(\d{1,2}):(\d{2}))?"
    part = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit("")).cast("int")
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(c, named, 2))), F.lit(0)).cast("int")
    zero = F.lit(0)
    one = F.try_make_timestamp(part(dotted, 3), part(dotted, 2), part(dotted, 1), F.coalesce(part(dotted, 4), zero), F.coalesce(part(dotted, 5), zero), zero)
    two = F.try_make_timestamp(part(named, 3), month, part(named, 1), F.coalesce(part(named, 4), zero), F.coalesce(part(named, 5), zero), zero)
    return F.coalesce(one, two, parse_time(c))


ITEM = "array<struct<title:string, link:string, guid:string, pubDate:string, description:string, enclosure:struct<_url:string>>>"


def rss_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """SC5, X10: one row for each item of RSS texts, with its id; items without id or title are left out."""
    parsed = F.from_xml(F.col(xml), F.lit(f"channel struct<item:{ITEM}>"))
    rows = feeds.withColumn("i", F.explode(parsed["channel"]["item"]))
    link, guid = F.trim("i.link"), F.trim("i.guid")
    raw = F.when((F.length(guid) <= 64) & ~guid.contains("://"), guid)
    key = F.left(F.coalesce(id_from_url(link), id_from_url(guid), raw), F.lit(96))
    out = rows.select(key.alias("external_id"), F.trim("i.title").alias("title"), link.alias("url"), parse_time(F.col("i.pubDate")).alias("published_at"), strip_html(F.col("i.description")).alias("body"), F.col("i.enclosure._url").alias("image_url"))
    return out.filter("external_id IS NOT NULL AND title <> ''")


def sitemap(xml: Column) -> Column:
    """SC6: the (loc, lastmod) of a sitemap text, newest first, undated last."""
    urls = F.from_xml(xml, F.lit("url array<struct<loc:string, lastmod:string>>"))["url"]
    typed = F.transform(urls, lambda u: F.struct(F.trim(u["loc"]).alias("loc"), parse_time(u["lastmod"]).alias("lastmod")))
    return F.array_sort(typed, lambda a, b: F.when(a["lastmod"] > b["lastmod"], -1).when(a["lastmod"] < b["lastmod"], 1).when(a["lastmod"].isNull() & b["lastmod"].isNotNull(), 1).when(a["lastmod"].isNotNull() & b["lastmod"].isNull(), -1).otherwise(0))


def strip_html(c: Column) -> Column:
    """Text without tags, the common entities read, white space collapsed."""
    out = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def links(html: Column, base: Column, pattern: str) -> Column:
    """SC8: addresses of links that match, made absolute, each once in the order of the page."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]+)"""), F.lit(1))
    host = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_extract(base, r"^(.*/)", 1)
    absolute = F.transform(found, lambda u: F.when(u.rlike("^[a-z]+://"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(host, u)).otherwise(F.concat(folder, u)))
    return F.array_distinct(F.filter(absolute, lambda u: u.rlike(pattern)))


def listing_rows(html: Column) -> Column:
    """SC10: (material_id, day, time) of listing rows that carry data attributes."""
    ids = F.regexp_extract_all(html, F.lit(r'data-material_id="(\d+)"'), F.lit(1))
    days = F.regexp_extract_all(html, F.lit(r'data-datei="([^"]+)"'), F.lit(1))
    times = F.regexp_extract_all(html, F.lit(r'class="time"[^>]*>\s*(\d{2}:\d{2})'), F.lit(1))
    return F.arrays_zip(ids.alias("material_id"), days.alias("day"), times.alias("time"))


# Metas of a page's picture and date, the parts of a page that are its article, and what marks a date.
IMAGE_METAS = ["og:image", "twitter:image", "vk:image"]
DATE_METAS = ["article:published_time", "pubdate", "publish_date"]
CONTENT_CLASSES = {"article__text", "article__content", "js-mediator-article"}
DATE_CLASSES = {"date", "article__date", "news-date"}
ISO_STAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
VOID = {"br", "img", "link", "input", "hr", "meta", "source", "wbr"}


class _Article(HTMLParser):
    """The title, heading, metas, paragraphs of the article (else of the page), pictures, linked data and dates."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, whether it holds the article, whether it holds a date
        self.meta: dict[str, str] = {}
        self.text: dict[str, list[str]] = {"title": [], "h1": [], "article": [], "page": []}
        self.marked: list[str] = []
        self.pictures: list[str] = []
        self.linked: list[str] = []
        self.dates: list[str] = []
        self.time: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = set(a.get("class", "").split())
        if tag == "meta" and a.get("content"):
            self.meta.setdefault(a.get("property") or a.get("name") or a.get("itemprop", ""), a["content"])
        if a.get("itemprop") == "image" or (tag == "link" and a.get("rel") == "image_src"):
            self.marked.append(a.get("content") or a.get("href") or a.get("src") or "")
        if tag == "img" and any(inside for _, inside, _ in self.stack):
            self.pictures.append(a.get("src") or "")
        if tag == "time" and a.get("datetime"):
            self.time = self.time or a["datetime"]
        if tag == "script" and a.get("type") == "application/ld+json":
            self.linked.append("")
        if tag not in VOID:
            dated = tag == "time" or bool(classes & DATE_CLASSES)
            if dated:
                self.dates.append("")
            self.stack.append((tag, tag == "article" or bool(classes & CONTENT_CLASSES) or a.get("itemprop") == "articleBody", dated))
            if tag == "p":
                self.text["article" if any(t == "article" for t, _, _ in self.stack) else "page"].append("")

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        tags = [t for t, _, _ in self.stack]
        if tags and tags[-1] in ("script", "style"):
            if tags[-1] == "script" and self.linked:
                self.linked[-1] += data
            return
        if any(d for _, _, d in self.stack) and self.dates:
            self.dates[-1] += data
        for tag in ("title", "h1"):
            if tag in tags:
                self.text[tag].append(data)
        if "p" in tags:
            into = self.text["article" if "article" in tags else "page"]
            if into:
                into[-1] += data

    def date(self) -> str | None:
        """The first of the metas, the linked data's datePublished, any stamp there, the page's times and dates."""
        stamps = [x for text in self.linked for x in (*re.findall(r'"datePublished"\s*:\s*"([^"]+)"', text)[:1], *re.findall(ISO_STAMP, text)[:1])]
        shown = [" ".join(d.split()) for d in self.dates]
        found = [*(self.meta.get(k) for k in DATE_METAS), *stamps, self.meta.get("datePublished"), self.time, *shown]
        return next((x for x in found if x), None)

    def images(self) -> list[str]:
        """X11: pictures in the order in which they are tried: of metas, marked as the page's, of the article."""
        return [x.strip() for x in (*(self.meta.get(k) or "" for k in IMAGE_METAS), *self.marked, *self.pictures) if x.strip()]


def read_article(html: str | None) -> tuple[str | None, str | None, list[str], str | None]:
    """SC7: title, body, pictures and date of a page, each by its first source that has one; a broken page gives what it has."""
    p = _Article()
    p.feed(html or "")
    join = lambda parts: " ".join(" ".join(parts).split()) or None
    paragraphs = [t for t in (" ".join(x.split()) for x in p.text["article"] or p.text["page"]) if t][:12]
    title = p.meta.get("og:title") or join(p.text["h1"]) or join(p.text["title"])
    body = "\n".join(paragraphs) or p.meta.get("og:description") or p.meta.get("description")
    return title, body, p.images(), p.date()


def articles(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """SC7, X11, D4: ``pages`` with title, body, image_url and published_at, read in Arrow batches.

    The picture is the first that is of the web, made absolute by the page's ``url``, and no mark of the site.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [read_article(x) for x in f[html]]
            images = [[urljoin(base or "", x) for x in g[2]] for g, base in zip(got, f[url], strict=True)]
            yield f.drop(columns=[html]).assign(cf_title=[g[0] for g in got], cf_body=[g[1] for g in got], cf_images=images, cf_date=[g[3] for g in got])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html]
    rows = pages.mapInPandas(read, ", ".join([*kept, "cf_title string, cf_body string, cf_images array<string>, cf_date string"]))
    image = F.get(F.filter("cf_images", lambda u: u.rlike("^https?://") & ~T.is_logo(u)), 0)
    own = [c for c in pages.columns if c not in (html, "title", "body", "image_url", "published_at")]
    return rows.select(*own, F.col("cf_title").alias("title"), F.col("cf_body").alias("body"), image.alias("image_url"), parse_ru_date(F.col("cf_date")).alias("published_at"))
