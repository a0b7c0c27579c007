"""The eleven outlets (CN1 to CN11): where their listings are, and what a saved listing page says."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pages as P

SCHEMA = "source_key string, external_id string, title string, url string, published_at timestamp"


@dataclass(frozen=True)
class Outlet:
    """``first`` is the newest listing and ``later`` the one of a cursor, which has the names of its parts in braces.

    ``kind`` says what a listing is: rss, sitemap, links or rows. Of links, those that match ``link`` and not ``skip`` are
    articles; ``number`` finds their id (group 1), else it is the last part of the address (``slug``) or a hash of it.
    ``dated`` finds year, month and day in an address; with two groups, the last day of a month at noon is meant.
    """

    kind: str
    first: str
    later: str
    link: str = ""
    skip: str = "(?!)"
    number: str = "(?!)"
    slug: bool = False
    dated: str = "(?!)"
    dated_title: bool = False


# The outlets' addresses and the patterns of their articles' addresses.
OUTLETS = {
    "tass": Outlet("sitemap", "https://tass.ru/rss/v2.xml", "https://tass.ru/sitemap/sitemap_news{number}.xml", number=r"/(\d{5,})/?$"),
    "ria": Outlet("links", "https://ria.ru/export/rss2/index.xml", "https://ria.ru/{year}{month}{day}/", r"(?i)(?:ria\.ru|riaru\.online)/\d{8}/", number=r"-(\d{6,})\.html?", dated=r"/(\d{4})(\d{2})(\d{2})/"),
    "kommersant": Outlet("links", "https://www.kommersant.ru/rubric/6", "https://www.kommersant.ru/archive/?date={year}-{month}-{day}", r"/doc/\d+", number=r"/doc/(\d+)"),
    "m24": Outlet("rss", "https://www.m24.ru/rss.xml", "https://www.m24.ru/news/{day}{month}{year}/{number}", number=r"/news/\d{8}/(\d+)"),
    "msk1": Outlet("links", "https://msk1.ru/rss-feeds/rss.xml", "https://msk1.ru/text/?page={number}", r"/text/[^/]+/\d{4}/\d{2}/\d{2}/\d+/?", number=r"/text/[^/]+/\d{4}/\d{2}/\d{2}/(\d+)/?", dated=r"/text/[^/]+/(\d{4})/(\d{2})/(\d{2})/"),
    "mskagency": Outlet("rows", "https://www.mskagency.ru/lenta", "https://www.mskagency.ru/materials/{number}"),
    "pik_comfort": Outlet("links", "https://pik-comfort.ru/news_all", "https://pik-comfort.ru/news_all", r"/news(?:_all|\d+)$|/news\d+", "/news_all", r"/news(\d+)/?$"),
    "granel": Outlet("links", "https://www.ggkm.ru/news/", "https://www.ggkm.ru/news/page/{number}/", r"(?i)/news/[a-z0-9\-]+/?$", "/news/(?:page|dolzhniki)", slug=True, dated_title=True),
    "zhil_nagatino": Outlet("links", "https://www.gbuns.ru/organizacia/novosti", "https://www.gbuns.ru/organizacia/novosti?start={offset}", r"(?i)/organizacia/novosti/\d+-news/\d+-[a-z0-9\-]+", number=r"(?i)/(\d+)-[a-z0-9\-]+/?$", dated_title=True),
    "gbu_portal": Outlet("links", "https://gbu-zhilishchnik.ru/novosti", "https://gbu-zhilishchnik.ru/novosti?page={number}", r"(?i)/novosti/\d+-[a-z0-9\-]+\.html", number=r"(?i)/novosti/(\d+)-", dated_title=True),
    "moek": Outlet("links", "https://www.moek.ru/press/news/", "https://www.moek.ru/press/news/{year}/{month}/", r"(?i)/press/news/\d{4}/\d{2}/\d+/?", number=r"/press/news/\d{4}/\d{2}/(\d+)/?", dated=r"/press/news/(\d{4})/(\d{2})/"),
}
LEADING_DATE = r"(?iu)^\d{1,2}\s+[а-яё]+\s*,?\s*\d{4}\s+"
MATERIAL = "https://www.mskagency.ru/materials/"


def listing_url(source_key: str, cursor: str | None) -> str:
    """The address of a listing: the newest without a cursor or for page 1, else that of a day, month, page, id or sitemap."""
    outlet = OUTLETS[source_key]
    if cursor in (None, "", "1") and "{number}" in outlet.later + "{number}" * ("{offset}" in outlet.later):
        return outlet.first
    digits = "".join(c for c in (cursor or "") if c.isdigit())
    page = (cursor or "1").split(":")[0]
    parts = {"year": digits[:4], "month": digits[4:6], "day": digits[6:8], "number": page, "offset": str(max(0, int(digits or 1) - 1) * 10)}
    return outlet.later.format(**parts)


def _dated(outlet: Outlet, url: Column) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(url, outlet.dated, i), F.lit("")).cast("int")
    if outlet.dated.count("(") == 3:
        return F.try_make_timestamp(part(1), part(2), part(3), F.lit(0), F.lit(0), F.lit(0))
    if outlet.dated.count("(") == 2:
        first = F.try_make_timestamp(part(1), part(2), F.lit(1), F.lit(12), F.lit(0), F.lit(0))
        last = F.dayofmonth(F.last_day(first))
        return F.try_make_timestamp(part(1), part(2), last, F.lit(12), F.lit(0), F.lit(0))
    return F.lit(None).cast("timestamp")


def anchors(html: Column, base: Column) -> Column:
    """(url, title) of a page's links in its order, absolute, with their texts; None for no text."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["'][^"'#]+[^>]*>.*?</a>"""), F.lit(0))
    url = lambda a: F.get(P.links(a, base, ""), 0)
    return F.transform(found, lambda a: F.struct(url(a).alias("url"), F.nullif(P.strip_html(a), F.lit("")).alias("title")))


def listed(pages: DataFrame, source_key: str) -> DataFrame:
    """CN1 to CN11: the articles (SCHEMA) of saved listings (url, html), each id once with its first title in page order.

    Titles that a link does not have come from the address; dates that it does not have are null. A page without articles
    gives no rows.
    """
    outlet = OUTLETS[source_key]
    of = lambda df: df.select(F.lit(source_key).alias("source_key"), *[f.split()[0] for f in SCHEMA.split(", ")[1:]])
    if outlet.kind == "rss":
        return of(P.rss_items(pages.select(F.col("html").alias("xml"))))
    if outlet.kind == "sitemap":
        feeds = pages.filter(F.col("html").contains("<rss"))
        items = of(P.rss_items(feeds.select(F.col("html").alias("xml"))))
        rows = pages.filter(~F.col("html").contains("<rss")).select(F.explode(P.sitemap(F.col("html"))).alias("e")).select(F.col("e.loc").alias("url"), F.col("e.lastmod").alias("published_at"))
        number = F.nullif(F.regexp_extract("url", outlet.number, 1), F.lit(""))
        return items.unionByName(of(rows.withColumns({"external_id": number, "title": P.title_from_slug(F.col("url"))}).filter(F.col("external_id").isNotNull())))
    if outlet.kind == "rows":
        return of(materials(pages))
    rows = pages.select("url", F.posexplode(anchors(F.col("html"), F.col("url"))).alias("at", "a")).select(F.col("url").alias("page"), "at", "a.*")
    rows = rows.filter(F.col("url").rlike(outlet.link) & ~F.col("url").rlike(outlet.skip)).withColumn("url", F.regexp_replace("url", r"[?#].*$", ""))
    number = F.nullif(F.regexp_extract("url", outlet.number, 1), F.lit(""))
    slug = F.left(F.regexp_extract("url", r"([^/]+)/?$", 1), F.lit(96)) if outlet.slug else F.lit(None).cast("string")
    rows = rows.withColumn("external_id", F.coalesce(number, slug, F.left(F.sha1(F.col("url").cast("binary")), F.lit(16))))
    bare = F.regexp_replace("title", LEADING_DATE, "") if outlet.dated_title else F.col("title")
    stamp = F.coalesce(P.parse_ru_date(F.regexp_replace("title", r"\s*,\s*(?=\d{4})", " ")), _dated(outlet, F.col("url"))) if outlet.dated_title else _dated(outlet, F.col("url"))
    rows = rows.withColumns({"published_at": stamp, "title": F.coalesce(F.nullif(F.trim(bare), F.lit("")), P.title_from_slug(F.col("url")))})
    first = rows.groupBy("external_id").agg(F.min_by(F.struct("title", "url", "published_at"), F.struct("page", "at")).alias("x"))
    return of(first.select("external_id", "x.*"))


def materials(pages: DataFrame) -> DataFrame:
    """CN6, X14: the rows of a listing that carry a material's number, day and time; titles unescaped, each number once."""
    block = r"""(?is)<[^>]+data-material_id="\d+".*?(?=<[^>]+data-material_id="|\z)"""
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(block), F.lit(0))).alias("at", "b"))
    part = lambda p: F.nullif(F.trim(F.regexp_extract("b", p, 1)), F.lit(""))
    number, day, clock = part(r'data-material_id="(\d+)"'), part(r'data-datei="([^"]+)"'), part(r'(?s)class="time"[^>]*>[^<]*?(\d{1,2}:\d{2})')
    title = P.strip_html(F.coalesce(part(r'(?is)<a\s[^>]*class="[^"]*title[^"]*"[^>]*>(.*?)</a>'), part(r"(?is)<a\s[^>]*>(.*?)</a>")))
    dotted = F.when(day.rlike(r"^\d{8}$"), F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})$", "$3.$2.$1")).otherwise(day)
    when = P.parse_ru_date(F.concat_ws(" ", dotted, F.lpad(clock, 5, "0")))
    typed = rows.select(F.col("url").alias("page"), "at", number.alias("external_id"), title.alias("title"), F.concat(F.lit(MATERIAL), number).alias("url"), when.alias("published_at"))
    kept = typed.filter(F.col("title") != "").groupBy("external_id").agg(F.min_by(F.struct("title", "url", "published_at"), F.struct("page", "at")).alias("x"))
    return kept.select("external_id", "x.*")
