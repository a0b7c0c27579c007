"""Queries of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import pages as P
from .overlay import source
from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql


@_R.add()
def sc7_articles(spark, sf_dir):
    return P.articles(source(spark, sf_dir, "pages")).select("page_id", "title", "body")


@_R.add(r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages""")
def k18_page_title(spark, sf_dir):
    html = F.col("html")
    return source(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count(html, F.lit("<p[ >]")).cast("long").alias("paragraphs"))


@_R.add()
def sc8_links(spark, sf_dir):
    p = source(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(P.links(F.col("html"), F.col("url"), ".")).alias("place", "link"))


BARE = "regexp_replace(url, '[?#].*$', '')"
IDS = ", ".join(f"nullif(regexp_extract({BARE}, '{p}', 1), '')" for p in P.ID_PATTERNS)
SLUGS = f"""SELECT page_id, coalesce({IDS}) AS id, coalesce(nullif(trim(translate(regexp_replace(regexp_replace(last_, '-\\d{{6,}}$', ''), '^\\d+$', ''), '-', ' ')), ''), nullif(last_, ''), url) AS slug
    FROM (SELECT *, regexp_extract({BARE}, '([^/]*)/?$', 1) AS last_ FROM pages) p"""


@_R.add(SLUGS)
def k19_url_ids(spark, sf_dir):
    """Ids and words in the pages' addresses."""
    return source(spark, sf_dir, "pages").select("page_id", P.id_from_url(F.col("url")).alias("id"), P.title_from_slug(F.col("url")).alias("slug"))
