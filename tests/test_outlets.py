"""Each outlet's listing as a saved page, addresses of listings, and the log of fetched listings."""

import json

import pytest

from civicfeed.sources import connector, outlets

RSS = "<rss><channel><item><title>{t}</title><link>{u}</link><pubDate>Wed, 03 Jan 2024 10:00:00 +0300</pubDate></item></channel></rss>"
# the key, the page's address, the page, (id, title, date) of its articles
PAGES = [
    ("tass", "https://tass.ru/sitemap/sitemap_news1.xml", "<urlset><url><loc>https://tass.ru/obschestvo/19650001</loc><lastmod>2024-01-05T10:00:00Z</lastmod></url><url><loc>https://tass.ru/about</loc></url></urlset>", [("19650001", "19650001", "2024-01-05 10:00:00")]),
    ("tass", "https://tass.ru/rss/v2.xml", RSS.format(t="Событие", u="https://tass.ru/a/19650002"), [("19650002", "Событие", "2024-01-03 07:00:00")]),
    ("ria", "https://ria.ru/20240105/", '<a href="/20240105/moskva-1919000001.html">Москва</a> <a href="https://ria.ru/20240105/moskva-1919000001.html?in=t">снова</a><a href="/tag/x/">тег</a>', [("1919000001", "Москва", "2024-01-05 00:00:00")]),
    ("kommersant", "https://www.kommersant.ru/archive/?date=2024-01-05", '<a class="uho" href="/doc/6431234?from=main"><b>Заголовок</b> дня</a><a href="/rubric/6">x</a>', [("6431234", "Заголовок дня", None)]),
    ("m24", "https://www.m24.ru/rss.xml", RSS.format(t="Город", u="https://www.m24.ru/news/03012024/655001"), [("655001", "Город", "2024-01-03 07:00:00")]),
    ("msk1", "https://msk1.ru/text/?page=2", '<a href="/text/gorod/2024/01/05/73000001/"></a><a href="/text/gorod/2024/01/05/73000001/comments/">12</a>', [("73000001", "73000001", "2024-01-05 00:00:00")]),
    ("mskagency", "https://www.mskagency.ru/lenta", '<div class="r" data-material_id="3301" data-datei="20240105"><span class="time">9:05</span><a class="title" href="/m">Дом &quot;на&quot; Мира</a></div><div data-material_id="3301" data-datei="20240105"><a href="/m">ещё</a></div><div data-material_id="3302" data-datei="05.01.2024"><span class="time">10:15</span><a href="/n"> Второй</a></div>', [("3301", 'Дом "на" Мира', "2024-01-05 09:05:00"), ("3302", "Второй", "2024-01-05 10:15:00")]),
    ("pik_comfort", "https://pik-comfort.ru/news_all", '<a href="/news123">Отключение</a><a href="/news_all">все</a>', [("123", "Отключение", None)]),
    ("granel", "https://www.ggkm.ru/news/page/2/", '<a href="/news/remont-lifta/">5 января 2024 Ремонт лифта</a><a href="/news/page/3/">3</a><a href="/news/dolzhniki/">x</a>', [("remont-lifta", "Ремонт лифта", "2024-01-05 00:00:00")]),
    ("zhil_nagatino", "https://www.gbuns.ru/organizacia/novosti?start=10", '<a href="/organizacia/novosti/12-news/345-otkluchenie-vody">12 января, 2024 Вода</a>', [("345", "Вода", "2024-01-12 00:00:00")]),
    ("gbu_portal", "https://gbu-zhilishchnik.ru/novosti", '<a href="/novosti/77-uborka.html">Уборка</a>', [("77", "Уборка", None)]),
    ("moek", "https://www.moek.ru/press/news/2024/02/", "<a href='/press/news/2024/02/881/'>Тепло</a>", [("881", "Тепло", "2024-02-29 12:00:00")]),
]


@pytest.mark.parametrize("key,url,html,want", PAGES, ids=[f"{p[0]}-{i}" for i, p in enumerate(PAGES)])
def test_saved_page(spark, key, url, html, want):
    pages = spark.createDataFrame([(url, html), (url + "#none", "<p>nothing</p>")], "url string, html string")
    if key in ("tass", "m24"):
        pages = pages.limit(1)
    got = outlets.listed(pages, key)
    assert got.columns == [f.split()[0] for f in outlets.SCHEMA.split(", ")]
    rows = got.withColumn("published_at", got["published_at"].cast("string")).collect()
    assert sorted((r.external_id, r.title, r.published_at) for r in rows) == want and all(r.source_key == key and r.url.startswith("https://") for r in rows)


def test_all_outlets_have_pages():
    assert {p[0] for p in PAGES} == set(outlets.OUTLETS) == set(connector.WALKS)


def test_addresses_of_listings():
    found = {k: [outlets.listing_url(k, c) for c in cursors] for k, cursors in {"ria": ["20240105"], "kommersant": ["20240105"], "msk1": ["1", "3"], "zhil_nagatino": ["1", "3"], "moek": ["2024-02"], "gbu_portal": [None, "2"], "pik_comfort": ["1"]}.items()}
    assert found == {
        "ria": ["https://ria.ru/20240105/"], "kommersant": ["https://www.kommersant.ru/archive/?date=2024-01-05"], "msk1": ["https://msk1.ru/rss-feeds/rss.xml", "https://msk1.ru/text/?page=3"],
        "zhil_nagatino": ["https://www.gbuns.ru/organizacia/novosti", "https://www.gbuns.ru/organizacia/novosti?start=20"], "moek": ["https://www.moek.ru/press/news/2024/02/"],
        "gbu_portal": ["https://gbu-zhilishchnik.ru/novosti", "https://gbu-zhilishchnik.ru/novosti?page=2"], "pik_comfort": ["https://pik-comfort.ru/news_all"],
    }


@pytest.mark.parametrize("uri", [False, True])
def test_replay_reads_the_log(tmp_path, uri):
    """A page that changes between a read and its replay does not change the batch."""
    page, log = tmp_path / "1.jsonl", tmp_path / "log"
    options = {"path": str(tmp_path), "source_key": "msk1", "log": f"file://{log}" if uri else str(log)}
    row = lambda n: json.dumps({"external_id": str(n), "title": f"т{n}\n"}) + "\n"
    page.write_text(row(1) + row(2))
    reader = connector.ListingReader(options, "page")
    start = reader.initialOffset()
    first, end = reader.read(start)
    first = list(first)
    page.write_text(row(9))
    assert list(connector.ListingReader(options, "page").readBetweenOffsets(start, end)) == first and len(first) == 2
    page.unlink()
    assert list(reader.readBetweenOffsets(start, end)) == first
    # an empty listing is logged too, and other listings are fetched
    assert connector.fetch(options, "2") == []
    (tmp_path / "2.jsonl").write_text(row(3))
    assert connector.fetch(options, "2") == [] and connector.fetch(options | {"log": str(tmp_path / "other")}, "2")[0]["external_id"] == "3"


def test_dated_listings_read_the_log(tmp_path):
    options = {"path": str(tmp_path), "source_key": "ria", "today": "2024-01-02", "since": "2024-01-01", "log": str(tmp_path / "log")}
    (tmp_path / "20240102.jsonl").write_text(json.dumps({"external_id": "1", "title": "a"}) + "\n")
    reader = connector.DatedReader(options, "day")
    once = [list(reader.read(p)) for p in reader.partitions({"read": 0}, {"read": 2})]
    (tmp_path / "20240102.jsonl").write_text("")
    assert [list(reader.read(p)) for p in reader.partitions({"read": 0}, {"read": 2})] == once and once[0][0][1] == "1" and once[1] == []
