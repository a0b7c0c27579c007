"""Ordered operators against plain folds; records; streams; files."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from civicfeed.operators import addresses, chat, dedup, feed, records
from civicfeed.sources import cursors, files, pages
from civicfeed.streaming import chat_state


def test_feed_dedupe_keeps_the_first_position(spark):
    rng = random.Random(3)
    for by in ("weight", "distance"):
        data = [(i, rng.choice([f"A notice of kind {i % 3}", None]), "b", "mc", rng.choice([None, f"z:{i % 4}:addr:{i}"]), rng.randint(1, 5) / 10, rng.choice([None, rng.randint(1, 3) * 1.0])) for i in range(40)]
        df = spark.createDataFrame(data, "id long, title string, body string, source string, source_msg_id string, weight double, distance double")
        got = [r.id for r in feed.dedupe_feed(df, by).orderBy("pos").collect()]
        better = (lambda r: (r[6] is None, r[6] or 0, -r[5], -r[0])) if by == "distance" else (lambda r: (-r[5], -r[0]))
        rows = sorted(data, key=lambda r: (-r[5], -r[0]))
        for key in (lambda r: r[4] and r[4].split(":addr:")[0], lambda r: r[1] and r[1].lower()):
            place, out = {}, []
            for r in rows:
                k = key(r)
                if k is None:
                    out.append(r)
                elif k not in place:
                    place[k] = len(out)
                    out.append(r)
                elif better(r) < better(out[place[k]]):
                    out[place[k]] = r
            rows = out
        assert got == [r[0] for r in rows]


def test_pages_follow_each_other(spark):
    rows = spark.createDataFrame([(i, float(i % 7) / 10) for i in range(30)], "id long, weight double")
    rows = rows.withColumn("pos", F.struct((-F.col("weight")).alias("w"), (-F.col("id")).alias("i")))
    seen, mark = [], None
    for _ in range(10):
        got = feed.page(rows, 4, None if mark is None else F.lit(mark)).orderBy("n").collect()
        seen += [r.id for r in got]
        mark = got[-1].next_cursor if got else None
        if mark is None:
            break
    assert seen == [r.id for r in rows.orderBy("pos").collect()]


def test_flood_against_a_fold(spark):
    rng = random.Random(5)
    data = [(i, rng.randint(0, 2), rng.randint(0, 400)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, k long, ts long")
    got = {r.id: r.flood for r in chat.flooded(df, ["k"], "ts", "id").collect()}
    past = {}
    for i, k, ts in sorted(data, key=lambda r: (r[2], r[0])):
        hits = past[k] = [t for t in past.get(k, []) if t >= ts - 90] + [ts]
        assert got[i] == (len(hits) > 3)


def test_photo_against_a_fold(spark):
    rng = random.Random(8)
    data = [(f"{i:03}", 1, rng.choice([None, 1, 2]), rng.randint(0, 9000), rng.choice([None, "", "text"]), rng.choice([None, f"u{i}"])) for i in range(150)]
    df = spark.createDataFrame(data, "message_id string, chat_id long, sender_user_id long, ts_sec long, text string, image_url string")
    got = {r.message_id: (r.image_url, r.action) for r in chat.pending_photos(df).collect()}
    held = {}
    for m, c, u, ts, text, url in sorted(data, key=lambda r: (r[3], r[0])):
        if u is None or not (text or url):
            continue
        if url and not text:
            held[u] = (url, ts)
            want = (url, "hold_photo")
        else:
            w = held.pop(u, None)
            want = (w[0], "attached") if w and not url and ts - w[1] <= 600 else (url, "passthrough")
        assert got[m] == want


def test_streams_agree_with_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rng = random.Random(4)
    data = [(1, f"{i:03}", rng.choice([1, 2]), rng.choice(["hi there", None]), rng.choice([None, f"u{i}"]), start + timedelta(seconds=rng.randint(0, 900))) for i in range(80)]
    df = spark.createDataFrame(data, "chat_id long, message_id string, sender_user_id long, text string, image_url string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    batch = df.withColumn("ts_sec", F.unix_seconds("ts")).withColumn("norm", F.coalesce("text", F.lit("")))
    for name, streamed, want in (
        ("flood", chat_state.floods(stream()), chat.flooded(batch, ["chat_id", "sender_user_id", "norm"], "ts_sec", "message_id").select("chat_id", "message_id", "flood")),
        ("photo", chat_state.pending_photos(stream()), chat.pending_photos(batch).select("chat_id", "message_id", "image_url", "action")),
        ("once", chat_state.once(stream(), ["message_id"]).select("message_id"), df.select("message_id")),
    ):
        q = streamed.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        key = lambda r: tuple("" if x is None else str(x) for x in r)
        assert sorted(map(key, spark.table(name).collect())) == sorted(map(key, want.collect()))


def test_high_water_writes_once(spark, tmp_path):
    spark.range(10).withColumn("k", F.col("id") % 4).write.parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    spark.createDataFrame([(0,)], "k long").write.parquet(target)
    rows = spark.readStream.schema("id long, k long").parquet(str(tmp_path / "in"))
    q = chat_state.high_water(rows, lambda b, _: b.select("k").write.mode("append").parquet(target), str(tmp_path / "cp"), lambda: spark.read.parquet(target), ["k"])
    q.awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3]


def test_known_streak_and_margin(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate([0, 1, 0, 1, 1, 0, 1])], "s long, i long, known long")
    assert [r.i for r in records.first_streak(rows, ["s"], "i", F.col("known") == 1, 2).orderBy("i").collect()] == [0, 1, 2, 3, 4]
    scores = spark.createDataFrame([("a", 95.0), ("a", 92.0), ("b", 95.0), ("b", 80.0), ("c", 50.0)], "k string, score double")
    assert [r.k for r in records.by_margin(scores, ["k"], "score", 90.0, 5.0).collect()] == ["b"]


def test_bind_and_lookup(spark):
    a = spark.createDataFrame([(1, "М", "улица Мира", "1"), (2, "М", "улица Мира", "2к1"), (3, "М", "Садовая улица", "7")], "id long, city string, street string, house string")
    d = spark.createDataFrame([(1, "М", "ул. Мира", "2 корпус 1"), (2, "М", "Мира", "99"), (3, "М", None, None), (4, "Т", "Мира", None)], "draft_id long, city string, street string, house string")
    assert {r.draft_id: (r.address_id, r.geo_by) for r in addresses.bind(d, a).collect()} == {1: (2, "home"), 2: (1, "street"), 3: (1, "city"), 4: (None, None)}
    h = spark.createDataFrame([(1, "на Садовой", "7"), (2, "Садовая", "7"), (3, "Нет такой", None)], "hint_id long, hint string, house string")
    found = {r.hint_id: (r.address_id, r.geo_by) for r in addresses.lookup(h, a).collect()}
    assert found[2] == (3, "home") and 3 not in found


def test_resolve(spark):
    v = [1.0, 0.0]
    e = spark.createDataFrame([(1, "news", "t:1", "a", "b", None, v)], "id long, source string, source_msg_id string, title string, body string, address_id long, v array<double>")
    d = spark.createDataFrame([(10, "news", "t:1", "x", "y", None, [0.0, 1.0]), (11, "news", "t:2", "x", "y", None, v), (12, "mc", None, "x", "y", 5, [0.0, 1.0])], e.schema)
    got = {r.id: (r.action, r.match_id) for r in dedup.resolve(d, e).collect()}
    assert got[10] == ("duplicate", 1) and got[11] == ("duplicate", 1) and got[12][0] == "new"


def test_address_file(spark, tmp_path):
    lines = ['{"address_text": "a", "latitude": 55.1, "longitude": 37.1, "postal_code": "123456"}', '{"address_text": "b", "latitude": 95, "longitude": 37.1}', "nonsense"]
    lines += ['{"address_text": "c", "latitude": 1, "longitude": 2}', '{"address_text": "c", "latitude": 1, "longitude": 3}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    good, bad = files.addresses(spark, str(tmp_path / "a.jsonl"))
    assert [r.address_text for r in good.collect()] == ["a"]
    assert sorted(r.error for r in bad.collect()) == ["conflicting address_text", "conflicting address_text", "latitude", "not JSON"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), "a int, b string, c int").collect())) == [(1, None), (2, "x")]
    assert files.manifest(df, "a").first().with_b == 1


def test_rss_and_sitemap(spark):
    xml = "<rss><channel><item><title>One</title><link>https://a.b/doc/12345</link><pubDate>Wed, 02 Oct 2024 15:00:00 +0300</pubDate><description>&lt;p&gt;x&lt;/p&gt;</description><enclosure url='i.jpg'/></item><item><title>Two</title></item></channel></rss>"
    got = pages.rss_items(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(r.external_id, r.title, str(r.published_at), r.body, r.image_url) for r in got] == [("12345", "One", "2024-10-02 12:00:00", "x", "i.jpg")]
    site = "<urlset><url><loc>a</loc></url><url><loc>b</loc><lastmod>2024-01-02</lastmod></url><url><loc>c</loc><lastmod>2024-01-03</lastmod></url></urlset>"
    found = spark.createDataFrame([(site,)], "x string").select(pages.sitemap(F.col("x")).alias("s")).first().s
    assert [u["loc"] for u in found] == ["c", "b", "a"]


def test_article():
    html = "<html><head><title>T</title><meta property='og:image' content='i'></head><body><h1>H</h1><p>out</p><article><p>one <b>two</b></p><p></p></article><time datetime='2024'>x</time></body></html>"
    assert pages.read_article(html) == ("H", "one two", ["i"], "2024")
    assert pages.read_article(None) == (None, None, [], None)


def test_cursors():
    assert cursors.next_day("20240301", date(2024, 3, 5), date(2024, 2, 28)) == (date(2024, 3, 1), "20240229")
    assert cursors.next_day("20240228", date(2024, 3, 5), date(2024, 2, 28))[1] is None
    assert cursors.next_month("2024-01", date(2024, 3, 5), date(2023, 12, 1)) == ("2024-01", "2023-12")
    assert cursors.next_page("2", 0, False, 0, 2) == "3" and cursors.next_page("2", 0, False, 1, 2) is None
    assert cursors.next_probe(5, False, 49) == (None, 50) and cursors.next_probe(5, True, 49) == (4, 0)
    assert cursors.next_sitemap("1:40", 50, 20, 0) == "2:0" and cursors.next_sitemap("1:0", 50, 20, 3) == "gnews:0"


def test_match_text(spark):
    a = spark.createDataFrame([(1, "улица Мира", "5", "123456"), (2, "улица Мирная", "5", None), (3, "Садовая улица", "7", None)], "id long, street string, house string, postal_code string")
    t = spark.createDataFrame([(1, "Авария на ул. Мира, д. 5"), (2, "Садовая 7, дом 7 и дом 8"), (3, "ул. Садовая, дом 7"), (4, "без адреса")], "text_id long, text string")
    assert {r.text_id: r.address_id for r in addresses.match_text(t, a).collect()} == {1: 1, 3: 3}


def test_resolved_boundaries():
    from civicfeed.operators.boundaries import stitch

    assert [sorted(set(r)) for r in stitch([[1, 2], [4, 3], [3, 2], [4, 1]])] == [[1, 2, 3, 4]]
    assert stitch([[1, 2], [2, 3]]) == []


@pytest.mark.parametrize(
    "walk,files,options,want",
    [
        ("day", ["20240103", "20240101"], {"today": "2024-01-03", "since": "2024-01-01"}, ["20240101-0", "20240101-1", "20240103-0", "20240103-1"]),
        ("month", ["2024-01", "2023-12", "2023-10"], {"today": "2024-01-03", "since": "2023-11-01"}, ["2023-12-0", "2023-12-1", "2024-01-0", "2024-01-1"]),
        ("page", ["1", "2", "4"], {}, ["1-0", "1-1", "2-0", "2-1"]),
        ("probe", ["9", "7"], {"first": "9", "misses": "2"}, ["7-0", "7-1", "9-0", "9-1"]),
    ],
)
def test_article_source(spark, tmp_path, walk, files, options, want):
    from civicfeed.sources.connector import ArticleSource

    for name in files:
        (tmp_path / f"{name}.jsonl").write_text("\n".join(f'{{"external_id": "{name}-{i}", "title": "t"}}' for i in range(2)))
    spark.dataSource.register(ArticleSource)
    rows = spark.readStream.format("articles").options(path=str(tmp_path), source_key="s", walk=walk, **options).load()
    q = rows.writeStream.format("memory").queryName(f"articles_{walk}").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.external_id for r in spark.table(f"articles_{walk}").collect()) == want


def test_walks_stop_at_old_rows():
    from civicfeed.sources.connector import WALKS, all_old, tuples

    rows = [{"external_id": "1", "published_at": "2024-01-05T10:00"}, {"external_id": "2", "published_at": "2023-12-31"}, {"external_id": "3"}]
    options = {"since": "2024-01-01", "source_key": "k"}
    assert [t[1] for t in tuples(options, rows)] == ["1", "3"]
    assert all_old(options, rows[1:2]) and not all_old(options, rows) and not all_old({}, rows) and not all_old(options, [])
    assert len(WALKS) == 11


def test_article_places(spark):
    a = spark.createDataFrame([(1, "Москва", "улица Мира", "5", "123456"), (2, "Москва", "Садовая улица", "7", "654321"), (3, "Москва", "улица Мира", "9", None)], "id long, city string, street string, house string, postal_code string")
    t = [
        (1, "m24", "Авария на ул. Мира, дом 9", None, None, None),
        (2, "tass", "Снег в Берлине", "Москва", "Мира", "5"),
        (3, "tass", "Новость", "Москва", "ул. Мира", "5"),
        (4, "m24", "Новость без места", None, None, None),
        (5, "tass", "Новость без места", None, None, None),
        (6, "m24", "Отключение, индекс 654321", None, None, None),
        (7, "m24", "Событие в Самаре", None, None, None),
    ]
    rows = spark.createDataFrame(t, "id long, outlet string, text string, city string, street string, house string")
    got = {r.id: (r.address_id, r.geo_by) for r in addresses.article_places(rows, a, {"m24": "Москва"}).collect()}
    assert got == {1: (3, "home"), 3: (1, "home"), 4: (1, "city"), 6: (2, "street")}


def test_drafts(spark):
    rows = spark.createDataFrame([(1, "mc", "x:1", "Отключение газа\nзавтра с 10:00 до 12:00", None, None, datetime(2024, 1, 10))], "id long, source string, source_msg_id string, raw_text string, title string, body string, published_at timestamp_ntz")
    r = addresses.to_drafts(rows).first()
    assert (r.title, r.importance, r.disaster_flag) == ("Отключение газа", 2, False) and str(r.active_from) == "2024-01-11 10:00:00"


def test_street_hints(spark):
    from civicfeed.functions import text as T

    got = spark.createDataFrame([("На Тверской улице и на ул. Мира, по Арбату.",)], "t string").select(T.street_hints(F.col("t")).alias("h")).first().h
    assert "Мира" in got and "Тверской" in got and "Арбату" in got


def test_load_order(spark, tmp_path):
    references = {"users_chat": ["users", "chats"], "chats": ["addresses"], "users": [], "addresses": []}
    order = files.load_order(references)
    assert order.index("addresses") < order.index("chats") < order.index("users_chat") and order.index("users") < order.index("users_chat")
    users = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    for name in ("users", "addresses"):
        files.write_csv(users, f"{tmp_path}/{name}.csv.gz")
    schemas = {"users": "id long, name string", "addresses": "id long, name string"}
    got = dict(files.load_tables(spark, str(tmp_path), schemas, references, {"users": users, "addresses": users.limit(0)}))
    assert list(got) == ["addresses"] and sorted(got["addresses"].collect()) == sorted(users.collect())
    assert set(dict(files.load_tables(spark, str(tmp_path), schemas, references, {"users": users}, True))) == {"users", "addresses"}
    assert files.missing_columns(users, {"rows": 2, "with_name": 1, "with_city": 1}) == ["city"]
