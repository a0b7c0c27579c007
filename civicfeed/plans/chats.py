"""Queries of Russian notices, candidates and house chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import rules, windows
from ..functions import text as T
from ..operators import candidates, chats, corpus, feed
from .overlay import NOW, source, table, with_tables
from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
C = F.col


def _holds(needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{n}')" for n in needles) + ")"


@_R.add(with_tables(f""" SELECT id, CAST(CASE WHEN {_holds(rules.DISASTER)} OR {_holds(rules.URGENT)} THEN 1 WHEN {_holds(rules.IMPORTANT)} THEN 2 ELSE 3 END AS INTEGER) AS importance, {_holds(rules.DISASTER)} AS disaster_flag
    FROM (SELECT id, replace(lower(concat_ws(' ', subject, place)), 'ё', 'е') AS t FROM notes) n""", "notes"))
def c1_keywords(spark, sf_dir):
    """The rules' own keywords on Russian notices."""
    n = table(spark, sf_dir, "notes").withColumn("r", rules.importance(F.concat_ws(" ", "subject", "place")))
    return n.select("id", "r.*")


@_R.add(with_tables(""" SELECT id, place_no IN (2, 9, 10) AS abroad, place_no IN (1, 3, 5, 6) AS other_city, place_no IN (0, 5, 8) AS here, place_no IN (1, 2, 3, 6, 9, 10) AS elsewhere FROM notes""", "notes"))
def f18_elsewhere(spark, sf_dir):
    """Which notices are about places abroad, other cities, this city, and so of elsewhere."""
    t = F.concat_ws(" ", "subject", "place")
    return table(spark, sf_dir, "notes").select("id", rules.is_foreign(t).alias("abroad"), rules.names_other_city(t).alias("other_city"), rules.in_moscow(t).alias("here"), rules.elsewhere(t).alias("elsewhere"))


WINDOWS = """ SELECT id, CASE time_no WHEN 0 THEN 'dmy_range_s_po' WHEN 1 THEN 'rel_day_time_range' WHEN 2 THEN 'day_month_range' WHEN 3 THEN 'until_tomorrow' WHEN 5 THEN 'dmy_dash_dmy' WHEN 6 THEN 'weekday_day_month' WHEN 7 THEN 'rel_day_time_start' END AS pattern,
    CASE time_no WHEN 0 THEN TIMESTAMP '2024-02-01 10:00:00' WHEN 1 THEN TIMESTAMP '2024-01-11 10:00:00' WHEN 2 THEN TIMESTAMP '2024-01-12 00:00:00' WHEN 5 THEN TIMESTAMP '2024-01-16 00:00:00' WHEN 6 THEN TIMESTAMP '2024-01-12 08:00:00' WHEN 7 THEN TIMESTAMP '2024-01-12 23:00:00' END AS active_from,
    CASE time_no WHEN 0 THEN TIMESTAMP '2024-02-03 18:00:00' WHEN 1 THEN TIMESTAMP '2024-01-11 12:30:00' WHEN 2 THEN TIMESTAMP '2024-01-14 23:59:00' WHEN 3 THEN TIMESTAMP '2024-01-11 23:59:00' WHEN 5 THEN TIMESTAMP '2024-01-18 23:59:00' WHEN 6 THEN TIMESTAMP '2024-01-12 20:00:00' WHEN 7 THEN TIMESTAMP '2024-01-13 03:00:00' END AS active_to,
    time_no = 4 AS no_window FROM notes"""


@_R.add(with_tables(WINDOWS, "notes"))
def d10_windows(spark, sf_dir):
    """The time windows of Russian notices written on 10 January 2024; each distinct text is read once."""
    n = table(spark, sf_dir, "notes").select("id", F.concat_ws(" ", "subject", "time").alias("t"))
    ref = F.lit("2024-01-10 09:00:00").cast("timestamp_ntz")
    read = n.select("t").distinct().withColumns({"w": windows.window(C("t"), ref), "no_window": windows.without_window(C("t"))})
    return n.join(read, "t").select("id", "w.pattern", "w.active_from", "w.active_to", "no_window")


@_R.add(with_tables(""" SELECT id, CASE id % 6 WHEN 5 THEN street || ' 607' ELSE street END AS street, CASE id % 3 WHEN 0 THEN 'Москва' WHEN 1 THEN city END AS city_label,
    CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN NULL WHEN id % 7 = 2 THEN NULL ELSE district END AS district_label FROM addresses""", "addresses"))
def k10_clean_parts(spark, sf_dir):
    """Streets that repeat their house in some form, and labels of cities and districts in several spellings."""
    i = C("id") % 6
    again = F.when(i == 0, C("house")).when(i == 1, F.concat(F.lit("д. "), C("house"), F.lit(" к1"))).when(i == 2, "4 с18").when(i == 3, F.lit("7/2")).when(i == 5, "607")
    city = F.when(C("id") % 3 == 0, " город  Москва ").when(C("id") % 3 == 1, C("city")).otherwise("Город не указан")
    j = C("id") % 7
    district = F.when(j == 0, "moscow").when(j == 1, F.concat(F.lit("ЖК "), F.lit("Жилой комплекс 1"))).when(j == 2, "unknown").when(j == 3, F.concat(F.lit("Муниципальный округ "), C("district"))).when(j == 4, F.concat(F.lit("район "), C("district"))).otherwise(C("district"))
    return table(spark, sf_dir, "addresses").select(
        "id", T.street_without_house(F.concat_ws(" ", "street", again), C("house")).alias("street"), T.city_label(city).alias("city_label"), T.district_label(district, C("city")).alias("district_label")
    )


@_R.add(with_tables(""" SELECT id, city AS city, CASE WHEN id % 2 = 0 THEN district || ', Center' END AS district, street AS street, CASE WHEN id % 3 <> 2 THEN house END AS house FROM addresses""", "addresses"))
def k11_parts(spark, sf_dir):
    """Addresses with districts and houses in several places, read back from their texts."""
    district = F.when(C("id") % 2 == 0, F.concat("district", F.lit(", Center")))
    number = F.when(C("id") % 3 == 0, F.concat(F.lit(", д. "), C("house"))).when(C("id") % 3 == 1, F.concat(F.lit(" дом "), C("house"))).otherwise("")
    text = F.concat(F.concat_ws(", ", "city", district, "street"), number)
    return table(spark, sf_dir, "addresses").select("id", T.parse_address(text).alias("p")).select("id", "p.*")


@_R.add(with_tables(""" SELECT CASE WHEN trim(coalesce(text, '')) = '' AND image_url IS NOT NULL THEN 'Фото из чата соседей' ELSE trim(coalesce(text, '')) END AS raw_text, (-(chat_id) - 1) || ':' || message_id AS source_msg_id, c.address_id,
    CASE WHEN m.ts_sec % 480 = 0 THEN 'text' ELSE 'chat_fallback' END AS geo_method, CASE WHEN m.ts_sec % 480 = 0 THEN 'street' ELSE 'home' END AS geo_by
    FROM messages m JOIN (SELECT chat_id AS cid, chat_type, address_id FROM chats) c ON c.cid = -(m.chat_id) - 1 AND c.chat_type = 'chat' JOIN addresses a ON a.id = c.address_id""", "messages", "chats", "addresses"))
def x7_message_candidates(spark, sf_dir):
    """Messages of linked chats as candidates, with their chat's address where the text names none."""
    m = table(spark, sf_dir, "messages").withColumns({"chat_id": -C("chat_id") - 1, "source_url": F.lit(None).cast("string"), "published_at": C("ts_sec")})
    found = candidates.from_messages(m, table(spark, sf_dir, "chats"), table(spark, sf_dir, "addresses"))
    own = C("published_at") % 480 == 0
    bound = found.withColumns({"address_id": F.when(own, C("fallback_address_id")), "geo_by": F.when(own, "street")})
    return candidates.with_fallback(bound).select("raw_text", "source_msg_id", "address_id", "geo_method", "geo_by")


ARTICLE_SQL = """ SELECT 'tass:' || id AS source_msg_id, CASE WHEN id % 4 <> 0 THEN subject END AS title, CASE WHEN length(b) >= 20 THEN b END AS body,
    concat_ws(chr(10), CASE WHEN id % 4 <> 0 THEN subject END, CASE WHEN length(b) >= 20 THEN b END) AS raw_text
    FROM (SELECT *, CASE WHEN id % 3 = 0 THEN '' ELSE place || ' ' || time || ' и далее' END AS b FROM notes) n"""


@_R.add(with_tables(ARTICLE_SQL, "notes"))
def x8_article_candidates(spark, sf_dir):
    """Articles as candidates: their bodies begin with the title or end with a link to more."""
    n = table(spark, sf_dir, "notes")
    title = F.when(C("id") % 4 != 0, F.concat(F.lit(" "), C("subject"), F.lit(" ")))
    said = F.concat("place", F.lit(" "), "time", F.lit(" и далее"))
    body = F.when(C("id") % 3 == 0, "Подробнее на сайте").when((C("id") % 3 == 1) & (C("id") % 4 != 0), F.concat("subject", F.lit(". "), said)).otherwise(F.concat(said, F.lit(" Читать далее")))
    rows = n.select(F.lit("tass").alias("outlet"), C("id").cast("string").alias("external_id"), title.alias("title"), body.alias("body"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("timestamp").alias("published_at"))
    return candidates.from_articles(rows, "news").select("source_msg_id", "title", "body", "raw_text")


@_R.add(with_tables(""" SELECT id, subject || chr(10) || CASE WHEN id % 2 = 0 THEN 'улица Мира' || chr(10) ELSE '' END || place AS text, CASE WHEN id % 2 = 0 THEN 1 WHEN place_no = 4 THEN 1 ELSE 0 END AS n_streets, place_no IN (2, 9, 10) AS skipped, subject AS title FROM notes""", "notes"))
def x9_notice_parts(spark, sf_dir):
    """What notices say and which streets they name: their own, else those of their texts; titles without their dates."""
    n = table(spark, sf_dir, "notes")
    streets = F.when(C("id") % 2 == 0, F.array(F.lit("улица Мира"))).otherwise(F.array().cast("array<string>"))
    text = F.concat_ws("\n", "subject", F.when(C("id") % 2 == 0, F.lit("улица Мира")), "place")
    own = F.concat(F.array(C("subject")), streets, F.array(C("place")))
    return n.select(
        "id", text.alias("text"), F.size(candidates.notice_streets(streets, C("subject"), C("place"))).alias("n_streets"),
        candidates.foreign_notice(F.get(own, 0), C("place"), streets).alias("skipped"), candidates.without_date(F.concat(F.lit("12 января, 2024 "), C("subject"))).alias("title"),
    )


@_R.add(with_tables(""" SELECT chat_id, message_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM messages WHERE NOT sender_is_bot AND length(trim(coalesce(text, ''))) > 0 AND ts_sec % 90 <> 0""", "messages"))
def f29_digest_messages(spark, sf_dir):
    """Messages to keep for digests, less a third that is there already."""
    m = table(spark, sf_dir, "messages").withColumn("published_at", C("ts_sec"))
    return candidates.digest_messages(m, m.filter("ts_sec % 90 = 0")).select("chat_id", "message_id", "text")


@_R.add(with_tables(""" SELECT e.id, geo_by IN ('street', 'home') AND a.id % 5 <> 0 AS pinned, round(12742000.0 * asin(least(1.0, sqrt(pow(sin(radians(55.75 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(55.75::DOUBLE)) * pow(sin(radians(37.6 - lon) / 2), 2)))), 4) AS metres,
    CASE WHEN geo_by = 'city' THEN 'city' WHEN e.id % 3 = 0 THEN 'street' ELSE 'home' END AS level FROM city_events e JOIN addresses a ON a.id = e.address_id""", "city_events", "addresses"))
def f35_pinned(spark, sf_dir):
    """Which events can be pinned on a map, how far they are from the centre, and how exactly their parts place them."""
    a = table(spark, sf_dir, "addresses").select(C("id").alias("address_id"), "lat", "lon", "street", "house")
    e = table(spark, sf_dir, "city_events").join(a, "address_id")
    lat = F.when(C("address_id") % 5 == 0, F.lit(91.0)).otherwise(C("lat"))
    level = candidates.geo_level(F.when(C("geo_by") != "city", C("street")), F.when((C("geo_by") != "city") & (C("id") % 3 != 0), C("house")))
    metres = F.lit(2.0) * 6_371_000 * F.asin(F.least(F.lit(1.0), R.haversine(C("lat"), C("lon"), F.lit(55.75), F.lit(37.6)) * 0 + F.sin(R.haversine(C("lat"), C("lon"), F.lit(55.75), F.lit(37.6)) / 2 / 6_371_000)))
    return e.select("id", T.has_location(C("geo_by"), lat, C("lon")).alias("pinned"), F.round(metres, 4).alias("metres"), level.alias("level"))


URLS = """ SELECT id, CASE id % 6 WHEN 0 THEN 'https://cdn.example/logo.png' WHEN 1 THEN 'https://brand.example/a.png' WHEN 2 THEN 'https://m.example/text/gorod/2024/01/0' || (id % 9 + 1) || '/7/' WHEN 3 THEN 'https://m.example/text/gorod/2024/13/01/7/' WHEN 4 THEN 'https://m.example/x.jpg?icon=1' END AS url FROM city_events"""


@_R.add(with_tables(f""" SELECT id, coalesce(id % 6 IN (0, 1), false) AS logo, CASE WHEN id % 6 = 2 THEN make_timestamp(2024, 1, CAST(id % 9 + 1 AS INTEGER), 0, 0, 0) END AS day FROM ({URLS}) u""", "city_events"))
def f23_urls(spark, sf_dir):
    """Pictures that are a site's own marks, and dates in articles' paths."""
    i = C("id") % 6
    day = F.concat(F.lit("https://m.example/text/gorod/2024/01/0"), (C("id") % 9 + 1).cast("string"), F.lit("/7/"))
    url = F.when(i == 0, "https://cdn.example/logo.png").when(i == 1, "https://brand.example/a.png").when(i == 2, day).when(i == 3, "https://m.example/text/gorod/2024/13/01/7/").when(i == 4, "https://m.example/x.jpg?icon=1")
    return table(spark, sf_dir, "city_events").select("id", T.is_logo(url).alias("logo"), T.date_in_path(url).alias("day"))


@_R.add(with_tables(""" SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'http://i.example/' || id WHEN 2 THEN 'https://p.example/2' END AS image, id % 5 IN (3) AS only_other,
    CASE WHEN id % 4 = 0 THEN 'first' WHEN id % 4 = 1 THEN 'second' END AS field, CASE WHEN id % 3 = 0 THEN '• a' WHEN id % 3 = 2 THEN NULL END AS content, 'dialog' AS chat_type FROM city_events""", "city_events"))
def v9_json_fields(spark, sf_dir):
    """Pictures among attachments, the first field that is there, and the text of language models' replies."""
    i, e = C("id"), table(spark, sf_dir, "city_events")
    one = lambda kind, url: F.struct(F.lit(kind).alias("type"), url.cast("string").alias("url"))
    none = F.array().cast("array<struct<type:string,url:string>>")
    picture = F.concat(F.lit(" http://i.example/"), i.cast("string"))
    got = F.when(i % 5 == 0, none).when(i % 5 == 1, F.array(one("sticker", F.lit("https://s")), one("Image", picture))).when(i % 5 == 2, F.array(one("photo", F.lit("ftp://x")), one("photo", F.lit("https://p.example/2"))))
    got = got.when(i % 5 == 3, F.array(one("file", F.lit("https://f")))).otherwise(F.array(one("image", F.lit(None))))
    json = F.when(i % 4 == 0, '{"a": "first", "b": {"c": "x"}}').when(i % 4 == 1, '{"a": " ", "b": {"c": "second"}}').when(i % 4 == 2, "{}").otherwise("no json")
    reply = F.when(i % 3 == 0, '{"choices": [{"message": {"content": "• a"}}]}').when(i % 3 == 1, '{"choices": []}').otherwise('{"choices": [{"message": {"content": "  "}}]}')
    return e.select("id", candidates.image_url(got).alias("image"), candidates.only_other_attachments(got).alias("only_other"), T.first_field(json, "$.a", "$.b.c").alias("field"), chats.reply_content(reply).alias("content"), candidates.chat_type(F.lit('{"chat_type": "DIALOG"}')).alias("chat_type"))


@_R.add(with_tables(""" SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE source END AS source, title, CASE WHEN id % 5 = 0 THEN '' ELSE body END AS body FROM city_events""", "city_events"))
def x30_event_fields(spark, sf_dir):
    """Fields of events as they are stored."""
    e = table(spark, sf_dir, "city_events")
    f = candidates.event_fields(F.when(C("id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), C("source"))), F.concat("title", F.lit(" ")), F.when(C("id") % 5 != 0, F.concat(F.lit(" "), C("body"))))
    return e.select("id", f.alias("f")).select("id", "f.*")


@_R.add(with_tables(""" SELECT chat_id, CASE WHEN a.id IS NULL THEN 'address' WHEN chat_id >= -40 THEN 'exists' WHEN chat_id % 7 = 0 THEN 'title' END AS error FROM (SELECT -(id) AS chat_id, CASE WHEN id % 11 = 0 THEN 0 ELSE id END AS address_id FROM addresses) w LEFT JOIN addresses a ON a.id = w.address_id
    WHERE NOT (a.id IS NULL AND chat_id % 7 = 0)""", "addresses"))
def x20_new_chats(spark, sf_dir):
    """Chats to add, and the first rule that each breaks."""
    a = table(spark, sf_dir, "addresses")
    i = C("id")
    wanted = a.filter("NOT (id % 11 = 0 AND id % 7 = 0)").select((-i).alias("chat_id"), F.when(i % 11 == 0, F.lit(0).cast("long")).otherwise(i).alias("address_id"), F.when((i % 7 == 0) & (i > 40), " ").otherwise("A chat").alias("title"), F.lit(" https://x ").alias("invite_link"))
    good, bad = chats.new_chats(wanted, table(spark, sf_dir, "chats"), a)
    return good.select("chat_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("chat_id", "error"))


@_R.add(with_tables(""" SELECT c.chat_id, CASE WHEN c.chat_id % 5 = 0 THEN 'removed' WHEN c.chat_id % 4 = 0 THEN 'chat' ELSE chat_type END AS chat_type, CASE WHEN c.chat_id % 5 = 0 THEN NULL WHEN c.chat_id % 4 = 0 THEN 'https://again' ELSE invite_link END AS invite_link,
    CASE WHEN c.chat_id % 4 = 0 AND c.chat_id % 5 <> 0 AND c.chat_id % 8 <> 0 THEN 'Back' ELSE title END AS title, CASE WHEN c.chat_id % 5 = 0 THEN 0 ELSE coalesce(m.n, 0) END AS n_members FROM chats c LEFT JOIN (SELECT chat_id, count(*) AS n FROM users_chat GROUP BY chat_id) m USING (chat_id)""", "chats", "users_chat"))
def x21_detached(spark, sf_dir):
    """Chats that the bot has left, and others that are confirmed anew."""
    c, m = chats.detach(table(spark, sf_dir, "chats"), table(spark, sf_dir, "users_chat"), table(spark, sf_dir, "chats").filter("chat_id % 5 = 0"))
    sure = table(spark, sf_dir, "chats").filter("chat_id % 4 = 0 AND chat_id % 5 <> 0").select("chat_id", F.when(C("chat_id") % 8 == 0, " ").otherwise("Back").alias("title"), F.lit("https://again").alias("invite_link"))
    n = m.groupBy("chat_id").agg(F.count("*").alias("n_members"))
    return chats.promote_chats(c, sure).join(n, "chat_id", "left").select("chat_id", "chat_type", "invite_link", "title", F.coalesce("n_members", F.lit(0)).alias("n_members"))


@_R.add(with_tables(""" SELECT address_id, chat_id FROM chat_addresses WHERE chat_id IN (SELECT chat_id FROM chats WHERE chat_type = 'chat')""", "chats", "chat_addresses"))
def x22_live_links(spark, sf_dir):
    """Linked chats of addresses and addresses of linked chats."""
    return chats.live_links(table(spark, sf_dir, "chats"), table(spark, sf_dir, "chat_addresses"))


WISHES = """ , w AS (SELECT user_id, chat_id, coalesce(address_id, 41 - chat_id) AS address_id FROM users_chat UNION ALL SELECT user_id + 1000, chat_id, -(chat_id) FROM users_chat WHERE user_id % 10 = 0)
    SELECT w.user_id, w.chat_id, w.address_id, CASE WHEN c.chat_id IS NULL THEN 'no_chat' WHEN ca.chat_id IS NULL THEN 'not_chat_address' WHEN m.user_id IS NULL THEN 'not_member' ELSE 'set' END AS outcome FROM w
    LEFT JOIN (SELECT chat_id FROM chats WHERE chat_type = 'chat') c USING (chat_id) LEFT JOIN chat_addresses ca ON ca.chat_id = w.chat_id AND ca.address_id = w.address_id LEFT JOIN users_chat m ON m.user_id = w.user_id AND m.chat_id = w.chat_id"""


@_R.add(with_tables(WISHES, "chats", "chat_addresses", "users_chat"))
def c23_member_addresses(spark, sf_dir):
    """What becomes of members' wishes for an address of their chat."""
    m = table(spark, sf_dir, "users_chat")
    wanted = m.select("user_id", "chat_id", F.coalesce("address_id", 41 - C("chat_id")).alias("address_id")).unionByName(m.filter("user_id % 10 = 0").select((C("user_id") + 1000).alias("user_id"), "chat_id", (-C("chat_id")).alias("address_id")))
    return chats.set_member_address(m, table(spark, sf_dir, "chats"), table(spark, sf_dir, "chat_addresses"), wanted)


@_R.add(with_tables(""" SELECT m.user_id, m.chat_id, a.address_id FROM users_chat m JOIN chats c ON c.chat_id = m.chat_id AND c.chat_type = 'chat' JOIN chat_addresses a ON a.chat_id = m.chat_id WHERE a.address_id % 3 <> 0""", "chats", "chat_addresses", "users_chat"))
def j21_saved_addresses(spark, sf_dir):
    """Addresses of members' chats that are to be saved, less a third that is."""
    m, c, a = (table(spark, sf_dir, t) for t in ("users_chat", "chats", "chat_addresses"))
    saved = m.select("user_id", "chat_id").join(a.filter("address_id % 3 = 0"), "chat_id")
    return chats.save_member_addresses(m, c, a, saved)


@_R.add(with_tables(""" , one AS (SELECT a.chat_id, min(a.address_id) AS only_id FROM chat_addresses a JOIN chats c ON c.chat_id = a.chat_id AND chat_type = 'chat' GROUP BY a.chat_id HAVING count(*) = 1)
    SELECT user_id, chat_id, coalesce(address_id, only_id, 0) AS address_id, address_id IS NOT NULL AND EXISTS (SELECT 1 FROM chat_addresses a WHERE a.chat_id = m.chat_id AND a.address_id = m.address_id) AS fits FROM users_chat m LEFT JOIN one USING (chat_id)""", "chats", "chat_addresses", "users_chat"))
def x26_referred(spark, sf_dir):
    """Members' addresses (0: none) after they came by a link, and whether what they had chosen is an address of the chat."""
    m, c, a = (table(spark, sf_dir, t) for t in ("users_chat", "chats", "chat_addresses"))
    fits = chats.linked_choices(m, a).select("user_id", "chat_id", F.lit(True).alias("fits"))
    return chats.referred(m, c, a).join(fits, ["user_id", "chat_id"], "left").select("user_id", "chat_id", F.coalesce("address_id", F.lit(0)).alias("address_id"), F.coalesce("fits", F.lit(False)).alias("fits"))


@_R.add(with_tables(""" SELECT chat_id, CASE WHEN chat_id % 4 = 0 OR chat_id % 9 = 0 THEN 'chat' ELSE chat_type END AS chat_type FROM chats""", "chats"))
def j22_confirmed(spark, sf_dir):
    """Chats with a request that was accepted are groups."""
    c = table(spark, sf_dir, "chats")
    links = c.select("chat_id", F.when(C("chat_id") % 4 == 0, "connected").when(C("chat_id") % 9 == 0, "waiting_join").otherwise("pending").alias("status"))
    return chats.confirmed_types(c, links.unionByName(links)).select("chat_id", "chat_type")


GROUPS = """ , g AS (SELECT f.user_id, f.chat_id, coalesce(f.title, r.title) AS title FROM facts f JOIN registry r ON r.chat_id = f.chat_id AND r.is_active WHERE f.type = 'chat' AND f.readable AND (f.is_admin OR f.is_owner))"""


@_R.add(with_tables(GROUPS + " SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY lower(title), chat_id) AS INTEGER) AS place, chat_id IN (SELECT chat_id FROM chats WHERE chat_type = 'chat') AS connected FROM g", "facts", "registry", "chats"))
def j23_admin_groups(spark, sf_dir):
    """Groups that users may manage, in their lists' order, and which of them are linked."""
    r, f = table(spark, sf_dir, "registry"), table(spark, sf_dir, "facts")
    linked = chats.connected_admin_groups(table(spark, sf_dir, "chats"), r, f).select("user_id", "chat_id", F.lit(True).alias("connected"))
    return chats.admin_groups(r, f).join(linked, ["user_id", "chat_id"], "left").withColumn("connected", F.coalesce("connected", F.lit(False)))


@_R.add(with_tables(""" SELECT c.chat_id, coalesce(f.title, c.title) AS title, coalesce(f.link, c.invite_link) AS invite_link FROM chats c JOIN (SELECT chat_id, max(title) AS title, max(link) AS link FROM facts WHERE type = 'chat' GROUP BY chat_id) f USING (chat_id)""", "chats", "facts"))
def x27_live_groups(spark, sf_dir):
    """Stored chats that are groups still, with the messenger's titles and links."""
    return chats.live_groups(table(spark, sf_dir, "chats"), table(spark, sf_dir, "facts")).select("chat_id", "title", "invite_link")


@_R.add(with_tables(""" , a AS (SELECT chat_id - 20 AS chat_id, CASE WHEN chat_id % 3 = 0 THEN title END AS title FROM registry WHERE chat_id % 2 = 0)
    SELECT coalesce(r.chat_id, a.chat_id) AS chat_id, coalesce(a.title, r.title, 'Чат ' || a.chat_id) AS title, CASE WHEN a.chat_id IS NOT NULL THEN 7 ELSE added_by_user_id END AS added_by_user_id,
    CASE WHEN a.chat_id IS NOT NULL THEN true WHEN r.chat_id % 5 = 0 THEN false ELSE is_active END AS is_active FROM registry r FULL JOIN a USING (chat_id)""", "registry"))
def x28_registry(spark, sf_dir):
    """The groups that the bot is in after it was added to some and removed from others."""
    r = table(spark, sf_dir, "registry")
    added = r.filter("chat_id % 2 = 0").select((C("chat_id") - 20).alias("chat_id"), F.when(C("chat_id") % 3 == 0, C("title")).otherwise("").alias("title"), F.lit(7).cast("long").alias("actor_id"))
    return chats.upsert_registry(r, added, r.filter("chat_id % 5 = 0"))


REMOVALS = """ , links AS (SELECT a.* FROM chat_addresses a JOIN chats c ON c.chat_id = a.chat_id AND chat_type = 'chat'), n AS (SELECT chat_id, count(*) AS n FROM links GROUP BY chat_id),
    w AS (SELECT chat_id, CASE WHEN chat_id % 7 = 0 THEN 0 ELSE address_id END AS address_id, chat_id % 8 <> 0 AS is_admin, chat_id % 9 <> 0 AS readable FROM chats),
    o AS (SELECT w.chat_id, w.address_id, CASE WHEN n IS NULL THEN 'no_chat' WHEN NOT is_admin THEN 'not_admin' WHEN NOT readable THEN 'not_readable' WHEN l.chat_id IS NULL THEN 'absent' WHEN n = 1 THEN 'removed_last' ELSE 'removed' END AS outcome
        FROM w LEFT JOIN n USING (chat_id) LEFT JOIN links l ON l.chat_id = w.chat_id AND l.address_id = w.address_id),
    rest AS (SELECT a.chat_id, min(a.address_id) AS next_id, count(*) AS left_ FROM chat_addresses a LEFT JOIN o ON o.chat_id = a.chat_id AND o.address_id = a.address_id AND outcome LIKE 'removed%' WHERE o.chat_id IS NULL GROUP BY a.chat_id)
    SELECT chat_id, outcome, CASE WHEN outcome = 'removed_last' THEN 'removed' ELSE chat_type END AS chat_type, CASE WHEN outcome = 'removed' THEN next_id ELSE c.address_id END AS main_id, coalesce(left_, 0) AS n_left,
        (SELECT count(*) FROM users_chat m WHERE m.chat_id = c.chat_id AND m.address_id IS NOT NULL AND NOT (outcome LIKE 'removed%' AND m.address_id = c.address_id)) AS n_chosen FROM chats c JOIN o USING (chat_id) LEFT JOIN rest USING (chat_id)"""


@_R.add(with_tables(REMOVALS, "chats", "chat_addresses", "users_chat"))
def x29_removed_addresses(spark, sf_dir):
    """Admins take an address from their chats: what becomes of the wish, the chat, its addresses and its members."""
    c = table(spark, sf_dir, "chats")
    k = C("chat_id")
    wanted = c.select("chat_id", F.when(k % 7 == 0, F.lit(0).cast("long")).otherwise(C("address_id")).alias("address_id"), (k % 8 != 0).alias("is_admin"), (k % 9 != 0).alias("readable"))
    said, after, rest, m = chats.remove_address(c, table(spark, sf_dir, "chat_addresses"), table(spark, sf_dir, "users_chat"), wanted)
    n_left = rest.groupBy("chat_id").agg(F.count("*").alias("n_left"))
    chosen = m.groupBy("chat_id").agg(F.count("address_id").alias("n_chosen"))
    out = said.select("chat_id", "outcome").join(after.select("chat_id", "chat_type", C("address_id").alias("main_id")), "chat_id").join(n_left, "chat_id", "left").join(chosen, "chat_id", "left")
    return out.fillna(0, ["n_left", "n_chosen"])


@_R.add(with_tables(""" SELECT external_id, address_id, address_text FROM (SELECT u.external_id, CASE WHEN external_id % 2 = 0 AND w.id IS NOT NULL THEN w.id ELSE own END AS address_id FROM (SELECT id AS external_id, CASE WHEN id % 3 <> 0 THEN id END AS own FROM addresses) u LEFT JOIN addresses w ON w.id = u.external_id * 2) x JOIN addresses a ON a.id = x.address_id""", "addresses"))
def x23_personal_addresses(spark, sf_dir):
    """Where users live, after half of them have asked for another address, which may not exist."""
    a = table(spark, sf_dir, "addresses")
    users = a.select(C("id").alias("external_id"), F.when(C("id") % 3 != 0, C("id")).alias("address_id"))
    wanted = a.filter("id % 2 = 0").select(C("id").alias("external_id"), (C("id") * 2).alias("address_id"))
    return chats.personal_addresses(chats.set_personal_addresses(users, a, wanted), a)


@_R.add(with_tables(""" SELECT coalesce(d.user_id, w.user_id) AS user_id, coalesce(d.event_id, w.event_id) AS event_id, CASE WHEN w.event_id IS NULL THEN acked_at END AS acked_at FROM deliveries d FULL JOIN (SELECT event_id, user_id FROM events WHERE event_id % 7 = 0) w ON w.user_id = d.user_id AND w.event_id = d.event_id""", "deliveries"))
def x17_demo_deliveries(spark, sf_dir):
    """Deliveries with demonstrations among them, which are there without an answer."""
    wanted = source(spark, sf_dir, "events").filter("event_id % 7 = 0").select("user_id", "event_id")
    return chats.demo_deliveries(table(spark, sf_dir, "deliveries").select("user_id", "event_id", "acked_at"), wanted)


@_R.add(with_tables(" SELECT id, importance FROM city_events ORDER BY importance <> 1, md5('5:' || id) LIMIT 1", "city_events"))
def l11_demo_event(spark, sf_dir):
    """One event at random, of importance 1 if there is one."""
    return chats.demo_event(table(spark, sf_dir, "city_events"), 5).select("id", "importance")


@_R.add(with_tables(" SELECT chat_id, string_agg('- ' || text, chr(10) ORDER BY ts_sec, message_id) AS prompt FROM messages WHERE text IS NOT NULL AND ts_sec % 5 = 0 GROUP BY chat_id", "messages"))
def x19_prompts(spark, sf_dir):
    """What a language model is asked to sum up, a chat at a time."""
    return chats.summary_prompt(table(spark, sf_dir, "messages").filter("text IS NOT NULL AND ts_sec % 5 = 0"), ["ts_sec", "message_id"])


@_R.add(with_tables(""" SELECT id FROM city_events WHERE importance = 1 ORDER BY id DESC LIMIT 2000""", "city_events"))
def l5_capped(spark, sf_dir):
    """Candidates under a cap, the newest first; a cap is a feature of the interface and off by default."""
    return feed.capped(table(spark, sf_dir, "city_events").filter("importance = 1"), 2000).select("id")


@_R.add(with_tables(""" SELECT id, 2 AS shared FROM addresses""", "addresses"))
def u4_shared_keys(spark, sf_dir):
    """How many keys a street shares with its own name and the number beside it."""
    return table(spark, sf_dir, "addresses").select("id", T.shared_keys(F.concat_ws(" ", "street"), F.concat_ws(" ", "street")).alias("shared"))


@_R.add(with_tables(""" SELECT id, t AS text FROM (SELECT id, CASE WHEN title IS NULL THEN body WHEN id % 2 = 0 THEN title || ' ' || body WHEN id % 5 = 1 THEN title ELSE title || '. ' || body END AS t FROM city_events) e WHERE length(t) >= 20""", "city_events"))
def x33_event_texts(spark, sf_dir):
    """Titles and bodies as one text each; every second body holds its title."""
    e = table(spark, sf_dir, "city_events")
    body = F.when((C("id") % 2 == 0) & C("title").isNotNull(), F.concat_ws(" ", F.lower("title"), "body")).when((C("id") % 5 == 1) & C("title").isNotNull(), " ").otherwise(C("body"))
    e = e.withColumns({"body": body}).withColumn("body", F.when(F.startswith("body", F.lower("title")), F.concat("title", F.substr("body", F.length("title") + 1))).otherwise(C("body")))
    return corpus.event_texts(e).select("id", "text")


@_R.add(with_tables(""" SELECT min(id) AS id, lower(title) AS text FROM city_events WHERE title IS NOT NULL AND lower(title) NOT IN (SELECT lower(title) FROM city_events WHERE title IS NOT NULL AND id % 40 < 7) GROUP BY lower(title)""", "city_events"))
def x35_unseen(spark, sf_dir):
    """Texts that a training file does not have yet."""
    e = table(spark, sf_dir, "city_events").filter("title IS NOT NULL")
    known = e.filter("id % 40 < 7").select(F.upper("title").alias("text"))
    return corpus.unseen(e.select("id", F.concat("title", F.lit(" ")).alias("text")), known).select("id", F.lower(F.trim("text")).alias("text"))


@_R.add("""WITH p AS (SELECT event_id FROM events WHERE event_type = 'error'), n AS (SELECT event_id FROM events WHERE event_type <> 'error' ORDER BY md5('3:' || event_id), event_id LIMIT (SELECT CAST(floor(count(*) * 0.7) AS BIGINT) FROM p))
    SELECT event_id FROM p UNION ALL SELECT event_id FROM n""")
def x37_negatives(spark, sf_dir):
    """Errors, and seven tenths as many of the other events."""
    e = source(spark, sf_dir, "events").select("event_id", "event_type")
    return corpus.negatives_to_ratio(e.filter("event_type = 'error'"), e.filter("event_type <> 'error'"), 0.7, "event_id", 3).select("event_id")


@_R.add(with_tables(""" , g AS (SELECT DISTINCT id, md5(substr(lower(title), i, 3)) AS h FROM city_events, range(1, 200) r(i) WHERE title IS NOT NULL AND i <= greatest(length(title) - 2, 1)) SELECT id, count(DISTINCT right(h, 2)) AS n, 1.0::DOUBLE AS size FROM g GROUP BY id""", "city_events"))
def v4_trigram_rows(spark, sf_dir):
    """How many groups each title's vector has, and that it is a unit vector."""
    e = table(spark, sf_dir, "city_events").filter("title IS NOT NULL").select("id", F.col("title").alias("text"))
    v = corpus.trigram_embedding(e, "id")
    return v.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(C("value") * C("value")), 9).alias("size"))


@_R.add(with_tables(""" SELECT city, 'STREET ' || upper(split_part(street, ' ', 2)) AS street, lower(street) AS sort_key FROM (SELECT city, street, min(id) AS i FROM addresses GROUP BY ALL) a""", "addresses"))
def x3_ui_values(spark, sf_dir):
    """The streets of each city, of several spellings the first."""
    a = table(spark, sf_dir, "addresses")
    both = a.select("city", F.concat(F.upper("street"), F.lit("\u200b")).alias("street"), (C("id") * 2 + 1).alias("id")).unionByName(a.select("city", F.upper("street").alias("street"), (C("id") * 2).alias("id")))
    return corpus.ui_values(both, ["city"], "street")


@_R.add(with_tables(" SELECT id FROM addresses WHERE address_text IN (SELECT address_text FROM addresses WHERE id % 9 = 0)", "addresses"))
def x4_by_text(spark, sf_dir):
    """Addresses by their exact texts."""
    a = table(spark, sf_dir, "addresses")
    return corpus.by_text(a, a.filter("id % 9 = 0")).select("id")


@_R.add(with_tables(f""" SELECT id, (active_to IS NULL OR active_to >= {NOW}) AND (published_at IS NULL OR published_at >= {NOW} - INTERVAL 20 DAY OR created_at >= {NOW} - INTERVAL 20 DAY OR active_from IS NULL OR active_from >= {NOW} - INTERVAL 20 DAY) AS maybe FROM city_events""", "city_events"))
def f12_maybe_active(spark, sf_dir):
    """Events that may count for duplicates, by the coarse test."""
    now = F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    return table(spark, sf_dir, "city_events").select("id", corpus.maybe_active(now, 20).alias("maybe"))


@_R.add(with_tables(""" SELECT count(*) FILTER (id % 3 <> 0) AS created, count(*) + count(*) FILTER (id % 10 = 1) - count(*) FILTER (id % 3 <> 0) AS skipped, min(published_at) AS oldest, max(published_at) AS newest FROM city_events WHERE source_msg_id IS NOT NULL""", "city_events"))
def sk9_flushed(spark, sf_dir):
    """Counters of a batch of which a third is there already and some rows come twice."""
    e = table(spark, sf_dir, "city_events").filter("source_msg_id IS NOT NULL")
    return corpus.flushed(e.unionByName(e.filter("id % 10 = 1")), e.filter("id % 3 = 0"), ["id"])[1]
