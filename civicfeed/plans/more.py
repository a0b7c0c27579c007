"""Further queries: predicates, joins, members, labels, boundaries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import addresses, boundaries, candidates, dedup, evaluate, labels, members, notify, records
from .overlay import NOW, source, table, with_tables
from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql


def _now():
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


@_R.add(with_tables(f""" SELECT id, importance IN (1, 2) AS in_feed, geo_by IN ('street', 'home') AS nearby, geo_by = 'city' AS city,
    importance = 2 OR (importance = 1 AND disaster_flag) AS legacy_city, importance IN (1, 2) AS on_map, active_to IS NULL OR active_to >= {NOW} AS current FROM city_events""", "city_events"))
def f1_feed_predicates(spark, sf_dir):
    from ..operators import feed

    e = table(spark, sf_dir, "city_events")
    i = F.col("importance")
    return e.select(
        "id", i.isin(1, 2).alias("in_feed"), feed.geo_matches("nearby", F.col("geo_by")).alias("nearby"), feed.geo_matches("city", F.col("geo_by")).alias("city"),
        feed.legacy_city(i, F.col("disaster_flag")).alias("legacy_city"), feed.on_map(i).alias("on_map"), feed.not_expired(_now()).alias("current"),
    )


@_R.add(with_tables(" SELECT id FROM addresses WHERE city = 'NATION_3' AND street LIKE 'Street 1%' AND postal_code >= '100100'", "addresses"))
def f33_address_filter(spark, sf_dir):
    wanted = {"city": F.col("city") == "NATION_3", "street": F.col("street").startswith("Street 1"), "postal_code": F.col("postal_code") >= "100100", "district": None}
    return addresses.filtered(table(spark, sf_dir, "addresses"), **wanted).select("id")


PLACED = """ , p AS (SELECT e.id, CASE WHEN e.id % 3 = 0 THEN e.address_id END AS address_id, CASE WHEN e.id % 4 <> 0 THEN lat END AS lat, CASE WHEN e.id % 4 <> 0 THEN lon END AS lon FROM city_events e LEFT JOIN addresses a ON a.id = e.address_id)
    SELECT a.id AS a_id, b.id AS b_id, CASE WHEN a.address_id IS NOT NULL AND b.address_id IS NOT NULL THEN a.address_id = b.address_id WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL
        THEN 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 9000
        ELSE a.address_id IS NULL AND b.address_id IS NULL END AS near, coalesce(a.address_id <> b.address_id, false) AS conflict FROM p a JOIN p b ON b.id = a.id + 3"""


@_R.add(with_tables(PLACED, "addresses", "city_events"))
def f26_compatible(spark, sf_dir):
    a = table(spark, sf_dir, "addresses").select(F.col("id").alias("address_id"), "lat", "lon")
    e = table(spark, sf_dir, "city_events").select("id", "address_id").join(a, "address_id", "left")
    part = lambda c, keep: F.when(keep, F.col(c)).alias(c)
    p = e.select("id", part("address_id", F.col("id") % 3 == 0), part("lat", F.col("id") % 4 != 0), part("lon", F.col("id") % 4 != 0))
    b = p.select((F.col("id") - 3).alias("id"), F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("address_id", "lat", "lon")])
    near = dedup.geo_nearby(*[F.col(c) for c in ("address_id", "b_address_id", "lat", "lon", "b_lat", "b_lon")], radius_m=9000.0)
    return p.join(b, "id").select(F.col("id").alias("a_id"), "b_id", near.alias("near"), dedup.conflict(F.col("address_id"), F.col("b_address_id")).alias("conflict"))


@_R.add(with_tables(" SELECT m.user_id, m.chat_id, a.city, count(*) AS n FROM members m JOIN addresses a ON a.id = m.address_id WHERE coalesce(m.chat_type, 'chat') = 'chat' GROUP BY ALL", "addresses", "members"))
def j5_memberships(spark, sf_dir):
    m = table(spark, sf_dir, "members")
    rows = members.memberships(m.select("user_id").distinct(), m, table(spark, sf_dir, "addresses"))
    return rows.groupBy("user_id", "chat_id", "city").agg(F.count("*").alias("n"))


@_R.add(with_tables(""" , linked AS (SELECT DISTINCT user_id, address_id FROM members WHERE chat_type = 'chat'), u AS (SELECT user_id, min(address_id) AS personal_id FROM members GROUP BY user_id)
    SELECT l.user_id, l.address_id FROM linked l JOIN u USING (user_id) WHERE l.address_id = personal_id OR NOT EXISTS (SELECT 1 FROM linked x WHERE x.user_id = l.user_id AND x.address_id = u.personal_id)""", "members"))
def c14_feed_origins(spark, sf_dir):
    m = table(spark, sf_dir, "members")
    return members.feed_origins(m.groupBy("user_id").agg(F.min("address_id").alias("personal_id")), m)


@_R.add(with_tables(" SELECT id, address_text FROM addresses WHERE postal_code IN ('100001', '100007', '100123')", "addresses"))
def j14_by_postcode(spark, sf_dir):
    texts = spark.createDataFrame([("100001 100007",), ("100123",)], "text string")
    return addresses.by_postcode(table(spark, sf_dir, "addresses"), texts).select("id", "address_text")


@_R.add(with_tables(""" SELECT d.id, d.user_id, u.chat_id, e.title, e.body, CASE WHEN e.importance IN (1, 2) THEN e.importance ELSE 1 END AS importance
    FROM deliveries d JOIN city_events e ON e.id = d.event_id JOIN (SELECT user_id, min(CASE WHEN chat_type = 'chat' THEN chat_id END) AS chat_id FROM members GROUP BY user_id) u ON u.user_id = d.user_id
    WHERE u.chat_id IS NOT NULL AND d.user_id % 2 = 0""", "city_events", "deliveries", "members"))
def j16_delivery_view(spark, sf_dir):
    """What is shown of deliveries that users ask for; odd users ask for the deliveries of the user before them and get none."""
    users = table(spark, sf_dir, "members").groupBy("user_id").agg(F.min(F.when(F.col("chat_type") == "chat", F.col("chat_id"))).alias("chat_id"))
    asked = table(spark, sf_dir, "deliveries").withColumn("asked_by", F.col("user_id") - F.col("user_id") % 2)
    return notify.delivery_view(asked, table(spark, sf_dir, "city_events"), users.withColumn("max_user_id", F.col("user_id"))).drop("max_user_id")


@_R.add(with_tables(" SELECT user_id, chat_id, (SELECT min(address_id) FROM members x WHERE x.chat_id = m.chat_id) AS address_id, count(*) AS n FROM members m GROUP BY user_id, chat_id", "members"))
def j20_chat_address(spark, sf_dir):
    return notify.chat_addresses(table(spark, sf_dir, "members"))


@_R.add(with_tables(r""" SELECT DISTINCT regexp_replace(source_msg_id, ':addr:\d+$', '') AS base FROM city_events WHERE source = 'mc' AND regexp_replace(source_msg_id, ':addr:\d+$', '') IN (SELECT 'moek:' || (id * 8) FROM city_events)""", "city_events"))
def j25_fan_out_match(spark, sf_dir):
    e = table(spark, sf_dir, "city_events")
    known = e.select(F.concat(F.lit("moek:"), (F.col("id") * 8).cast("string")).alias("base")).distinct()
    return candidates.fanned_out(e.filter("source = 'mc'"), known)


@_R.add(with_tables(" SELECT address_id, min(chat_id) AS first_chat, count(DISTINCT user_id) AS users FROM members GROUP BY address_id % 100, address_id", "members"))
def a5_first_added(spark, sf_dir):
    return notify.first_added(table(spark, sf_dir, "members"))


@_R.add("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a9_label_counts(spark, sf_dir):
    return records.counts_by(source(spark, sf_dir, "labels"), ["quality", "toxic"])


@_R.add(with_tables(" SELECT count(*) FILTER (active_from IS NOT NULL AND active_to IS NOT NULL) AS both_ends, count(*) FILTER (active_from IS NOT NULL AND active_to IS NULL) AS only_from, count(*) FILTER (active_from IS NULL AND active_to IS NOT NULL) AS only_to, count(*) FILTER (active_from IS NULL AND active_to IS NULL) AS neither FROM city_events", "city_events"))
def a13_bound_counts(spark, sf_dir):
    return labels.bound_counts(table(spark, sf_dir, "city_events"))


@_R.add(with_tables(" SELECT label, count(*) AS n, round(avg(score), 9) AS mean FROM pairs GROUP BY label", "pairs"))
def a14_mean_similarity(spark, sf_dir):
    return evaluate.mean_similarity(table(spark, sf_dir, "pairs")).withColumn("mean", F.round("mean", 9))


@_R.add("""WITH v AS (SELECT left(md5(c_name), 6) AS v FROM customer), p AS (SELECT length, upper(left(v, length)) AS prefix, count(*) AS n FROM v, (VALUES (1), (2), (3), (4)) l(length) GROUP BY ALL),
    f AS (SELECT length FROM p GROUP BY length HAVING count(*) BETWEEN 2 AND 20 AND max(n) <= 10000 ORDER BY length LIMIT 1) SELECT prefix, n FROM p JOIN f USING (length)""")
def a16_prefix_groups(spark, sf_dir):
    c = source(spark, sf_dir, "customer").select(F.left(F.md5(F.col("c_name").cast("binary")), F.lit(6)).alias("v"))
    return labels.prefix_groups(c, "v", groups=(2, 20), largest=10_000).select("prefix", "n")


@_R.add(with_tables(""" SELECT user_id, address_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN address_id % 3 <> 0 THEN address_id % 17 END NULLS LAST, chat_id, address_id) AS place FROM members""", "members"))
def w9_ordered_addresses(spark, sf_dir):
    m = table(spark, sf_dir, "members").withColumns({"added_at": F.when(F.col("address_id") % 3 != 0, F.col("address_id") % 17), "position": F.col("chat_id")})
    return members.ordered_addresses(m).select("user_id", "address_id", F.col("place").cast("long").alias("place"))


@_R.add(with_tables(" SELECT id, source FROM city_events WHERE id > 500 ORDER BY id LIMIT 101", "city_events"))
def l4_keyset_page(spark, sf_dir):
    return records.keyset_page(table(spark, sf_dir, "city_events"), "id", 500, 100).select("id", "source")


@_R.add(with_tables(""" SELECT n, id FROM (SELECT row_number() OVER (ORDER BY lower(address_text), id) AS n, id, least(2, greatest(1, ceil(count(*) OVER () / 10))) AS page
    FROM addresses WHERE city = 'NATION_5') x WHERE n > 10 * (page - 1) AND n <= 10 * page""", "addresses"))
def l9_page_by_number(spark, sf_dir):
    a = table(spark, sf_dir, "addresses").filter("city = 'NATION_5'")
    return records.numbered_page(a, [F.lower("address_text"), F.col("id")], 2, 10).select("n", "id")


@_R.add(with_tables(" SELECT id FROM city_events WHERE id NOT IN (SELECT id FROM city_events WHERE importance = 1)", "city_events"))
def sk3_delete(spark, sf_dir):
    e = table(spark, sf_dir, "city_events")
    return records.delete(e, e.filter("importance = 1"), ["id"]).select("id")


@_R.add("""SELECT c_custkey AS external_id, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS username FROM customer""")
def sk11_user_upsert(spark, sf_dir):
    c = source(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.select(k.alias("external_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("username"))
    new = c.select(k.alias("external_id"), F.when(k % 2 == 0, F.concat("c_name", F.lit("!"))).otherwise(" ").alias("name"), F.when(k % 3 == 0, "new").otherwise("").alias("username"))
    return members.upsert_users(old, new)


@_R.add(with_tables(""" , have AS (SELECT DISTINCT user_id, address_id FROM members WHERE chat_type = 'chat'), asked AS (SELECT DISTINCT user_id, address_id + (user_id % 2) * 100 AS address_id FROM members)
    SELECT a.user_id, a.address_id, CASE WHEN NOT EXISTS (SELECT 1 FROM have h WHERE h.address_id = a.address_id) THEN 'no_chat' WHEN NOT EXISTS (SELECT 1 FROM have h WHERE h.address_id = a.address_id AND h.user_id = a.user_id) THEN 'not_member' ELSE 'personal' END AS outcome FROM asked a""", "members"))
def x25_residence(spark, sf_dir):
    m = table(spark, sf_dir, "members")
    return members.residence(m, m.select("user_id", (F.col("address_id") + (F.col("user_id") % 2) * 100).alias("address_id")).distinct())


@_R.add(with_tables(""" , kept AS (SELECT * FROM members WHERE address_id % 4 <> 0), home AS (SELECT user_id, min(address_id) AS address_id FROM members GROUP BY user_id)
    SELECT h.user_id, CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.user_id = h.user_id AND k.address_id = h.address_id) THEN h.address_id ELSE (SELECT min_by(k.address_id, k.chat_id * 1000000 + k.address_id) FROM kept k WHERE k.user_id = h.user_id) END AS address_id FROM home h WHERE EXISTS (SELECT 1 FROM kept k WHERE k.user_id = h.user_id)""", "members"))
def x24_promote_home(spark, sf_dir):
    m = table(spark, sf_dir, "members")
    return members.promote(m.filter("address_id % 4 <> 0"), m.groupBy("user_id").agg(F.min("address_id").alias("address_id"))).filter("address_id IS NOT NULL")


@_R.add(with_tables(""" SELECT id, CASE WHEN s = 'pending' AND e = 'claim' THEN 'claimed' WHEN s IN ('pending', 'claimed') AND e = 'cancel' THEN 'cancelled' WHEN s = 'claimed' AND e = 'link' THEN 'linked' ELSE s END AS status
    FROM (SELECT id, ['pending', 'claimed', 'linked'][id % 3 + 1] AS s, ['claim', 'cancel', 'link', 'other'][id % 4 + 1] AS e FROM city_events) x""", "city_events"))
def c24_request_states(spark, sf_dir):
    i = F.col("id")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    return table(spark, sf_dir, "city_events").select("id", members.move(pick(["pending", "claimed", "linked"]), pick(["claim", "cancel", "link", "other"])).alias("status"))


@_R.add(with_tables(""" SELECT id, CAST(CASE WHEN t LIKE '%error%' THEN 1 WHEN t LIKE '%purchase%' THEN 2 ELSE 3 END AS INTEGER) AS importance, CASE WHEN t LIKE '%error%' THEN 'cat1:error' WHEN t LIKE '%purchase%' THEN 'cat2:purchase' ELSE 'default_info' END AS reason
    FROM (SELECT id, lower(body) AS t FROM city_events) e""", "city_events"))
def c3_label_rules(spark, sf_dir):
    rules = [("cat1:error", "error", 1, True, 0.92), ("cat2:purchase", "purchase", 2, False, 0.9)]
    e = table(spark, sf_dir, "city_events").withColumn("r", labels.first_rule(F.col("body"), rules, (3, False, 0.75)))
    return e.select("id", "r.importance", "r.reason")


@_R.add(with_tables(""" SELECT text, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY r) AS n FROM (
    SELECT DISTINCT title AS text, 'gold' AS source, 0 AS r FROM city_events WHERE title IS NOT NULL AND id % 2 = 0 UNION ALL SELECT DISTINCT title, 'rest', 1 FROM city_events WHERE title IS NOT NULL) u) x WHERE n = 1""", "city_events"))
def u3_merged_sources(spark, sf_dir):
    e = table(spark, sf_dir, "city_events").filter("title IS NOT NULL")
    part = lambda d, name: d.select(F.col("title").alias("text"), F.lit(name).alias("source")).distinct()
    return labels.merged([part(e.filter("id % 2 = 0"), "gold"), part(e, "rest")], "text")


@_R.add("SELECT doc_id, CASE WHEN ('0x' || left(md5('1:' || doc_id), 8))::BIGINT < 858993459 THEN 'valid' ELSE 'train' END AS part FROM documents")
def c26_split(spark, sf_dir):
    return labels.split(source(spark, sf_dir, "documents"), "doc_id", 0.2).select("doc_id", "part")


@_R.add(with_tables(""" SELECT id, date_diff('second', created_at, active_from) / 3600.0::DOUBLE AS from_h, CASE WHEN abs(date_diff('second', created_at, active_to) / 3600.0) <= 48 THEN date_diff('second', created_at, active_to) / 3600.0::DOUBLE END AS to_h FROM city_events""", "city_events"))
def d9_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "city_events")
    return e.select("id", labels.offsets(F.col("created_at"), F.col("active_from"), F.col("active_to"), 48).alias("o")).select("id", "o.*")


@_R.add(with_tables(""" SELECT id, least(a, b) AS active_from, greatest(a, b) AS active_to FROM (SELECT id, created_at + to_hours(CAST(id % 5 AS INTEGER)) AS a, created_at + to_hours(CAST(id % 7 AS INTEGER)) AS b FROM city_events) x""", "city_events"))
def d8_bounds(spark, sf_dir):
    e = table(spark, sf_dir, "city_events")
    return e.select("id", labels.bounds(F.col("created_at"), F.col("id") % 5, F.col("id") % 7).alias("b")).select("id", "b.*")


DRAFTS = """ , d AS (SELECT id, source, CASE WHEN id % 40 = 0 THEN 'draft:' || id ELSE 'known:' || (id + 1) END AS source_msg_id, address_id, id % 7 + 1 AS x, id % 11 AS y, id % 13 AS z FROM city_events WHERE id % 20 = 0),
    e AS (SELECT id, CASE WHEN id % 20 = 1 THEN (SELECT source FROM city_events p WHERE p.id = c.id - 1) ELSE source END AS source, 'known:' || id AS source_msg_id, CASE WHEN id % 9 <> 0 THEN address_id END AS address_id, id % 7 + 1 AS x, id % 11 AS y, id % 13 AS z FROM city_events c WHERE id % 20 <> 0),
    same AS (SELECT d.id, max(e.id) AS same_id FROM d JOIN e USING (source, source_msg_id) GROUP BY d.id),
    pairs AS (SELECT d.id, e.id AS event_id, round((d.x * e.x + d.y * e.y + d.z * e.z)::DOUBLE / (sqrt((d.x * d.x + d.y * d.y + d.z * d.z)::DOUBLE) * sqrt((e.x * e.x + e.y * e.y + e.z * e.z)::DOUBLE)), 9) AS score FROM d JOIN e ON d.address_id = e.address_id
        UNION ALL SELECT d.id, e.id, round((d.x * e.x + d.y * e.y + d.z * e.z)::DOUBLE / (sqrt((d.x * d.x + d.y * d.y + d.z * d.z)::DOUBLE) * sqrt((e.x * e.x + e.y * e.y + e.z * e.z)::DOUBLE)), 9) FROM d JOIN e ON e.address_id IS NULL),
    best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, event_id DESC) = 1)
    SELECT d.id, CASE WHEN same_id IS NOT NULL OR score >= 0.82 THEN 'duplicate' WHEN score >= 0.7 THEN 'update' ELSE 'new' END AS action, coalesce(same_id, event_id) AS match_id FROM d LEFT JOIN same USING (id) LEFT JOIN best USING (id)"""


@_R.add(with_tables(DRAFTS, "city_events"))
def c11_same_message(spark, sf_dir):
    e = table(spark, sf_dir, "city_events")
    i = F.col("id")
    rows = e.withColumn("v", F.array(*[x.cast("double") for x in (i % 7 + 1, i % 11, i % 13)]))
    known = F.concat(F.lit("known:"), (i + (i % 20 == 0).cast("int")).cast("string"))
    drafts = rows.filter("id % 20 = 0").withColumn("source_msg_id", F.when(i % 40 == 0, F.concat(F.lit("draft:"), i.cast("string"))).otherwise(known))
    before = e.select((i + 1).alias("id"), F.col("source").alias("before"))
    events = rows.filter("id % 20 <> 0").join(before, "id", "left").withColumns({
        "source": F.when(i % 20 == 1, F.col("before")).otherwise(F.col("source")), "source_msg_id": known, "address_id": F.when(i % 9 != 0, F.col("address_id")),
    })
    return dedup.resolve(drafts, events).select("id", "action", "match_id")


@_R.add(with_tables(""" SELECT id, CASE WHEN lat < 55.75 THEN 'South' ELSE 'North' END AS district FROM addresses WHERE lat <> 55.75 AND lon BETWEEN 37.0 AND 38.5 AND lat BETWEEN 55.0 AND 56.5""", "addresses"))
def c19_changed_districts(spark, sf_dir):
    # two boundaries of four nodes each, their ways in mixed order and direction
    def box(k, name, south, north):
        nodes = [(k + i, y, x) for i, (y, x) in enumerate(((south, 37.0), (south, 38.5), (north, 38.5), (north, 37.0)))]
        ways = [(k, [k, k + 1]), (k + 1, [k + 3, k + 2]), (k + 2, [k + 2, k + 1]), (k + 3, [k + 3, k])]
        return (
            [("node", i, y, x, None, None, None) for i, y, x in nodes]
            + [("way", i, None, None, n, None, None) for i, n in ways]
            + [("relation", k, None, None, None, [("way", i, "outer") for i, _ in ways], {"admin_level": "8", "name": name})]
        )

    elements = spark.createDataFrame(box(10, "South", 55.0, 55.75) + box(20, "North", 55.75, 56.5), "type string, id long, lat double, lon double, nodes array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
    bounds = boundaries.boundaries(elements)
    return boundaries.changed_districts(table(spark, sf_dir, "addresses").filter("lat <> 55.75"), bounds)


@_R.add(with_tables(""" , a AS (SELECT *, 'node/' || id AS source_key FROM addresses UNION ALL SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN lat + 1 ELSE lat END AS lat), 'way/' || id FROM addresses WHERE id % 2 = 0)
    SELECT id, min(source_key) AS source_key, count(*) AS n FROM a GROUP BY id HAVING count(DISTINCT lat) = 1""", "addresses"))
def c18_prepare(spark, sf_dir):
    a = table(spark, sf_dir, "addresses")
    key = lambda d, kind: d.withColumn("source_key", F.concat(F.lit(f"{kind}/"), F.col("id").cast("string")))
    second = a.filter("id % 2 = 0").withColumn("lat", F.when(F.col("id") % 5 == 0, F.col("lat") + 1).otherwise(F.col("lat")))
    agree, _ = records.split_conflicts(key(a, "node").unionByName(key(second, "way")), "id", ["lat", "lon", "postal_code", "is_private"], "source_key")
    return agree.select("id", "source_key", "n")


@_R.add()
def f28_due_chats(spark, sf_dir):
    chats = table(spark, sf_dir, "members").select("chat_id", "chat_type").distinct().withColumn("last_digest_date", F.lit(None).cast("date"))
    return members.due_chats(chats, _now(), 3, 30).select("chat_id")
