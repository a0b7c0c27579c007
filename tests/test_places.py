"""Joins by place across the meridian of 180 degrees, places of houses, texts to addresses, owners' deliveries: against plain loops."""

import math
import random

from pyspark.sql import functions as F

from civicfeed.functions.likeness import indel_ratio, partial_ratio
from civicfeed.operators import addresses as A
from civicfeed.operators import feed, geo, notify, records


def metres(a, b):
    (la, lo), (lb, lp) = ([math.radians(x) for x in p] for p in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))


def test_near_across_the_meridian(spark):
    rng = random.Random(5)
    points = [(i, rng.uniform(-17, -16.9), (179.95 + rng.uniform(0, 0.1) + 180) % 360 - 180) for i in range(150)] + [(150, -16.95, 180.0), (151, -16.95, -180.0)]
    rows = spark.createDataFrame([(*p, "x") for p in points], "id long, lat double, lon double, street string")
    origins = spark.createDataFrame([(*p, "x") for p in points[::10] + points[150:]], "user_id long, o_lat double, o_lon double, o_street string")
    got = {(r.user_id, r.id) for r in geo.near(rows, origins, 1000.0).collect()}
    assert got == {(o[0], p[0]) for o in points[::10] + points[150:] for p in points if metres(o[1:], p[1:]) <= 1000}
    first = geo.nearest(rows, origins.withColumnRenamed("user_id", "origin_id"), 1, 1000.0).filter("origin_id = 150").first()
    assert first.id in (150, 151)


def test_places_of_houses(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["A", "B", None]), rng.choice(["x", "y"]), rng.choice(["1", "2", "10", "10а", "2к1", None])) for i in range(300)]
    got = {r.id: r.place for r in A.house_labels(spark.createDataFrame(rows, "id long, city string, street string, house string")).collect()}
    order = ["1", "2", "2к1", "10", "10а"]
    for city in ("A", "B", None):
        own = sorted((-1 if h is None else order.index(h), i) for i, c, _, h in rows if c == city)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))


def test_match_text_against_all_pairs(spark):
    rng = random.Random(7)
    names = ["мира", "ленина", "академика королева", "тверская", "новый арбат", "яр", "ту", "льва толстого", "большая черкизовская"]
    houses = ["1", "2", "15"]
    known = [(i, f"улица {n}", h) for i, (n, h) in enumerate((n, h) for n in names for h in houses)]

    def worn(n):
        letters = list(n)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(letters))
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "о", "а"])
        return "".join(letters) or n

    texts = [(i, f"авария на {worn(rng.choice(names))} дом {rng.choice(houses + ['7'])} сегодня") for i in range(150)]
    a = spark.createDataFrame([(i, s, h, None) for i, s, h in known], "id long, street string, house string, postal_code string")
    got = {r.text_id: r.address_id for r in A.match_text(spark.createDataFrame(texts, "text_id long, text string"), a).collect()}
    want = {}
    for i, text in texts:
        words = text.split()
        house = words[words.index("дом") + 1]
        words = words[: words.index("дом")] + words[words.index("дом") + 2 :]
        scores = sorted(((A.street_score(s.split(" ", 1)[1], words), -n) for n, s, h in known if h == house), reverse=True)
        if scores and scores[0][0] >= 90 and scores[0][0] - scores[1][0] >= 5:
            want[i] = -scores[0][1]
    assert got == want and len(want) > 40


def test_pages_end_where_rows_do(spark):
    rows = spark.createDataFrame([(i,) for i in range(23)], "id long")
    page = lambda n: [(r.n, r.id) for r in records.numbered_page(rows, [F.desc("id")], n, 10).orderBy("n").collect()]
    assert page(1) == page(-4) == [(i + 1, 22 - i) for i in range(10)] and page(3) == page(9) == [(21, 2), (22, 1), (23, 0)]
    assert records.numbered_page(rows.limit(0), [F.col("id")], 1, 10).isEmpty()


def test_deliveries_are_for_their_owners(spark):
    deliveries = spark.createDataFrame([(1, 7, 70, 70, 5), (2, 7, 71, 70, 5), (3, 8, 80, 80, 6), (4, 9, 90, 90, 6)], "id long, user_id long, asked_by long, x long, event_id long")
    events = spark.createDataFrame([(5, "t", None, 3), (6, None, "b", 2)], "id long, title string, body string, importance int")
    users = spark.createDataFrame([(7, 70, -1), (8, 80, None), (9, 90, -3)], "user_id long, max_user_id long, chat_id long")
    got = notify.delivery_view(deliveries, events, users).select("id", "chat_id", "title", "body", "importance").collect()
    assert sorted(map(tuple, got)) == [(1, -1, "t", "", 1), (4, -3, None, "b", 2)]


def test_nearby_feed_keeps_whole_events(spark):
    """Two addresses of one user near one event: the nearer counts; copies by content fall to the nearest."""
    known = [(1, "A", "улица Мира", "A 1", 55.7500, 37.60), (2, "A", "улица Мира", "A 2", 55.7510, 37.60), (3, "A", "иная", "A 3", 55.9, 37.60)]
    addresses = spark.createDataFrame(known, "id long, city string, street string, address_text string, lat double, lon double")
    rows = [(10, 1, "A long enough title", "b"), (11, 2, "A long  enough TITLE", "c"), (12, 3, "Another long title", "d")]
    events = spark.createDataFrame([(*r, 1, "news", f"m:{r[0]}", "home") for r in rows], "id long, address_id long, title string, body string, importance int, source string, source_msg_id string, geo_by string")
    at = F.lit("2024-01-01").cast("timestamp")
    events = events.withColumns({"published_at": at, "created_at": at, "active_from": F.lit(None).cast("timestamp"), "active_to": F.lit(None).cast("timestamp")})
    origins = spark.createDataFrame([(1, 55.7502, 37.60, "ул. Мира"), (1, 55.7490, 37.60, "иная")], "user_id long, o_lat double, o_lon double, o_street string")
    got = feed.nearby_feed(events, addresses, origins, at, 1500.0).collect()
    assert [(r.id, r.body, r.same_street, r.address_text) for r in got] == [(10, "b", True, "A 1")] and abs(got[0].distance - 22.2) < 1


def test_partial_ratio_is_bounded_right():
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("абв ") for _ in range(rng.randint(0, 12)))
    for _ in range(3000):
        a, b = sorted((text(), text()), key=len)
        windows = [indel_ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b))] if a else []
        full = 100.0 if (not a and not b) or (a and a in b) else max(windows, default=0.0)
        least = rng.choice([0.0, rng.uniform(0, 100)])
        assert partial_ratio(a, b, least) == max(full, least)
