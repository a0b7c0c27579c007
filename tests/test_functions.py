"""Text, ranking and rule columns on single values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from civicfeed.functions import ranking as R
from civicfeed.functions import rules
from civicfeed.functions import text as T
from civicfeed.operators import evaluate
from civicfeed.functions.likeness import indel_ratio
from civicfeed.sources import pages as P


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "fn,text,want",
    [
        (T.collapse_ws, " a  b\n", "a b"),
        (T.normalize_text, "Ёлка  И", "елка и"),
        (T.normalize_component, "  ", None),
        (T.address_text, "Ул. Ленина, д.5 к.2", "улица ленина дом 5 корпус 2"),
        (T.search_text, "15/1", "15 корпус 1"),
        (T.search_text, "Ленина 15к1", "ленина 15 корпус 1"),
        (T.street_name, "ул. Тверская", "тверская"),
        (T.house, "15 корпус 1", "15к1"),
        (T.house_search, "15с1", "15/1"),
        (T.house_keys, "2к1", ["2к1", "2к", "2"]),
        (T.stem, "тверская", "тверск"),
        (T.stem, "дом", "дом"),
        (T.outlet, "tass:1:2", "tass"),
        (T.outlet, "tass", None),
        (T.base_id, "moek:9:addr:10", "moek:9"),
        (T.postcodes, "123456 и 1234567, 123456 654321", ["123456", "654321"]),
        (T.house_in_text, "на ул. Мира, дом 5 к 2", "5к2"),
        (T.is_boilerplate, "Подробнее на сайте.", True),
        (T.is_boilerplate, "Сегодня отключат воду на улице Мира", False),
        (T.greeting_only, "Добрый день!!", True),
        (T.greeting_only, "Добрый день, нет воды", False),
        (T.has_update_hint, "Авария устранена", True),
        (T.has_update_hint, "Авария", False),
        (T.natural_key, "2а", "000000000002а"),
        (T.street_key, "Мира ул", "мира улица"),
        (rules.project_city, "Московская область", True),
        (rules.in_moscow, "Вчера в Москве", True),
        (P.id_from_url, "https://a.b/doc/123?x=1", "123"),
        (P.id_from_url, "https://a.b/x?id=5", None),
        (P.title_from_slug, "https://a.b/novost-dnya-1234567", "novost dnya"),
        (P.strip_html, "<p>a&amp;b<br>c</p><script>x</script>", "a&b c"),
    ],
)
def test_text(spark, fn, text, want):
    assert one(spark, fn(F.col("t")), t=text) == want


def test_alias_keys(spark):
    keys = one(spark, T.alias_keys(F.col("t")), t="1-я Тверская улица")
    assert {"1 я тверская улица", "тверск"} <= set(keys) or "тверская" in keys


def test_clean_body(spark):
    clean = lambda b, t: one(spark, T.clean_body(F.col("b"), F.col("t")), b=b, t=t)
    assert clean("Отключение воды на улице Мира завтра. Подробнее на сайте", None) == "Отключение воды на улице Мира завтра"
    assert clean("Подробнее на сайте", None) is None
    assert clean("Заголовок статьи. И длинный текст о воде в доме", "Заголовок статьи") == "И длинный текст о воде в доме"
    assert clean("Заголовок длинной статьи тут", "Заголовок длинной статьи тут") is None


def test_compact_and_bullets(spark):
    assert one(spark, T.compact(F.col("t"), 5), t="abcdefg") == "abcd…"
    assert one(spark, T.bullets(F.col("t")), t="- a\n* b\n1. c") == "• a\n• b\n• c"
    assert one(spark, T.bullets(F.col("t")), t="- a") is None
    assert one(spark, T.payload_id(F.col("t"), "ack"), t="notify:ack:12") == 12
    assert one(spark, T.payload_id(F.col("t"), "ack"), t="notify:ack:0") is None


def test_parse_address(spark):
    x = one(spark, T.parse_address(F.col("t")), t="Москва, Арбат, ул. Мира, д. 5")
    assert tuple(x) == ("Москва", "Арбат", "ул. Мира", "5")


def test_distance_and_weight(spark):
    metres = one(spark, R.haversine(F.lit(55.75), F.lit(37.6), F.lit(55.76), F.lit(37.6)))
    assert abs(metres - 1111.95) < 0.5
    full = R.weight(F.lit(1), F.lit("news"), F.lit("tass"), F.lit("home"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), F.lit(0.0))
    assert abs(one(spark, full) - (0.5 * 1.0 + 0.3 * 0.5 + 0.2 * 0.92)) < 1e-12
    assert one(spark, R.band(F.lit(250.0))) == "home" and one(spark, R.band(F.lit(1500.1))) == "district"
    assert abs(one(spark, R.boosted(F.lit(0.5), F.lit(True), F.lit(None).cast("boolean"))) - 0.57) < 1e-12


def test_circle_is_closed(spark):
    ring = one(spark, R.circle(F.lit(55.75), F.lit(37.6), 800.0))
    assert len(ring) == 65 and abs(ring[0].lat - ring[-1].lat) < 1e-9
    inside = R.point_in_ring(F.lit(37.6), F.lit(55.75), R.circle(F.lit(55.75), F.lit(37.6), 800.0))
    assert one(spark, inside)


def test_softmax(spark):
    p = one(spark, R.softmax(F.array(F.lit(1.0), F.lit(2.0))))
    assert abs(sum(p) - 1) < 1e-12 and abs(p[1] / p[0] - math.e) < 1e-9


def test_rules(spark):
    x = one(spark, rules.importance(F.col("t")), t="Сильный УРАГАН в городе")
    assert tuple(x) == (1, True)
    assert tuple(one(spark, rules.importance(F.col("t")), t="идёт пожар"))[0] == 3  # a needle with ё never matches
    assert tuple(one(spark, rules.importance(F.col("t")), t=None)) == (3, False)


@pytest.mark.parametrize("text,want", [("21 сентября 2026, 10:30", "2026-09-21 10:30:00"), ("01.02.2024 05:06", "2024-02-01 05:06:00"), ("Wed, 02 Oct 2024 15:00:00 +0300", "2024-10-02 12:00:00"), ("2024-01-05T01:02:03Z", "2024-01-05 01:02:03"), ("завтра", None)])
def test_dates(spark, text, want):
    got = one(spark, P.parse_ru_date(F.col("t")).cast("string"), t=text)
    assert got == want


def test_published_confusion_matrices(spark):
    """The two published matrices give their published macro F1."""
    for matrix, want in (([[138, 178, 21], [63, 315, 107], [30, 113, 333]], 0.591382), ([[79, 146, 112], [28, 195, 262], [19, 54, 403]], 0.475897)):
        data = [(t, g) for t, row in zip(evaluate.LABELS, matrix, strict=True) for g, n in zip(evaluate.LABELS, row, strict=True) for _ in range(n)]
        got = evaluate.f1(spark.createDataFrame(data, "label string, guess string"), []).first().macro_f1
        assert abs(got - want) < 1e-6


def test_indel_ratio():
    assert indel_ratio("abc", "abc") == 100
    assert indel_ratio("abc", "") == 0
    assert abs(indel_ratio("kitten", "sitting") - 200 * 4 / 13) < 1e-9


WINDOWS = [
    ("Отключение ГВС с 01.02.2024 10:00 по 03.02.2024 18:00", ("2024-02-01 10:00:00", "2024-02-03 18:00:00", "dmy_range_s_po")),
    ("отключение с 15.01 9:30:15, время включения 16.01", ("2024-01-15 09:30:15", "2024-01-16 00:00:00", "dmy_range_s_po")),
    ("работы с 12 января по 14 января", ("2024-01-12 00:00:00", "2024-01-14 23:59:00", "day_month_range")),
    # farther than 400 hours ahead: the year before is as far back, so the year after is taken
    ("работы с 1 мая по 3 мая", ("2025-05-01 00:00:00", "2025-05-03 23:59:00", "day_month_range")),
    ("работы с 1 мая 2024 по 3 мая 2024", ("2024-05-01 00:00:00", "2024-05-03 23:59:00", "day_month_range")),
    ("с 28 декабря по 30 декабря", ("2023-12-28 00:00:00", "2023-12-30 23:59:00", "day_month_range")),
    ("опрессовка 7 - 21 июля 2026", ("2026-07-07 00:00:00", "2026-07-21 23:59:00", "day_dash_day_month")),
    ("опрессовка 7–31 июня 2026", ("2026-06-07 00:00:00", "2026-06-28 23:59:00", "day_dash_day_month")),
    ("16.01-18.01 не будет воды", ("2024-01-16 00:00:00", "2024-01-18 23:59:00", "dmy_dash_dmy")),
    ("завтра с 10:00 до 12:30", ("2024-01-11 10:00:00", "2024-01-11 12:30:00", "rel_day_time_range")),
    ("сегодня ночью 23:00-02:00", ("2024-01-10 23:00:00", "2024-01-11 02:00:00", "rel_day_time_range")),
    ("завтра 15/01 будет трактор", ("2024-01-15 08:00:00", "2024-01-15 14:00:00", "rel_day_slash_date")),
    ("послезавтра в 23:00", ("2024-01-12 23:00:00", "2024-01-13 03:00:00", "rel_day_time_start")),
    ("завтра чистка снега с 9 часов", ("2024-01-11 09:00:00", "2024-01-11 16:00:00", "rel_day_from_hour")),
    ("в пятницу, 12 января", ("2024-01-12 08:00:00", "2024-01-12 20:00:00", "weekday_day_month")),
    ("воды нет до завтра до 18 часов", (None, "2024-01-11 18:00:00", "until_tomorrow")),
    ("ветер до завтра", (None, "2024-01-11 23:59:00", "until_tomorrow")),
    ("ремонт до 15/01", (None, "2024-01-15 23:59:00", "until_dmy")),
    ("ремонт до 15.01", (None, "2024-01-15 00:00:00", "until_dmy")),
    ("ремонт до 15 января", (None, "2024-01-15 23:59:00", "until_day_month")),
    ("ремонт с 15.01", ("2024-01-15 00:00:00", None, "from_dmy_only")),
    ("ремонт с 15 января", ("2024-01-15 00:00:00", None, "from_day_month_only")),
    ("лифт стоит с 10:00 до 12:00", ("2024-01-10 10:00:00", "2024-01-10 12:00:00", "same_day_time_range")),
    ("лифт стоит с 06:00 до 07:00", ("2024-01-11 06:00:00", "2024-01-11 07:00:00", "same_day_time_range")),
    ("сильный ветер днем 12, ночью и днём 13 января", ("2024-01-12 00:00:00", "2024-01-13 23:59:00", "weather_day_span")),
    ("оплата до 15/01", None),
    ("сказка до 15/01", None),
    ("просто текст", None),
]


def test_windows(spark):
    from civicfeed.functions import windows

    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WINDOWS)], "i int, t string")
    ref = F.lit("2024-01-10 09:00:00").cast("timestamp_ntz")
    for r in texts.select("i", windows.window(F.col("t"), ref).alias("w")).collect():
        text, want = WINDOWS[r.i]
        assert (r.w and tuple(None if x is None else str(x) for x in (r.w.active_from, r.w.active_to, r.w.pattern))) == want, text


def test_without_window(spark):
    from civicfeed.functions import windows

    cases = [("просто текст", True), ("передать показания до 25", True), ("завтра с 10:00 до 12:00", False), ("в мае", True), ("отмена 5 мая", False), (None, True)]
    got = spark.createDataFrame(cases, "t string, want boolean").select("t", "want", windows.without_window(F.col("t")).alias("is")).collect()
    assert all(r["is"] == r.want for r in got), got


@pytest.mark.parametrize("needle", rules.DISASTER + rules.URGENT + rules.IMPORTANT)
def test_every_keyword(needle):
    """Each keyword of both lists is tried by the pattern of its class."""
    assert re.search(rules.any_of([x for x in (rules.DISASTER, rules.URGENT, rules.IMPORTANT) if needle in x][0]), f"вот {needle}")


def test_keywords_decide(spark):
    for text, want in (("Взрыв газа в доме", (1, True)), ("Теракт предотвращён", (1, True)), ("Обрушение стены", (1, True)), ("мужчина с ножом", (1, False)), ("заливает соседей", (1, False)), ("авария на сетях", (2, False)), ("без отопления", (2, False)), ("ярмарка", (3, False))):
        assert tuple(one(spark, rules.importance(F.col("t")), t=text)) == want, text


def test_places(spark):
    for text in ("пожар в Свердловской области", "поездка в республику Татарстан", "Тульский край", "новости из Тулы"):
        assert one(spark, rules.elsewhere(F.col("t")), t=text), text
    hints = F.array(F.lit("Минск"), F.lit("улица Минская"), F.lit("Самара"), F.lit("Самарская"), F.lit(" "))
    assert one(spark, rules.local_hints(hints)) == ["улица Минская", "Самарская"]
    assert one(spark, rules.is_foreign(F.col("t")), t="Встреча в Берлине")
    assert not one(spark, rules.is_foreign(F.col("t")), t="Ремонт на улице Мира")
    assert one(spark, rules.elsewhere(F.col("t")), t="В Самаре снег") and not one(spark, rules.elsewhere(F.col("t")), t="В Москве и Самаре снег")
    assert one(spark, rules.bare_city(F.col("t")), t="Казань") and not one(spark, rules.bare_city(F.col("t")), t="улица Казань")
