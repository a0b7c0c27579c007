"""Queries of text, date and label functions whose right answers are written down: every event has one of a list of texts.

The SQL has the answers, worked out by hand from the rules; so a query is a function on a whole column against what
it should give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import members
from ..sources import pages as P
from .overlay import source
from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
Case = tuple[str | None, object]


def _literal(value: object, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    return f"CAST({value} AS {kind})" if isinstance(value, (bool, int, float)) else f"CAST('{value}' AS {kind})".replace("\n", "' || chr(10) || '")


def _add(name: str, doc: str, function: Callable[[Column], Column], cases: list[Case], kind: str = "VARCHAR") -> None:
    """A query of a function of one text."""

    def query(spark, sf_dir):
        texts = F.array(*[F.lit(t).cast("string") for t, _ in cases])
        rows = source(spark, sf_dir, "events").select("event_id", F.get(texts, (F.col("event_id") % len(cases)).cast("int")).alias("t"))
        read = rows.select("t").distinct().withColumn("value", function(F.col("t")))  # each text is read once
        return rows.join(read.withColumnRenamed("t", "u"), F.col("t").eqNullSafe(F.col("u"))).select("event_id", "value")

    query.__name__, query.__doc__ = name, doc
    branches = " ".join(f"WHEN {i} THEN {_literal(v, kind)}" for i, (_, v) in enumerate(cases))
    _R.add(f"SELECT event_id, CASE event_id % {len(cases)} {branches} END AS value FROM events")(query)


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


_add("k2_normal_text", "K2", T.normalize_text, [("  Ёлка  И\t Ёж ", "елка и еж"), ("", ""), (None, None), ("ABC\nдеф", "abc деф")])
_add("k3_component", "K3", T.normalize_component, [("  ", None), (" Улица  Мира", "улица мира"), (None, None)])
_add("k4_ui_text", "K4: the NFKC form, without marks, ё as е", T.ui_text, [("ＡＢＣ​ Ёж", "abc еж"), ("Дом № 5", "дом no 5"), ("½ ﬁ", "1⁄2 fi"), (None, ""), ("‪Мир‬", "мир")])
_add("k5_search_text", "K5", T.search_text, [("ул. Мира 15/1", "улица мира 15 корпус 1"), ("Мира 15к1", "мира 15 корпус 1"), ("пр-т Мира, д.2с3", "проспект мира дом 2 строение 3"), (None, ""), ("б-р Яна-Райниса", "бульвар яна райниса")])
_add("k6_address_text", "K6", T.address_text, [("ул. Ленина, д.5", "улица ленина дом 5"), ("просп Мира 3/1", "проспект мира 3/1"), ("пер. Сивцев, корп 2", "переулок сивцев корпус 2"), ("наб. Реки", "набережная реки")])
_add("k7_street_name", "K7", T.street_name, [("улица Мира", "мира"), ("ул. Мира", "мира"), ("Мира улица", "мира улица"), (" ", None), ("пр-т  Ленина", "ленина"), (None, None)])
_add("k8_streets_match", "K8", lambda c: T.streets_match(c, F.lit("улица Мира")), [("ул. Мира", True), ("Мира", True), ("улица Ленина", False), (None, False)], "BOOLEAN")
_add("k9_house", "K9", T.house, [("15 корпус 1", "15к1"), ("15 Стр 2", "15с2"), (" ", None), (None, None), ("2А", "2а")])
_add("k9_house_search", "K9", T.house_search, [("15 корпус 1", "15/1"), ("15с1", "15/1"), ("15/1", "15/1"), ("15", "15"), (None, None)])
_add("k9_house_keys", "K9", lambda c: _joined(T.house_keys(c)), [("15 корпус 1", "15к1|15к|15"), ("15", "15"), ("7/2", "7/2|7"), (None, "")])
_add("k14_stem", "K14", T.stem, [("тверская", "тверск"), ("мира", "мира"), ("ленинском", "ленинск"), ("Нового", "нового"), ("академика", "академика")])
_add("k15_alias_keys", "K15", lambda c: _joined(T.alias_keys(c)), [("улица Мира", "мира|улица мира"), ("", ""), (None, None)])
_add("k17_clean_body", "K17", lambda c: T.clean_body(c, F.lit("Отключение воды")), [("Отключение воды. Завтра не будет холодной воды", "Завтра не будет холодной воды"), ("Отключение воды", None), ("Завтра во дворе концерт. Читать далее", "Завтра во дворе концерт"), ("Коротко", None), (None, None)])
_add("k19_ids", "K19", P.id_from_url, [("https://a.b/doc/123?x=1", "123"), ("https://a.b/news/20240101/77/", "77"), ("https://a.b/text/gorod/2024/01/02/55/", "55"), ("https://a.b/abc-1234567.html", "1234567"), ("https://a.b/c", None), (None, None)])
_add("k22_postcodes", "K22", lambda c: _joined(T.postcodes(c)), [("101000, 101000 и 125047", "101000|125047"), ("1234567", ""), (None, None)])
_add("k23_house_in_text", "K23", T.house_in_text, [("на ул. Мира, д. 15 к 1", "15к1"), ("дом 7а", "7а"), ("без дома", None), (None, None)])
_add("k24_street_hints", "K24", lambda c: _joined(T.street_hints(c)), [("Авария на улице Мира сегодня", "Мира"), ("Перекрыт Ленинский проспект", "Перекрыт Ленинский"), ("пожар на Арбате.", "Арбате"), ("ничего", "")])
_add("k26_bullets", "K26", T.bullets, [("- раз\n* два\n3) три", "• раз\n• два\n• три"), ("Итог:\n- раз\n- два\n- три\n- четыре\n- пять\n- шесть", "• раз\n• два\n• три\n• четыре\n• пять"), ("- раз\n- два", None), ("раз\nдва\nтри", None), (None, None)])
_add("k26_decorated", "K26", lambda c: T.decorated(c, None), [("#итого\n• раз", "#итого\n\n• раз"), ("• раз", "#итого\n\n• раз"), (" ", "#итого")])
_add("k27_payload", "K27; 0 for none", lambda c: F.coalesce(T.payload_id(c, "ack"), F.lit(0)), [("notify:ack:15", 15), ("notify:ack:0", 0), ("notify:ack:x", 0), ("notify:open:5", 0), (None, 0)], "INTEGER")
_add("k32_street_key", "K32", T.street_key, [("улица Мира", "мира улица"), ("Мира ул.", "мира улица"), ("", "")])
_add("d2_times", "D2", lambda c: P.parse_time(c).cast("timestamp_ntz"), [("2024-01-05T01:02:03Z", "2024-01-05 01:02:03"), ("Wed, 02 Oct 2024 15:00:00 +0300", "2024-10-02 12:00:00"), ("вчера", None), (None, None)], "TIMESTAMP")
_add("d3_ru_dates", "D3", lambda c: P.parse_ru_date(c).cast("timestamp_ntz"), [("21 сентября 2026, 10:30", "2026-09-21 10:30:00"), ("01.02.2024 05:06", "2024-02-01 05:06:00"), ("5 мая 2024", "2024-05-05 00:00:00"), ("31.02.2024", None), ("завтра", None)], "TIMESTAMP")
_add("d7_digest_minute", "D7: the hashes of -1, 5 and 77", lambda c: members.digest_minute(c.cast("long"), 20, 30), [("-1", 1173), ("5", 1195), ("77", 1179)], "BIGINT")
_add("f14_greeting", "F14", T.greeting_only, [("Привет!", True), ("Добрый день", True), ("Привет, как дела?", False), ("+", True), ("Всем привет!!!", True)], "BOOLEAN")
_add("f20_bare_city", "F20", rules.bare_city, [("Казань", True), ("улица Казань", False), ("Самарская", False), ("Нижний Новгород!", True), ("нью-йорк", True)], "BOOLEAN")
_add("f21_local_hints", "F21", lambda c: _joined(rules.local_hints(F.split(c, ";"))), [("Минск;улица Минская;Самара;Самарская; ", "улица Минская|Самарская"), ("Тверская;Берлин", "Тверская"), ("", "")])
_add("f22_boilerplate", "F22", T.is_boilerplate, [("Подробнее на сайте", True), ("Читать далее", True), ("", True), (None, True), ("Читайте нас", True), ("Подробнее о том, как завтра во дворе дома пройдёт большой праздник", False), ("Концерт", False)], "BOOLEAN")
_add("f24_update_hint", "F24", T.has_update_hint, [("Авария устранена", True), ("Воду подали", False), ("подали  воду", True), ("Работы продлены", True), ("Новая авария", False), (None, False)], "BOOLEAN")
_add("k20s_outlet", "K20s", T.outlet, [("tass:1", "tass"), ("a:b:c", "a"), ("nocolon", None), (" :x", None), (None, None)])
_add("l10_natural_order", "L10: whether a house comes before 10", lambda c: T.natural_key(c) < T.natural_key(F.lit("10")), [("9", True), ("10", False), ("10а", False), ("2к15", True), ("100", False)], "BOOLEAN")
_add("v7_digests", "V7", lambda c: F.left(F.sha2(c, 256), F.lit(24)), [("a", "ca978112ca1bbdcafac231b3"), ("", "e3b0c44298fc1c149afbf4c8"), (None, None)])
