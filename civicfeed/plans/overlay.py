"""The city-event tables, seen in the driver's tables by one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

ADDRESSES = """SELECT c_custkey + 1 AS id, n_name AS city, c_mktsegment AS district,
  concat('Street ', CAST(c_custkey % 50 AS STRING)) AS street, CAST(c_custkey % 120 + 1 AS STRING) AS house,
  concat(n_name, ', Street ', CAST(c_custkey % 50 AS STRING), ', d. ', CAST(c_custkey % 120 + 1 AS STRING)) AS address_text,
  CAST(100000 + c_custkey % 400 AS STRING) AS postal_code,
  CAST(55.55 AS DOUBLE) + CAST((c_custkey * 7919) % 10000 AS DOUBLE) / 25000 AS lat,
  CAST(37.35 AS DOUBLE) + CAST((c_custkey * 104729) % 10000 AS DOUBLE) / 16000 AS lon,
  CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_private
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

EVENTS = """SELECT event_id AS id,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('Notice about ', event_type, ' number ', CAST(event_id % 40 AS STRING)) END AS title,
  concat('Body text for event type ', event_type, ' with reading ', CAST(event_id % 97 AS STRING)) AS body,
  CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 2 ELSE 3 END AS importance,
  CASE user_id % 5 WHEN 0 THEN 'neighbors_chat' WHEN 1 THEN 'news' WHEN 2 THEN 'mc' WHEN 3 THEN 'max_public' ELSE 'manual' END AS source,
  user_id * 10 + event_id % 10 + 1 AS address_id,
  CASE event_id % 4 WHEN 0 THEN 'home' WHEN 2 THEN 'city' ELSE 'street' END AS geo_by,
  CASE user_id % 5 WHEN 4 THEN NULL
       WHEN 2 THEN concat('moek:', CAST(event_id - event_id % 4 AS STRING), ':addr:', CAST(user_id * 10 + event_id % 10 + 1 AS STRING))
       ELSE concat(CASE event_id % 3 WHEN 0 THEN 'tass' WHEN 1 THEN 'm24' ELSE 'blog' END, ':', CAST(event_id AS STRING)) END AS source_msg_id,
  event_type = 'error' AND value > 300 AS disaster_flag,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS published_at, ts AS created_at,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ts ELSE ts + INTERVAL '12' HOUR END AS active_from,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ts + INTERVAL '6' HOUR WHEN 2 THEN ts + INTERVAL '48' HOUR ELSE ts + INTERVAL '720' HOUR END AS active_to
FROM events"""

MESSAGES = """SELECT conv_id % 20 AS chat_id, concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS message_id,
  CASE WHEN (conv_id + turn) % 6 = 0 THEN NULL ELSE text END AS text,
  CASE WHEN role = 'system' THEN NULL ELSE conv_id % 50 END AS sender_user_id, role = 'assistant' AS sender_is_bot,
  CAST((conv_id % 50) * 7200 + conv_id * 30 + turn * 240 AS BIGINT) AS ts_sec,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('https://img.example/', CAST(conv_id AS STRING), '/', CAST(turn AS STRING)) END AS image_url
FROM conversations"""

MEMBERS = """SELECT c_custkey % 100 AS user_id, -(c_custkey % 40) - 1 AS chat_id, c_custkey + 1 AS address_id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'removed' ELSE 'chat' END AS chat_type
FROM customer"""

DELIVERIES = """SELECT event_id AS id, user_id, event_id, CAST(event_id % 4 AS INT) AS attempts,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS last_sent_at,
  CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL '1' HOUR END AS acked_at
FROM events WHERE event_type IN ('error', 'purchase')"""

PAIRS = """SELECT a.vec_id AS a_id, b.vec_id AS b_id,
  CASE WHEN a.label = b.label THEN CASE WHEN (a.vec_id + b.vec_id) % 2 = 0 THEN 'duplicate' ELSE 'update' END ELSE 'unrelated' END AS label,
  CAST((a.vec_id * 37 + b.vec_id * 101) % 1000 AS DOUBLE) / 1000 AS score
FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 3"""

CHATS = """SELECT -k - 1 AS chat_id, concat('Chat ', CAST(k AS STRING)) AS title, CASE WHEN k % 6 = 0 THEN 'removed' ELSE 'chat' END AS chat_type,
  CASE WHEN k % 3 = 0 THEN NULL ELSE concat('https://chat.example/', CAST(k AS STRING)) END AS invite_link, a AS address_id
FROM (SELECT c_custkey % 40 AS k, min(c_custkey) + 1 AS a FROM customer GROUP BY c_custkey % 40) g"""

CHAT_ADDRESSES = """SELECT -(c_custkey % 40) - 1 AS chat_id, c_custkey + 1 AS address_id FROM customer WHERE c_custkey % 40 % 5 <> 1 OR c_custkey < 40"""

USERS_CHAT = """SELECT u AS user_id, -k - 1 AS chat_id, CASE WHEN u % 3 = 0 THEN a WHEN u % 3 = 1 THEN 999999 END AS address_id
FROM (SELECT c_custkey % 100 AS u, c_custkey % 40 AS k, min(c_custkey) + 1 AS a FROM customer GROUP BY c_custkey % 100, c_custkey % 40) g"""

REGISTRY = """SELECT DISTINCT -(c_custkey % 50) - 1 AS chat_id, concat('Group ', CAST(c_custkey % 50 AS STRING)) AS title, c_custkey % 50 % 9 AS added_by_user_id, c_custkey % 50 % 4 <> 0 AS is_active FROM customer"""

#: What the messenger says of groups and their members.
FACTS = """SELECT DISTINCT -(c_custkey % 60) - 1 AS chat_id, c_custkey % 300 AS user_id, CASE WHEN c_custkey % 60 % 10 = 7 THEN 'dialog' ELSE 'chat' END AS type,
  CASE WHEN c_custkey % 60 % 3 = 0 THEN concat('New ', CAST(c_custkey % 60 AS STRING)) END AS title, CASE WHEN c_custkey % 60 % 4 = 1 THEN 'https://new.example' END AS link,
  c_custkey % 60 % 7 <> 3 AS readable, c_custkey % 300 % 2 = 0 AS is_admin, c_custkey % 300 % 5 = 0 AS is_owner FROM customer"""

#: Russian notices: a subject, a place and a time each.
SUBJECTS = ["Взрыв в жилом доме", "Объявлен режим ЧС", "Запах газа в подъезде", "Мужчина с ножом во дворе", "Отключение воды", "Ремонт теплосети", "Перекрыт проезд", "Авария на сетях", "Собрание собственников", "Ярмарка выходного дня", "Эвакуация школы", "Сильный ураган", "Идёт пожар на складе", "Концерт в парке", "Не работает лифт", "Заливает подвал"]
PLACES = ["в Москве", "в Самаре", "в Берлине", "в Свердловской области", "на улице Мира", "в Москве и Казани", "в республике Татарстан", "у метро", "в Подмосковье", "в Минске", "в США"]
TIMES = ["с 01.02.2024 10:00 по 03.02.2024 18:00", "завтра с 10:00 до 12:30", "с 12 января по 14 января", "до завтра", "скоро", "16.01-18.01", "в пятницу, 12 января", "послезавтра в 23:00"]


def _one_of(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


NOTES = f"""SELECT event_id AS id, {_one_of('event_id', SUBJECTS)} AS subject, {_one_of('event_id', PLACES)} AS place, {_one_of('event_id', TIMES)} AS time,
  event_id % {len(PLACES)} AS place_no, event_id % {len(TIMES)} AS time_no FROM events"""

SQL = {"chats": CHATS, "chat_addresses": CHAT_ADDRESSES, "users_chat": USERS_CHAT, "registry": REGISTRY, "facts": FACTS, "notes": NOTES, "addresses": ADDRESSES, "city_events": EVENTS, "messages": MESSAGES, "members": MEMBERS, "deliveries": DELIVERIES, "pairs": PAIRS}
READS = {"chats": ("customer",), "chat_addresses": ("customer",), "users_chat": ("customer",), "registry": ("customer",), "facts": ("customer",), "notes": ("events",), "addresses": ("customer", "nation"), "city_events": ("events",), "messages": ("conversations",), "members": ("customer",), "deliveries": ("events",), "pairs": ("embeddings",)}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A city-event table. Spark gets PAIRS as an equi join on the ids that may follow: a range alone compares all with all."""
    if name == "pairs":
        v = source(spark, sf_dir, "embeddings").select("vec_id", "label")
        b = v.select(F.col("vec_id").alias("b_id"), F.col("label").alias("b_label"))
        ids = v.select(F.col("vec_id").alias("a_id"), F.col("label").alias("a_label"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("b_id"))
        kind = F.when(F.col("a_label") == F.col("b_label"), F.when((F.col("a_id") + F.col("b_id")) % 2 == 0, "duplicate").otherwise("update")).otherwise("unrelated")
        score = ((F.col("a_id") * 37 + F.col("b_id") * 101) % 1000).cast("double") / 1000
        return ids.join(b, "b_id").select("a_id", "b_id", kind.alias("label"), score.alias("score"))
    text = re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", SQL[name])
    text = re.sub(r"\{(\w+)\}(?! [ab]\b)", r"{\1} AS \1", text)
    return spark.sql(text, **{t: source(spark, sf_dir, t) for t in READS[name]})


def with_tables(query: str, *names: str) -> str:
    """A DuckDB query over city-event tables."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + query
