"""Text, time and file functions over whole texts of the driver's tables, and strict files, digests and drafts made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import digest, labels
from ..sources import pages as P
from ..sources.cursors import days_between
from .overlay import NOW, source, table, with_tables
from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
C = F.col


def _md5(c):
    return F.md5(c.cast("binary"))


@_R.add(r"""SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ё', 'е'), '\s+', ' ', 'g'))) AS normal, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS line,
    trim(regexp_replace(lower(text), '\s+', ' ', 'g')) <> '' AS has_component FROM documents""")
def k2_documents(spark, sf_dir):
    """Every document's text on one line, also lower-cased, by digests."""
    d = source(spark, sf_dir, "documents")
    return d.select("doc_id", _md5(T.normalize_text(C("text"))).alias("normal"), _md5(T.collapse_ws(C("text"))).alias("line"), T.normalize_component(C("text")).isNotNull().alias("has_component"))


@_R.add(r"""SELECT doc_id, CAST(len(codes) AS INTEGER) AS n, array_to_string(list_sort(codes), ',') AS codes
    FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '[^\p{L}\p{N}\p{M}_]+', '  ', 'g'), '(?:^| )[0-9]{6}(?: |$)'), lambda x: trim(x))) AS codes FROM documents) d""")
def k22_documents(spark, sf_dir):
    """The six-digit words of every document."""
    codes = T.postcodes(C("text"))
    return source(spark, sf_dir, "documents").select("doc_id", F.size(codes).alias("n"), F.array_join(F.array_sort(codes), ",").alias("codes"))


@_R.add("SELECT doc_id, left(sha256(text), 24) AS content, left(sha1(concat_ws('|', source, text)), 16) AS stable FROM documents")
def v7_documents(spark, sf_dir):
    """Content hashes and stable ids of every document."""
    d = source(spark, sf_dir, "documents")
    return d.select("doc_id", F.left(F.sha2(C("text"), 256), F.lit(24)).alias("content"), T.stable_id(C("source"), C("text")).alias("stable"))


@_R.add("""SELECT conv_id, turn, CASE WHEN len(items) >= 3 THEN '• ' || array_to_string(items[:5], chr(10) || '• ') END AS bullets, '#итого' || chr(10) || chr(10) || trim(text) AS decorated FROM (
    SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS items FROM conversations) c""")
def k26_conversations(spark, sf_dir):
    """Every message's lines as the bullets of a digest, three to five of them, and its text under the digest's tag."""
    c = source(spark, sf_dir, "conversations")
    listed = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- "), x)), "\n")
    return c.select("conv_id", "turn", T.bullets(listed).alias("bullets"), T.decorated(C("text"), None).alias("decorated"))


@_R.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey ELSE 0 END AS acked, date_trunc('minute', CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER))) AS dotted,
    CAST(o_orderdate AS TIMESTAMP) AS named, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) - INTERVAL 3 HOUR AS zoned FROM orders""")
def d3_orders(spark, sf_dir):
    """Times of orders written out and read back: with dots, with the month's name, and with an offset; and ids in payloads."""
    o = source(spark, sf_dir, "orders").withColumn("key", C("o_orderkey"))
    day = C("o_orderdate").cast("timestamp")
    t = F.timestamp_seconds(F.unix_seconds(day) + C("key") % 1440 * 60)
    month = F.get(F.array(*[F.lit(m) for m in P.MONTHS]), F.month(day) - 1)
    payload = F.concat(F.lit("notify:"), F.when(C("key") % 4 < 3, "ack").otherwise("open"), F.lit(":"), C("key").cast("string"))
    ntz = lambda c: c.cast("timestamp_ntz")
    return o.select(
        "o_orderkey", F.coalesce(T.payload_id(payload, "ack"), F.lit(0)).cast("long").alias("acked"), ntz(P.parse_ru_date(F.date_format(t, "dd.MM.yyyy HH:mm"))).alias("dotted"),
        ntz(P.parse_ru_date(F.concat_ws(" ", F.dayofmonth(day), month, F.year(day)))).alias("named"), ntz(P.parse_time(F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00")))).alias("zoned"),
    )


PART = "CAST(id % 9 + 1 AS VARCHAR)"


@_R.add(with_tables(f""" SELECT id, house || 'к' || {PART} AS house_key, CASE id % 3 WHEN 2 THEN house || 'с' ELSE house || 'к' END || {PART} AS short, lower(district) || ' ' || house || CASE id % 3 WHEN 2 THEN ' строение ' ELSE ' корпус ' END || {PART} AS search,
    house || '/' || {PART} AS search_house, house || 'к' || {PART} || '|' || house || 'к|' || house AS keys FROM addresses""", "addresses"))
def k9_addresses(spark, sf_dir):
    """Every address's house with a second number, written in three ways, as the keys of all ways."""
    part = (C("id") % 9 + 1).cast("string")
    written = F.concat("house", F.when(C("id") % 3 == 0, " корпус ").when(C("id") % 3 == 1, " Корп ").otherwise(" стр "), part)
    tight = F.concat("house", F.when(C("id") % 3 == 0, "/").when(C("id") % 3 == 1, "к").otherwise("с"), part)
    whole = F.concat("house", F.lit(" корпус "), part)
    return table(spark, sf_dir, "addresses").select(
        "id", T.house(whole).alias("house_key"), T.house(written).alias("short"), T.search_text(F.concat_ws(" ", "district", tight)).alias("search"),
        T.house_search(written).alias("search_house"), F.array_join(T.house_keys(whole), "|").alias("keys"),
    )


@_R.add("""SELECT strftime(day, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY day DESC) AS place, count(event_id) AS n FROM (
    SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY))::DATE AS day FROM events) d LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY day""")
def d5_days_backward(spark, sf_dir):
    """The days from the last event's back to the first one's, each with its events."""
    e = source(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    days = days_between(e.agg(F.max("day").alias("today"), F.min("day").alias("since")))
    counted = days.join(e, "day", "left").groupBy("day", "place").agg(F.count("event_id").alias("n"))
    return counted.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "place", "n")


CYCLE_SQL = f"""WITH m AS (SELECT conv_id % 20 AS chat_id, conv_id * 100 + turn AS id, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 10 + turn AS INTEGER)) AS created_at FROM conversations WHERE length(trim(text)) > 0),
    c AS (SELECT DISTINCT conv_id % 20 AS chat_id, CASE WHEN conv_id % 20 % 3 = 1 THEN conv_id % 20 * 300 END AS last_message_id, CASE WHEN conv_id % 20 % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id % 20 * 40 AS INTEGER)) END AS last_message_at FROM conversations WHERE conv_id % 20 % 7 <> 5),
    f AS (SELECT c.chat_id, count(id) AS n, max(id) AS new_id, max(created_at) AS new_at FROM c LEFT JOIN m ON m.chat_id = c.chat_id AND CASE WHEN last_message_id IS NOT NULL THEN id > last_message_id WHEN last_message_at IS NOT NULL THEN created_at > last_message_at ELSE true END GROUP BY c.chat_id)
    SELECT chat_id, strftime({NOW} + INTERVAL 3 HOUR, '%Y-%m-%d') AS day, n, n > 30 AS sent, coalesce(CASE WHEN n > 30 THEN new_id ELSE last_message_id END, 0) AS last_message_id, CASE WHEN n > 30 THEN new_at ELSE last_message_at END AS last_message_at FROM c JOIN f USING (chat_id)"""


@_R.add(CYCLE_SQL)
def c22_digest_cycle(spark, sf_dir):
    """The digests of twenty chats over all conversations: cursors by row id, by time or none; some have today's already."""
    said = source(spark, sf_dir, "conversations").withColumns({"chat_id": C("conv_id") % 20, "id": C("conv_id") * 100 + C("turn")})
    at = lambda minutes: F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + minutes * 60)
    messages = said.select("chat_id", "id", "text", at(C("conv_id") * 10 + C("turn")).alias("created_at"))
    k = C("chat_id")
    chats = said.select("chat_id").distinct().select(
        "chat_id", F.lit("chat").alias("chat_type"), F.when(k % 7 == 5, F.lit("2024-01-31").cast("date")).alias("last_digest_date"),
        F.when(k % 3 == 1, k * 300).alias("last_message_id"), F.when(k % 3 != 0, at(k * 40)).alias("last_message_at"),
    )
    now = F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_LTZ"))
    done = digest.outcomes(chats, messages, now, 30, 2, 0)
    return done.select("chat_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "sent", F.coalesce("last_message_id", F.lit(0)).alias("last_message_id"), C("last_message_at").cast("timestamp_ntz").alias("last_message_at"))


DECIDED = r"""WITH d AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    r AS (SELECT text, doc_id % 3 AS k, CASE WHEN length(t) < 12 THEN 3 WHEN lower(t) LIKE '%ung%' THEN 1 WHEN lower(t) LIKE '%ción%' THEN 2 ELSE 3 END AS importance,
        CASE WHEN length(t) < 12 THEN 'too_short' WHEN lower(t) LIKE '%ung%' THEN 'cat1:ung' WHEN lower(t) LIKE '%ción%' THEN 'cat2:cion' ELSE 'default_info' END AS reason FROM d),
    f AS (SELECT lower(trim(text)) AS key, min_by({'text': text, 'k': k, 'importance': importance}, {'k': k, 'text': text}) AS x FROM r WHERE reason <> 'too_short' GROUP BY 1),
    p AS (SELECT x.text AS text, x.k AS k, x.importance AS importance, row_number() OVER (PARTITION BY x.importance ORDER BY x.k, md5('1:' || x.text)) AS n FROM f),
    g AS (SELECT *, CASE WHEN n > 120 THEN '' WHEN ('0x' || left(md5('1:' || text), 8))::BIGINT < 858993459 THEN 'valid' ELSE 'train' END AS part FROM p)
    SELECT CASE WHEN n > 120 THEN 'capped' ELSE 'taken' END AS outcome, ['gold', 'chat', 'web'][k + 1] AS source, importance, part, count(*) AS n FROM g GROUP BY ALL
    UNION ALL SELECT 'skipped:too_short', ['gold', 'chat', 'web'][k + 1], 0, '', count(*) FROM r WHERE reason = 'too_short' GROUP BY ALL"""


@_R.add(DECIDED)
def c26_training_set(spark, sf_dir):
    """The report of a training set from all documents: three sources, rules by letters, 120 texts of a class."""
    d = source(spark, sf_dir, "documents")
    rules = [("cat1:ung", "ung", 1, True, 0.92), ("cat2:cion", "ción", 2, False, 0.9)]
    sources = [(name, d.filter(C("doc_id") % 3 == k)) for k, name in enumerate(("gold", "chat", "web"))]
    return labels.training_set(sources, lambda text: labels.first_rule(text, rules, (3, False, 0.75)), 120, 0.2)[1]
