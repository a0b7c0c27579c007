"""Queries of text functions, rules and chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import chat, corpus, evaluate, labels
from .overlay import source, table, with_tables
from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

WS = r"[ \t\n\r]+"
NORM = f"trim(regexp_replace(lower(text), '{WS}', ' ', 'g'))"


@_R.add(f"SELECT doc_id, left(trim(regexp_replace(text, '{WS}', ' ', 'g')), 80) AS head, length({NORM}) AS n, md5({NORM}) AS digest FROM documents")
def k1_normalize_text(spark, sf_dir):
    d = source(spark, sf_dir, "documents")
    norm = T.normalize_text(F.col("text"))
    return d.select("doc_id", F.left(T.collapse_ws(F.col("text")), F.lit(80)).alias("head"), F.length(norm).cast("long").alias("n"), F.md5(norm.cast("binary")).alias("digest"))


@_R.add(with_tables(r""" SELECT id, lower(street) AS street, 'd' || house AS house, regexp_extract(address_text, 'd\. (\d+)$', 1) AS number, postal_code FROM addresses""", "addresses"))
def k7_address_parts(spark, sf_dir):
    a = table(spark, sf_dir, "addresses")
    number = F.regexp_extract("address_text", r"d\. (\d+)$", 1)
    return a.select("id", T.street_name(F.col("street")).alias("street"), F.concat(F.lit("d"), T.house(F.col("house"))).alias("house"), number.alias("number"), F.element_at(T.postcodes(F.concat_ws(" ", F.col("postal_code"), F.lit("x"))), 1).alias("postal_code"))


@_R.add(with_tables(""" SELECT id, split_part(address_text, ', ', 1) AS city, split_part(address_text, ', ', 2) AS street,
    concat_ws(', ', city, street, 'д. ' || house) AS built FROM addresses""", "addresses"))
def k11_parse_address(spark, sf_dir):
    a = table(spark, sf_dir, "addresses")
    p = T.parse_address(F.replace("address_text", F.lit("d. "), F.lit("д. ")))
    built = T.build_address(F.col("city"), F.lit(None).cast("string"), F.col("street"), F.col("house"))
    return a.select("id", p["city"].alias("city"), p["street"].alias("street"), built.alias("built"))


@_R.add(with_tables(r""" SELECT source, regexp_replace(source_msg_id, ':addr:\d+$', '') AS base, count(*) AS n FROM city_events WHERE source_msg_id IS NOT NULL GROUP BY ALL""", "city_events"))
def k21_fan_out_base(spark, sf_dir):
    e = table(spark, sf_dir, "city_events").filter("source_msg_id IS NOT NULL")
    return e.groupBy("source", T.base_id(F.col("source_msg_id")).alias("base")).agg(F.count("*").alias("n"))


@_R.add(f"""SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(left(t, 59)) || '…' ELSE t END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS t FROM documents) d""")
def k25_compact(spark, sf_dir):
    return source(spark, sf_dir, "documents").select("doc_id", T.compact(F.col("text"), 60).alias("line"))


@_R.add("SELECT doc_id, left(sha1(concat_ws('|', source, doc_id::VARCHAR)), 16) AS id, sha256(source) AS digest FROM documents")
def k19_stable_id(spark, sf_dir):
    d = source(spark, sf_dir, "documents")
    return d.select("doc_id", T.stable_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"), F.sha2("source", 256).alias("digest"))


@_R.add("SELECT c_custkey, upper(left(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 4)) AS prefix FROM customer")
def k31_prefix(spark, sf_dir):
    return source(spark, sf_dir, "customer").select("c_custkey", T.significant_prefix(F.col("c_name"), 4).alias("prefix"))


@_R.add(f"""SELECT key, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, left({NORM}, 400) AS key FROM documents WHERE length({NORM}) >= 40) d GROUP BY key""")
def w2_content_keys(spark, sf_dir):
    d = source(spark, sf_dir, "documents")
    norm = T.normalize_text(F.col("text"))
    return d.filter(F.length(norm) >= 40).groupBy(F.left(norm, F.lit(400)).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


NEEDLES = (["error"], ["purchase number 1"], ["signup", "purchase"])


@_R.add(with_tables(""" SELECT id, CAST(CASE WHEN t LIKE '%error%' OR t LIKE '%purchase number 1%' THEN 1 WHEN t LIKE '%signup%' OR t LIKE '%purchase%' THEN 2 ELSE 3 END AS INTEGER) AS importance, t LIKE '%error%' AS disaster_flag
    FROM (SELECT id, lower(concat_ws(' ', title, body)) AS t FROM city_events) e""", "city_events"))
def c1_classify(spark, sf_dir):
    e = table(spark, sf_dir, "city_events").withColumn("r", rules.importance(F.concat_ws(" ", "title", "body"), *NEEDLES))
    return e.select("id", "r.*")


@_R.add(with_tables(""" SELECT id, CASE WHEN id % 100 >= 45 THEN CAST(id % 3 + 1 AS INTEGER) ELSE importance END AS importance, disaster_flag FROM (
    SELECT id, CAST(CASE WHEN t LIKE '%error%' THEN 1 WHEN t LIKE '%signup%' THEN 2 ELSE 3 END AS INTEGER) AS importance, t LIKE '%error%' AS disaster_flag FROM (SELECT id, lower(concat_ws(' ', title, body)) AS t FROM city_events) e) r""", "city_events"))
def c2_cascade(spark, sf_dir):
    e = table(spark, sf_dir, "city_events")
    ruled = rules.importance(F.concat_ws(" ", "title", "body"), ["error"], ["error"], ["signup"])
    model = (F.col("id") % 3 + 1).cast("int")
    return e.withColumn("r", rules.cascade(model, F.col("id") % 100 / 100, ruled)).select("id", "r.*")


FLOOD_SQL = """SELECT event_id, n > 3 AS flood FROM (SELECT event_id,
  count(*) OVER (PARTITION BY user_id, event_type ORDER BY us RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW)
  - (count(*) OVER (PARTITION BY user_id, event_type, us) - row_number() OVER (PARTITION BY user_id, event_type, us ORDER BY event_id)) AS n
  FROM (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events) e) f"""


@_R.add(FLOOD_SQL)
def w5_flood(spark, sf_dir):
    e = source(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return chat.flooded(e, ["user_id", "event_type"], "us", "event_id", 259_200_000_000).select("event_id", "flood")


PHOTO_SQL = """ SELECT message_id, CASE WHEN tx AND NOT im AND pk AND ts_sec - pts <= 600 THEN purl ELSE image_url END AS image_url,
  CASE WHEN im AND NOT tx THEN 'hold_photo' WHEN tx AND NOT im AND pk AND ts_sec - pts <= 600 THEN 'attached' ELSE 'passthrough' END AS action
 FROM (SELECT c.*, lag(image_url) OVER w AS purl, lag(ts_sec) OVER w AS pts, lag(im AND NOT tx) OVER w AS pk
  FROM (SELECT b.*, coalesce(length(trim(text)) > 0, false) AS tx, image_url IS NOT NULL AS im FROM messages b) c
  WHERE sender_user_id IS NOT NULL AND (tx OR im) WINDOW w AS (PARTITION BY chat_id, sender_user_id ORDER BY ts_sec, message_id)) d"""


@_R.add(with_tables(PHOTO_SQL, "messages"))
def w6_pending_photo(spark, sf_dir):
    return chat.pending_photos(table(spark, sf_dir, "messages")).select("message_id", "image_url", "action")


@_R.add(with_tables(f""" SELECT message_id, CASE WHEN sender_is_bot THEN 'bot_sender' WHEN t LIKE '/%' THEN 'command' WHEN t = '' AND image_url IS NULL THEN 'empty'
    WHEN length(t) < 3 AND image_url IS NULL THEN 'empty' END AS reason,
    CASE WHEN sender_is_bot OR t LIKE '/%' OR (length(t) < 3 AND image_url IS NULL) THEN NULL WHEN image_url IS NOT NULL AND t <> '' THEN 'text_image' WHEN image_url IS NOT NULL THEN 'image' ELSE 'text' END AS signal
    FROM (SELECT *, trim(coalesce(text, '')) AS t FROM messages) m""", "messages"))
def f13_chat_filter(spark, sf_dir):
    # texts of these messages do not repeat within the window, so no flood rule is in the SQL
    return chat.verdicts(table(spark, sf_dir, "messages")).select("message_id", "reason", "signal")


@_R.add(with_tables(r""" , own AS (SELECT chat_id, text, ts_sec, message_id, trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')) AS norm FROM messages WHERE length(trim(text)) > 0),
    latest AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY chat_id, norm ORDER BY ts_sec DESC, message_id DESC) = 1),
    few AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY ts_sec DESC, message_id DESC) <= 5)
    SELECT chat_id, count(*) AS n_texts, string_agg(text, chr(10) ORDER BY ts_sec, message_id) AS texts FROM few GROUP BY chat_id""", "messages"))
def w7_last_texts(spark, sf_dir):
    return chat.last_texts(table(spark, sf_dir, "messages"))


@_R.add(with_tables(""" , m AS (SELECT chat_id, CAST(split_part(message_id, ':', 1) AS BIGINT) * 100 + CAST(split_part(message_id, ':', 2) AS BIGINT) AS id FROM messages)
    SELECT chat_id, count(*) AS n, max(id) AS last_message_id FROM m WHERE chat_id % 3 = 0 OR id > 300 GROUP BY chat_id HAVING count(*) > 10""", "messages"))
def c22_due_digests(spark, sf_dir):
    m = table(spark, sf_dir, "messages")
    part = lambda i: F.split_part("message_id", F.lit(":"), F.lit(i)).cast("long")
    rows = m.select("chat_id", (part(1) * 100 + part(2)).alias("id"))
    chats = m.select("chat_id").distinct().withColumn("last_message_id", F.when(F.col("chat_id") % 3 != 0, F.lit(300).cast("long")))
    return chat.due_digests(chats, rows, 10)


@_R.add("SELECT event_id, CASE WHEN x > 10000000000 THEN x // 1000 ELSE x END AS seconds FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 END AS x FROM events) e")
def d13_epoch(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    x = F.when(F.col("event_id") % 2 == 0, F.floor(us / 1000)).otherwise(F.floor(us / 1_000_000))
    return source(spark, sf_dir, "events").select("event_id", chat.epoch_seconds(x).alias("seconds"))


GUESS_SQL = "CASE WHEN score >= 0.82 THEN 'duplicate' WHEN score >= 0.58 THEN 'update' ELSE 'unrelated' END"


@_R.add(with_tables(f""", g AS (SELECT label, {GUESS_SQL} AS guess FROM pairs) SELECT x.label, count(*) FILTER (guess = 'duplicate') AS duplicate, count(*) FILTER (guess = 'update') AS "update", count(*) FILTER (guess = 'unrelated') AS unrelated
    FROM (VALUES ('duplicate'), ('update'), ('unrelated')) x(label) LEFT JOIN g USING (label) GROUP BY x.label""", "pairs"))
def a10_confusion(spark, sf_dir):
    p = table(spark, sf_dir, "pairs").withColumn("guess", evaluate.predicted(F.col("score"), F.lit(0.82), F.lit(0.58)))
    return evaluate.confusion(p)


def _f1_sql(x: str) -> str:
    right, wrong = f"count(*) FILTER (label = '{x}' AND guess = '{x}')", f"count(*) FILTER ((label = '{x}') <> (guess = '{x}'))"
    return f"CASE WHEN {right} > 0 THEN 2.0::DOUBLE * {right} / (2 * {right} + {wrong}) ELSE 0.0 END"


_MACRO = "(" + " + ".join(_f1_sql(x) for x in evaluate.LABELS) + ") / 3"


@_R.add(with_tables(f""", g AS (SELECT label, {GUESS_SQL} AS guess FROM pairs) SELECT round({_f1_sql('duplicate')}, 9) AS f1_duplicate, round({_f1_sql('update')}, 9) AS f1_update, round({_f1_sql('unrelated')}, 9) AS f1_unrelated, round({_MACRO}, 9) AS macro_f1 FROM g""", "pairs"))
def a11_f1(spark, sf_dir):
    p = table(spark, sf_dir, "pairs").withColumn("guess", evaluate.predicted(F.col("score"), F.lit(0.82), F.lit(0.58)))
    scores = evaluate.f1(p, [])
    return scores.select(*[F.round(c, 9).alias(c) for c in scores.columns])


@_R.add(with_tables(f""", t AS (SELECT CAST(0.70 + i * 0.01 AS DOUBLE) AS duplicate FROM range(21) r(i)), u AS (SELECT CAST(0.45 + i * 0.01 AS DOUBLE) AS "update" FROM range(41) r(i)),
    g AS (SELECT round(duplicate, 2) AS duplicate, round("update", 2) AS "update", label, CASE WHEN score >= round(duplicate, 2) THEN 'duplicate' WHEN score >= round("update", 2) THEN 'update' ELSE 'unrelated' END AS guess FROM pairs, t, u WHERE round(duplicate, 2) >= round("update", 2))
    SELECT duplicate, "update", round({_MACRO}, 9) AS macro_f1 FROM g GROUP BY duplicate, "update" ORDER BY round({_MACRO}, 12) DESC, duplicate, "update" LIMIT 1""", "pairs"))
def a12_grid_search(spark, sf_dir):
    best = evaluate.grid_search(table(spark, sf_dir, "pairs"), [round(0.70 + i / 100, 2) for i in range(21)], [round(0.45 + i / 100, 2) for i in range(41)])
    return best.select("duplicate", "update", F.round("macro_f1", 9).alias("macro_f1"))


@_R.add(with_tables(f""", t AS (SELECT CAST(0.70 + i * 0.01 AS DOUBLE) AS duplicate FROM range(21) r(i)), u AS (SELECT CAST(0.45 + i * 0.01 AS DOUBLE) AS "update" FROM range(41) r(i)),
    w AS (SELECT round(duplicate, 2) AS duplicate, round("update", 2) AS "update", label, CASE WHEN score >= round(duplicate, 2) THEN 'duplicate' WHEN score >= round("update", 2) THEN 'update' ELSE 'unrelated' END AS guess FROM pairs, t, u WHERE round(duplicate, 2) >= round("update", 2)),
    b AS (SELECT duplicate AS best_duplicate, "update" AS best_update, round({_MACRO}, 9) AS best_macro_f1 FROM w GROUP BY duplicate, "update" ORDER BY round({_MACRO}, 12) DESC, duplicate, "update" LIMIT 1),
    n AS (SELECT count(*) AS n_pairs, round(avg(score), 9) AS sim_mean, count(*) FILTER (label = 'duplicate') AS n_duplicate, count(*) FILTER (label = 'update') AS n_update, count(*) FILTER (label = 'unrelated') AS n_unrelated FROM pairs),
    g AS (SELECT label, CASE WHEN score >= 0.88 THEN 'duplicate' WHEN score >= 0.72 THEN 'update' ELSE 'unrelated' END AS guess FROM pairs), d AS (SELECT round({_MACRO}, 9) AS macro_f1 FROM g)
    SELECT * FROM n, d, b""", "pairs"))
def c25_report(spark, sf_dir):
    """The report on pairs at the default thresholds and the best of the grid."""
    r = corpus.report(table(spark, sf_dir, "pairs"), [round(0.70 + i / 100, 2) for i in range(21)], [round(0.45 + i / 100, 2) for i in range(41)])
    return r.select("n_pairs", "n_duplicate", "n_update", "n_unrelated", "best_duplicate", "best_update", *[F.round(c, 9).alias(c) for c in ("sim_mean", "macro_f1", "best_macro_f1")])


@_R.add(with_tables(" SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM (SELECT label, count(*) AS n FROM pairs GROUP BY label) c", "pairs"))
def a17_class_weights(spark, sf_dir):
    w = evaluate.class_weights(table(spark, sf_dir, "pairs"), "label")
    return w.select("label", "n", F.round("weight", 9).alias("weight"))


@_R.add("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, md5('7:' || doc_id)) AS n, lang FROM documents QUALIFY n <= 30")
def w11_capped_classes(spark, sf_dir):
    return labels.capped_classes(source(spark, sf_dir, "documents"), "lang", "source", "doc_id", 30).select("doc_id", "n", "lang")
