"""Queries of feeds, places and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as T
from ..operators import dedup, feed, geo
from .overlay import NOW, source, table, with_tables
from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql


def _now():
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


HAVERSINE = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
OUTLET_SQL = "CASE WHEN source_msg_id LIKE '%:%' THEN split_part(source_msg_id, ':', 1) END"
RELIABILITY_SQL = f"coalesce(CASE {OUTLET_SQL} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.OUTLETS.items()) + " END, CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.CHANNELS.items()) + " ELSE 0.5 END)::DOUBLE"
IMPORTANCE_SQL = "(CASE importance WHEN 1 THEN 1.0 WHEN 2 THEN 0.72 WHEN 3 THEN 0.42 ELSE 0.3 END)::DOUBLE"
PRECISION_SQL = "(CASE geo_by WHEN 'home' THEN 1.0 WHEN 'street' THEN 0.78 WHEN 'city' THEN 0.48 ELSE 0.30 END)::DOUBLE"
AGE_SQL = f"exp(-ln(2::DOUBLE) * greatest(0, datesub('hour', coalesce(published_at, created_at), {NOW})) / 24.0::DOUBLE)"


def _weight_sql(near: str = "0.55::DOUBLE") -> str:
    relevance = f"greatest(0.0, least(1.0, 0.5::DOUBLE * {IMPORTANCE_SQL} + 0.35::DOUBLE * {near} + 0.15::DOUBLE * {PRECISION_SQL}))"
    return f"(0.5::DOUBLE * {relevance} + 0.3::DOUBLE * {AGE_SQL} + 0.2::DOUBLE * {RELIABILITY_SQL})"


CONTENT_SQL = """CASE WHEN length(trim(lower(title))) >= 12 THEN concat('t|', trim(lower(title)))
    WHEN length(trim(lower(body))) >= 40 THEN concat('b|', left(trim(lower(body)), 400)) END"""
SIBLING_SQL = r"CASE WHEN source_msg_id IS NOT NULL THEN concat_ws('|', source, regexp_replace(source_msg_id, ':addr:\d+$', '')) END"


def _dedupe_sql(rows: str, prefer: str, user: str = "") -> str:
    """Both deduplication passes over rows of a subquery, with pos as the rank by weight and id."""
    part = f"{user}, " if user else ""
    own = f"PARTITION BY {user}" if user else ""
    one = f"""SELECT *, row_number() OVER (PARTITION BY {part}coalesce('k' || {SIBLING_SQL}, concat('#', id)) ORDER BY {prefer}) AS n1,
        min(pos0) OVER (PARTITION BY {part}coalesce('k' || {SIBLING_SQL}, concat('#', id))) AS pos1
        FROM (SELECT *, row_number() OVER ({own} ORDER BY weight DESC, id DESC) AS pos0 FROM ({rows}) r0) r1"""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part}coalesce('k' || {CONTENT_SQL}, concat('#', id)) ORDER BY {prefer}) AS n2,
        min(pos1) OVER (PARTITION BY {part}coalesce('k' || {CONTENT_SQL}, concat('#', id))) AS pos2
        FROM ({one}) r2 WHERE n1 = 1) r3 WHERE n2 = 1"""


CITY_ROWS = f"""SELECT e.*, {_weight_sql()} AS weight FROM city_events e JOIN addresses a ON e.address_id = a.id AND length(trim(address_text)) > 0
    WHERE importance IN (1, 2) AND (active_to IS NULL OR active_to >= {NOW}) AND geo_by = 'city'"""


@_R.add(with_tables(f" SELECT id, round(weight, 9) AS weight, source, CAST(row_number() OVER (ORDER BY pos2) AS INTEGER) AS place FROM ({_dedupe_sql(CITY_ROWS, 'weight DESC, id DESC')}) f QUALIFY place <= 200", "addresses", "city_events"))
def c13_city_feed(spark, sf_dir):
    rows = feed.city_feed(table(spark, sf_dir, "city_events"), table(spark, sf_dir, "addresses"), _now())
    top = feed.page(rows, 200)
    return top.select("id", F.round("weight", 9).alias("weight"), "source", F.col("n").alias("place"))


ORIGINS = """(SELECT DISTINCT m.user_id, a.lat, a.lon, a.street FROM members m JOIN addresses a ON m.address_id = a.id WHERE m.chat_type = 'chat')"""
NEARBY_ROWS = f"""SELECT e.*, x.user_id, x.distance, greatest(0.0, least(1.0, {_weight_sql('greatest(0.0, 1 - least(x.distance, 1500.0) / 1500.0)')}
        + CASE WHEN x.same_street THEN 0.07 ELSE 0.0 END::DOUBLE
        + CASE WHEN active_from IS NULL AND active_to IS NULL THEN 0.0 WHEN active_from > {NOW} THEN -0.20 WHEN active_to IS NULL OR active_to >= {NOW} THEN 0.12 ELSE -0.20 END::DOUBLE)) AS weight
    FROM (SELECT o.user_id, e.id, min({HAVERSINE.format(a='o.', b='a.')}) AS distance, max(o.street = a.street) AS same_street
        FROM city_events e JOIN addresses a ON e.address_id = a.id JOIN {ORIGINS} o ON {HAVERSINE.format(a='o.', b='a.')} <= 1500
        WHERE importance IN (1, 2) AND (active_to IS NULL OR active_to >= {NOW}) AND geo_by IN ('street', 'home') GROUP BY o.user_id, e.id) x
    JOIN city_events e ON e.id = x.id"""


@_R.add(with_tables(f" SELECT user_id, id, round(weight, 9) AS weight, round(distance, 4) AS distance FROM ({_dedupe_sql(NEARBY_ROWS, 'round(distance, 6), weight DESC, id DESC', 'user_id')}) f", "addresses", "city_events", "members"))
def c12_nearby_feed(spark, sf_dir):
    addresses = table(spark, sf_dir, "addresses")
    members = table(spark, sf_dir, "members").filter("chat_type = 'chat'").withColumnRenamed("address_id", "id")
    origins = members.join(addresses, "id").select("user_id", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("street").alias("o_street")).distinct()
    rows = feed.nearby_feed(table(spark, sf_dir, "city_events"), addresses, origins, _now(), 1500.0)
    return rows.select("user_id", "id", F.round("weight", 9).alias("weight"), F.round("distance", 4).alias("distance"))


@_R.add(with_tables(f" SELECT id, round({_weight_sql()}, 9) AS weight FROM city_events", "city_events"))
def k20_weight(spark, sf_dir):
    return feed.scored(table(spark, sf_dir, "city_events"), _now()).select("id", F.round("weight", 9).alias("weight"))


@_R.add(with_tables(f" SELECT id, round({RELIABILITY_SQL}, 4) AS reliability, {OUTLET_SQL} AS outlet FROM city_events", "city_events"))
def k20b_reliability(spark, sf_dir):
    outlet = T.outlet(F.col("source_msg_id"))
    return table(spark, sf_dir, "city_events").select("id", F.round(R.reliability(F.col("source"), outlet), 4).alias("reliability"), outlet.alias("outlet"))


@_R.add(with_tables(f""" SELECT id, CASE WHEN active_from IS NULL AND active_to IS NULL THEN NULL WHEN active_from > {NOW} THEN false ELSE active_to IS NULL OR active_to >= {NOW} END AS active,
    coalesce(active_to >= {NOW}, true) AND coalesce(greatest(published_at, created_at, active_from) >= {NOW} - INTERVAL 7 DAY, true) AS in_pool,
    CASE WHEN disaster_flag OR importance = 1 THEN 'catastrophe' WHEN importance = 2 THEN 'important' ELSE 'minor' END AS category FROM city_events""", "city_events"))
def f10_activity(spark, sf_dir):
    return table(spark, sf_dir, "city_events").select(
        "id",
        R.active_now(F.col("active_from"), F.col("active_to"), _now()).alias("active"),
        R.in_dedup_pool(F.col("published_at"), F.col("created_at"), F.col("active_from"), F.col("active_to"), _now(), 7).alias("in_pool"),
        R.map_category(F.col("disaster_flag"), F.col("importance")).alias("category"),
    )


@_R.add(with_tables(f" SELECT id, lower(md5(concat(pos2::VARCHAR, ''))) IS NOT NULL AS kept FROM ({_dedupe_sql(f'SELECT *, {_weight_sql()} AS weight FROM city_events', 'weight DESC, id DESC')}) f", "city_events"))
def w1_feed_dedupe(spark, sf_dir):
    rows = feed.dedupe_feed(feed.scored(table(spark, sf_dir, "city_events"), _now()))
    return rows.select("id", F.lit(True).alias("kept"))


@_R.add(with_tables(""" SELECT id, rtrim(translate(to_base64(encode(format('{:.12f}:{}', weight, id))), '+/', '-_'), '=') AS mark
    FROM (SELECT id, round(importance / 3.0::DOUBLE, 6) AS weight FROM city_events) e""", "city_events"))
def l2_cursor(spark, sf_dir):
    rows = table(spark, sf_dir, "city_events").withColumn("weight", F.round(F.col("importance") / F.lit(3.0), 6))
    return rows.select("id", feed.cursor(F.col("weight"), F.col("id")).alias("mark"))


@_R.add(with_tables(f""" SELECT id, round(weight, 9) AS weight FROM (SELECT id, {_weight_sql()} AS weight FROM city_events) e
    WHERE weight < 0.5 - 1e-12 OR (abs(weight - 0.5) <= 1e-12 AND id < 5000)""", "city_events"))
def l3_after_cursor(spark, sf_dir):
    rows = feed.scored(table(spark, sf_dir, "city_events"), _now())
    mark = feed.cursor(F.lit(0.5), F.lit(5000).cast("long"))
    return rows.filter(feed.after(mark)).select("id", F.round("weight", 9).alias("weight"))


@_R.add(with_tables(f""", rows AS (SELECT e.id, e.disaster_flag, e.importance, e.geo_by, a.city, a.street, a.address_text, a.lat, a.lon
        FROM city_events e JOIN addresses a ON e.address_id = a.id WHERE importance IN (1, 2) AND (active_to IS NULL OR active_to >= {NOW}) AND e.id > 100 ORDER BY e.id LIMIT 201),
    centres AS (SELECT city, street, avg(lat) AS c_lat, avg(lon) AS c_lon FROM addresses GROUP BY city, street)
    SELECT id, CASE WHEN disaster_flag OR importance = 1 THEN 'catastrophe' WHEN importance = 2 THEN 'important' ELSE 'minor' END AS category,
        CASE geo_by WHEN 'street' THEN concat_ws(', ', city, street) WHEN 'home' THEN address_text END AS place,
        round(CASE geo_by WHEN 'street' THEN c_lat WHEN 'home' THEN lat END, 6) AS lat, round(CASE geo_by WHEN 'street' THEN c_lon WHEN 'home' THEN lon END, 6) AS lon
    FROM rows LEFT JOIN centres USING (city, street)""", "addresses", "city_events"))
def c15_map_page(spark, sf_dir):
    rows = feed.map_page(table(spark, sf_dir, "city_events"), table(spark, sf_dir, "addresses"), _now(), 100, 200)
    return rows.select("id", "category", "place", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@_R.add(with_tables(" SELECT city, street, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM addresses GROUP BY city, street", "addresses"))
def a1_street_centres(spark, sf_dir):
    rows = geo.street_centres(table(spark, sf_dir, "addresses"))
    return rows.select("city", "street", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@_R.add(with_tables(f""" SELECT o.id AS origin_id, a.id, round({HAVERSINE.format(a='o.', b='a.')}, 4) AS distance,
        CASE WHEN {HAVERSINE.format(a='o.', b='a.')} <= 250 THEN 'home' WHEN {HAVERSINE.format(a='o.', b='a.')} <= 800 THEN 'block' WHEN {HAVERSINE.format(a='o.', b='a.')} <= 1500 THEN 'street' ELSE 'district' END AS band
    FROM addresses a JOIN addresses o ON {HAVERSINE.format(a='o.', b='a.')} <= 2000""", "addresses"))
def j3_within_radius(spark, sf_dir):
    a = table(spark, sf_dir, "addresses")
    return geo.pairs_within(a, 2000.0, lambda d: [F.round(d, 4).alias("distance"), R.band(d).alias("band")])


@_R.add(with_tables(f""" SELECT origin_id, id, rank FROM (SELECT o.id AS origin_id, a.id, CAST(row_number() OVER (PARTITION BY o.id
        ORDER BY pow(a.lat - o.lat, 2) + pow((a.lon - o.lon) * cos(radians(o.lat)), 2), a.id) AS INTEGER) AS rank
    FROM addresses a JOIN addresses o ON {HAVERSINE.format(a='o.', b='a.')} <= 1500) n WHERE rank <= 5""", "addresses"))
def j24_nearest(spark, sf_dir):
    a = table(spark, sf_dir, "addresses")
    o = a.select(F.col("id").alias("origin_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    return geo.nearest(a, o, 5, 1500.0).select("origin_id", "id", "rank")


def squares(spark):
    """Two boundaries that overlap, the second with a hole."""

    def ring(a, b, c, d):
        return "array(" + ", ".join(f"named_struct('lon', {x}D, 'lat', {y}D)" for x, y in ((c, a), (d, a), (d, b), (c, b), (c, a))) + ")"

    return spark.sql(
        f"SELECT 'A square' AS name, array({ring(55.6, 55.7, 37.5, 37.7)}) AS outer, filter(array({ring(0, 1, 0, 1)}), x -> false) AS inner"
        f" UNION ALL SELECT 'B square', array({ring(55.65, 55.8, 37.4, 37.6)}), array({ring(55.72, 55.74, 37.42, 37.5)})"
    )


@_R.add(with_tables(""" SELECT id, CASE WHEN lat BETWEEN 55.6 AND 55.7 AND lon BETWEEN 37.5 AND 37.7 THEN 'A square'
        WHEN lat BETWEEN 55.65 AND 55.8 AND lon BETWEEN 37.4 AND 37.6 AND NOT (lat BETWEEN 55.72 AND 55.74 AND lon BETWEEN 37.42 AND 37.5) THEN 'B square' END AS district_name FROM addresses""", "addresses"))
def j10_point_in_polygon(spark, sf_dir):
    return geo.districts(table(spark, sf_dir, "addresses"), squares(spark)).select("id", "district_name")


@_R.add(with_tables(" SELECT count(*) AS n, CAST(sum(e_id) AS BIGINT) AS ids FROM (SELECT a.id AS e_id FROM addresses a JOIN (SELECT lat, lon FROM addresses GROUP BY lat, lon HAVING count(*) = 1) u USING (lat, lon)) x", "addresses"))
def j18_unique_coordinates(spark, sf_dir):
    a = table(spark, sf_dir, "addresses")
    found = geo.unique_coordinates(a.select(F.col("id").alias("e_id"), "lat", "lon"), a)
    return found.agg(F.count("*").alias("n"), F.sum("e_id").alias("ids"))


@_R.add(with_tables(f""" SELECT id, round(6371000.0 * 2 * asin(sqrt(pow(sin(radians(lat - 55.75) / 2), 2) + cos(radians(55.75::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - 37.6) / 2), 2))), 4) AS metres,
    CAST(floor(lat / 0.01) AS INTEGER) AS cell_y, round(1500.0::DOUBLE / (111320.0 * greatest(0.2, cos(radians(lat)))), 12) AS half_width FROM addresses""", "addresses"))
def g1_geometry(spark, sf_dir):
    a = table(spark, sf_dir, "addresses")
    return a.select(
        "id",
        F.round(R.haversine(F.lit(55.75), F.lit(37.6), F.col("lat"), F.col("lon")), 4).alias("metres"),
        R.cell(F.col("lat")).alias("cell_y"),
        F.round(R.box(F.col("lat"), 1500.0)[1], 12).alias("half_width"),
    )


CIRCLES = """ , c AS (SELECT id, i, radians(lat) AS phi, radians(lon) AS lam, 800.0::DOUBLE / 6371000.0::DOUBLE AS d, 2 * pi() * i / 64 AS turn FROM addresses, range(65) r(i)),
    y AS (SELECT *, asin(sin(phi) * cos(d) + cos(phi) * sin(d) * cos(turn)) AS y FROM c)
    SELECT id, CAST(i AS INTEGER) AS corner, round(degrees(lam + atan2(sin(turn) * sin(d) * cos(phi), cos(d) - sin(phi) * sin(y))), 8) AS lon, round(degrees(y), 8) AS lat FROM y"""


@_R.add(with_tables(CIRCLES, "addresses"))
def g8_circles(spark, sf_dir):
    """The corners of a circle of 800 m around every address."""
    a = table(spark, sf_dir, "addresses")
    rounded = lambda p: F.struct(F.round(p["lon"], 8).alias("lon"), F.round(p["lat"], 8).alias("lat"))
    rows = geo.circles(a.select("id", "lat", "lon"), 800.0, rounded)
    return rows.select("id", F.posexplode("circle").alias("corner", "p")).select("id", "corner", "p.lon", "p.lat")


def _cos(x: str, y: str) -> str:
    return f"list_cosine_similarity(CAST({x} AS DOUBLE[]), CAST({y} AS DOUBLE[]))"


@_R.add(f"""SELECT draft_id, best_id, round(score, 6) AS score, CASE WHEN score >= 0.40 THEN CASE WHEN hint AND score < 0.97 THEN 'update' ELSE 'duplicate' END
        WHEN score >= 0.30 AND (hint OR score >= 0.35) THEN 'update' ELSE 'new' END AS action FROM (
    SELECT d.vec_id AS draft_id, e.vec_id AS best_id, d.vec_id % 7 = 0 AS hint, {_cos('d.embedding', 'e.embedding')} AS score,
        row_number() OVER (PARTITION BY d.vec_id ORDER BY round({_cos('d.embedding', 'e.embedding')}, 9) DESC, e.vec_id DESC) AS rn
    FROM embeddings d JOIN embeddings e ON d.vec_id % 20 = 0 AND e.vec_id % 20 <> 0 AND (d.vec_id % 3 = 0 OR e.vec_id % 5 = 0 OR d.label = e.label)) x WHERE rn = 1""")
def c9_relation(spark, sf_dir):
    v = source(spark, sf_dir, "embeddings")
    rows = v.select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").alias("v"))
    drafts = rows.filter("id % 20 = 0").withColumn("address_id", F.when(F.col("id") % 3 != 0, F.col("label")))
    events = rows.filter("id % 20 <> 0").withColumn("address_id", F.when(F.col("id") % 5 != 0, F.col("label")))
    best = dedup.best_matches(drafts, events)
    score, hint = F.round("score", 9), F.col("draft_id") % 7 == 0
    return best.select("draft_id", "best_id", F.round(score, 6).alias("score"), dedup.action(score, hint, 0.40, 0.30).alias("action"))


BATCH_SQL = """WITH RECURSIVE rows AS (SELECT vec_id AS id, vec_id % 3 = 0 AS is_event, CASE WHEN vec_id % 5 <> 0 THEN label END AS address_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    numbered AS (SELECT *, row_number() OVER (ORDER BY id) AS turn FROM rows WHERE NOT is_event),
    pairs AS (SELECT d.id AS d, o.id AS o, round(list_cosine_similarity(d.v, o.v), 9) AS score FROM numbered d JOIN rows o
        ON (o.is_event OR o.id < d.id) AND (d.address_id IS NULL OR o.address_id IS NULL OR d.address_id = o.address_id)
        WHERE round(list_cosine_similarity(d.v, o.v), 9) >= 0.30),
    blocking AS (SELECT d, list(o) AS os FROM pairs WHERE score >= 0.35 GROUP BY d),
    turns AS (SELECT turn, id, coalesce(os, []::BIGINT[]) AS os FROM numbered LEFT JOIN blocking ON d = id),
    steps(turn, made) AS (
        SELECT 0::BIGINT, (SELECT list(id) FROM rows WHERE is_event)
        UNION ALL SELECT t.turn, CASE WHEN list_has_any(s.made, t.os) THEN s.made ELSE list_append(s.made, t.id) END FROM steps s JOIN turns t ON t.turn = s.turn + 1),
    made AS (SELECT unnest(made) AS o FROM (SELECT made FROM steps ORDER BY turn DESC LIMIT 1)),
    best AS (SELECT d, max(score) AS score, max_by(o, (score, o)) AS o FROM pairs JOIN made USING (o) GROUP BY d)
SELECT n.id, CASE WHEN n.id IN (SELECT o FROM made) THEN 'new' WHEN score >= 0.40 THEN 'duplicate' ELSE 'update' END AS action,
    CASE WHEN n.id IN (SELECT o FROM made) THEN -1 ELSE o END AS match_id, round(score, 6) AS score
FROM numbered n LEFT JOIN best ON d = n.id"""


@_R.add(BATCH_SQL)
def c11_batch_order(spark, sf_dir):
    """Two thirds of all vectors as drafts of one batch, each decided after those before it; the others are events."""
    v = source(spark, sf_dir, "embeddings")
    absent = [F.lit(None).cast("string").alias(c) for c in ("source", "source_msg_id", "title", "body")]
    rows = v.select(F.col("vec_id").alias("id"), *absent, F.when(F.col("vec_id") % 5 != 0, F.col("label")).alias("address_id"), F.col("embedding").alias("v"))
    decided = dedup.resolve_batch(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0"), 0.40, 0.30)
    return decided.select("id", "action", F.coalesce("match_id", F.lit(-1)).alias("match_id"), F.round("score", 6).alias("score"))


@_R.add(f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_cos('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v1_cosine(spark, sf_dir):
    v = source(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = v.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("w"))
    pairs = v.join(b, F.col("b_id") == F.col("vec_id") + 1)
    return pairs.select(F.col("vec_id").alias("a_id"), "b_id", F.round(R.cosine(F.col("embedding"), F.col("w")), 9).alias("score"))


@_R.add("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) > 0 AS fine FROM embeddings")
def v2_normalise(spark, sf_dir):
    v = source(spark, sf_dir, "embeddings").withColumn("u", R.normalized(F.col("embedding")))
    size = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return v.select("vec_id", (F.abs(size - 1) < 1e-9).alias("fine"))


@_R.add()
def v3_hashed_embedding(spark, sf_dir):
    e = table(spark, sf_dir, "city_events")
    distinct = e.select(F.concat_ws(" ", "title", "body").alias("text")).distinct()
    return distinct.select("text", dedup.hashed_embedding()(F.col("text")).alias("v"))


MERGE_SQL = """ SELECT n.id, CASE WHEN contains(lower(o.body), lower(trim(n.body))) THEN o.body ELSE n.body END AS body,
    least(o.importance, n.importance) AS importance, o.disaster_flag OR n.disaster_flag AS disaster_flag FROM city_events n JOIN city_events o ON o.id = n.id - 1"""


@_R.add(with_tables(MERGE_SQL, "city_events"))
def c10_merge(spark, sf_dir):
    e = table(spark, sf_dir, "city_events").select("id", "body", "importance", "disaster_flag")
    o = e.select((F.col("id") + 1).alias("id"), *[F.col(c).alias(f"o_{c}") for c in e.columns[1:]])
    m = dedup.merge_payload(F.col("o_body"), F.col("body"), F.col("o_importance"), F.col("importance"), F.col("o_disaster_flag"), F.col("disaster_flag"))
    return e.join(o, "id").select("id", m.alias("m")).select("id", "m.*")
