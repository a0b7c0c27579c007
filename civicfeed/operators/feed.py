"""Ranked feeds: scoring, two passes of deduplication that keep positions, keyset pages, the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as T
from .geo import near, street_centres

TITLE_LEAST, BODY_LEAST, BODY_KEY = 12, 40, 400


def not_expired(now: Column) -> Column:
    """events without an end, or whose end is ahead."""
    return F.col("active_to").isNull() | (F.col("active_to") >= now)


def geo_matches(scope: str, geo_by: Column) -> Column:
    """nearby takes streets and homes, city takes cities; unknown precision is in neither."""
    value = F.lower(F.trim(geo_by))
    wanted = {"nearby": ["street", "home"], "city": ["city"]}.get(scope, [])
    return F.coalesce(value.isin(wanted), F.lit(False))


def content_key(title: Column, body: Column) -> Column:
    """A long enough title, else the head of a long enough body, else none."""
    t, b = T.normalize_text(title), T.normalize_text(body)
    return F.when(F.length(t) >= TITLE_LEAST, F.concat(F.lit("t|"), t)).when(F.length(b) >= BODY_LEAST, F.concat(F.lit("b|"), F.left(b, F.lit(BODY_KEY))))


def dedupe(df: DataFrame, key: Column, prefer: list[Column], id_column: str = "id", position: str = "pos") -> DataFrame:
    """The row of each key that is first by ``prefer`` (all ascending), at the position of the key's first row.

    Rows with a null key all stay. Keys are reduced by partial aggregation, so a key with very many rows is no burden
    to one task; a null key is its own group by id, so missing keys do not meet.
    """
    group = F.coalesce(F.concat(F.lit("k"), key), F.concat(F.lit("#"), F.col(id_column).cast("string")))
    others = [c for c in df.columns if c != position]
    best = F.min_by(F.struct(*others), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(prefer)]))
    kept = df.groupBy(group.alias("cf_group")).agg(F.min(position).alias(position), best.alias("cf_row"))
    return kept.select("cf_row.*", position)


def _preference(by: str) -> list[Column]:
    heavy = [-F.col("weight"), -F.col("id")]
    return [F.col("distance").isNull(), F.round("distance", 6), *heavy] if by == "distance" else heavy


def _positioned(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.struct((-F.col("weight")).alias("w"), (-F.col("id")).alias("i")))


def dedupe_feed(df: DataFrame, by: str = "weight") -> DataFrame:
    """Both passes: one row for each notice fanned out to addresses, then one for each content.

    ``by`` "distance" prefers the nearest (to a millionth of a metre), else the heaviest; ids break ties. The
    position is the rank by weight before either pass, kept as a struct so that nothing is ranked in one task.
    """
    sibling = F.when(F.col("source_msg_id").isNotNull(), T.sibling_key(F.col("source"), F.col("source_msg_id")))
    once = dedupe(_positioned(df), sibling, _preference(by))
    return dedupe(once, content_key(F.col("title"), F.col("body")), _preference(by))


def scored(events: DataFrame, now: Column, distance: Column | None = None, scale_m: float = 6000.0) -> DataFrame:
    """``events`` with their weight."""
    w = R.weight(F.col("importance"), F.col("source"), T.outlet(F.col("source_msg_id")), F.col("geo_by"), F.col("published_at"), F.col("created_at"), now, distance, scale_m)
    return events.withColumn("weight", w)


def addressed(events: DataFrame, addresses: DataFrame) -> DataFrame:
    """Events with an address that has a text."""
    known = addresses.filter(F.length(F.trim("address_text")) > 0)
    return events.join(known.withColumnRenamed("id", "address_id"), "address_id")


def city_feed(events: DataFrame, addresses: DataFrame, now: Column, city: str | None = None) -> DataFrame:
    """Current important events of a city's precision, scored and deduplicated; order by pos."""
    rows = addressed(events.filter(F.col("importance").isin(1, 2) & not_expired(now) & geo_matches("city", F.col("geo_by"))), addresses)
    if city is not None:
        rows = rows.filter(F.col("city") == city)
    return dedupe_feed(scored(rows, now))


def nearby_feed(events: DataFrame, addresses: DataFrame, origins: DataFrame, now: Column, radius_m: float, user: str = "user_id") -> DataFrame:
    """For each user, current important events near one of their addresses, nearest address first.

    Places meet first: the radius join pairs addresses that have events with origins, once for all of an address's events. Weights
    know the distance, the user's own street and what is on now. Ids and keys are deduplicated; bodies come last.
    """
    current = events.filter(F.col("importance").isin(1, 2) & not_expired(now) & geo_matches("nearby", F.col("geo_by")))
    known = addresses.filter(F.length(F.trim("address_text")) > 0)
    used = known.join(current.select(F.col("address_id").alias("id")).distinct(), "id", "left_semi")
    close = near(used, origins, radius_m).groupBy(user, F.col("id").alias("address_id")).agg(F.min("distance").alias("distance"), F.max("same_street").alias("same_street"))
    keyed = current.select(
        "id", "address_id", "importance", "source", "source_msg_id", "geo_by", "published_at", "created_at", "active_from", "active_to",
        F.when(F.col("source_msg_id").isNotNull(), T.sibling_key(F.col("source"), F.col("source_msg_id"))).alias("sibling"),
        F.md5(content_key(F.col("title"), F.col("body"))).alias("content"),
    )
    full = scored(keyed.join(close, "address_id"), now, F.col("distance"), radius_m)
    active = R.active_now(F.col("active_from"), F.col("active_to"), now)
    full = full.withColumn("weight", R.boosted(F.col("weight"), F.col("same_street"), active))
    kept = dedupe_users(full.select(user, "id", "weight", "distance", "same_street", "sibling", "content"), user)
    return kept.join(current, "id").join(known.withColumnRenamed("id", "address_id"), "address_id")


def dedupe_users(df: DataFrame, user: str) -> DataFrame:
    """dedupe_feed by distance within each user, by the keys ``sibling`` and ``content``."""
    who = F.concat(F.col(user).cast("string"), F.lit("/"))
    ranked = _positioned(df).withColumn("cf_row_id", F.concat(who, F.col("id").cast("string")))
    once = dedupe(ranked, F.concat(who, "sibling"), _preference("distance"), "cf_row_id")
    return dedupe(once.drop("sibling"), F.concat(who, "content"), _preference("distance"), "cf_row_id").drop("cf_row_id", "content")


def cursor(weight: Column, event_id: Column) -> Column:
    """L2: the page mark of a row, URL-safe base64 of weight and id without padding."""
    text = F.format_string("%.12f:%d", weight, event_id)
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), F.lit("="))


def after(mark: Column) -> Column:
    """Whether a row of weight and id comes after a page mark, equal weights to 1e-12."""
    padded = F.rpad(F.translate(mark, "-_", "+/"), ((F.length(mark) + 3) / 4).cast("int") * 4, F.lit("="))
    text = F.decode(F.unbase64(padded), "UTF-8")
    w, i = F.split_part(text, F.lit(":"), F.lit(1)).cast("double"), F.split_part(text, F.lit(":"), F.lit(2)).cast("long")
    return (F.col("weight") < w - 1e-12) | ((F.abs(F.col("weight") - w) <= 1e-12) & (F.col("id") < i))


def page(feed: DataFrame, limit: int, mark: Column | None = None) -> DataFrame:
    """L3: the next ``limit`` rows by position with the mark of the page after, where there is one."""
    rows = feed if mark is None else feed.filter(after(mark))
    ahead = rows.orderBy("pos").limit(limit + 1)  # a bounded page
    numbered = ahead.withColumn("n", F.row_number().over(Window.orderBy("pos"))).withColumn("rows", F.count("*").over(Window.partitionBy()))
    last = (F.col("n") == limit) & (F.col("rows") > limit)
    return numbered.filter(F.col("n") <= limit).withColumn("next_cursor", F.when(last, cursor(F.col("weight"), F.col("id"))))


def map_page(events: DataFrame, addresses: DataFrame, now: Column, after_id: int, limit: int) -> DataFrame:
    """A page by id of what the map shows, with each event's marker and place."""
    shown = events.filter((F.col("importance") > 0) & (F.col("importance") < 3) & not_expired(now))
    rows = addressed(shown.filter(F.col("id") > after_id), addresses).orderBy("id").limit(limit + 1)
    centres = street_centres(addresses).withColumnsRenamed({"lat": "c_lat", "lon": "c_lon"})
    placed = rows.join(centres, ["city", "street"], "left")
    at = lambda c: F.when(F.col("geo_by") == "street", F.col(f"c_{c}")).when(F.col("geo_by") == "home", F.col(c))
    label = F.when(F.col("geo_by") == "street", F.concat_ws(", ", "city", "street")).when(F.col("geo_by") == "home", F.col("address_text"))
    return placed.select("id", R.map_category(F.col("disaster_flag"), F.col("importance")).alias("category"), label.alias("place"), at("lat").alias("lat"), at("lon").alias("lon"))


def capped(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """At most ``cap`` candidates, those of the highest ids, so that reruns agree; all without a cap."""
    return rows if cap is None else rows.orderBy(F.desc("id")).limit(cap)


def legacy_city(importance: Column, disaster: Column) -> Column:
    """F8: the old city rule: trifles never, the gravest only if they are disasters."""
    return F.when(importance == 3, False).when(importance == 1, F.coalesce(disaster, F.lit(False))).otherwise(True)


def on_map(importance: Column) -> Column:
    """what the map shows."""
    return (importance > 0) & (importance < 3)


def with_address(events: DataFrame, addresses: DataFrame, *columns: str) -> DataFrame:
    """Events with columns of their address, null without one."""
    return events.join(addresses.select(F.col("id").alias("address_id"), *columns), "address_id", "left")
