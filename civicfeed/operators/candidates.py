"""Messages, articles and notices as candidates for events (X5 to X9, X30, X40, V9, K30): one row each, before any decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T

# What a photo without words says, and the kinds of attachments that are pictures.
PHOTO_TEXT = "Фото из чата соседей"
PICTURES = ["image", "photo"]
DIGEST_LIMIT = 4000
LEADING_DATE = r"(?iU)^\d{1,2}\s+[а-яё]+\s*,?\s*\d{4}\s+"
STREET_LINE = (
    rf"(?iU){T.STREET_TYPE}\s+[А-ЯЁа-яё0-9\- ]{{3,40}}"
    r"|(?iU)[А-ЯЁ][а-яё0-9\- ]{2,30}\s+(?:ул\.?|улиц[аеыу]|пр-?т\.?|проспект|пер\.?|шоссе|бульвар|наб\.?|проезд)"
)


def message_id(scope: Column, own: Column) -> Column:
    """The key of a message or an article within its chat or outlet; null without either."""
    return F.concat(scope.cast("string"), F.lit(":"), own)


def web_url(c: Column) -> Column:
    """A trimmed URL if it is one of the web, else null."""
    return F.when(F.trim(c).rlike("^https?://"), F.trim(c))


def image_url(attachments: Column) -> Column:
    """V9: the first picture's URL of attachments (array of type, url); stickers and files are none."""
    own = F.filter(attachments, lambda a: F.lower(a["type"]).isin(PICTURES) & web_url(a["url"]).isNotNull())
    return web_url(F.get(own, 0)["url"])


def only_other_attachments(attachments: Column) -> Column:
    """V9: there are attachments, and none is a picture."""
    none = ~F.exists(attachments, lambda a: F.coalesce(F.lower(a["type"]).isin(PICTURES), F.lit(False)))
    return F.coalesce((F.size(attachments) > 0) & none, F.lit(False))


def geo_level(street: Column, house: Column) -> Column:
    """How exactly an address names a place."""
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(said(house), "home").when(said(street), "street").otherwise("city")


def components(city: Column, district: Column, street: Column, house: Column, text: Column) -> Column:
    """An address's own parts if it has any, else those that its text names."""
    own = F.struct(city.alias("city"), district.alias("district"), street.alias("street"), house.alias("house"))
    return F.when(F.coalesce(city, district, street, house).isNotNull(), own).otherwise(T.parse_address(text))


def from_messages(messages: DataFrame, chats: DataFrame, addresses: DataFrame) -> DataFrame:
    """Chat messages as candidates with their chat's address as the place to fall back on; unlinked chats have none.

    ``messages`` has chat_id, message_id, text, image_url, source_url and published_at; ``chats`` chat_id, chat_type and
    address_id. A photo without words has a fixed text.
    """
    live = chats.filter("chat_type = 'chat'").select("chat_id", "address_id")
    homes = addresses.select(F.col("id").alias("address_id"), geo_level(F.col("street"), F.col("house")).alias("fallback_geo_by"))
    said = F.trim(F.coalesce("text", F.lit("")))
    raw = F.when((said == "") & F.col("image_url").isNotNull(), PHOTO_TEXT).otherwise(said)
    rows = messages.join(live, "chat_id").join(homes, "address_id")
    return rows.select(
        raw.alias("raw_text"), F.lit("neighbors_chat").alias("source"), message_id(F.col("chat_id"), F.col("message_id")).alias("source_msg_id"),
        web_url(F.col("source_url")).alias("source_url"), "image_url", "published_at", F.col("address_id").alias("fallback_address_id"), "fallback_geo_by",
    )


def with_fallback(bound: DataFrame) -> DataFrame:
    """address_id and geo_by of candidates, those of their chat where the text gave none; and which it was."""
    missing = F.col("address_id").isNull()
    return bound.withColumns({
        "geo_method": F.when(missing, "chat_fallback").otherwise("text"), "geo_by": F.when(missing, F.col("fallback_geo_by")).otherwise(F.col("geo_by")),
        "address_id": F.coalesce("address_id", "fallback_address_id"),
    }).drop("fallback_address_id", "fallback_geo_by")


def from_articles(articles: DataFrame, source: str) -> DataFrame:
    """Articles or notices (outlet, external_id, title, body, url, image_url, published_at) as candidates.

    The body is cleaned; the raw text is title and body, each on its own line.
    """
    title = T.blank_to_null(F.trim("title"))
    rows = articles.withColumns({"t": title, "b": T.clean_body(F.col("body"), title)})
    return rows.select(
        F.coalesce(F.concat_ws("\n", "t", "b"), F.lit("")).alias("raw_text"), F.lit(source).alias("source"), message_id(F.col("outlet"), F.col("external_id")).alias("source_msg_id"),
        F.col("t").alias("title"), F.col("b").alias("body"), F.col("url").alias("source_url"), "image_url", "published_at",
    )


def notice_streets(streets: Column, title: Column, body: Column) -> Column:
    """A notice's own streets, else the lines of its text that name some, each once."""
    found = F.regexp_extract_all(F.concat_ws("\n", title, F.coalesce(body, F.lit(""))), F.lit(STREET_LINE), F.lit(0))
    named = F.array_distinct(F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != ""))
    return F.when(F.size(streets) > 0, streets).otherwise(named)


def notice_text(title: Column, body: Column, streets: Column) -> Column:
    """All that a notice says, a line each."""
    parts = F.concat(F.array(title, body), streets)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def foreign_notice(title: Column, body: Column, streets: Column) -> Column:
    """Whether a notice is about a place abroad."""
    return rules.is_foreign(notice_text(title, body, streets))


def without_date(title: Column) -> Column:
    """A title without the date in front of it, unless nothing is left."""
    return F.coalesce(T.blank_to_null(F.trim(F.regexp_replace(title, LEADING_DATE, ""))), title)


def digest_messages(messages: DataFrame, known: DataFrame) -> DataFrame:
    """messages (chat_id, message_id, text, sender_is_bot, published_at) for digests that are not there yet, once each."""
    text = T.collapse_ws(F.coalesce("text", F.lit("")))
    fit = ~F.coalesce("sender_is_bot", F.lit(False)) & (text != "") & ~F.startswith(text, F.lit("/")) & (F.coalesce("message_id", F.lit("")) != "")
    rows = messages.filter(fit).select("chat_id", "message_id", F.left(text, F.lit(DIGEST_LIMIT)).alias("text"), F.col("published_at").alias("created_at"))
    first = rows.groupBy("chat_id", "message_id").agg(F.min(F.struct("created_at", "text")).alias("x")).select("chat_id", "message_id", "x.text", "x.created_at")
    return first.join(known.select("chat_id", "message_id").distinct(), ["chat_id", "message_id"], "left_anti")


def event_fields(source: Column, title: Column, body: Column) -> Column:
    """Source trimmed (null if blank, which is an error), title null if blank, body never null."""
    return F.struct(T.blank_to_null(F.trim(source)).alias("source"), T.blank_to_null(F.trim(title)).alias("title"), F.coalesce(F.trim(body), F.lit("")).alias("body"))


def chat_type(recipient: Column) -> Column:
    """The kind of chat in a message's recipient (JSON), in lower case."""
    return F.lower(F.get_json_object(recipient, "$.chat_type"))


def fanned_out(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Base ids of notices, without what fanning out to addresses added, that are among the known ones (base)."""
    return rows.select(T.base_id(F.col("source_msg_id")).alias("base")).distinct().join(known.select("base").distinct(), "base", "left_semi")
