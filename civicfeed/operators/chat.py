"""Chat messages: filtering, floods, photos that wait for their text, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the filter.
FLOOD_SECONDS, FLOOD_REPEATS, PHOTO_SECONDS, LEAST_CHARS = 90, 3, 600, 3


def flooded(df: DataFrame, keys: list[str], ts: str, order: str, seconds: int = FLOOD_SECONDS, repeats: int = FLOOD_REPEATS) -> DataFrame:
    """``df`` with flood, whether a row has over ``repeats`` rows of its keys in the time up to it, itself counted.

    Both ends of the time count; of rows at the same time only those before it in ``order`` do.
    """
    range_ = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-seconds, 0)
    same = Window.partitionBy(*keys, ts)
    later = F.count("*").over(same) - F.row_number().over(same.orderBy(order))
    return df.withColumn("flood", F.count("*").over(range_) - later > repeats)


def pending_photos(df: DataFrame, seconds: int = PHOTO_SECONDS) -> DataFrame:
    """The photo of a message without text goes to its author's next message if that has text and no photo.

    Rows without sender, or with neither text nor photo, are left out. action: hold_photo, attached, passthrough.
    """
    has_text = F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))
    rows = df.withColumns({"tx": has_text, "im": F.col("image_url").isNotNull()}).filter(F.col("sender_user_id").isNotNull() & (F.col("tx") | F.col("im")))
    w = Window.partitionBy("chat_id", "sender_user_id").orderBy("ts_sec", "message_id")
    before = {"p_url": F.lag("image_url").over(w), "p_ts": F.lag("ts_sec").over(w), "p_hold": F.lag(F.col("im") & ~F.col("tx")).over(w)}
    rows = rows.withColumns(before)
    takes = F.col("tx") & ~F.col("im") & F.coalesce(F.col("p_hold"), F.lit(False)) & (F.col("ts_sec") - F.col("p_ts") <= seconds)
    url = F.when(takes, F.col("p_url")).otherwise(F.col("image_url"))
    what = F.when(F.col("im") & ~F.col("tx"), "hold_photo").when(takes, "attached").otherwise("passthrough")
    return rows.withColumns({"image_url": url, "action": what}).drop("tx", "im", *before)


def verdicts(df: DataFrame, greeting: Column | None = None) -> DataFrame:
    """``df`` with reason (null if accepted) and signal, by the first rule that applies.

    Bots, commands, messages of nothing, greetings, short ones, floods (by chat, sender and text).
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    marked = df.withColumn("cf_text", T.normalize_text(text))
    marked = flooded(marked, ["chat_id", "sender_user_id", "cf_text"], "ts_sec", "message_id")
    photo = F.col("image_url").isNotNull()
    greets = T.greeting_only(text) if greeting is None else greeting
    reason = (
        F.when(F.col("sender_is_bot"), "bot_sender")
        .when(text.startswith("/"), "command")
        .when((text == "") & ~photo, "empty")
        .when(greets & ~photo, "greeting_only")
        .when((F.length(text) < LEAST_CHARS) & ~photo, "empty")
        .when(F.col("flood") & (text != ""), "flood")
    )
    signal = F.when(photo & (text != ""), "text_image").when(photo, "image").otherwise("text")
    return marked.withColumns({"reason": reason, "signal": F.when(reason.isNull(), signal)}).drop("cf_text", "flood")


def last_texts(df: DataFrame, keep: int = 5) -> DataFrame:
    """For each chat its last ``keep`` distinct texts, joined in the order of time."""
    own = df.filter(F.length(F.trim("text")) > 0).withColumn("norm", T.normalize_text(F.col("text")))
    latest = own.groupBy("chat_id", "norm").agg(F.max(F.struct("ts_sec", "message_id", "text")).alias("m"))
    place = Window.partitionBy("chat_id").orderBy(F.desc("m.ts_sec"), F.desc("m.message_id"))
    few = latest.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= keep)
    texts = F.transform(F.sort_array(F.collect_list("m")), lambda m: m["text"])
    return few.groupBy("chat_id").agg(F.count("*").alias("n_texts"), F.array_join(texts, "\n").alias("texts"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds from a time that may be in milliseconds."""
    return F.when(ts > 10_000_000_000, F.floor(ts / 1000)).otherwise(ts).cast("long")


def due_digests(chats: DataFrame, messages: DataFrame, least: int) -> DataFrame:
    """Chats with more than ``least`` messages after their cursor, with the new cursor.

    ``chats`` has chat_id and last_message_id, ``messages`` chat_id and id.
    """
    fresh = messages.join(chats, "chat_id").filter(F.col("last_message_id").isNull() | (F.col("id") > F.col("last_message_id")))
    return fresh.groupBy("chat_id").agg(F.count("*").alias("n"), F.max("id").alias("last_message_id")).filter(F.col("n") > least)
