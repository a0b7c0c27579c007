"""Notifications and memberships: who hears of what, what is due, state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linked_groups(members: DataFrame) -> DataFrame:
    """Live memberships, each once."""
    return members.filter(F.col("chat_type") == "chat").select("user_id", "chat_id", "address_id").distinct()


def recipients(events: DataFrame, addresses: DataFrame, members: DataFrame) -> DataFrame:
    """Users to tell of an event: of its house, its street, or its city, by the event's precision.

    An event that goes to one house, street or city, as nearly all do, names each user there once; only those whose id
    comes with several targets are made distinct after they met users.
    """
    live = linked_groups(members).join(addresses.select(F.col("id").alias("address_id"), "city", "street"), "address_id")
    own = events.join(addresses.select(F.col("id").alias("address_id"), F.col("city"), F.col("street")), "address_id").filter(F.col("geo_by").isin("home", "street", "city"))
    only = lambda c, *kinds: F.when(F.col("geo_by").isin(*kinds), F.col(c)).alias(c)
    target = F.struct("geo_by", only("address_id", "home"), only("city", "street", "city"), only("street", "street"))
    targets = own.groupBy("id").agg(F.collect_set(target).alias("t"))

    def met(rows: DataFrame) -> DataFrame:
        at = rows.select("id", F.explode("t").alias("t")).select("id", "t.*")
        users = lambda kind, *on: at.filter(F.col("geo_by") == kind).select("id", *on).join(live.select("user_id", *on).distinct(), list(on)).select("id", "user_id")
        return users("home", "address_id").unionByName(users("street", "city", "street")).unionByName(users("city", "city"))

    found = met(targets.filter(F.size("t") == 1)).unionByName(met(targets.filter(F.size("t") > 1)).distinct())
    return found.withColumnRenamed("id", "event_id")


def enqueue(events: DataFrame, addresses: DataFrame, members: DataFrame, deliveries: DataFrame, cursor: int | None) -> tuple[DataFrame, DataFrame]:
    """C20: new deliveries of events after the cursor, and the new cursor. Without a cursor nothing is sent."""
    mark = events.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(cursor or 0)).alias("last_event_id"))
    fresh = events.filter(F.lit(cursor is not None) & (F.col("id") > F.lit(cursor or 0)) & F.col("importance").isin(1, 2))
    found = recipients(fresh, addresses, members)
    return found.join(deliveries.select("event_id", "user_id").distinct(), ["event_id", "user_id"], "left_anti"), mark


def due(deliveries: DataFrame, now: Column, retry_seconds: int) -> DataFrame:
    """ST6: deliveries without an answer, never sent or sent long enough ago."""
    before = now - F.make_dt_interval(secs=F.lit(max(1, retry_seconds)))
    return deliveries.filter(F.col("acked_at").isNull() & (F.col("last_sent_at").isNull() | (F.col("last_sent_at") <= before)))


def due_priority(deliveries: DataFrame, users: DataFrame, events: DataFrame, now: Column, retry_seconds: int) -> DataFrame:
    """due deliveries to users (user_id, max_user_id, chat_id, notify_blocked_at) that have a chat and have not blocked
    the bot, of events that are still of importance 1 or 2; with what is to be sent.
    """
    open_ = users.filter(F.col("chat_id").isNotNull() & F.col("notify_blocked_at").isNull()).select("user_id", "max_user_id", "chat_id")
    grave = events.filter(F.col("importance").isin(1, 2)).select(F.col("id").alias("event_id"), "title", "body", "importance")
    ready = due(deliveries, now, retry_seconds).select(F.col("id").alias("delivery_id"), "user_id", "event_id")
    return ready.join(open_, "user_id").join(grave, "event_id")


def marked_sent(deliveries: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """One attempt more and the time of it for the deliveries that went out; acked ones stay as they are."""
    out = deliveries.join(sent.select("id", F.lit(True).alias("cf_sent")), "id", "left")
    went = F.coalesce("cf_sent", F.lit(False)) & F.col("acked_at").isNull()
    return out.withColumns({"attempts": F.col("attempts") + went.cast("int"), "last_sent_at": F.when(went, now).otherwise(F.col("last_sent_at"))}).drop("cf_sent")


def home_of(members: DataFrame) -> DataFrame:
    """Each user's first address by chat id."""
    return members.groupBy("user_id").agg(F.min_by("address_id", F.struct("chat_id", "address_id")).alias("address_id"))


def titles_by_address(selected: DataFrame, referred: DataFrame) -> DataFrame:
    """The sorted distinct chat titles of each address over both sources."""
    both = selected.select("address_id", "title").unionByName(referred.select("address_id", "title")).distinct()
    return both.groupBy("address_id").agg(F.array_join(F.array_sort(F.collect_list("title")), ", ").alias("titles"))


def latest_request(links: DataFrame) -> DataFrame:
    """Each user's open request, claimed ones first, then the newest."""
    w = Window.partitionBy("user_id").orderBy(F.desc("claimed"), F.desc("created_at"), F.desc("id"))
    return links.filter(F.col("status") == "pending").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def priority_text(importance: Column, title: Column, body: Column) -> Column:
    """A marker and the title, and the body where it says more."""
    from ..functions import text as T

    mark = F.when(importance == 1, "[!] ").otherwise("[i] ")
    t, b = T.compact(title, 240), T.compact(body, 3000)
    more = F.coalesce(F.lower(t) != F.lower(b), F.lit(True))
    return F.concat(mark, F.coalesce(t, b), F.when(t.isNotNull() & more, F.concat(F.lit("\n"), b)).otherwise(F.lit("")))


def delivery_view(deliveries: DataFrame, events: DataFrame, users: DataFrame) -> DataFrame:
    """What is shown of a delivery to who asks for it (``asked_by``, a messenger's id): nothing to others than its owner.

    Users without a chat see none. An event that is of no importance by now is shown as of the first, since it was sent.
    """
    shown = F.when(F.col("importance").isin(1, 2), F.col("importance")).otherwise(1).alias("importance")
    e = events.select(F.col("id").alias("event_id"), "title", F.coalesce("body", F.lit("")).alias("body"), shown)
    owners = users.filter(F.col("chat_id").isNotNull()).select("user_id", "max_user_id", "chat_id")
    own = deliveries.join(owners, "user_id").filter(F.col("asked_by") == F.col("max_user_id"))
    return own.join(e, "event_id").select("id", "user_id", "max_user_id", "chat_id", "title", "body", "importance")


def chat_addresses(members: DataFrame) -> DataFrame:
    """Each user's chats with the chat's first address and how often the user is in it."""
    chats = members.groupBy("chat_id").agg(F.min("address_id").alias("address_id"))
    return members.groupBy("user_id", "chat_id").agg(F.count("*").alias("n")).join(chats, "chat_id", "left")


def first_added(members: DataFrame) -> DataFrame:
    """The first chat of each address and how many users it has."""
    return members.groupBy("address_id").agg(F.min("chat_id").alias("first_chat"), F.count_distinct("user_id").alias("users"))
