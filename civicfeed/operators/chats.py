"""House chats: what is linked, who may change it, and the state after each change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .records import absent, checked

# Limits of what a chat may be called and linked by.
TITLE_LIMIT, LINK_LIMIT = 255, 2048


def new_chats(wanted: DataFrame, chats: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats to add (chat_id, title, invite_link, address_id) that keep the rules, and the others with the rule that each breaks."""
    known = addresses.select(F.col("id").alias("address_id"), F.lit(True).alias("cf_address")).distinct()
    used = chats.select("chat_id", F.lit(True).alias("cf_used")).distinct()
    rows = wanted.withColumns({"title": F.trim("title"), "invite_link": F.trim("invite_link")}).join(known, "address_id", "left").join(used, "chat_id", "left")
    rules = {
        "chat_id": F.col("chat_id").isNotNull(),
        "title": F.length("title").between(1, TITLE_LIMIT),
        "invite_link": F.col("invite_link").isNull() | F.length("invite_link").between(1, LINK_LIMIT),
        "address": F.col("cf_address"),
        "exists": F.col("cf_used").isNull(),
    }
    good, bad = checked(rows, rules)
    return good.drop("cf_address", "cf_used"), bad.drop("cf_address", "cf_used")


def detach(chats: DataFrame, members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats and members after the bot has left some chats: those are removed, without a link and without members."""
    left = gone.select("chat_id", F.lit(True).alias("cf_gone")).distinct()
    marked = chats.join(left, "chat_id", "left")
    out = marked.withColumns({
        "chat_type": F.when(F.col("cf_gone"), "removed").otherwise(F.col("chat_type")), "invite_link": F.when(F.col("cf_gone").isNull(), F.col("invite_link")),
    })
    return out.drop("cf_gone"), members.join(left.select("chat_id"), "chat_id", "left_anti")


def promote_chats(chats: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Chats that are confirmed groups (chat_id, title, invite_link); empty new values leave the old ones."""
    new = confirmed.select("chat_id", T.blank_to_null(F.trim("title")).alias("cf_title"), T.blank_to_null(F.trim("invite_link")).alias("cf_link"), F.lit(True).alias("cf_ok"))
    out = chats.join(new, "chat_id", "left")
    return out.withColumns({
        "chat_type": F.when(F.col("cf_ok"), "chat").otherwise(F.col("chat_type")), "title": F.coalesce("cf_title", "title"), "invite_link": F.coalesce("cf_link", "invite_link"),
    }).drop("cf_title", "cf_link", "cf_ok")


def live_links(chats: DataFrame, chat_addresses: DataFrame) -> DataFrame:
    """Pairs of a linked chat and an address of it, from which both lists are read."""
    return chat_addresses.join(chats.filter("chat_type = 'chat'").select("chat_id"), "chat_id", "left_semi").select("chat_id", "address_id").distinct()


def set_member_address(members: DataFrame, chats: DataFrame, chat_addresses: DataFrame, wanted: DataFrame) -> DataFrame:
    """What becomes of wishes (user_id, chat_id, address_id): set, no_chat, not_chat_address or not_member."""
    linked = chats.filter("chat_type = 'chat'").select("chat_id", F.lit(True).alias("cf_chat")).distinct()
    allowed = chat_addresses.select("chat_id", "address_id", F.lit(True).alias("cf_address")).distinct()
    mine = members.select("user_id", "chat_id", F.lit(True).alias("cf_member")).distinct()
    rows = wanted.join(linked, "chat_id", "left").join(allowed, ["chat_id", "address_id"], "left").join(mine, ["user_id", "chat_id"], "left")
    said = F.when(F.col("cf_chat").isNull(), "no_chat").when(F.col("cf_address").isNull(), "not_chat_address").when(F.col("cf_member").isNull(), "not_member").otherwise("set")
    return rows.select("user_id", "chat_id", "address_id", said.alias("outcome"))


def save_member_addresses(members: DataFrame, chats: DataFrame, chat_addresses: DataFrame, saved: DataFrame) -> DataFrame:
    """All addresses of members' linked chats (user_id, chat_id, address_id) that are not saved yet."""
    rows = members.select("user_id", "chat_id").distinct().join(live_links(chats, chat_addresses), "chat_id").select("user_id", "chat_id", "address_id")
    return absent(rows, saved, ["user_id", "chat_id", "address_id"])


def referred(members: DataFrame, chats: DataFrame, chat_addresses: DataFrame) -> DataFrame:
    """Members (user_id, chat_id, address_id, maybe null) after they came by a chat's link: a chat's only address is theirs
    unless they have chosen one; of several none is guessed.
    """
    only = live_links(chats, chat_addresses).groupBy("chat_id").agg(F.count("*").alias("n"), F.min("address_id").alias("cf_only")).filter("n = 1").drop("n")
    return members.join(only, "chat_id", "left").withColumn("address_id", F.coalesce("address_id", "cf_only")).drop("cf_only")


def linked_choices(members: DataFrame, chat_addresses: DataFrame) -> DataFrame:
    """members' chosen addresses that their chat has."""
    return members.filter("address_id IS NOT NULL").join(chat_addresses.select("chat_id", "address_id").distinct(), ["chat_id", "address_id"], "left_semi").select("user_id", "chat_id", "address_id")


def confirmed_types(chats: DataFrame, links: DataFrame) -> DataFrame:
    """Chats with a request (chat_id, status) that is connected or waits for a join are groups."""
    sure = links.filter(F.col("status").isin("connected", "waiting_join")).select("chat_id", F.lit(True).alias("cf_ok")).distinct()
    return chats.join(sure, "chat_id", "left").withColumn("chat_type", F.when(F.col("cf_ok"), "chat").otherwise(F.col("chat_type"))).drop("cf_ok")


def upsert_registry(registry: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The groups that the bot is in (chat_id, title, added_by_user_id, is_active) after it was added to some and removed from others.

    A group without a title is named by its id; an empty new title leaves the old one; being added comes after being removed.
    """
    new = added.groupBy("chat_id").agg(F.max("title").alias("cf_title"), F.max("actor_id").alias("cf_actor")).withColumn("cf_new", F.lit(True))
    gone = removed.select("chat_id", F.lit(True).alias("cf_gone")).distinct()
    rows = registry.join(new, "chat_id", "full_outer").join(gone, "chat_id", "left")
    title = F.coalesce(T.blank_to_null(F.left("cf_title", F.lit(TITLE_LIMIT))), "title", F.concat(F.lit("Чат "), F.col("chat_id").cast("string")))
    return rows.select(
        "chat_id", title.alias("title"), F.when(F.col("cf_new"), F.col("cf_actor")).otherwise(F.col("added_by_user_id")).alias("added_by_user_id"),
        F.when(F.col("cf_new"), True).when(F.col("cf_gone"), False).otherwise(F.col("is_active")).alias("is_active"),
    )


def admin_groups(registry: DataFrame, facts: DataFrame) -> DataFrame:
    """Groups that a user may manage, by what the messenger says of them (chat_id, user_id, type, title, readable, is_admin,
    is_owner): active, a group, readable, and the user its admin or owner. Titles are the messenger's if it has one; ``place``
    is the order of a user's list, by title without case, then id.
    """
    from pyspark.sql import Window

    own = registry.filter("is_active").select("chat_id", F.col("title").alias("cf_title"))
    may = F.coalesce("readable", F.lit(False)) & (F.coalesce("is_admin", F.lit(False)) | F.coalesce("is_owner", F.lit(False)))
    rows = facts.filter((F.col("type") == "chat") & may).join(own, "chat_id").select("user_id", "chat_id", F.coalesce(T.blank_to_null(F.col("title")), "cf_title").alias("title"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.lower("title"), "chat_id")))


def connected_admin_groups(chats: DataFrame, registry: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of ``admin_groups`` that are linked to an address."""
    return admin_groups(registry, facts).drop("place").join(chats.filter("chat_type = 'chat'").select("chat_id").distinct(), "chat_id", "left_semi")


def live_groups(chats: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored chats that are groups to the messenger (chat_id, type, title, link), with its title and link where it has them."""
    now = facts.filter("type = 'chat'").groupBy("chat_id").agg(F.max("title").alias("cf_title"), F.max("link").alias("cf_link"))
    rows = chats.dropDuplicates(["chat_id"]).join(now, "chat_id")
    return rows.withColumns({"title": F.coalesce("cf_title", "title"), "invite_link": F.coalesce("cf_link", "invite_link"), "chat_type": F.lit("chat")}).drop("cf_title", "cf_link")


def remove_address(chats: DataFrame, chat_addresses: DataFrame, members: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(outcomes, chats, chat_addresses, members) after wishes (chat_id, address_id, is_admin, readable), one a chat.

    Only an admin of a linked, readable chat may. A chat that loses its last address is removed; one that loses its main
    address takes the least of the others; members who had chosen it have chosen none.
    """
    links = live_links(chats, chat_addresses)
    held = links.withColumn("cf_has", F.lit(True))
    counts = links.groupBy("chat_id").agg(F.count("*").alias("cf_n"))
    rows = wanted.join(counts, "chat_id", "left").join(held, ["chat_id", "address_id"], "left")
    said = F.when(F.col("cf_n").isNull(), "no_chat").when(~F.coalesce("is_admin", F.lit(False)), "not_admin").when(~F.coalesce("readable", F.lit(False)), "not_readable")
    said = said.when(F.col("cf_has").isNull(), "absent").when(F.col("cf_n") == 1, "removed_last").otherwise("removed")
    outcomes = rows.select("chat_id", "address_id", said.alias("outcome"))
    done = outcomes.filter(F.startswith("outcome", F.lit("removed"))).select("chat_id", F.col("address_id").alias("cf_address"), F.col("outcome").alias("cf_outcome"))
    rest = chat_addresses.join(done, (chat_addresses.chat_id == done.chat_id) & (F.col("address_id") == F.col("cf_address")), "left_anti")
    following = rest.groupBy("chat_id").agg(F.min("address_id").alias("cf_next"))
    after = chats.join(done, "chat_id", "left").join(following, "chat_id", "left")
    moved = (F.col("cf_outcome") == "removed") & (F.col("address_id") == F.col("cf_address"))
    after = after.withColumns({
        "chat_type": F.when(F.col("cf_outcome") == "removed_last", "removed").otherwise(F.col("chat_type")), "address_id": F.when(moved, F.col("cf_next")).otherwise(F.col("address_id")),
    })
    m = members.join(done, "chat_id", "left")
    m = m.withColumn("address_id", F.when(~F.coalesce(F.col("address_id") == F.col("cf_address"), F.lit(False)), F.col("address_id")))
    return outcomes, after.select(*chats.columns), rest, m.select(*members.columns)


def set_personal_addresses(users: DataFrame, addresses: DataFrame, wanted: DataFrame) -> DataFrame:
    """Users (external_id, address_id) with the address that they ask for, if it exists; unknown users are not added."""
    known = wanted.join(addresses.select(F.col("id").alias("address_id")).distinct(), "address_id", "left_semi")
    new = known.groupBy("external_id").agg(F.max("address_id").alias("cf_new"))
    return users.join(new, "external_id", "left").withColumn("address_id", F.coalesce("cf_new", "address_id")).drop("cf_new")


def personal_addresses(users: DataFrame, addresses: DataFrame) -> DataFrame:
    """Users by external id with the address that they live at."""
    return users.join(addresses.select(F.col("id").alias("address_id"), "address_text"), "address_id").select("external_id", "address_id", "address_text")


def demo_deliveries(deliveries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Deliveries (user_id, event_id, acked_at) with the wanted ones there and without an answer."""
    asked = wanted.select("user_id", "event_id", F.lit(True).alias("cf_asked")).distinct()
    rows = deliveries.join(asked, ["user_id", "event_id"], "full_outer")
    return rows.withColumn("acked_at", F.when(F.col("cf_asked").isNull(), F.col("acked_at"))).drop("cf_asked")


def demo_event(events: DataFrame, seed: int) -> DataFrame:
    """One event at random: the least seeded hash among those of importance 1, else among all."""
    mark = F.struct((F.col("importance") != 1).alias("a"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")).alias("b"))
    return events.agg(F.min_by(F.struct(*events.columns), mark).alias("x")).filter("x IS NOT NULL").select("x.*")


def summary_prompt(messages: DataFrame, order: list[str]) -> DataFrame:
    """For each chat its digest's messages, a line each, and nothing else of them; a digest has few messages."""
    lines = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return messages.groupBy("chat_id").agg(F.array_join(F.transform(lines, lambda m: F.concat(F.lit("- "), m["text"])), "\n").alias("prompt"))


def reply_content(reply: Column) -> Column:
    """V8: the text of the first choice in a language model's JSON reply; null if the reply is malformed or blank."""
    choices = F.from_json(reply, "struct<choices:array<struct<message:struct<content:string>>>>")["choices"]
    content = F.get(choices, 0)["message"]["content"]
    return F.when(F.trim(content) != "", content)
