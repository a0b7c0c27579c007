"""Members, chats and their addresses: lists, gates and state changes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def memberships(users: DataFrame, members: DataFrame, addresses: DataFrame) -> DataFrame:
    """Each user's chats with their addresses; a chat without a type counts as live, a removed one does not."""
    live = members.filter(F.coalesce("chat_type", F.lit("chat")) == "chat")
    a = addresses.select(F.col("id").alias("address_id"), "city", "street", "address_text")
    return users.join(live, "user_id").join(a, "address_id")


def feed_origins(users: DataFrame, members: DataFrame) -> DataFrame:
    """C14: the addresses by which a user's feed is made: the personal one if a linked chat has it, else all linked ones.

    ``users`` has user_id and personal_id.
    """
    linked = members.filter(F.col("chat_type") == "chat").select("user_id", "address_id").distinct()
    own = users.join(linked, "user_id")
    has = F.max((F.col("address_id") == F.col("personal_id")).cast("int")).over(Window.partitionBy("user_id"))
    marked = own.withColumn("cf_has", F.coalesce(has, F.lit(0)))
    return marked.filter((F.col("cf_has") == 0) | (F.col("address_id") == F.col("personal_id"))).select("user_id", "address_id")


def ordered_addresses(rows: DataFrame) -> DataFrame:
    """Each user's addresses in the order in which they were added, the undated last, by position and id."""
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("added_at"), "position", "address_id")
    return rows.withColumn("place", F.row_number().over(w))


def remove_address(members: DataFrame, user_id: int, address_id: int) -> DataFrame:
    """Memberships without one address of one user."""
    return members.filter(~((F.col("user_id") == user_id) & (F.col("address_id") == address_id)))


def promote(members: DataFrame, homes: DataFrame) -> DataFrame:
    """users' homes (user_id, address_id), replaced by the address of their least chat where they have left it."""
    left = members.groupBy("user_id").agg(F.collect_set("address_id").alias("have"), F.min_by("address_id", F.struct("chat_id", "address_id")).alias("next"))
    out = homes.join(left, "user_id", "left")
    keeps = F.coalesce(F.array_contains("have", F.col("address_id")), F.lit(False))
    return out.select("user_id", F.when(keeps, F.col("address_id")).otherwise(F.col("next")).alias("address_id"))


def upsert_users(old: DataFrame, new: DataFrame) -> DataFrame:
    """SK11: users by external_id; an empty new name or user name leaves the old one."""
    n = new.select("external_id", *[F.nullif(F.trim(c), F.lit("")).alias(f"cf_{c}") for c in ("name", "username")])
    joined = old.join(n, "external_id", "full_outer")
    return joined.select("external_id", *[F.coalesce(f"cf_{c}", c).alias(c) for c in ("name", "username")])


def residence(members: DataFrame, asked: DataFrame) -> DataFrame:
    """What becomes of users' wish for an address (user_id, address_id): personal, not_member or no_chat."""
    chats = members.filter(F.col("chat_type") == "chat").select("address_id", F.lit(True).alias("cf_chat")).distinct()
    mine = members.filter(F.col("chat_type") == "chat").select("user_id", "address_id", F.lit(True).alias("cf_mine")).distinct()
    out = asked.join(chats, "address_id", "left").join(mine, ["user_id", "address_id"], "left")
    what = F.when(F.col("cf_chat").isNull(), "no_chat").when(F.col("cf_mine").isNull(), "not_member").otherwise("personal")
    return out.select("user_id", "address_id", what.alias("outcome"))


#: The states of a connection request and where each event leads.
MOVES = {("pending", "claim"): "claimed", ("claimed", "link"): "linked", ("pending", "cancel"): "cancelled", ("claimed", "cancel"): "cancelled", ("pending", "expire"): "expired", ("claimed", "fail"): "failed"}


def move(status: Column, event: Column) -> Column:
    """The state after an event; an event that a state does not know changes nothing."""
    out = F.when(F.lit(False), status)
    for (old, what), new in MOVES.items():
        out = out.when((status == old) & (event == what), new)
    return out.otherwise(status)


@F.pandas_udf(LongType())
def _spread(chat_ids: pd.Series, sizes: pd.Series) -> pd.Series:
    """BLAKE2b of an id's digits, eight bytes as a big-endian number, modulo a size."""
    return pd.Series([int.from_bytes(hashlib.blake2b(str(c).encode(), digest_size=8).digest(), "big") % n for c, n in zip(chat_ids, sizes, strict=True)], dtype="int64")


def digest_minute(chat_id: Column, hour: int, jitter: int) -> Column:
    """The minute of the day of a chat's digest: the hour, moved by a hash of the chat up to ``jitter`` minutes."""
    if jitter <= 0:
        return F.lit(hour * 60)
    return F.lit(hour * 60) + _spread(chat_id, F.lit(2 * jitter + 1)) - jitter


def due_chats(chats: DataFrame, now: Column, hour: int, jitter: int, tz: str = "Europe/Moscow") -> DataFrame:
    """chats without today's digest whose minute has come in their local day."""
    local = F.from_utc_timestamp(now, tz)
    minute = F.hour(local) * 60 + F.minute(local)
    today = F.col("last_digest_date").eqNullSafe(F.to_date(local))
    return chats.filter((F.col("chat_type") == "chat") & ~today & (minute >= digest_minute(F.col("chat_id"), hour, jitter)))
