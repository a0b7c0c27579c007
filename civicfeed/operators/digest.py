"""The daily digest of house chats (C22, ST7, X15): what is due, what is new, and a log from which all state follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .members import due_chats

OUTCOME = "chat_id long, day date, n long, sent boolean, last_message_id long, last_message_at timestamp"


def after_cursor(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Each chat's messages after its cursor: by row id where that is known, else by time, else all of them.

    ``messages`` has chat_id, id, text, created_at; ``chats`` has chat_id, last_message_id, last_message_at.
    """
    marks = chats.select("chat_id", F.col("last_message_id").alias("mark_id"), F.col("last_message_at").alias("mark_at"))
    by_id, by_time = F.col("id") > F.col("mark_id"), F.col("created_at") > F.col("mark_at")
    fresh = F.when(F.col("mark_id").isNotNull(), by_id).when(F.col("mark_at").isNotNull(), by_time).otherwise(F.lit(True))
    return messages.join(marks, "chat_id").filter(fresh & (F.length(F.trim("text")) > 0)).drop("mark_id", "mark_at")


def outcomes(chats: DataFrame, messages: DataFrame, now: Column, least: int, hour: int, jitter: int, tz: str = "Europe/Moscow") -> DataFrame:
    """Each due chat's outcome of the day (OUTCOME): a digest if it has over ``least`` new messages, else a quiet day.

    A digest moves the cursor to its last message; a quiet day leaves it, so that its messages count tomorrow. ``chats`` has
    chat_id, chat_type, last_digest_date and the cursor.
    """
    due = due_chats(chats, now, hour, jitter, tz).select("chat_id", "last_message_id", "last_message_at")
    fresh = after_cursor(messages, due).groupBy("chat_id").agg(F.count("*").alias("n"), F.max("id").alias("new_id"), F.max("created_at").alias("new_at"))
    sent = F.coalesce(F.col("n") > max(0, least), F.lit(False))
    rows = due.join(fresh, "chat_id", "left").withColumn("sent", sent)
    moved = lambda new, old: F.when(F.col("sent"), F.col(new)).otherwise(F.col(old))
    day = F.to_date(F.from_utc_timestamp(now, tz))
    return rows.select(
        F.col("chat_id").cast("long").alias("chat_id"), day.alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "sent",
        moved("new_id", "last_message_id").cast("long").alias("last_message_id"), moved("new_at", "last_message_at").cast("timestamp").alias("last_message_at"),
    )


def texts(outcome: DataFrame, messages: DataFrame, chats: DataFrame) -> DataFrame:
    """(chat_id, id, text) of what a digest is made from: the messages that its outcome counted, one row each."""
    told = outcome.filter("sent").select("chat_id", F.col("last_message_id").alias("upto"))
    return after_cursor(messages, chats).join(told, "chat_id").filter(F.col("id") <= F.col("upto")).select("chat_id", "id", "text")


class DigestLog:
    """Outcomes by cycle, one folder each. Cursors, days and what is consumed all follow from the log, so a cycle is one write.

    A cycle whose folder is complete gives that again. One that stopped before is worked out anew, from the state before it: no
    state can be half moved. Digests are sent before the folder is written: after a stop they may go out twice, but none is lost.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _done(self, cycle: int) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/cycle={cycle}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, before: int | None = None) -> DataFrame:
        """All complete outcomes with their cycle, or those of the cycles before one."""
        try:
            rows = self.spark.read.schema(f"{OUTCOME}, cycle long").parquet(self.folder)
        except AnalysisException:  # no cycle yet
            rows = self.spark.createDataFrame([], f"{OUTCOME}, cycle long")
        cycles = [r.cycle for r in rows.select("cycle").distinct().collect()]
        complete = [c for c in cycles if self._done(c) and (before is None or c < before)]
        return rows.filter(F.col("cycle").isin(complete))

    def state(self, chats: DataFrame, before: int | None = None) -> DataFrame:
        """``chats`` with the day and the cursor that the log has for them; their own where it has none."""
        last = self.read(before).groupBy("chat_id").agg(F.max("day").alias("l_day"), F.max_by(F.struct("last_message_id", "last_message_at"), "cycle").alias("l"))
        joined = chats.join(last, "chat_id", "left").withColumn("known", F.col("l_day").isNotNull())
        kept = {"last_digest_date": "l_day", "last_message_id": "l.last_message_id", "last_message_at": "l.last_message_at"}
        return joined.withColumns({c: F.when(F.col("known"), F.col(new)).otherwise(F.col(c)) for c, new in kept.items()}).drop("known", "l_day", "l")

    def unread(self, messages: DataFrame) -> DataFrame:
        """Messages that no digest has consumed."""
        told = self.read().filter("sent").groupBy("chat_id").agg(F.max("last_message_id").alias("upto"))
        return messages.join(told, "chat_id", "left").filter(F.col("upto").isNull() | (F.col("id") > F.col("upto"))).drop("upto")

    def run(self, cycle: int, chats: DataFrame, messages: DataFrame, now: Column, least: int, hour: int, jitter: int, tz: str = "Europe/Moscow", send: Callable[[DataFrame, DataFrame], None] | None = None) -> DataFrame:
        """The outcomes of a cycle. ``send`` gets those that are digests, and their messages; its error leaves the cycle open."""
        path = f"{self.folder}/cycle={cycle}"
        if not self._done(cycle):
            known = self.state(chats, before=cycle)
            found = outcomes(known, messages, now, least, hour, jitter, tz)
            if send:
                send(found.filter("sent"), texts(found, messages, known))
            found.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(OUTCOME).parquet(path)

    def stream(self, ticks: DataFrame, chats: Callable[[], DataFrame], messages: Callable[[], DataFrame], least: int, hour: int, jitter: int, checkpoint: str, tz: str = "Europe/Moscow", send: Callable[[DataFrame, DataFrame], None] | None = None):
        """A cycle for each batch of a stream of times (``now``), by the latest in it; a batch that runs twice is one cycle."""

        def one(batch: DataFrame, batch_id: int) -> None:
            latest = batch.agg(F.max("now").alias("now")).first().now
            if latest is not None:
                self.run(batch_id, chats(), messages(), F.lit(latest), least, hour, jitter, tz, send)

        return ticks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
