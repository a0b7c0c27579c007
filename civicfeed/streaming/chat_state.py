"""Structured Streaming forms of the chat operators and of idempotent consumption."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators.chat import FLOOD_REPEATS, FLOOD_SECONDS, PHOTO_SECONDS

MESSAGE = "chat_id long, message_id string, sender_user_id long, text string, image_url string, ts timestamp"


def floods(messages: DataFrame, seconds: int = FLOOD_SECONDS, repeats: int = FLOOD_REPEATS, late: str = "10 minutes") -> DataFrame:
    """ST3: messages with flood, whether their author has sent the text over ``repeats`` times in the last seconds.

    State is the times of one author's one text within the window, and goes when event time has passed it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        for f in frames:
            f = f.sort_values(["ts", "message_id"])
            marks = []
            for t in f["ts"]:
                at = t.timestamp()
                times = [x for x in times if x >= at - seconds] + [at]
                marks.append(len([x for x in times if x <= at]) > repeats)
            yield f.assign(flood=marks)[["chat_id", "message_id", "flood"]]
        state.update((times,))
        if times:
            state.setTimeoutTimestamp(max(int((max(times) + seconds + 1) * 1000), state.getCurrentWatermarkMs() + 1))

    keyed = messages.withColumn("norm", T.normalize_text(F.coalesce("text", F.lit("")))).withWatermark("ts", late)
    return keyed.groupBy("chat_id", "sender_user_id", "norm").applyInPandasWithState(step, "chat_id long, message_id string, flood boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def pending_photos(messages: DataFrame, seconds: int = PHOTO_SECONDS, late: str = "10 minutes") -> DataFrame:
    """ST4: messages with the photo that their author sent just before; a photo alone waits in state and expires."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: tuple[str, float] | None = tuple(state.get) if state.exists else None
        for f in frames:
            f = f.sort_values(["ts", "message_id"])
            urls, actions = [], []
            for text, url, t in zip(f["text"], f["image_url"], f["ts"], strict=True):
                has_text, photo, at = bool(text and text.strip()), url is not None, t.timestamp()
                if photo and not has_text:
                    held = (url, at)
                    actions.append("hold_photo")
                elif has_text and not photo and held and at - held[1] <= seconds:
                    url, held = held[0], None
                    actions.append("attached")
                else:
                    held = None
                    actions.append("passthrough")
                urls.append(url)
            yield f.assign(image_url=urls, action=actions)[["chat_id", "message_id", "image_url", "action"]]
        if held is None:
            state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(max(int((held[1] + seconds + 1) * 1000), state.getCurrentWatermarkMs() + 1))

    full = messages.filter(F.col("sender_user_id").isNotNull() & ((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) | F.col("image_url").isNotNull()))
    return full.withWatermark("ts", late).groupBy("chat_id", "sender_user_id").applyInPandasWithState(
        step, "chat_id long, message_id string, image_url string, action string", "url string, at double", "append", GroupStateTimeout.EventTimeTimeout
    )


def once(messages: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """ST5: each key once within the watermark."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def daily_counts(messages: DataFrame, tz: str = "Europe/Moscow", late: str = "1 hour") -> DataFrame:
    """ST7: messages of each chat and local day of a time zone; ``day_start`` is the instant at which that day begins.

    Days are windows of local time, so that those of 23 and 25 hours are days too; a day is out once the watermark has
    passed its end by the widest offset of a zone.
    """
    local = messages.withColumn("cf_local", F.from_utc_timestamp(F.to_utc_timestamp("ts", F.current_timezone()), tz)).withWatermark("cf_local", late)
    days = local.groupBy("chat_id", F.window("cf_local", "1 day")).agg(F.count("*").alias("n"))
    start = F.from_utc_timestamp(F.to_utc_timestamp(F.col("window.start"), tz), F.current_timezone())
    return days.select("chat_id", start.alias("day_start"), "n")


def high_water(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, existing: Callable[[], DataFrame], keys: list[str]):
    """ST2, ST10: batches of new rows, less those written before; a batch that runs twice writes nothing twice."""

    def one(batch: DataFrame, batch_id: int) -> None:
        write(batch.dropDuplicates(keys).join(existing().select(*keys).distinct(), keys, "left_anti"), batch_id)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def near_duplicates(drafts: DataFrame, duplicate: float, days: int = 30, late: str = "1 hour") -> DataFrame:
    """ST9: drafts (id, address_id, v, ts) with match_id, the live event of their address that they repeat, null for new events.

    A draft that is like no event of its address since ``days`` days before it becomes one. Drafts without an address
    are a lane of their own. State has the ids, times and vectors of a lane's live events and drops each once the watermark
    or a later draft has passed its horizon; a lane without live events has no state. Drafts of one batch come by time, then id;
    the best match is the most similar, then the one of the higher id.
    """
    horizon = days * 86_400.0

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times, flat = (list(x) for x in state.get) if state.exists else ([], [], [])
        mark = state.getCurrentWatermarkMs() / 1000 - horizon
        live = [i for i, t in enumerate(times) if t >= mark]
        width = len(flat) // len(ids) if ids else 0
        events = [(ids[i], times[i], np.array(flat[i * width : (i + 1) * width])) for i in live]
        if not state.hasTimedOut:
            for f in frames:
                found = []
                for n, v, t in f.sort_values(["ts", "id"])[["id", "v", "ts"]].itertuples(index=False):
                    at, x = t.timestamp(), np.asarray(v, float)
                    x = x / max(float(np.linalg.norm(x)), 1e-12)
                    scores = [(round(float(x @ e[2]), 9), e[0]) for e in events if e[1] >= at - horizon]
                    best = max(scores, default=(-2.0, None))
                    if best[0] >= duplicate:
                        found.append((n, best[1], best[0]))
                    else:
                        events.append((n, at, x))
                        found.append((n, None, None))
                yield pd.DataFrame({"id": [r[0] for r in found], "match_id": pd.array([r[1] for r in found], "Int64"), "score": pd.array([r[2] for r in found], "Float64")})
        if not events:
            if state.exists:
                state.remove()
            return
        state.update(([e[0] for e in events], [e[1] for e in events], np.concatenate([e[2] for e in events]).tolist()))
        state.setTimeoutTimestamp(max(int((min(e[1] for e in events) + horizon) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    lanes = drafts.select("id", F.coalesce(F.col("address_id").cast("long"), F.lit(-1).cast("long")).alias("lane"), F.col("v").cast("array<double>").alias("v"), "ts").withWatermark("ts", late)
    return lanes.groupBy("lane").applyInPandasWithState(step, "id long, match_id long, score double", "ids array<long>, times array<double>, v array<double>", "append", GroupStateTimeout.EventTimeTimeout)
