"""Incremental collection: what each source reads next, and when a backfill is over."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plan(cursors: DataFrame, counts: DataFrame, now: Column, lookback_days: int, enough: int = 1) -> DataFrame:
    """ST1, X39: each source's mode and the time from which it reads.

    A source whose backfill is complete, or that has rows enough, reads what is new; the others fill back.
    """
    rows = cursors.join(counts, "source_key", "left")
    done = F.col("backfill_complete") | (F.coalesce("n", F.lit(0)) >= enough)
    since = now - F.make_dt_interval(F.lit(lookback_days))
    mode = F.when(done, "incremental").otherwise("backfill")
    return rows.select("source_key", mode.alias("mode"), F.when(mode == "incremental", F.greatest("newest_seen_at", since)).otherwise(since).alias("since"), "listing_cursor")


def advanced(cursors: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """A4: cursors widened by the times of a batch of rows (source_key, published_at), with the time of the run."""
    seen = batch.groupBy("source_key").agg(F.min("published_at").alias("low"), F.max("published_at").alias("high"))
    out = cursors.join(seen, "source_key", "left")
    return out.withColumns({"oldest_seen_at": F.least("oldest_seen_at", "low"), "newest_seen_at": F.greatest("newest_seen_at", "high"), "last_run_at": now}).drop("low", "high")


def next_day(cursor: str | None, today: date, since: date, form: str = "%Y%m%d") -> tuple[date, str | None]:
    """CN2, CN3: the day that a backfill reads, and the cursor after it; None when it is over."""
    from datetime import datetime

    day = datetime.strptime(cursor, form).date() if cursor else today
    before = day - timedelta(days=1)
    return day, before.strftime(form) if before >= since else None


def next_month(cursor: str | None, today: date, since: date) -> tuple[str, str | None]:
    """CN11: the month that a backfill reads, and the one before; None when it is over."""
    year, month = map(int, (cursor or today.strftime("%Y-%m")).split("-"))
    before = (year - (month == 1), 12 if month == 1 else month - 1)
    return f"{year:04d}-{month:02d}", f"{before[0]:04d}-{before[1]:02d}" if before >= (since.year, since.month) else None


def next_page(cursor: str | None, added: int, all_old: bool, empty_run: int = 0, most_empty: int = 1) -> str | None:
    """CN5, CN6, CN9, CN10: the page after one that brought something new; None after old or empty pages."""
    page = int(cursor or 1)
    over = all_old or (added == 0 and empty_run + 1 >= most_empty)
    return None if over else str(page + 1)


def next_probe(cursor: int, found: bool, misses: int, most: int = 50) -> tuple[int | None, int]:
    """CN4: the id to try after one that was there or not, and the misses in a row; None after too many."""
    misses = 0 if found else misses + 1
    return (None if misses >= most or cursor <= 1 else cursor - 1), misses


def next_sitemap(cursor: str | None, size: int, step: int, empty_run: int) -> str | None:
    """CN1: "index:offset" after a step through a sitemap of ``size`` entries; the next feed after three empty ones."""
    kind, offset = (cursor or "0:0").split(":")
    if kind == "gnews":
        return f"gnews:{int(offset) + step}" if int(offset) + step < size else None
    if empty_run >= 3:
        return "gnews:0"
    return f"{kind}:{int(offset) + step}" if int(offset) + step < size else f"{int(kind) + 1}:0"


def latest_first(pages: DataFrame, since: Column, most: int | None = None) -> DataFrame:
    """SC9, U6: pages from a time on, newest first, ``most`` of them."""
    rows = pages.filter(F.col("published_at").isNull() | (F.col("published_at") >= since)).orderBy(F.desc_nulls_last("published_at"), "external_id")
    return rows if most is None else rows.limit(most)


def days_back(spark: SparkSession, today: date, since: date) -> DataFrame:
    """The days from one back to another, the latest first."""
    days = F.sequence(F.lit(today), F.lit(since), F.expr("interval -1 day"))
    return spark.range(1).select(F.explode(days).alias("day"))


def days_between(ranges: DataFrame) -> DataFrame:
    """D5 of a column: (day, place) for each row of today and since, the latest day first; place counts from 1."""
    days = ranges.select(F.posexplode(F.sequence("today", "since", F.expr("interval -1 day"))).alias("i", "day"))
    return days.select("day", (F.col("i") + 1).cast("long").alias("place"))
