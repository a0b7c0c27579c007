"""Keyed records: insert, upsert, partial update, delete, conflict rejection, duplicates in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is first by ``order``, all ascending; reduced by partial aggregation."""
    best = F.min_by(F.struct(*df.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*[F.col(k).alias(f"cf_{k}") for k in keys]).agg(best.alias("cf_row")).select("cf_row.*")


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """J8, SK5: rows whose keys are not there yet; equal new keys come once, null keys always."""
    known = old.select(*keys).distinct()
    return new.join(known, keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: list[str]) -> DataFrame:
    """SK4: ``old`` with the rows of ``new``, matched by keys; the named columns keep their value where the new one is null.

    Both have the same columns, and ``new`` one row a key.
    """
    values = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"cf_{c}") for c in values], F.lit(True).alias("cf_new"))
    joined = old.withColumn("cf_old", F.lit(True)).join(n, keys, "full_outer")

    def value(c: str) -> Column:
        fresh = F.coalesce(f"cf_{c}", c) if c in keep_if_null else F.col(f"cf_{c}")
        return F.when(F.col("cf_new"), fresh).otherwise(F.col(c)).alias(c)

    return joined.select(*[F.col(c) if c in keys else value(c) for c in old.columns])


def update(old: DataFrame, patch: DataFrame, key: str, clear: list[str] = ()) -> DataFrame:
    """SK2: non-null values of the patch replace, null ones leave; clear_x columns of the patch set x to null."""
    fields = [c for c in patch.columns if c in old.columns and c != key]
    p = patch.select(F.col(key), *[F.col(c).alias(f"cf_{c}") for c in fields], *[F.col(f"clear_{c}") for c in clear])
    out = old.join(p, key, "left")
    for c in fields:
        new = F.coalesce(f"cf_{c}", c)
        out = out.withColumn(c, F.when(F.coalesce(f"clear_{c}", F.lit(False)), F.lit(None)).otherwise(new) if c in clear else new)
    return out.select(*old.columns)


def split_conflicts(df: DataFrame, key: str, compared: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Keys whose rows agree, one row each with all their order values; and the keys that conflict, with counts.

    Nulls are values. Rows of a key are counted by a set of one text for each, and never collected.
    """
    seen = F.to_json(F.struct(*compared), {"ignoreNullFields": "false"})
    groups = df.groupBy(key).agg(
        F.min(seen).alias("low"), F.max(seen).alias("high"), F.count("*").alias("n"), F.min(order).alias(order), F.min_by(F.struct(*compared), order).alias("v")
    )
    agree = groups.filter(F.col("low") == F.col("high")).select(key, order, "v.*", "n")
    return agree, groups.filter(F.col("low") != F.col("high")).select(key, "n")


def checked(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """SC3, SK1, X20, X34: rows that pass all rules, and the others with the first rule that each breaks."""
    first = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    marked = df.withColumn("cf_error", first)
    return marked.filter(F.col("cf_error").isNull()).drop("cf_error"), marked.filter(F.col("cf_error").isNotNull()).withColumnRenamed("cf_error", "error")


def first_streak(df: DataFrame, keys: list[str], order: str, known: Column, length: int) -> DataFrame:
    """Of each key the rows before ``length`` known ones in a row have been seen."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("cf_k", F.coalesce(known, F.lit(False)).cast("int"))
    island = F.sum(1 - F.col("cf_k")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("cf_island", island)
    run = F.sum("cf_k").over(Window.partitionBy(*keys, "cf_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("cf_over", (run >= length).cast("int"))
    seen = F.max("cf_over").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("cf_seen", F.coalesce(seen, F.lit(0))).filter(F.col("cf_seen") == 0)
    return rows.drop("cf_k", "cf_island", "cf_over", "cf_seen")


def by_margin(df: DataFrame, keys: list[str], score: str, least: float, margin: float) -> DataFrame:
    """The best row of each key, if good enough and far enough ahead of the second."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score))
    rows = df.withColumns({"cf_n": F.row_number().over(w), "cf_next": F.lead(score).over(w)}).filter(F.col("cf_n") == 1)
    clear = F.col("cf_next").isNull() | (F.col(score) - F.col("cf_next") >= margin)
    return rows.filter((F.col(score) >= least) & clear).drop("cf_n", "cf_next")


def sequential_ids(df: DataFrame, order: list[str], name: str = "new_id", parts: int | None = None) -> DataFrame:
    """SK10: ids from 1 in the given order, without sorting in one task; ``order`` has no ties.

    Ranges have their bounds from quantiles of the first order column, which are taken once: counts of ranges and ids
    within them then agree, whatever columns either plan reads. A range is a task's rows; the first order column is a
    number or a time of which no single value has a large share.
    """
    lead = F.unix_micros(F.col(order[0]).cast("timestamp")) if dict(df.dtypes)[order[0]] in ("date", "timestamp", "timestamp_ntz") else F.col(order[0])
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(lead.cast("double").alias("x")).agg(F.percentile_approx("x", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts or []))]).cast("array<double>")
    placed = df.withColumn("cf_part", F.size(F.filter(bounds, lambda b: b < F.coalesce(lead.cast("double"), F.lit(float("-inf"))))))
    sizes = placed.groupBy("cf_part").count()
    before = sizes.withColumn("cf_before", F.coalesce(F.sum("count").over(Window.orderBy("cf_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("cf_part").orderBy(*order))
    out = placed.join(F.broadcast(before.select("cf_part", "cf_before")), "cf_part")
    return out.withColumn(name, F.col("cf_before") + within).drop("cf_part", "cf_before")


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """SK3: rows whose keys are not among those that are gone."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def existing(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur in another table."""
    return rows.join(others.select(*keys), keys, "left_semi")


def without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows that the other table, of the same columns, does not have."""
    return rows.exceptAll(others)


def keyset_page(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """L4: the page after a key, with one row more than it holds if there is a next one."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(size + 1)


def offset_page(rows: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 0) of rows in an order; ``rows.count()`` is the total."""
    return rows.orderBy(*order).offset(page * size).limit(size)


def numbered_page(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1, the nearest there is) of a list, with each row's number in all of it as ``n``.

    Only the rows up to the page's end are sorted out of each task and numbered.
    """
    last = max(1, -(-rows.count() // size))
    end = min(max(page, 1), last) * size
    n = F.row_number().over(Window.orderBy(*order)).cast("long")
    return rows.orderBy(*order).limit(end).withColumn("n", n).filter(F.col("n") > end - size)


def counts_by(rows: DataFrame, keys: list[str], **tests: Column) -> DataFrame:
    """The rows of each value of the keys, and how many of them pass each test."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(t).alias(name) for name, t in tests.items()])
