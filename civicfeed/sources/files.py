"""Files: JSON lines checked row by row, CSV with a null mark, snapshots, manifests, map data."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import absent, checked

ADDRESS_SCHEMA = "address_text string, latitude decimal(10,7), longitude decimal(10,7), postal_code string, is_private boolean, city string, district string, street string, house string"
EVENT_SCHEMA = "title string, body string, importance int, source string, source_msg_id string, geo_by string, address_text string, city string, street string, disaster_flag boolean, published_at timestamp, active_from timestamp, active_to timestamp"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC3: typed rows with the raw line of those that do not parse in ``bad_line``."""
    return spark.read.schema(f"{schema}, bad_line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").json(path)


def addresses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC3: addresses that pass all checks, each text once; and the rejected rows with their error.

    An address text with differing rows is rejected whole.
    """
    rows = json_lines(spark, path, ADDRESS_SCHEMA).withColumn("address_text", F.trim("address_text"))
    rules = {
        "not JSON": F.col("bad_line").isNull(),
        "address_text": F.length("address_text").between(1, 1000),
        "latitude": F.abs("latitude") <= 90,
        "longitude": F.abs("longitude") <= 180,
        "postal_code": F.col("postal_code").isNull() | F.col("postal_code").rlike("^[0-9]{6}$"),
    }
    good, bad = checked(rows, rules)
    good = good.drop("bad_line").distinct()
    n = F.count("*").over(Window.partitionBy("address_text"))
    counted = good.withColumn("n", n)
    conflict = counted.filter("n > 1").drop("n").withColumns({"bad_line": F.lit(None).cast("string"), "error": F.lit("conflicting address_text")})
    return counted.filter("n = 1").drop("n"), bad.unionByName(conflict)


def events_snapshot(spark: SparkSession, path: str, known_addresses: DataFrame, existing: DataFrame) -> DataFrame:
    """SC4, X13: events with id, title or body that are not there yet, with their address by exact text, else by city."""
    rows = json_lines(spark, path, EVENT_SCHEMA).filter(F.col("bad_line").isNull() & F.col("source_msg_id").isNotNull())
    rows = rows.filter(F.length(F.trim(F.concat_ws("", "title", "body"))) > 0).drop("bad_line")
    exact = known_addresses.groupBy("address_text").agg(F.min("id").alias("exact_id"))
    cities = known_addresses.groupBy(F.col("city").alias("c")).agg(F.min("id").alias("city_id"))
    found = rows.join(exact, "address_text", "left").join(cities, F.col("city") == F.col("c"), "left")
    address = F.coalesce("exact_id", F.when(F.col("street").isNull(), F.col("city_id")))
    return absent(found.withColumn("address_id", address).drop("exact_id", "city_id", "c"), existing, ["source", "source_msg_id"])


def dump_events(events: DataFrame, known_addresses: DataFrame, path: str, last: int) -> None:
    """SK7: the last events by id, written in ascending order with their address's columns."""
    a = known_addresses.select(F.col("id").alias("address_id"), "address_text", "city", "street")
    newest = events.orderBy(F.desc("id")).limit(last)
    newest.join(a, "address_id", "left").orderBy("id").write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC11: the columns of the file's header that the schema has, null where the file says \\N."""
    wanted = spark.createDataFrame([], schema).schema
    raw = spark.read.option("header", True).option("nullValue", "\\N").csv(path)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted if f.name in raw.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """SC11: compressed CSV with a header and \\N for null."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "\\N").option("compression", "gzip").csv(path)


def manifest(df: DataFrame, key: str) -> DataFrame:
    """SK8: the number of rows, how many have each column, and a digest that does not depend on the rows' order."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    counts = [F.count(c).alias(f"with_{c}") for c in df.columns if c != key]
    return df.agg(F.count("*").alias("rows"), *counts, F.sha2(F.sum(row.cast("decimal(38,0)")).cast("string").cast("binary"), 256).alias("digest"))


def seed_if_empty(target: DataFrame, rows: DataFrame) -> DataFrame:
    """SK6: the rows, if the target has none."""
    return rows if target.isEmpty() else rows.limit(0)


def osm_addresses(elements: DataFrame) -> DataFrame:
    """SC13: map elements (type, id, lat, lon, center, tags) with a street and house to address rows."""
    t = lambda k: F.try_element_at("tags", F.lit(k))
    rows = elements.select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("source_key"),
        F.coalesce("lat", "center.lat").alias("lat"),
        F.coalesce("lon", "center.lon").alias("lon"),
        F.coalesce(t("addr:city"), F.lit("Москва")).alias("city"),
        t("addr:street").alias("street"),
        t("addr:housenumber").alias("house"),
        F.when(t("addr:postcode").rlike("^[0-9]{6}$"), t("addr:postcode")).alias("postal_code"),
    ).filter("street IS NOT NULL AND house IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    return rows.withColumn("address_text", F.concat_ws(", ", "city", "street", F.concat(F.lit("д. "), F.col("house"))))


def load_order(references: dict[str, list[str]]) -> list[str]:
    """Tables in an order in which each comes after those that it refers to; a circle is an error."""
    from graphlib import TopologicalSorter

    return list(TopologicalSorter(references).static_order())


def load_tables(spark: SparkSession, path: str, schemas: dict[str, str], references: dict[str, list[str]], current: dict[str, DataFrame], forced: bool = False) -> Iterator[tuple[str, DataFrame]]:
    """X38, SC11: the dumped tables that are to be loaded, in ``load_order``; those that have rows already only if ``forced``."""
    for name in load_order(references):
        if name in schemas and (forced or name not in current or current[name].isEmpty()):
            yield name, read_csv(spark, f"{path}/{name}.csv.gz", schemas[name])


def missing_columns(df: DataFrame, manifest_row: dict) -> list[str]:
    """Columns that a dump's manifest counts and its file lacks."""
    return sorted(c.removeprefix("with_") for c in manifest_row if c.startswith("with_") and c.removeprefix("with_") not in df.columns)
