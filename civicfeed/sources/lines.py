"""Strict readers of line files: every error with its file and line, and a verdict on each whole file before anything is loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.records import checked


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, compressed or not, numbered from 1 in each file.

    A file may be many splits. Lines keep their order in a split, so a line's number is what it is in its split plus the
    lines of the splits before it; only a count for each split is gathered, and no line is moved.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    rows = raw.withColumn("at", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(splits, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def strict_json(spark: SparkSession, path: str, schema: str, rules: dict[str, Column], skip_blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """SC3, X34: typed rows (with file and line) of the files without an error, and the errors: file, line, error.

    Each line must be a JSON object of the schema that passes the rules; the first that it breaks is its error. One bad line
    rejects its file, as does a file without a row (line 0). Blank lines are errors unless ``skip_blank``.
    """
    lines = numbered_lines(spark, path)
    if skip_blank:
        lines = lines.filter(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, bad_line string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}))
    # the hash reads all fields: fields that no later column needs would else not be parsed, nor found to be of a wrong type
    is_object = F.col("read").isNotNull() & F.col("bad_line").isNull() & F.trim("value").startswith("{")
    rows = parsed.select("file", "line", "value", F.hash("row").alias("read"), "row.*")
    good, bad = checked(rows, {"not a JSON object of the schema": is_object, **rules})
    errors = bad.select("file", "line", "error")
    files = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string")  # the index of files is the driver's
    plain = F.regexp_replace("file", "^([a-z0-9]+:)/+", "$1/").alias("plain")  # the index and the rows write local paths with other slashes
    absent = files.select("file", plain).join(lines.select(plain).distinct(), "plain", "left_anti")
    empty = absent.select("file", F.lit(0).cast("long").alias("line"), F.lit("no rows").alias("error"))
    errors = errors.unionByName(empty)
    return good.drop("value", "bad_line", "read").join(errors.select("file").distinct(), "file", "left_anti"), errors


ADDRESS_LINE = "address_text string, latitude string, longitude string, postal_code string, is_private boolean, city string, district string, street string, house string"
#: The longest texts of an address's parts.
LONGEST = {"city": 128, "district": 256, "street": 512, "house": 64}


def address_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC3: addresses of the files that pass as a whole, each once, their parts completed from their texts; and the errors.

    Rows of a file that share a text must be equal, else the later ones of them are errors.
    """
    number = lambda c, most: F.abs(F.expr(f"try_cast({c} AS decimal(20,10))")) <= most
    rules = {
        "address_text": F.length(F.trim("address_text")).between(1, 1000),
        "latitude": number("latitude", 90),
        "longitude": number("longitude", 180),
        "postal_code": F.col("postal_code").isNull() | F.col("postal_code").rlike("^[0-9]{6}$"),
        **{c: F.col(c).isNull() | (F.length(F.trim(c)) <= n) for c, n in LONGEST.items()},
    }
    rows, errors = strict_json(spark, path, ADDRESS_LINE, rules)
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    rows = rows.withColumns({"address_text": F.trim("address_text"), **{c: part(c) for c in LONGEST}, **{c: F.col(c).cast("decimal(20,10)") for c in ("latitude", "longitude")}})
    rows = rows.withColumn("p", T.parse_address(F.col("address_text")))
    rows = rows.withColumn("city", F.coalesce(T.city_label(F.col("city")), T.city_label(F.col("p.city"))))
    rows = rows.withColumn("district", T.district_label(F.coalesce("district", "p.district"), F.col("city")))
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.col(f"p.{c}")) for c in ("street", "house")}).drop("p")
    values = [c for c in rows.columns if c not in ("file", "line", "address_text")]
    first = rows.groupBy("file", "address_text").agg(F.min_by(F.struct(*values), "line").alias("kept"))
    against = rows.join(first, ["file", "address_text"])
    clash = against.filter(~F.struct(*values).eqNullSafe(F.col("kept"))).select("file", "line", F.lit("other data for the same address_text").alias("error"))
    errors = errors.unionByName(clash)
    kept = first.join(errors.select("file").distinct(), "file", "left_anti").select("file", "address_text", "kept.*")
    return kept, errors


TIME_LINE = "text string, reference string, active_from string, active_to string, source string"


def time_examples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Examples of time windows of the files that pass as a whole, and the errors. Blank lines do not count."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    time = lambda c: F.expr(f"try_cast(trim({c}) AS timestamp)")
    rules = {
        "text": ~blank("text"),
        "reference": time("reference").isNotNull(),
        "active_from": blank("active_from") | time("active_from").isNotNull(),
        "active_to": blank("active_to") | time("active_to").isNotNull(),
        "active_from after active_to": blank("active_from") | blank("active_to") | (time("active_from") <= time("active_to")),
    }
    rows, errors = strict_json(spark, path, TIME_LINE, rules, skip_blank=True)
    return rows.select("file", "line", F.trim("text").alias("text"), *[time(c).alias(c) for c in ("reference", "active_from", "active_to")], "source"), errors


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SK8: (name, bytes, sha256) of each file, digested by executors; a file is read whole by a task, Spark's limit is 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def combined_digest(manifest: DataFrame) -> DataFrame:
    """SK8: the number of files, their bytes, and one SHA-256 over ``name sha256`` lines in the order of names."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda f: F.concat_ws(" ", f["name"], f["sha256"]))
    return manifest.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("digest"))
