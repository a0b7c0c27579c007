"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

DataFrame functions only. Row-level work reads one small row a document; sums are taken by source and by slices
of a document hash, so that no source, however large, is sorted or summed in one task. Nor are the sources
themselves, which may be as many as hosts: sums along an order are taken in ranges of it, and over the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Sources up to which their table goes to all tasks by broadcast (about 10 MB).
BROADCAST_SOURCES = 100_000
#: Sources in a range of an order along which sums are taken.
RANGE_SOURCES = 100_000
#: Hexadecimal digits of the hash that name a slice of a source.
SLICE_DIGITS = 3


def sums_before(df: DataFrame, n: int, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` of n rows with, for each of ``sums``, that sum over the rows before in an order that has no ties.

    Rows are dealt into ranges, whose sums are added up in turn; a range has about RANGE_SOURCES rows.
    """
    ranges = -(-n // RANGE_SOURCES) or 1
    placed = materialize(df.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before, within = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.orderBy("part"), Window.partitionBy("part").orderBy(*order)))
    parts = placed.groupBy("part").agg(*[F.sum(c).alias(f"own_{name}") for name, c in sums.items()])
    zero = F.lit(0)
    parts = parts.select("part", *[F.coalesce(F.sum(f"own_{name}").over(before), zero).alias(f"base_{name}") for name in sums])
    run = placed.join(F.broadcast(parts), "part")
    columns = [(F.col(f"base_{name}") + F.coalesce(F.sum(c).over(within), zero)).alias(name) for name, c in sums.items()]
    return run.select(*df.columns, *columns)


def water_fill(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at
    ``cap`` times its source's size and the excess goes to the others by weight until none is above its cap. In
    order of cap over weight, the level at which all sources stand that are not capped is the largest of what
    the total less the caps before leaves to each unit of weight from there on.
    """
    sizes = materialize(sizes, "sources")
    all_ = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()
    ranked = sums_before(sizes, all_.n, [F.asc_nulls_last("source")], {"place": F.lit(1)})
    turn = (F.col("place") % len(weights) + 1).cast("int")
    named = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn))
    named = named.withColumn("cap", cap * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    filling = sums_before(named, all_.n, [F.col("fill").asc(), F.asc_nulls_last("source")], {"caps": F.col("cap"), "passed": F.col("weight")})
    filling = materialize(filling, "filling")
    weight = filling.agg(F.sum("weight")).first()[0]
    level = filling.agg(F.max((F.lit(all_.words) - F.col("caps")).cast("double") / (F.lit(weight) - F.col("passed")))).first()[0]
    target = F.least(F.lit(level).cast("double") * F.col("weight"), F.col("cap").cast("double"))
    return filling.withColumn("target", target).select("source", "source_size", "target")


def mix(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: int = 11,
) -> DataFrame:
    """``df`` with size, source_size, target and ``repeats``, how often the mix takes the row.

    size is the number of words (null text: 0). Each row is taken as often as its source's target holds the whole
    source, and once more if it is among the first by a seeded hash of its key that fill the rest of the target,
    to half a row's size. A null source is a source; null keys share a hash; rows with equal keys and sizes are
    taken alike; texts without words have size 0 and fill nothing. Reruns agree. An empty frame stays empty; input
    columns named like a result are replaced, all others are passed on whatever their names.
    """
    results = ("size", "source_size", "target", "repeats")
    # in here an input column goes by its place, so that no name clashes
    own = [f"in_{i}" for i in range(len(df.columns))]
    base, place_of = df.toDF(*own), dict(zip(map(str.lower, df.columns), own, strict=True))
    name = F.coalesce(F.col(place_of[key.lower()]).cast("string"), F.lit(""))
    place: dict[str, Column] = {
        "cf_source": F.col(place_of[source.lower()]),
        "cf_hash": F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")),
        "cf_key": name,
        "size": F.coalesce(F.regexp_count(F.col(place_of[text.lower()]), F.lit(WORD)), F.lit(0)).cast("long"),
    }
    small = materialize(base.select(*[c.alias(n) for n, c in place.items()]), "sizes")
    cut = F.substring("cf_hash", 1, SLICE_DIGITS)
    slices = materialize(small.groupBy("cf_source", cut.alias("slice")).agg(F.sum("size").alias("words")), "slices")
    sources = slices.groupBy(F.col("cf_source").alias("source")).agg(F.sum("words").alias("source_size"))
    filled = water_fill(sources, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    filled = filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    filled = materialize(filled, "targets")
    bounded = filled.count() <= BROADCAST_SOURCES

    def with_source(left: DataFrame, right: DataFrame, column: str = "cf_source") -> DataFrame:
        right = F.broadcast(right) if bounded else right
        return left.join(right, F.col(column).eqNullSafe(F.col("source")), "left").drop("source")

    # the slice in which each source's rest ends
    run = Window.partitionBy("cf_source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = with_source(slices, filled.select("source", "rest")).withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    ends = ends.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    ends = ends.select(F.col("cf_source").alias("source"), F.col("slice").alias("last_slice"), "before", "rest")
    # the last row taken within it: equal rows are taken together
    inside = with_source(small.withColumn("slice", cut), ends).filter(F.col("slice") == F.col("last_slice"))
    peers = inside.groupBy("cf_source", "before", "rest", "cf_hash", "cf_key", "size").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("cf_source").orderBy("cf_hash", "cf_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    taken = peers.withColumn("so_far", F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    taken = taken.filter(F.col("so_far") + F.col("words") / 2 <= F.col("rest"))
    last = taken.groupBy(F.col("cf_source").alias("source")).agg(F.max(F.struct("cf_hash", "cf_key", "size")).alias("last_row"))
    cuts = ends.select("source", "last_slice").withColumnRenamed("source", "s").join(last, F.col("s").eqNullSafe(F.col("source")), "left").drop("source")
    plan = filled.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = materialize(plan.select(F.col("source"), "source_size", "target", "whole", "last_slice", "last_row"), "plan")

    joined = with_source(base.withColumns(place), plan)
    row = F.struct("cf_hash", "cf_key", "size")
    early = F.substring("cf_hash", 1, SLICE_DIGITS) < F.col("last_slice")
    extra = F.coalesce(early | (row <= F.col("last_row")), F.lit(False)).cast("int")
    out = joined.withColumn("repeats", F.col("whole") + extra)
    kept = [F.col(n).alias(c) for c, n in zip(df.columns, own, strict=True) if c.lower() not in results]
    return out.select(*kept, "size", "source_size", "target", "repeats")
