"""Labelling and assembling training sets: ordered rules, sources in order of trust, balance, splits, templates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rule(text: Column, rules: Sequence[tuple[str, str, int, bool, float]], default: tuple[int, bool, float], short: int = 12) -> Column:
    """Importance, disaster flag, confidence and reason of the first rule (reason, pattern, ...) that matches.

    Texts under ``short`` characters are skipped: their reason is too_short.
    """
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))

    def verdict(level: int, disaster: bool, sure: float, reason: str) -> Column:
        return F.struct(F.lit(level).alias("importance"), F.lit(disaster).alias("disaster_flag"), F.lit(float(sure)).alias("confidence"), F.lit(reason).alias("reason"))

    out = F.when(F.length(t) < short, verdict(3, False, 0.0, "too_short"))
    for reason, pattern, level, disaster, sure in rules:
        out = out.when(F.lower(t).rlike(pattern), verdict(level, disaster, sure, reason))
    return out.otherwise(verdict(*default, "default_info"))


def merged(sources: Sequence[DataFrame], text: str) -> DataFrame:
    """Rows of all sources, of equal texts (lower-cased, trimmed) the one of the earliest source."""
    tagged = [s.withColumn("cf_rank", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for s in tagged[1:]:
        both = both.unionByName(s)
    w = Window.partitionBy(F.lower(F.trim(text))).orderBy("cf_rank", text)
    return both.withColumn("cf_n", F.row_number().over(w)).filter("cf_n = 1").drop("cf_n", "cf_rank")


def split(df: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    """``df`` with part, "train" or "valid" by a seeded hash of the key, the same on every run."""
    at = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("long")
    return df.withColumn("part", F.when(at < int(share * 2**32), "valid").otherwise("train"))


def negatives(df: DataFrame, positive: Column, key: str, per_positive: float, seed: int = 1) -> DataFrame:
    """All positives, and negatives up to a ratio of them, chosen by a seeded hash.

    The share to keep is known from two counts, so rows are kept one by one and none are sorted; the ratio holds
    up to chance.
    """
    counts = df.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).first()
    share = min(1.0, per_positive * counts.p / counts.n) if counts.n else 0.0
    at = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("long")
    return df.filter(positive | (at < int(share * 2**32)))


def expand(templates: DataFrame, places: DataFrame, prefixes: Sequence[str] = ("",), seed: int = 1) -> DataFrame:
    """Every template (template_id, template with {place}) with every place, behind a seeded prefix."""
    both = templates.join(F.broadcast(places))  # both are lists written by hand
    pick = F.pmod(F.xxhash64(F.lit(seed), "template_id", "place"), F.lit(len(prefixes)))
    text = F.concat(F.element_at(F.array(*[F.lit(p) for p in prefixes]), (pick + 1).cast("int")), F.replace("template", F.lit("{place}"), F.col("place")))
    return both.select("template_id", "place", text.alias("text"))


def offsets(ref: Column, start: Column, end: Column, most_hours: int = 720) -> Column:
    """The hours from a reference to both ends of a window, null where too far to be true."""
    hours = lambda c: (F.unix_seconds(c.cast("timestamp")) - F.unix_seconds(ref.cast("timestamp"))) / 3600
    ok = lambda h: F.when(F.abs(h) <= most_hours, h)
    return F.struct(ok(hours(start)).alias("from_h"), ok(hours(end)).alias("to_h"))


def bounds(ref: Column, from_h: Column, to_h: Column) -> Column:
    """The window that two offsets in hours give, its ends in order."""
    at = lambda h: (ref.cast("timestamp") + F.make_dt_interval(secs=h * 3600)).cast("timestamp_ntz")
    a, b = at(from_h), at(to_h)
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, F.least(a, b)).otherwise(a).alias("active_from"), F.when(both, F.greatest(a, b)).otherwise(b).alias("active_to"))


def prefix_groups(values: DataFrame, name: str, longest: int = 4, groups: tuple[int, int] = (2, 12), largest: int = 72) -> DataFrame:
    """The groups by the shortest prefix length that gives a fit number of groups of a fit size."""
    bare = F.upper(F.regexp_replace(F.col(name), r"[^\p{L}\p{N}]", ""))
    rows = values.select(F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("length"), bare.alias("v"))
    by = rows.groupBy("length", F.expr("left(v, length)").alias("prefix")).agg(F.count("*").alias("n"))
    fit = by.groupBy("length").agg(F.count("*").alias("g"), F.max("n").alias("m")).filter(F.col("g").between(*groups) & (F.col("m") <= largest))
    return by.join(F.broadcast(fit.agg(F.min("length").alias("length")).filter("length IS NOT NULL")), "length").select("prefix", "n")


def capped_classes(df: DataFrame, label: str, trust: str, key: str, most: int, seed: int = 7) -> DataFrame:
    """At most ``most`` rows of each class, of the sources that are trusted first, by a seeded hash within a source; ``n`` is their place.

    A source's rows of a class are in 4,096 slices by the head of their hash. Counts of slices say which of them a class's
    places begin in; only these slices' rows are numbered, each slice on its own.
    """
    slot = ("cf_label", "cf_trust", "cf_slice")
    hashed = df.withColumn("cf_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    rows = hashed.withColumns({"cf_label": F.col(label), "cf_trust": F.col(trust), "cf_slice": F.left("cf_hash", F.lit(3))})
    before = Window.partitionBy("cf_label").orderBy("cf_trust", "cf_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*slot).count().withColumn("cf_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    sizes = sizes.filter(F.col("cf_before") < most).select("cf_before", *[F.col(c).alias(f"{c}_") for c in slot])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in slot]
    within = F.row_number().over(Window.partitionBy(*slot).orderBy("cf_hash"))
    placed = rows.join(sizes, same[0] & same[1] & same[2]).withColumn("n", (F.col("cf_before") + within).cast("long"))
    return placed.filter(F.col("n") <= most).drop("cf_hash", "cf_before", *slot, *[f"{c}_" for c in slot])


def training_set(sources: Sequence[tuple[str, DataFrame]], decide: Callable[[Column], Column], most: int, share: float, least: float = 0.5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """A training set from texts of several sources, the most trusted first, and its report.

    Each text (column ``text``) is decided (importance, disaster_flag, confidence, reason); decisions under ``least``
    are left out. Of equal texts the first source's counts; each class gets at most ``most`` texts, exactly so many if it has
    them; a seeded hash parts them into train and valid. Rows: text, source, importance, disaster_flag, reason, part. The report
    (outcome, source, importance, part, n) has what was taken, was over its class's quota (capped) or was skipped, by reason.
    """
    tagged = [df.select("text", F.lit(name).alias("source"), F.lit(i).alias("cf_rank")) for i, (name, df) in enumerate(sources)]
    both = tagged[0]
    for more in tagged[1:]:
        both = both.unionByName(more)
    decided = both.filter(F.col("text").isNotNull()).withColumn("d", decide(F.col("text"))).select("text", "source", "cf_rank", "d.*")
    sure = F.col("confidence") >= least
    words = F.lower(F.trim("text")).alias("cf_key")
    first = decided.filter(sure).groupBy(words).agg(F.min_by(F.struct("text", "source", "cf_rank", "importance", "disaster_flag", "reason"), F.struct("cf_rank", "text")).alias("x")).select("x.*")
    kept = split(capped_classes(first, "importance", "cf_rank", "text", most, seed), "text", share, seed)
    rows = kept.select("text", "source", "importance", "disaster_flag", "reason", "part")
    taken = kept.groupBy("source", "importance", "part").count().select(F.lit("taken").alias("outcome"), "source", "importance", "part", F.col("count").alias("n"))
    had = first.groupBy("source", "importance").agg(F.count("*").alias("had")).join(kept.groupBy("source", "importance").agg(F.count("*").alias("got")), ["source", "importance"], "left")
    over = had.withColumn("n", F.col("had") - F.coalesce("got", F.lit(0))).filter("n > 0").select(F.lit("capped").alias("outcome"), "source", "importance", F.lit("").alias("part"), "n")
    skipped = decided.filter(~sure).groupBy("source", "reason").agg(F.count("*").alias("n"))
    skipped = skipped.select(F.concat(F.lit("skipped:"), "reason").alias("outcome"), "source", F.lit(0).alias("importance"), F.lit("").alias("part"), "n")
    return rows, taken.unionByName(over).unionByName(skipped)


def bound_counts(df: DataFrame, start: str = "active_from", end: str = "active_to") -> DataFrame:
    """How many windows have both ends, one of them, or none."""
    a, b = F.col(start).isNotNull(), F.col(end).isNotNull()
    return df.agg(F.count_if(a & b).alias("both_ends"), F.count_if(a & ~b).alias("only_from"), F.count_if(~a & b).alias("only_to"), F.count_if(~a & ~b).alias("neither"))
