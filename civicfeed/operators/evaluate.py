"""Evaluation of pair labels: confusion, F1, threshold grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ["duplicate", "update", "unrelated"]


def predicted(score: Column, duplicate: Column, update: Column) -> Column:
    """V6: a label by two thresholds."""
    return F.when(score >= duplicate, "duplicate").when(score >= update, "update").otherwise("unrelated")


def confusion(df: DataFrame, truth: str = "label", guess: str = "guess") -> DataFrame:
    """A10: one row for each true label, one column for each guess, zeros filled in."""
    spine = df.sparkSession.createDataFrame([(x,) for x in LABELS], f"{truth} string")
    counts = df.groupBy(truth).pivot(guess, LABELS).count()
    return spine.join(counts, truth, "left").na.fill(0)


def f1(df: DataFrame, keys: list[str], truth: str = "label", guess: str = "guess") -> DataFrame:
    """F1 of each label and their mean, for each value of the keys; 0 where nothing is right."""
    out = {}
    for x in LABELS:
        right = F.count_if((F.col(truth) == x) & (F.col(guess) == x))
        wrong = F.count_if((F.col(truth) == x) != (F.col(guess) == x))
        out[x] = F.when(right > 0, 2 * right / (2 * right + wrong)).otherwise(F.lit(0.0))
    scores = df.groupBy(*keys).agg(*[v.alias(f"f1_{x}") for x, v in out.items()])
    return scores.withColumn("macro_f1", (F.col("f1_duplicate") + F.col("f1_update") + F.col("f1_unrelated")) / 3)


def grid_search(df: DataFrame, duplicates: list[float], updates: list[float], truth: str = "label", score: str = "score") -> DataFrame:
    """The threshold pair (duplicate at least update) of best macro F1; the lowest pair among equals.

    Scores are counted between the thresholds first, so the grid meets a few counts and not the pairs.
    """
    spark = df.sparkSession
    cuts = sorted({*duplicates, *updates})
    step = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(score) >= c))
    counts = df.groupBy(truth, step.alias("step")).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(d, u, cuts.index(d), cuts.index(u)) for d in duplicates for u in updates if d >= u], "duplicate double, update double, d int, u int")
    tried = counts.join(F.broadcast(grid)).withColumn("guess", F.when(F.col("step") > F.col("d"), "duplicate").when(F.col("step") > F.col("u"), "update").otherwise("unrelated"))
    out = {}
    for x in LABELS:
        right = F.sum(F.when((F.col(truth) == x) & (F.col("guess") == x), F.col("n")).otherwise(0))
        wrong = F.sum(F.when((F.col(truth) == x) != (F.col("guess") == x), F.col("n")).otherwise(0))
        out[x] = F.when(right > 0, 2 * right / (2 * right + wrong)).otherwise(F.lit(0.0))
    scores = tried.groupBy("duplicate", "update").agg(((out["duplicate"] + out["update"] + out["unrelated"]) / 3).alias("macro_f1"))
    return scores.orderBy(F.desc(F.round("macro_f1", 12)), "duplicate", "update").limit(1)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """The number of rows over classes times a class's rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def mean_similarity(df: DataFrame, truth: str = "label", score: str = "score") -> DataFrame:
    """How many pairs each label has and how alike they are on average."""
    return df.groupBy(truth).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
