"""Scores of outcomes. Ratios over nothing are null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(df: DataFrame, expected: str, predicted: str, classes: list) -> DataFrame:
    """One row for each expected class, one column n_<class> for each predicted class."""
    out = df.where(F.col(expected).isNotNull() & F.col(predicted).isNotNull()).groupBy(expected)
    return out.agg(*[F.count_if(F.col(predicted) == c).alias(f"n_{c}") for c in classes])


def class_scores(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """support, precision, recall and f1 for each class that occurs on either side."""
    pairs = df.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select("n", "e", "p", F.explode(F.array_distinct(F.array("e", "p"))).alias("class")).where("class is not null")
    c = F.col("class")
    out = sides.groupBy("class").agg(
        F.sum(F.when((F.col("e") == c) & (F.col("p") == c), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("e") == c, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("p") == c, F.col("n")).otherwise(0)).alias("said"))
    p, r = ratio(F.col("hits"), F.col("said")), ratio(F.col("hits"), F.col("support"))
    return out.select("class", "support", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed agreement, agreement by chance, and Cohen's kappa (null where chance is 1)."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = pairs.select("n", F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col("a").cast("string").alias("v")), F.struct(F.lit("b").alias("side"), F.col("b").cast("string").alias("v")))))
    margins = sides.groupBy("v").agg(F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0)).alias("y"))
    chance = margins.agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    both = total.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k")
    po, pe = ratio(F.col("same"), F.col("n")), F.try_divide(F.col("xy"), F.col("n").cast("double") * F.col("n"))
    return both.select("n", po.alias("observed"), pe.alias("chance"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def sweep(df: DataFrame, case: str, score: str, passed: Column, values: list[float]) -> DataFrame:
    """Re-scores every case at each value of `threshold` (which `passed` may name) and counts, at each
    value, the cases that pass and those whose outcome differs from the value before."""
    at = df.select(case, score, F.posexplode(F.array(*[F.lit(v) for v in values])).alias("step", "threshold")).withColumn("passed", passed)
    before = F.lag("passed").over(Window.partitionBy(case).orderBy("step"))
    flips = at.withColumn("flip", F.coalesce(F.col("passed") != before, F.lit(False)))
    return flips.groupBy("step", "threshold").agg(F.count_if("passed").alias("n_passed"), F.count_if("flip").alias("n_flips"), F.count("*").alias("n_cases"))


def timing(df: DataFrame, value: str, sets: list[list[str]]) -> DataFrame:
    """n, min, median, p95 (nearest rank) and max under each grouping set."""
    cols = [c for c in dict.fromkeys(c for s in sets for c in s)]
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by `{value}`)")
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max(value).alias("most"))


def slopes(df: DataFrame, order: str, x: str, y: str) -> DataFrame:
    """Change of y over change of x between neighbouring rows; few rows, one for each size."""
    w = Window.orderBy(order)
    return df.withColumn("slope", F.try_divide(F.lead(y).over(w) - F.col(y), F.lead(x).over(w) - F.col(x))).where("slope is not null")


def bar(value: Column, good: float, least: float | None = None) -> Column:
    """met, below, no-go (under the least bar), or n/a where nothing was measured."""
    out = F.when(value.isNull(), "n/a").when(value >= good, "met")
    return (out.when(value < least, "no-go") if least is not None else out).otherwise("below")
