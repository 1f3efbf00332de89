"""Joins that resolve one record to another, with uniqueness, precedence and margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_prefix(wanted: DataFrame, known: DataFrame, key: str, name: str, length: int) -> DataFrame:
    """wanted.key resolved to known.name: the exact name, else the only name it is a prefix of. Keys
    have `length` characters at least, so the join is an equi-join on the first `length`."""
    head = lambda c: F.substring(c, 1, length)
    pairs = wanted.withColumn("_h", head(F.col(key))).join(known.select(F.col(name).alias("_name"), head(F.col(name)).alias("_h")).distinct(), "_h")
    pairs = pairs.where(F.startswith("_name", F.col(key)))
    best = pairs.groupBy(key).agg(F.max(F.when(F.col("_name") == F.col(key), F.col("_name"))).alias("exact"), F.count("*").alias("n"), F.min("_name").alias("any"))
    resolved = F.coalesce("exact", F.when(F.col("n") == 1, F.col("any")))
    return wanted.join(best, key, "left").select(*wanted.columns, F.coalesce("n", F.lit(0)).alias("n_candidates"), resolved.alias("resolved"))


def best_with_margin(pairs: DataFrame, key: str, other: str, score: str, least: float, margin: float) -> DataFrame:
    """The best-scoring partner of each key, if it reaches `least` and leads the next by `margin`."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(other))
    ranked = pairs.where(F.col(score) >= least).withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    return ranked.where((F.col("_r") == 1) & (F.col("_next").isNull() | (F.round(F.col(score) - F.col("_next"), 6) >= margin))).drop("_r", "_next")


def exact_then_folded(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with right's columns by equal key, else by right's key equal to the lower-cased one."""
    fields = [c for c in right.columns if c != key]
    packed = right.select(key, F.struct(*fields).alias("_r"))
    a = left.join(packed.withColumnRenamed("_r", "_exact"), key, "left")
    b = a.join(packed.select(F.col(key).alias("_k"), F.col("_r").alias("_folded")), F.lower(F.col(key)) == F.col("_k"), "left")
    hit = F.coalesce("_exact", "_folded")
    return b.withColumn("_hit", hit).select(*left.columns, "_hit.*", F.col("_hit").isNotNull().alias("matched"))


def all_known(members: DataFrame, group: str, member: str, known: DataFrame) -> DataFrame:
    """Groups every member of which is known (relational division)."""
    flags = members.join(known.select(F.col(member), F.lit(True).alias("_known")).distinct(), member, "left")
    return flags.groupBy(group).agg(F.count("*").alias("n_members"), F.every(F.col("_known").isNotNull()).alias("ok")).where("ok").drop("ok")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], bin_width: int) -> DataFrame:
    """Pairs of spans a (start_a, end_a) and b (start_b, end_b) of one key that share a position. Each
    span is put into the bins it touches; a pair counts in the bin of its first shared position."""

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width))
        return df.where(F.col(s) < F.col(e)).withColumn("_bin", F.explode(bins))

    pairs = binned(a, "start_a", "end_a").join(binned(b, "start_b", "end_b"), [*keys, "_bin"])
    first = F.greatest("start_a", "start_b")
    return pairs.where((first < F.least("end_a", "end_b")) & (F.floor(first / bin_width) == F.col("_bin"))).drop("_bin")


def same_work(nodes: DataFrame, group: str, node: str, relations: list[Column], rounds: int = 64) -> DataFrame:
    """Components of the records of each group under the union of equalities; a null key relates
    nothing. Labels pass through the shared keys until none changes."""
    from sourcegrain.operators.components import label

    edges = None
    for k, key in enumerate(relations):
        keyed = nodes.select(F.col(group).alias("g"), F.col(node).alias("n"), key.alias("key")).where("key is not null")
        first = keyed.groupBy("g", "key").agg(F.min("n").alias("m"))
        some = keyed.join(first, ["g", "key"]).where("n <> m").select("g", "n", "m")
        edges = some if edges is None else edges.union(some)
    return label(nodes.select(F.col(group).alias("g"), F.col(node).alias("n")), edges.distinct(), rounds).toDF(group, node, "work")
