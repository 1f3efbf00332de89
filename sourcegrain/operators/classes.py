"""Pairs of records, judged once for each pair of classes of equal records: what is compared grows with
the distinct records, not with their copies. Null traits are a class of their own; rows without group or
node have no pairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.operators import windows

#: Members of a class that are expanded together.
BLOCK = 512


def _same(left: list[str], right: list[str]) -> Column:
    """Equal columns, null and null too."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def _kinds(rows: DataFrame, group: list[str], traits: list[str]) -> DataFrame:
    return rows.select(*group, *traits).dropna(subset=group).distinct()


def tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def expanded(rows: DataFrame, group: list[str], trait: str, node: str, facts: Callable[[Column, Column], dict[str, Column]], where: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """a_id, b_id and the facts of their traits for all pairs a_id < b_id of a group. Members come in
    sorted blocks, and pairs of blocks are dealt out, as a few bytes of them make many rows."""
    kinds = _kinds(rows, group, [trait])
    met = kinds.toDF(*group, "_a").join(kinds.toDF(*group, "_b"), group)
    a, b = F.col("_a"), F.col("_b")
    if where is not None:
        met = met.where(where(a, b))
    found = facts(a, b)
    met = met.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_a", "_b", *[c.alias(name) for name, c in found.items()])
    ids = rows.groupBy(*group, trait).agg(F.sort_array(F.collect_list(node)).alias("ids"))
    blocks = ids.where(F.size("ids") > 0).select(*group, trait, F.explode(F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(BLOCK)), lambda k: F.slice("ids", k, BLOCK))).alias("ids"))
    key = [f"_g{i}" for i in range(len(group))]
    for side in "ab":
        theirs = blocks.toDF(*[f"_{side}{g}" for g in key], f"_{side}_trait", f"_{side}_ids")
        on = reduce(lambda x, y: x & y, [F.col(g) == F.col(f"_{side}{g}") for g in key]) & F.col(f"_{side}").eqNullSafe(F.col(f"_{side}_trait"))
        met = met.join(theirs, on)
    met = met.where(F.get("_a_ids", F.lit(0)) < F.element_at("_b_ids", -1)).select("_a_ids", "_b_ids", *found).repartition(tasks(rows))
    one = met.select(F.explode("_a_ids").alias("a_id"), "_b_ids", *found)
    return one.select("a_id", F.explode("_b_ids").alias("b_id"), *found).where("a_id < b_id")


def best_partners(
    rows: DataFrame, group: str, traits: list[str], node: str, score: Callable[[dict, dict], Column], least: float, k: int = 1, meet: list[str] | None = None
) -> DataFrame:
    """a_id, b_id, score: for each node its k best partners (rows of the group with another node) of a
    score of `least` at least, and perhaps more; ties go to the lesser node. With `meet`, pairs that agree
    in none of these traits are known to score less.

    A row leaves out one node only, its own. So of each class the first k + 1 nodes will do, with k of
    their rows at most, and of all that a class meets again the first k + 1 nodes with their k best rows.
    Nodes that stand in one class are cut to these at once, others to their best rows. Equal rows count k
    times at most. Classes and their pairs are dealt out, and the rows meet what their class has found by
    a shuffle: small files would else be broadcast, and a few tasks do all the work."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.select(group, *traits, node).dropna(subset=[group, node])
    nodes = rows.groupBy(group, *traits, node).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("_n"))
    first = windows.first_of(nodes, [group, *traits], [F.asc(node)], k + 1).withColumn("_alone", F.count("*").over(Window.partitionBy(group, node)) == 1)
    kinds = first.groupBy(group, *traits).agg(F.collect_list(F.struct(F.col(node).alias("b_id"), "_n", "_alone")).alias("_first")).where(F.size("_first") > 0)
    left = kinds.select(group, *traits).toDF("_g", *[f"_a_{t}" for t in traits]).repartition(n)
    right = kinds.toDF("_h", *[f"_b_{t}" for t in traits], "_first").repartition(n)
    shared = [F.col(f"_a_{t}") == F.col(f"_b_{t}") for t in meet or []]
    met = None
    for i, equal in enumerate(shared or [F.lit(True)]):
        some = left.join(right, (F.col("_g") == F.col("_h")) & equal)
        for before in shared[:i]:
            some = some.where(~F.coalesce(before, F.lit(False)))
        met = some if met is None else met.union(some)
    sides = [{t: F.col(f"_{side}_{t}") for t in traits} for side in "ab"]
    kind = ["_g", *[f"_a_{t}" for t in traits]]
    met = met.withColumn("_score", score(*sides)).where(F.col("_score") >= least)
    met = met.repartition(n, *kind).select(*kind, "_score", F.inline("_first"))

    order = [F.desc("_score"), F.asc("b_id")]
    met = windows.first_of(met.withColumn("_own", F.when(~F.col("_alone"), F.col("b_id"))), [*kind, "_own"], order, k + 1)
    scores = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_score", "_n")), asc=False), lambda x: F.array_repeat(x["_score"], x["_n"])))
    seen = met.groupBy(*kind, "b_id").agg(F.slice(scores, 1, k).alias("_scores"))
    best = windows.first_of(seen, kind, [F.desc(F.get("_scores", F.lit(0))), F.asc("b_id")], k + 1)
    last = F.transform("_scores", lambda x: F.struct(F.nanvl(-x, F.lit(float("-inf"))).alias("place"), F.col("b_id"), x.alias("score")))  # not a number comes first
    best = best.groupBy(*kind).agg(F.sort_array(F.flatten(F.collect_list(last))).alias("_best"))

    out = nodes.join(best.hint("shuffle_hash"), (F.col(group) == F.col("_g")) & _same(traits, kind[1:]))
    partners = F.slice(F.filter("_best", lambda x: x["b_id"] != F.col(node)), 1, k)
    out = out.select(F.col(node).alias("a_id"), F.inline(F.flatten(F.array_repeat(partners, F.col("_n")))))
    return out.select("a_id", "b_id", "score")
