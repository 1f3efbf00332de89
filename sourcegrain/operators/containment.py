"""Which texts contain which passages, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(texts: DataFrame, needles: DataFrame, item: str, doc: str) -> DataFrame:
    """(item, doc) where the needle stands in the text. Blank-separated words inside a needle (all but
    its first and last, which may be cut) are whole words of the text too, so needles and texts meet in
    an equi-join on up to three of them; the whole needle is then tested. Needles without a word inside
    are tested text by text, in blocks of a thousand."""
    inner = F.filter(F.split("needle", " "), lambda w, i: i > 0)
    inner = F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0)))
    sized = needles.select(item, "needle", F.slice(inner, 1, 3).alias("a")).withColumn("n", F.size("a")).withColumn("anchor", F.concat_ws(" ", "a")).drop("a")
    words = texts.select(doc, F.split("text", " ").alias("w"))
    hits = None
    for n in sorted(r["n"] for r in sized.select("n").distinct().collect()):
        mine = sized.where(F.col("n") == n)
        if n == 0:
            rows = [(r[item], r["needle"]) for r in mine.toLocalIterator()]
            for i in range(0, len(rows), 1000):
                block = F.array(*[F.struct(F.lit(k).alias(item), F.lit(s).alias("needle")) for k, s in rows[i : i + 1000]])
                some = texts.select(doc, F.inline(F.filter(block, lambda x: F.contains(F.col("text"), x["needle"])))).select(item, doc)
                hits = some if hits is None else hits.union(some)
            continue
        last = F.size("w") - n
        grams = _grams("w", n)
        cut = words.where(last >= 0).select(doc, F.explode(F.array_distinct(grams)).alias("anchor"))
        some = cut.join(mine, "anchor").select(item, doc, "needle").distinct().join(texts, doc).where(F.contains("text", F.col("needle"))).select(item, doc)
        hits = some if hits is None else hits.union(some)
    return hits.distinct() if hits is not None else texts.join(needles, F.lit(False)).select(item, doc)


def _grams(words: str, n: int):
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
