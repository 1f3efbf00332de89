"""Exact top-k retrieval by inner product, and the lexical path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Claims of a broadcast block: with 384 floats each, about 6 MB.
BLOCK = 4096


def is_prose(text: Column, words: int = 4) -> Column:
    """At least so many words of three letters or more."""
    return F.size(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0))) >= words


def prose_or_all(passages: DataFrame, paper: str, text: str) -> DataFrame:
    """The prose passages of each paper; all of them where none is prose."""
    flag = passages.withColumn("_p", is_prose(F.col(text)))
    some = F.max("_p").over(Window.partitionBy(paper))
    return flag.withColumn("_any", some).where("_p or not _any").drop("_p", "_any")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def top_k(pairs: DataFrame, claim: str, passage: str, score: str, k: int) -> DataFrame:
    """The k best passages of each claim, with `rank` from 1; ties go to the lesser passage."""
    w = Window.partitionBy(claim).orderBy(F.desc(score), F.asc(passage))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_in_paper(claims: DataFrame, passages: DataFrame, paper: str, k: int) -> DataFrame:
    """claims (paper, claim_id, claim_vec) against passages (paper, passage_id, passage_vec)."""
    scored = claims.join(passages, paper).select("claim_id", "passage_id", F.round(dot(F.col("claim_vec"), F.col("passage_vec")), 9).alias("score"))
    return top_k(scored, "claim_id", "passage_id", "score", k)


def top_k_everywhere(claims: DataFrame, passages: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """claims (claim_id, claim_vec), a stated query set, against all passages. Claims go out in blocks
    of bounded size; each task keeps its own k best of a claim, so what is shuffled is k rows for
    each claim and task, whatever the number of passages."""
    spark, out, part = claims.sparkSession, None, []

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            best_s, best_p = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
            for batch in batches:
                p = batch.column("passage_id").to_numpy()
                x = np.array(batch.column("passage_vec").to_pylist(), np.float64).reshape(len(p), -1)
                if not len(p):
                    continue
                best_s = np.concatenate((best_s, np.round(vectors @ x.T, 9)), 1)
                best_p = np.concatenate((best_p, np.broadcast_to(p, (len(ids), len(p)))), 1)
                order = np.lexsort((best_p, -best_s), axis=1)[:, :k]
                best_s, best_p = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_p, order, 1)
            n = best_s.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_p.ravel()), pa.array(best_s.ravel())], names=["claim_id", "passage_id", "score"])

        return passages.mapInArrow(run, "claim_id long, passage_id long, score double")

    for r in claims.select("claim_id", "claim_vec").toLocalIterator():
        part.append((r[0], list(r[1])))
        if len(part) == block:
            out, part = (search(part) if out is None else out.union(search(part))), []
    if part or out is None:
        found = search(part) if part else claims.limit(0).selectExpr("claim_id", "claim_id passage_id", "0D score")
        out = found if out is None else out.union(found)
    return top_k(out, "claim_id", "passage_id", "score", k)


def lexical_verdict(score: Column) -> tuple[Column, Column]:
    """Label and confidence of the best lexical score: support from 0.2 on."""
    supported = score >= 0.2
    return F.when(supported, "SUPPORT").otherwise("NOT_FOUND"), F.when(supported, F.least(F.lit(0.95), 0.55 + score)).otherwise(F.lit(0.2))
