"""The provider chain over recorded answers: providers are asked in order, records accumulate, and the
decision is taken again after each; the first that settles the reference ends its chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcegrain.operators import identity


def outcome(status: Column) -> Column:
    """What an HTTP status says of one request: 0 is a transport failure, 404 an empty answer."""
    return F.when(status.isNull() | (status == 0), "transport").when(status == 429, "rate_limited").when(status.isin(200, 404), "ok").otherwise(F.concat(F.lit("http_"), status.cast("string")))


def doi_filter(doi: Column) -> Column:
    """A DOI as a filter value; null where it holds a character that the filter syntax uses."""
    return F.when((doi != "") & ~F.rlike(doi, F.lit(r"[,?|!]")), doi)


def title_query(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(title, ",?|!", "    "), r"\s+", " "))


def chain(references: DataFrame, attempts: DataFrame, candidates: DataFrame, providers: list[str]) -> DataFrame:
    """attempts: ref_id, provider, status_code. Gives the deciding status, rule and record of each
    reference, and as outcome found, or ambiguous, or failed / rate_limited where the search was not
    complete, or not_found where it was."""
    decided = None
    for k in range(len(providers)):
        seen = identity.decide(references, candidates.where(F.col("provider").isin(providers[: k + 1]))).withColumn("step", F.lit(k))
        decided = seen if decided is None else decided.unionByName(seen)
    last = len(providers) - 1
    settled = F.when(F.col("status") == "found", F.col("step")).when(F.col("step") == last, F.lit(last + 1))
    picked = decided.groupBy("ref_id").agg(F.min_by(F.struct("status", "rule", "provider", "record_id", "contenders", "step"), settled).alias("d")).select("ref_id", "d.*")
    tried = attempts.join(picked.select("ref_id", "step"), "ref_id").where(F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider")) - 1 <= F.col("step"))
    bad = tried.withColumn("o", outcome(F.col("status_code"))).groupBy("ref_id").agg(F.count("*").alias("n"), F.count_if(F.col("o") == "rate_limited").alias("slow"), F.count_if(F.col("o") != "ok").alias("bad"))
    final = (
        F.when(F.col("status").isin("found", "ambiguous"), F.col("status")).when(F.coalesce("n", F.lit(0)) == 0, "failed")
        .when(F.col("slow") == F.col("n"), "rate_limited").when(F.col("bad") > 0, "failed").otherwise("not_found"))
    return picked.join(bad, "ref_id", "left").select("ref_id", final.alias("outcome"), "rule", "provider", "record_id", "contenders")


def replay(requests: DataFrame, pins: DataFrame) -> DataFrame:
    """Requests (url) answered from recorded responses; one that isn't recorded is a transport failure,
    never an empty answer."""
    return requests.join(pins, "url", "left").withColumn("status_code", F.coalesce("status_code", F.lit(0)))
