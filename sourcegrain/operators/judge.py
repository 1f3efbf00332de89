"""Claims against passages: evidence, recorded judgements, and their statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import sets
from sourcegrain.operators import retrieval

# Fixed values.
LABELS = ("SUPPORT", "PARTIAL", "CONTRADICT", "NOT_FOUND")
SURE, UNSURE = 0.85, 0.3


def judge(claims: DataFrame, replies: DataFrame) -> DataFrame:
    """claims (claim_id, claim, n_passages) with recorded replies (claim_id, reply: JSON with `label` and
    `reason`). status is JUDGED with a verdict, or says why there is none; then the verdict is null."""
    x = claims.join(replies, "claim_id", "left")
    body = F.try_parse_json("reply")
    label = F.upper(F.trim(F.try_variant_get(body, "$.label", "string")))
    status = (
        F.when(F.trim(F.coalesce("claim", F.lit(""))) == "", "EMPTY_CLAIM").when(F.coalesce("n_passages", F.lit(0)) == 0, "NO_PASSAGES")
        .when(F.col("reply").isNull(), "CALL_FAILED").when(body.isNull(), "INVALID_REPLY").when(label.isNull() | ~label.isin(*LABELS), "INVALID_LABEL").otherwise("JUDGED"))
    out = x.select("claim_id", status.alias("status"), label.alias("_l"), F.try_variant_get(body, "$.reason", "string").alias("reason"))
    ok = F.col("status") == "JUDGED"
    return out.select("claim_id", "status", F.when(ok, F.col("_l")).alias("verdict"), F.when(ok, F.when(F.col("_l") == "NOT_FOUND", UNSURE).otherwise(SURE)).alias("confidence"), F.when(ok, F.col("reason")).alias("reason"))


def broken(results: DataFrame) -> DataFrame:
    """Rows that break the rule that a verdict stands just where a judgement was made."""
    return results.where((F.col("status") == "JUDGED") != F.col("verdict").isNotNull())


def lexical_evidence(claims: DataFrame, passages: DataFrame, paper: str, k: int = 3) -> DataFrame:
    """The k passages of the claim's paper that hold most of the claim's tokens, with the verdict that
    the best of them gives. claims: paper, claim_id, claim; passages: paper, passage_id, content."""
    token = lambda c: sets.token_set(F.col(c), shortest=3)
    pairs = claims.withColumn("_a", token("claim")).join(passages.withColumn("_b", token("content")), paper)
    scored = pairs.select("claim_id", "passage_id", sets.share_of_first(F.col("_a"), F.col("_b")).alias("score"))
    top = retrieval.top_k(scored, "claim_id", "passage_id", "score", k)
    label, sure = retrieval.lexical_verdict(F.max("score").over(Window.partitionBy("claim_id")))
    return top.select("claim_id", "passage_id", "rank", "score", label.alias("verdict"), sure.alias("confidence"))


def sentences_of(evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """Second stage: the sentences (over three words) of the retrieved passages, to be embedded and
    ranked; the passage itself where it has none."""
    parts = F.filter(F.split("content", r"\. "), lambda s: F.size(F.split(F.trim(s), r"\s+")) > 3)
    x = evidence.join(passages.select("passage_id", "content"), "passage_id").withColumn("_p", parts)
    return x.select("claim_id", "passage_id", F.posexplode(F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.array("content"))).alias("sentence_no", "sentence"))


def lookup_status(marker_ok: Column, n_numbers: Column, has_list: Column, in_list: Column, has_bibliography: Column, n_entries: Column, has_pdf: Column) -> Column:
    """Precedence of the reasons for which a citation can't be compared."""
    return (
        F.when(~marker_ok, "UNSUPPORTED_MARKER").when(n_numbers > 1, "MULTIPLE_REFERENCES").when((n_numbers == 1) & ~has_list, "REFERENCES_UNAVAILABLE")
        .when((n_numbers == 1) & ~in_list, "NUMBER_NOT_IN_LIST").when(~has_bibliography, "NO_BIBLIOGRAPHY").when(n_entries > 1, "AMBIGUOUS").when(n_entries == 0, "NOT_FOUND")
        .when(~has_pdf, "NO_PDF").otherwise("COMPARED"))
