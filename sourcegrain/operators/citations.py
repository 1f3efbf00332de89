"""Citation markers and the claims that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import text

# The three kinds of citation marker, and headings.
LATEX = r"\\cite[a-zA-Z*]*(?:\s*\[[^\]]*\])?\s*\{[^{}]+\}"
_LIST = r"\s*\d+(?:\s*[-–—]\s*\d+)?(?:\s*[,;]\s*\d+(?:\s*[-–—]\s*\d+)?)*\s*"
NUMERIC = rf"(?<!\w)(?:\[{_LIST}\]|【{_LIST}】)"
AUTHOR_YEAR = r"\((?=[^()]{1,120}\b(?:19|20)\d{2}\b)(?=[^()]{1,120}[A-Za-z])[^()]{1,120}\)"
REFERENCES = r"(?i)^(?:references?|bibliography|参考文献)\s*$"
HEADING = r"(?i)^(?:\d+(?:\.\d+)*[.)]?\s+\S.*|(?:abstract|introduction|background|related work|method(?:ology)?|experiments?|results?|discussion|conclusion|limitations?|appendix)\b.*)$"
SHORTEST_TOKEN, LEAST_TOKENS = 3, 3


def markers(x: Column) -> Column:
    """Distinct markers in the order in which they stand. One alternation finds all three kinds from left
    to right, as the kinds can't begin at one place."""
    found = F.regexp_extract_all(x, F.lit(f"(?U)(?:{LATEX}|{NUMERIC}|{AUTHOR_YEAR})"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda m: text.collapse(m)), lambda m: m != ""))


def single_key(marker: Column) -> Column:
    """The key of a LaTeX marker that cites one source, else null."""
    keys = F.filter(F.transform(F.split(F.regexp_extract(marker, r"\{([^{}]+)\}", 1), ","), lambda k: F.trim(k)), lambda k: k != "")
    return F.when(F.size(keys) == 1, F.get(keys, F.lit(0)))


def numbers(marker: Column) -> Column:
    return F.when(F.rlike(marker, F.lit(r"^[\[【]")), text.expand_numbers(F.regexp_replace(marker, r"[\[\]【】]", ""))).otherwise(F.array().cast("array<int>"))


def is_heading(x: Column) -> Column:
    return (F.length(x) <= 140) & (F.rlike(x, F.lit(REFERENCES)) | F.rlike(x, F.lit(HEADING)))


def claims(paragraphs: DataFrame, paper: str) -> DataFrame:
    """paragraphs (paper, ord, content, page): one row for each sentence and marker before the reference
    heading, with at least three informative tokens; claim_id is a digest of where and what it is."""
    w = Window.partitionBy(paper).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    past = F.max(F.when(F.rlike(F.trim("content"), F.lit(REFERENCES)), 1).otherwise(0)).over(w)
    body = paragraphs.withColumn("_past", past).where((F.col("_past") == 0) & ~is_heading(F.trim("content")))
    s = body.select(paper, "ord", "page", F.posexplode(text.sentences(F.col("content"))).alias("sentence_no", "sentence"))
    s = s.withColumn("markers", markers(F.col("sentence"))).where(F.size("markers") > 0)
    plain = F.regexp_replace("sentence", f"(?U)(?:{LATEX}|{NUMERIC}|{AUTHOR_YEAR})", " ")
    tokens = F.filter(F.regexp_extract_all(F.lower(plain), F.lit(r"(?U)\w[\w'’\-]*"), F.lit(0)), lambda t: (F.length(t) >= SHORTEST_TOKEN) & ~t.isin(text.STOP_WORDS))
    out = s.where(F.size(F.array_distinct(tokens)) >= LEAST_TOKENS).select(paper, "ord", "page", "sentence_no", "sentence", F.posexplode("markers").alias("marker_no", "marker"))
    return out.withColumn("claim_id", F.concat(F.lit("claim-"), F.left(F.sha1(F.concat_ws("|", F.col(paper).cast("string"), F.col("ord").cast("string"), F.col("sentence_no").cast("string"), "marker", "sentence")), F.lit(16))))


def cite_numbers(claims_: DataFrame, references: DataFrame, paper: str) -> DataFrame:
    """Numeric markers joined to reference ids; a marker counts only if every number in it exists."""
    wide = claims_.select(paper, "claim_id", F.explode(numbers(F.col("marker"))).alias("reference_id"))
    met = wide.join(references.select(paper, "reference_id", F.lit(True).alias("_known")).distinct(), [paper, "reference_id"], "left")
    ok = met.groupBy(paper, "claim_id").agg(F.every(F.col("_known").isNotNull()).alias("ok")).where("ok")
    return wide.join(ok.drop("ok"), [paper, "claim_id"])
