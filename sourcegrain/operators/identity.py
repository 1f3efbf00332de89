"""Which publication record a reference denotes: structural rules, never a weighted score.

references: ref_id, title, authors array<string>, year, venue, doi, arxiv_id. candidates: ref_id, ord,
provider, record_id, title, authors, year, venue, kind, doi, arxiv_id, url, is_repository. Candidates
of one reference are few (providers answer ten at most), so a reference's candidates sit in one row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcegrain.functions import sets, text

# Fixed values.
YEAR_TOLERANCE, VENUE_SHARE, CONTENDERS = 1, 0.5, 3
NO_PUBLICATION = (
    "component", "database", "dataset", "erratum", "grant", "journal", "journal-issue", "paratext", "peer-review", "reference-entry",
    "retraction", "software", "supplementary-materials",
)


def _kind_ok(kind: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(kind, F.lit("")))).isin(*NO_PUBLICATION)


def judged_candidates(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each candidate with the facts that the decision uses: identifier hits, why it is ineligible (null
    if it isn't), exact title, shared title tokens, venue share, surname."""
    r = references.select(
        "ref_id", F.col("year").alias("q_year"), text.normalize_doi(F.col("doi")).alias("q_doi"), text.bare_arxiv(F.col("arxiv_id")).alias("q_arxiv"),
        text.normalize_title(F.col("title")).alias("q_title"), text.venue_tokens(text.normalize_venue(F.col("venue"))).alias("q_venue"))
    arxiv = [F.when(text.bare_arxiv(F.col(c)) != "", text.bare_arxiv(F.col(c))) for c in ("arxiv_id", "doi", "url", "record_id")]
    c = candidates.select(
        "*", text.normalize_title(F.col("title")).alias("n_title"), text.normalize_doi(F.col("doi")).alias("n_doi"), F.coalesce(*arxiv, F.lit("")).alias("n_arxiv"),
        text.normalize_venue(F.col("venue")).alias("n_venue"), text.first_surname(F.col("authors")).alias("surname"))
    both = c.join(r, "ref_id")
    why = (
        F.when(~_kind_ok(F.col("kind")), "not a publication type").when(F.col("n_venue") == "", "no venue")
        .when(F.abs(F.col("q_year") - F.col("year")) > YEAR_TOLERANCE, "year disagrees").when(F.col("n_title") == "", "no title"))
    known = lambda q, n: _kind_ok(F.col("kind")) & (F.col(q) != "") & (F.col(q) == F.col(n))
    return both.select(
        *candidates.columns, "surname", "n_title", "n_doi", known("q_doi", "n_doi").alias("doi_hit"), known("q_arxiv", "n_arxiv").alias("arxiv_hit"), why.alias("why_not"),
        ((F.col("q_title") != "") & (F.col("q_title") == F.col("n_title"))).alias("exact"),
        F.when(F.col("q_title") == F.col("n_title"), 1.0).otherwise(sets.longer_overlap(text.title_tokens(F.col("q_title")), text.title_tokens(F.col("n_title")))).alias("overlap"),
        sets.share_of_first(F.col("q_venue"), text.venue_tokens(F.col("n_venue"))).alias("share"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _works(dois: pd.Series, keys: pd.Series) -> pd.Series:
    """For each of a reference's records the least place of a record of the same work: one DOI, or one
    title, surname and year, or a chain of these."""

    def one(d: list[str], k: list[str]) -> list[int]:
        label = list(range(len(k)))
        for _ in label:
            for i in range(len(k)):
                for j in range(i):
                    if k[i] == k[j] or d[i] and d[i] == d[j]:
                        label[i] = label[j] = min(label[i], label[j])
        return label

    return pd.Series([one(list(d), list(k)) for d, k in zip(dois, keys, strict=True)])


def _choice(where: Column) -> Column:
    """The representative among the rows: published before repository copies, then provider and id."""
    return F.min(F.when(where, F.struct(F.coalesce("is_repository", F.lit(False)).alias("r"), "provider", "record_id")))


def decide(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """ref_id, status (found, ambiguous, not_found), rule, provider, record_id, contenders, reason."""
    c = judged_candidates(references, candidates)
    c = c.persist()
    eligible = F.col("why_not").isNull()
    key = F.to_json(F.struct("n_title", "surname", F.coalesce("year", F.lit(-1)).alias("y")))
    listed = F.sort_array(F.collect_list(F.struct("ord", "provider", "record_id", "is_repository", "share", "n_doi", key.alias("key"))))
    exact = c.where(eligible & F.col("exact")).groupBy("ref_id").agg(listed.alias("x"))
    exact = exact.withColumn("works", _works(F.transform("x", lambda r: r["n_doi"]), F.transform("x", lambda r: r["key"])))
    exact = exact.select("ref_id", F.inline(F.arrays_zip("x", "works"))).select("ref_id", "x.*", F.col("works").alias("work"))
    reps = exact.groupBy("ref_id", "work").agg(
        _choice(F.lit(True)).alias("rep"), F.count("*").alias("n"),
        F.min_by("share", F.struct(F.coalesce("is_repository", F.lit(False)), "provider", "record_id")).alias("share"))
    w = Window.partitionBy("ref_id")
    reps = reps.withColumn("best", F.max("share").over(w))
    tied = reps.groupBy("ref_id").agg(
        F.count("*").alias("n_works"), F.sum("n").alias("n_exact"), F.min("rep").alias("one"), F.max("best").alias("best"),
        F.count_if(F.col("share") == F.col("best")).alias("n_best"), F.min(F.when(F.col("share") == F.col("best"), F.col("rep"))).alias("by_venue"),
        F.sort_array(F.collect_list(F.concat_ws(":", "rep.provider", "rep.record_id"))).alias("works"))
    near = c.where(eligible & (F.col("overlap") > 0)).groupBy("ref_id").agg(
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("overlap")).alias("o"), "ord", F.concat_ws(":", "provider", "record_id").alias("x")))), lambda s: s["x"]), 1, CONTENDERS).alias("near"))
    reasons = c.where(~eligible).groupBy("ref_id", "why_not").agg(F.count("*").alias("k"), F.min("ord").alias("o")).groupBy("ref_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "o", "why_not"))), lambda s: F.concat((-s["k"]).cast("string"), F.lit(" "), s["why_not"])), ", ").alias("why"),
        F.sum("k").alias("n_rejected"))
    facts = c.groupBy("ref_id").agg(F.count("*").alias("n_all"), _choice(F.col("doi_hit")).alias("by_doi"), _choice(F.col("arxiv_hit")).alias("by_arxiv"), F.count_if(eligible).alias("n_ok"))
    q = references.select("ref_id", (text.normalize_title(F.col("title")) == "").alias("untitled"), ((text.normalize_doi(F.col("doi")) == "") & (text.bare_arxiv(F.col("arxiv_id")) == "")).alias("unnamed"))
    for part in (facts, tied, near, reasons):
        q = q.join(part, "ref_id", "left")
    col = F.col
    venue_wins = (col("best") >= VENUE_SHARE) & (col("n_best") == 1)
    cases = [  # condition, status, rule, selected, contenders
        (col("untitled") & col("unnamed"), "not_found", "", None, None),
        (F.coalesce("n_all", F.lit(0)) == 0, "not_found", "", None, None),
        (col("by_doi").isNotNull(), "found", "doi", "by_doi", None),
        (col("by_arxiv").isNotNull(), "found", "arxiv", "by_arxiv", None),
        (col("untitled"), "not_found", "identifier", None, None),
        (col("n_exact") == 1, "found", "exact-title", "one", None),
        (col("n_works") == 1, "found", "exact-title+dedup", "one", None),
        (venue_wins, "found", "exact-title+venue", "by_venue", None),
        (col("n_works") > 1, "ambiguous", "exact-title", None, "works"),
        (col("n_ok") == 0, "not_found", "eligibility", None, None),
        (col("near").isNotNull(), "ambiguous", "title-overlap", None, "near"),
        (F.lit(True), "not_found", "title-overlap", None, None),
    ]
    chosen = F.coalesce(*[F.when(when, F.lit(k)) for k, (when, *_) in enumerate(cases)])
    q = q.withColumn("_k", chosen)
    pick = lambda f: F.coalesce(*[F.when(col("_k") == k, f(x)) for k, x in enumerate(cases)])
    rejected = F.when(col("n_rejected").isNull(), F.concat(F.lit("none of the "), F.coalesce("n_all", F.lit(0)).cast("string"), F.lit(" records is the work"))).otherwise(
        F.concat(col("n_rejected").cast("string"), F.lit(" of "), col("n_all").cast("string"), F.lit(" records were ineligible ("), col("why"), F.lit(")")))
    selected = pick(lambda x: col(x[3]) if x[3] else F.lit(None))
    return q.select(
        "ref_id", pick(lambda x: F.lit(x[1])).alias("status"), pick(lambda x: F.lit(x[2])).alias("rule"), selected["provider"].alias("provider"), selected["record_id"].alias("record_id"),
        F.coalesce(pick(lambda x: col(x[4]) if x[4] else F.lit(None)), F.array().cast("array<string>")).alias("contenders"), rejected.alias("reason"))
