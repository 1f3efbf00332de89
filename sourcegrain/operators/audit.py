"""From field checks to audited statuses and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcegrain.functions import text
from sourcegrain.operators import compare

# The statuses of an audited reference.
STATUSES = ("VERIFIED", "NEEDS_REVIEW", "METADATA_MISMATCH", "AMBIGUOUS", "NOT_FOUND", "LOOKUP_FAILED")


def long_checks(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """One row (key, field, status) for each named check."""
    made = F.array(*[F.struct(F.lit(name).alias("field"), status.alias("status")) for name, status in fields.items()])
    return df.select(key, F.inline(made))


def statuses(checks: DataFrame, key: str) -> DataFrame:
    """A decisive mismatch (any field but the venue; not one recovered from raw text, where the column
    `recovered` says so) accuses; agreement in all fields verifies; the rest needs review."""
    decisive = (F.col("field") != "venue") & (F.col("status") == "MISMATCH")
    if "recovered" in checks.columns:
        decisive &= ~F.col("recovered")
    out = checks.groupBy(key).agg(F.bool_or(decisive).alias("accused"), F.every(F.col("status") == "MATCH").alias("clean"))
    return out.select(key, F.when(F.col("accused"), "METADATA_MISMATCH").when(F.col("clean"), "VERIFIED").otherwise("NEEDS_REVIEW").alias("audit_status"))


def counts(results: DataFrame, status: str = "audit_status") -> DataFrame:
    """A row for each status, those that do not occur with 0."""
    spark = results.sparkSession
    known = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in STATUSES])).alias(status))
    return known.join(results.groupBy(status).agg(F.count("*").alias("n")), status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def run_status(results: DataFrame, status: str = "audit_status") -> DataFrame:
    """One row: completed, partial where some lookups failed, failed where all did, empty without rows."""
    failed, n = F.count_if(F.col(status) == "LOOKUP_FAILED"), F.count("*")
    return results.agg(n.alias("total"), F.when(n == 0, "empty").when(failed == n, "failed").when(failed > 0, "partial").otherwise("completed").alias("run_status"))


# Names for what is missing, required fields, and where fields come from that nobody typed in.
MISSING = {"BIB_MISSING": "INPUT_MISSING", "PDF_MISSING": "SOURCE_MISSING"}
REQUIRED = ("title", "authors", "year", "venue")
RECOVERED_FROM = ("parser", "llm_segmentation", "raw_text_heuristic")


def same_people(a: Column, b: Column) -> Column:
    """Two author lists name the same people, in whatever order: each of the one takes a partner of the other with its
    surname, whose given names are the same or not stated; initials state nothing."""

    def read(names: Column) -> Column:
        given = lambda p: F.array_sort(F.array_distinct(F.filter(p["first"], lambda t: F.length(t) > 1)))
        return F.transform(compare.people(names), lambda p: F.struct(F.array_join(p["last"], " ").alias("last"), given(p).alias("given")))

    def take(left: Column, one: Column) -> Column:
        ok = lambda r: (r["last"] == one["last"]) & ((F.size(r["given"]) == 0) | (F.size(one["given"]) == 0) | (r["given"] == one["given"]))
        at = F.array_min(F.filter(F.transform(left, lambda r, i: F.when(ok(r), i)), lambda i: i.isNotNull()))
        return F.when(at.isNotNull(), F.filter(left, lambda r, i: i != at))

    x, y = read(a), read(b)
    rest = F.aggregate(x, F.when(F.size(x) == F.size(y), y), take)
    return F.coalesce((F.size(x) > 0) & rest.isNotNull(), F.lit(False))


def recovered_fields(source: Column, stated: Column, read: Column) -> Column:
    """Names of the fields whose values came out of raw text: all that are there if the metadata's source is one of
    RECOVERED_FROM, else those that `read` has and `stated` lacks (structs of title, authors, year, venue, doi)."""
    has = lambda s, f: F.size(s[f]) > 0 if f == "authors" else s[f].isNotNull() if f == "year" else F.trim(F.coalesce(s[f], F.lit(""))) != ""
    fields = [*REQUIRED, "doi"]
    return F.array_compact(F.array(*[F.when(has(read, f) & (source.isin(*RECOVERED_FROM) | ~has(stated, f)), f) for f in fields]))


def compare_external(pairs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """pairs: key, left and right structs as in compare_records, recovered array<string>. Gives the checks (key, field,
    status) and the statuses (key, audit_status). Authors are compared in order; a mere difference of given names, a venue
    named differently or a recovered field withholds VERIFIED, but accuses nobody."""
    x = pairs.withColumn("_r", compare.ordered_authors(F.col("left.authors"), F.col("right.authors")))
    x = x.withColumn("_venue", compare.venues_agree(F.coalesce("left.venue", F.lit("")), F.coalesce("right.venue", F.lit(""))))
    plain = lambda c: F.trim(F.regexp_replace(text.fold(F.coalesce(F.col(c), F.lit(""))), r"(?U)[\W_]+", " "))
    both_venues = (F.coalesce(F.trim("left.venue"), F.lit("")) != "") & (F.coalesce(F.trim("right.venue"), F.lit("")) != "")
    facts = x.select(
        key, "recovered", (F.size("left.authors") > 0).alias("_l"), (F.size("right.authors") > 0).alias("_s"), F.col("_r.agree").alias("_agree"),
        F.col("_r.given_conflict").alias("_given"), (both_venues & F.col("_venue")).alias("_venue"), (plain("left.title") == plain("right.title")).alias("_title"))
    names = F.create_map(*[F.lit(v) for kv in MISSING.items() for v in kv])
    checks = compare.compare_records(pairs.select(key, "left", "right"), key).withColumn("status", F.coalesce(names[F.col("status")], "status")).join(facts, key)
    authors = F.when(F.col("_agree") & ~F.col("_given"), "MATCH").otherwise("MISMATCH")
    status = (
        F.when((F.col("field") == "authors") & F.col("_l") & F.col("_s"), authors)
        .when((F.col("field") == "venue") & (F.col("status") == "MISMATCH") & F.col("_venue"), "MATCH")
        .otherwise(F.col("status"))
    )
    checks = checks.withColumn("status", status)
    mild = F.array_contains("recovered", F.col("field")) | (F.col("field") == "venue") | (F.col("field") == "authors") & F.col("_agree")
    out = checks.groupBy(key).agg(
        F.bool_or((F.col("status") == "MISMATCH") & ~mild).alias("accused"),
        F.every((F.col("status") == "MATCH") | ~F.col("field").isin(*REQUIRED)).alias("complete"), F.bool_and(F.col("_title") & F.col("_venue")).alias("exact"))
    verdict = F.when(F.col("accused"), "METADATA_MISMATCH").when(F.col("complete") & F.col("exact"), "VERIFIED").otherwise("NEEDS_REVIEW")
    optional = facts.select(key, F.explode(F.array(F.lit("venue"), F.lit("doi"))).alias("field")).join(checks.select(key, "field"), [key, "field"], "left_anti")
    return checks.select(key, "field", "status").union(optional.select(key, "field", F.lit("NOT_CHECKED"))), out.select(key, verdict.alias("audit_status"))


def audit_references(references: DataFrame, outcomes: DataFrame | None, compared: DataFrame | None, key: str) -> DataFrame:
    """(key, audit_status) for each of references (key, title): without a title there is nothing to look up; without a
    lookup or with a failed one existence is unchecked; a found record's comparison decides. outcomes: key, outcome."""
    titled = F.trim(F.coalesce("title", F.lit(""))) != ""
    if outcomes is None:
        return references.select(key, F.when(titled, "LOOKUP_FAILED").otherwise("NEEDS_REVIEW").alias("audit_status"))
    x = references.select(key, titled.alias("_titled")).join(outcomes.select(key, "outcome"), key, "left")
    x = x.join(compared, key, "left") if compared is not None else x.withColumn("audit_status", F.lit(None).cast("string"))
    found = F.coalesce("audit_status", F.lit("LOOKUP_FAILED"))
    status = (
        F.when(~F.col("_titled"), "NEEDS_REVIEW").when(F.col("outcome") == "found", found).when(F.col("outcome") == "ambiguous", "NEEDS_REVIEW")
        .when(F.col("outcome") == "not_found", "NOT_FOUND").otherwise("LOOKUP_FAILED"))
    return x.select(key, status.alias("audit_status"))
