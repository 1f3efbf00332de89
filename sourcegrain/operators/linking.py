"""From citations to reference entries, and from entries to library papers.

references: paper, reference_id, raw_text. entries: paper, key, title, authors array<string>, year, doi. papers: paper_id,
title, authors, year, doi. Nothing is guessed: a marker or an entry with several possible partners gets none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import sets, text
from sourcegrain.operators import citations, compare

# Dates after authors, surnames before initials, signal phrases, and how titles and people weigh.
DATE = r"(?i)\(((?:18|19|20)\d{2}[a-z]?|n\.?d\.?)(?:,\s*[A-Za-z]+\s+\d{1,2})?\)"
SURNAME = r"(?:^|,\s*(?:&\s*)?)([A-ZÀ-ɏ][A-Za-zÀ-ɏ'’ -]*?),\s*(?=[A-Z])"
SIGNAL = r"(?i)^(?:(?:see(?:\s+also)?|e\.g\.|cf\.|as\s+cited\s+in)\s+)+"
CITED_YEAR = r"(?i)(?<!\d)((?:18|19|20)\d{2}[a-z]?|n\.?d\.?)(?!\d)"
HEAD, ET_AL_LEAST = 300, 3
AUTHOR_BONUS, YEAR_BONUS, LEAST_SCORE, LEAST_MARGIN = 0.15, 0.10, 0.65, 0.1
LEAST_RATIO = 0.8


def bare_year(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def bare_author(x: Column) -> Column:
    return F.regexp_replace(text.accent_fold(x), " ", "")


def author_year_keys(references: DataFrame, paper: str) -> DataFrame:
    """(paper, reference_id, surnames, corporate, year) of the references that name authors before a date in
    parentheses; without a surname and initial, all that stands there is one corporate author."""
    head = F.left("raw_text", F.lit(HEAD))
    who = F.trim(F.regexp_extract(head, rf"(?s)^(.*?)(?:{DATE})", 1), F.lit(". \t\n"))
    x = references.withColumn("_year", F.regexp_extract(head, DATE, 1)).where("_year <> ''").withColumn("_who", who)
    names = F.regexp_extract_all("_who", F.lit(SURNAME), F.lit(1))
    x = x.withColumn("_names", names).withColumn("corporate", F.size("_names") == 0).withColumn("_names", F.when(F.col("corporate"), F.array("_who")).otherwise(F.col("_names")))
    folded = F.transform(text.accent_fold_all(F.col("_names")), lambda n: F.regexp_replace(n, " ", ""))
    return x.where("_who <> ''").select(paper, "reference_id", folded.alias("surnames"), "corporate", bare_year(F.col("_year")).alias("year"))


def cited_author_years(claims: DataFrame, paper: str) -> DataFrame:
    """(paper, claim_id, part, author, year) of the parenthetical markers of claims: parts end at a semicolon, and the years
    of a part share its author."""
    inside = F.regexp_replace("marker", r"^\(|\)$", "")
    parts = claims.where(F.startswith("marker", F.lit("("))).select(paper, "claim_id", F.posexplode(F.split(inside, ";")).alias("part", "cited"))
    parts = parts.withColumn("years", F.regexp_extract_all("cited", F.lit(CITED_YEAR), F.lit(1))).where(F.size("years") > 0)
    author = F.regexp_replace(F.trim(F.regexp_extract("cited", rf"(?s)^(.*?)(?:{CITED_YEAR})", 1), F.lit(" ,\t\n")), SIGNAL, "")
    return parts.select(paper, "claim_id", "part", author.alias("author"), F.explode("years").alias("year"))


def match_author_years(cited: DataFrame, keys: DataFrame, paper: str) -> DataFrame:
    """cited joined to the reference ids whose year is the same and whose authors fit: a corporate author or a single one
    by name, two or more by the first names in order, `et al.` by the first of at least three."""
    x = cited.withColumn("year", bare_year(F.col("year"))).withColumn("et_al", F.rlike("author", F.lit(r"(?i)\bet\s+al\.?,?\s*$")))
    x = x.withColumn("whole", bare_author(F.col("author")))
    names = F.split(F.regexp_replace("author", r"(?i)\s*\bet\s+al\.?,?\s*$", ""), r"(?i)\s+(?:&|and)\s+")
    x = x.withColumn("_n", names).withColumn("names", F.transform(text.accent_fold_all(F.col("_n")), lambda n: F.regexp_replace(n, " ", "")))
    met = x.join(keys, [paper, "year"])
    n, known = F.col("names"), F.col("surnames")
    first = F.get(known, F.lit(0))
    alone = (F.size(known) == 1) & F.endswith(F.get(n, F.lit(0)), first)
    fits = (
        F.when(F.col("corporate"), F.col("whole") == first)
        .when(F.col("et_al"), (F.size(known) >= ET_AL_LEAST) & (F.get(n, F.lit(0)) == first))
        .when(F.size(n) > 1, n == F.slice(known, F.lit(1), F.size(n)))
        .otherwise(alone)
    )
    return met.where((F.col("author") != "") & fits).select(*cited.columns, "reference_id")


def first_surname(authors: Column) -> Column:
    return F.array_join(F.get(compare.people(authors), F.lit(0))["last"], " ")


def marker_entries(markers: DataFrame, entries: DataFrame, paper: str) -> DataFrame:
    """(paper, marker, candidates, key): by citation key, whatever its case; without one, by a year and the first author's
    surname among the marker's words. Numeric markers name nothing, and key is null unless one entry is left."""
    m = markers.select(paper, "marker").distinct().where(~F.rlike("marker", F.lit(f"(?U)^(?:{citations.NUMERIC})$")))
    clean = F.trim("marker", F.lit("()[]【】 "))
    keys = F.array_distinct(F.array_compact(F.array(F.lower(citations.single_key(F.col("marker"))), F.lower(clean))))
    e = entries.select(paper, "key", F.lower("key").alias("_low"), "year", first_surname(F.col("authors")).alias("_surname"))
    direct = m.withColumn("_low", F.explode(keys)).join(e, [paper, "_low"]).select(paper, "marker", "key").distinct().withColumn("direct", F.lit(True))
    words = F.split(text.accent_fold(F.col("marker")), " ")
    year = F.regexp_extract("marker", r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    named = m.withColumn("year", year).where("year is not null").withColumn("_surname", F.explode(F.array_distinct(words)))
    named = named.join(e.where("_surname <> ''"), [paper, "year", "_surname"]).select(paper, "marker", "key").distinct().withColumn("direct", F.lit(False))
    found = direct.union(named).groupBy(paper, "marker").agg(F.collect_set(F.when(F.col("direct"), F.col("key"))).alias("d"), F.collect_set(F.when(~F.col("direct"), F.col("key"))).alias("n"))
    kept = F.when(F.size("d") > 0, F.col("d")).otherwise(F.col("n"))
    return m.join(found.select(paper, "marker", kept.alias("k")), [paper, "marker"], "left").select(
        paper, "marker", F.coalesce(F.size("k"), F.lit(0)).alias("candidates"), F.when(F.size("k") == 1, F.get("k", F.lit(0))).alias("key"))


def pdf_title(x: Column) -> Column:
    """For titles from a PDF's text: folded, line-break hyphens joined, dashes as blanks, punctuation kept."""
    return F.regexp_replace(F.regexp_replace(text.fold(x), rf"(?U)(?<=\w)[{text.DASHES}]\s+(?=\w)", ""), f"[{text.DASHES}]", " ")


def pdf_title_tokens(title: Column) -> Column:
    return F.filter(text.venue_tokens(title), lambda t: F.length(t) > 2)


def entry_papers(entries: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """(key, paper_id, score): the one paper of the same DOI; where none has it, the best by the share of title words, author
    and year, if it scores LEAST_SCORE and leads by LEAST_MARGIN. Papers of another DOI are out of the question. Only papers
    that share a title word, or both bonuses, are scored: others can't reach the least score."""
    low = lambda c: F.trim(F.lower(F.coalesce(F.col(c), F.lit(""))))
    side = lambda df, name, c: df.select(F.col(name), low("doi").alias(c + "doi"), pdf_title(F.coalesce("title", F.lit(""))).alias(c + "title"), first_surname(F.col("authors")).alias(c + "who"), F.col("year").alias(c + "year"))
    e, p = side(entries, key, "e_"), side(papers, "paper_id", "p_")
    e, p = e.withColumn("e_t", pdf_title_tokens(F.col("e_title"))), p.withColumn("p_t", pdf_title_tokens(F.col("p_title")))
    exact = e.where("e_doi <> ''").join(p.where("p_doi <> ''"), F.col("e_doi") == F.col("p_doi")).groupBy(key).agg(F.count("*").alias("n"), F.min("paper_id").alias("paper_id"))
    rest = e.join(exact.select(key), key, "left_anti")
    common = rest.select(key, F.explode("e_t").alias("t")).join(p.select("paper_id", F.explode("p_t").alias("t")), "t").select(key, "paper_id").distinct()
    met = rest.join(common, key).join(p, "paper_id").where("not (e_doi <> '' and p_doi <> '')")
    overlap = sets.shared(F.col("e_t"), F.col("p_t")) / F.greatest(F.size("e_t"), F.size("p_t"))
    score = F.when(F.col("e_title") == F.col("p_title"), 1.0).otherwise(overlap)
    score += F.when((F.col("e_who") != "") & (F.col("e_who") == F.col("p_who")), AUTHOR_BONUS).otherwise(0.0)
    score += F.when(F.col("e_year") == F.col("p_year"), YEAR_BONUS).otherwise(0.0)
    ranked = met.select(key, "paper_id", F.least(score, F.lit(1.0)).alias("score"))
    best = ranked.groupBy(key).agg(F.max(F.struct("score", "paper_id")).alias("b"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    clear = (F.col("b.score") >= LEAST_SCORE) & (F.col("b.score") - F.coalesce(F.get("s", F.lit(1)), F.lit(-1.0)) >= LEAST_MARGIN)
    return exact.where("n = 1").select(key, "paper_id", F.lit(1.0).alias("score")).union(best.where(clear).select(key, "b.paper_id", "b.score"))


def by_title(entries: DataFrame, wanted: DataFrame, paper: str) -> DataFrame:
    """wanted (paper, title) with the key of the paper's entry whose title resembles it most, by a ratio of LEAST_RATIO at
    least; the first entry wins a tie. entries: paper, ord, key, title."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+", " "))
    x = wanted.select(paper, "title", plain("title").alias("_a")).join(entries.select(paper, "ord", "key", plain("title").alias("_b")), paper)
    # the ratio is twice the shared characters over all: sizes alone rule most pairs out before the slow comparison
    x = x.where(2 * F.least(F.length("_a"), F.length("_b")) >= LEAST_RATIO * (F.length("_a") + F.length("_b")))
    x = x.withColumn("ratio", text.sequence_ratio("_a", "_b")).where(F.col("ratio") >= LEAST_RATIO)
    return x.groupBy(paper, "title").agg(F.max(F.struct("ratio", -F.col("ord"), "key")).alias("b")).select(paper, "title", "b.key", "b.ratio")


def document_view(paragraphs: DataFrame, pages: DataFrame, paper: str) -> DataFrame:
    """paragraphs (paper, ord, page, content), pages (paper, pages): each paragraph on a page that exists; a page's first
    heading becomes its heading and is no paragraph; the others are numbered from 0 on their page."""
    x = paragraphs.join(pages, paper).withColumn("content", text.collapse(F.col("content"))).where("content <> ''")
    x = x.withColumn("page", F.least(F.greatest("page", F.lit(1)), F.greatest("pages", F.lit(1)))).drop("pages")
    w = Window.partitionBy(paper, "page").orderBy("ord")
    heads = F.count_if(citations.is_heading(F.col("content"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("is_page_heading", citations.is_heading(F.col("content")) & (heads == 1))
    heading = F.max(F.when(F.col("is_page_heading"), F.col("content"))).over(Window.partitionBy(paper, "page"))
    x = x.withColumn("heading", heading).where("not is_page_heading")
    return x.select(paper, "ord", "page", "heading", "content", (F.row_number().over(w) - 1).alias("display_index"))
