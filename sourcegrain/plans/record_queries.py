"""Operators that need bibliographic records, on literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrain.functions import text
from sourcegrain.operators import audit, citations, compare, identity, judge, linking, lookup, references, structure
from sourcegrain.sources import bibtex

QUERIES, SQL = {}, {}
REFERENCE = "ref_id string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string"
CANDIDATE = "ref_id string, ord int, provider string, record_id string, title string, authors array<string>, year int, venue string, kind string, doi string, arxiv_id string, url string, is_repository boolean"


def query(sql: str = ""):
    def put(f):
        QUERIES[f.__name__] = lambda spark, d: f(spark)
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def records(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    a = ["Bastian Epping"]
    refs = [
        ("doi", "A Title", a, 2014, "", "https://doi.org/10.1000/X1", ""),
        ("arxiv", "Other", a, 2019, "", "", "1911.03587v2"),
        ("exact", "Graph  Neural Net-\nworks", a, 2020, "NeurIPS", "", ""),
        ("dedup", "Same Work", a, 2014, "", "", ""),
        ("venue", "Two Works", a, None, "Journal of Graphs", "", ""),
        ("tie", "Two Works", a, None, "", "", ""),
        ("near", "Deep learning for graphs", a, 2020, "", "", ""),
        ("kind", "Dataset Only", a, 2020, "", "", ""),
        ("none", "Nothing Alike", a, 2020, "", "", ""),
        ("blank", "", [], None, "", "", ""),
        ("empty", "No Candidates", a, 2020, "", "", ""),
    ]
    c = lambda ref, n, p, r, t, y, v, kind="article", doi="", arxiv="", repo=False, who=a: (ref, n, p, r, t, who, y, v, kind, doi, arxiv, "", repo)
    cands = [
        c("doi", 0, "openalex", "W1", "Quite Another", 1990, "", doi="10.1000/x1", repo=True), c("doi", 1, "crossref", "C1", "A Title", 2014, "V", doi="10.1000/x1"), c("doi", 2, "crossref", "C0", "A Title", 2014, "V", "component", "10.1000/x1"),
        c("arxiv", 0, "openalex", "W2", "Other", 2019, "arXiv", arxiv="arXiv:1911.03587"),
        c("exact", 0, "openalex", "W3", "Graph Neural Networks", 2021, "NeurIPS"), c("exact", 1, "openalex", "W4", "Graph Neural Networks", 2025, "NeurIPS"),
        c("dedup", 0, "openalex", "W5", "Same work", 2014, "J", doi="10.1/a"), c("dedup", 1, "crossref", "C5", "Same Work", 2015, "J", doi="10.1/A"), c("dedup", 2, "openalex", "W6", "Same Work", 2014, "arXiv", repo=True),
        c("venue", 0, "crossref", "C7", "Two works", 2001, "Journal of Graphs"), c("venue", 1, "crossref", "C8", "Two Works", 2009, "Proceedings of Things"),
        c("tie", 0, "crossref", "C7", "Two works", 2001, "Journal of Graphs"), c("tie", 1, "crossref", "C8", "Two Works", 2009, "Proceedings of Things"),
        c("near", 0, "openalex", "W9", "Learning on graphs", 2020, "J"), c("near", 1, "openalex", "W10", "Deep learning for graphs and trees", 2020, "J"), c("near", 2, "openalex", "W11", "Cooking", 2020, "J"),
        c("kind", 0, "crossref", "C9", "Dataset Only", 2020, "J", "dataset"), c("kind", 1, "crossref", "C10", "Dataset Only", 2020, ""),
        c("none", 0, "crossref", "C11", "Cooking", 2020, "J"),
    ]
    return spark.createDataFrame(refs, REFERENCE), spark.createDataFrame(cands, CANDIDATE)


_DECIDED = [
    ("doi", "found", "doi", "crossref:C1"), ("arxiv", "found", "arxiv", "openalex:W2"), ("exact", "found", "exact-title", "openalex:W3"), ("dedup", "found", "exact-title+dedup", "crossref:C5"),
    ("venue", "found", "exact-title+venue", "crossref:C7"), ("tie", "ambiguous", "exact-title", ""), ("near", "ambiguous", "title-overlap", ""), ("kind", "not_found", "eligibility", ""),
    ("none", "not_found", "title-overlap", ""), ("blank", "not_found", "", ""), ("empty", "not_found", "", ""),
]


def values(rows: list[tuple], names: str) -> str:
    said = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) AS t({names})"


@query(values(_DECIDED, "ref_id, status, rule, record"))
def identity_decisions(spark: SparkSession) -> DataFrame:
    d = identity.decide(*records(spark))
    return d.select("ref_id", "status", "rule", F.concat_ws(":", "provider", "record_id").alias("record"))


@query(values([("near", 0, "openalex:W10"), ("near", 1, "openalex:W9"), ("tie", 0, "crossref:C7"), ("tie", 1, "crossref:C8")], "ref_id, place, record"))
def identity_contenders(spark: SparkSession) -> DataFrame:
    return identity.decide(*records(spark)).select("ref_id", F.posexplode("contenders").alias("place", "record"))


@query(values([("exact", "found"), ("empty", "failed"), ("none", "failed"), ("kind", "not_found"), ("doi", "found")], "ref_id, outcome"))
def lookup_chain(spark: SparkSession) -> DataFrame:
    refs, cands = records(spark)
    some = refs.where("ref_id in ('exact', 'empty', 'none', 'kind', 'doi')")
    tried = [("exact", "openalex", 200), ("empty", "openalex", 200), ("empty", "crossref", 500), ("none", "openalex", 429), ("none", "crossref", 200), ("kind", "openalex", 404), ("kind", "crossref", 200), ("doi", "openalex", 200)]
    attempts = spark.createDataFrame(tried, "ref_id string, provider string, status_code int")
    return lookup.chain(some, attempts, cands, ["openalex", "crossref"]).select("ref_id", "outcome")


@query(values([(1, "title", "MATCH"), (1, "year", "MISMATCH"), (1, "authors", "MATCH"), (1, "venue", "MATCH"), (2, "title", "MISMATCH"), (2, "year", "BIB_MISSING"), (2, "authors", "MISMATCH"), (2, "doi", "MATCH")], "pair, field, status"))
def bib_record_checks(spark: SparkSession) -> DataFrame:
    side = "struct<title:string,authors:array<string>,year:int,venue:string,doi:string>"
    rows = [
        (1, ("Emergent Abilities", ["Wei, Jason", "Tay, Yi"], 2022, "Trans. Machine Learning", ""), ("emergent abilities!", ["Jason Wei", "Yi Tay", "X Y"], 2023, "Trans Machine Learning", "")),
        (2, ("A title of one thing", ["Ann Li"], None, "", "https://doi.org/10.1/Q"), ("Something else entirely", ["Bo Ek"], 2020, "", "10.1/q")),
    ]
    return compare.compare_records(spark.createDataFrame(rows, f"pair int, left {side}, right {side}"), "pair")


@query(values([(1, True, False, None, 0, 0, False), (2, False, True, None, 1, 0, False), (3, False, False, 1, 0, 0, False), (4, True, False, None, 0, 0, True), (5, False, False, None, 1, 0, False)], "pair, agree, truncated, position, missing, extra, given_conflict"))
def latex_author_compare(spark: SparkSession) -> DataFrame:
    rows = [
        (1, ['M{\\"u}ller, J.', "Ghaffari Laleh, Narmin"], ["Jon Müller", "Narmin Ghaffari Laleh"]), (2, ["Li, Ann", "others"], ["Ann Li", "Bo Ek"]),
        (3, ["Li, Ann", "Ek, Bo"], ["Ann Li", "Cy Oz"]), (4, ["Li, Ann"], ["Bea Li"]), (5, ["Li, Ann"], ["Ann Li", "Bo Ek"])]
    df = spark.createDataFrame(rows, "pair int, a array<string>, b array<string>").withColumn("r", compare.ordered_authors("a", "b"))
    return df.select("pair", "r.*")


BIB = """@comment{skip {this}} @string{nips = "Neural Information"}
@article{Key1, title = {The {BERT} \\"{o}f "x" -- it}, author = "Ann Li and Ek, Bo", journal = nips # " Systems", year = {c. 2019}, pages={1--2}}
@misc{key2, title="A \\& B", year=1999, doi = {10.1/z}
"""


@query(values([("Key1", 0, "article", 'The BERT of "x" – it', "Li, Ann; Ek, Bo", 2019, "Neural Information Systems"), ("key2", 1, "misc", "A & B", "", None, "")], "key, ord, entry_type, title, authors, year, venue"))
def bib_parse_entries(spark: SparkSession) -> DataFrame:
    out = bibtex.parse(spark.createDataFrame([("a.bib", BIB), ("b.bib", None)], "path string, text string"))
    return out.select("key", "ord", "entry_type", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue")


@query(values([(1, "Do LLMs Feel? Teaching machines", "Victor O.K. Li; Ann Ek", 2023, "Proc", "10.18653/v1/p19-1", ""), (2, "A title", "Bo Li", 2020, "", "", "1911.03587")], "n, title, authors, year, venue, doi, arxiv_id"))
def reference_fields(spark: SparkSession) -> DataFrame:
    rows = [(1, "[5] Victor O.K. Li and Ann Ek. Do LLMs Feel? Teaching machines. In Jo Oz, editors, Proc. X, pages 1-2. 2023. doi: 10.18653/v1/P19-1."), (2, "2. Bo Li et al. 2020. A title. arXiv:1911.03587v3 [cs].")]
    out = references.parse_raw(spark.createDataFrame(rows, "n int, raw_text string"))
    return out.select("n", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "doi", "arxiv_id")


@query(values([("num", "bracket-numbered"), ("apa", "author-year-parenthesized"), ("odd", "unknown-unnumbered")], "doc, family"))
def reference_styles(spark: SparkSession) -> DataFrame:
    rows = [("num", 0, "[1] Li, A. Title."), ("num", 1, "[2] Ek, B. Title."), ("apa", 0, "Li, A., & Ek, B. (2020). A title."), ("apa", 1, "Oz, C. (2019a, May 3). Other."), ("odd", 0, "some words"), ("odd", 1, "more words")]
    return references.style(spark.createDataFrame(rows, "doc string, ord int, content string"), "doc").select("doc", "family")


@query(values([("d", 1, "[1] Li, A. A long title.", 1), ("d", 2, "[3] Ek, B. Other.", 3)], "doc, entry, raw_text, number"))
def reference_entries(spark: SparkSession) -> DataFrame:
    rows = [("d", 0, 5, "preface"), ("d", 1, 5, "[1] Li, A. A long"), ("d", 2, 6, "title."), ("d", 3, 6, "[3] Ek, B.  Other.")]
    out = references.split_entries(spark.createDataFrame(rows, "doc string, ord int, page int, content string"), "doc")
    return out.select("doc", F.col("entry").cast("int").alias("entry"), "raw_text", "number")


@query(values([(0, 0, "[1, 3-5]"), (0, 0, "(Li et al., 2020)"), (0, 1, "\\cite{key}")], "ord, sentence_no, marker"))
def claim_markers(spark: SparkSession) -> DataFrame:
    rows = [("p", 0, 1, "Graphs help models learn [1, 3-5] as shown (Li et al., 2020). Trees help models even more \\cite{key}. See [9]."), ("p", 1, 2, "References"), ("p", 2, 2, "Li shows many things here [7].")]
    return citations.claims(spark.createDataFrame(rows, "paper string, ord int, page int, content string"), "paper").select("ord", "sentence_no", "marker")


@query(values([("1, 3-5", "1,3,4,5"), ("7", "7"), ("5-3", ""), ("a", ""), ("1-500", "")], "given, numbers"))
def marker_ranges(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(x,) for x in ("1, 3-5", "7", "5-3", "a", "1-500")], "given string")
    return df.select("given", F.array_join(text.expand_numbers(F.col("given")).cast("array<string>"), ",").alias("numbers"))


@query(values([("a", "JUDGED", "SUPPORT", 0.85), ("b", "JUDGED", "NOT_FOUND", 0.3), ("c", "INVALID_REPLY", None, None), ("d", "CALL_FAILED", None, None), ("e", "NO_PASSAGES", None, None), ("f", "INVALID_LABEL", None, None)], "claim_id, status, verdict, confidence"))
def judged_claims(spark: SparkSession) -> DataFrame:
    claims = spark.createDataFrame([(k, "text", int(k != "e")) for k in "abcdef"], "claim_id string, claim string, n_passages int")
    said = [("a", '{"label": "support", "reason": "r"}'), ("b", '{"label": "NOT_FOUND"}'), ("c", "no json"), ("e", "{}"), ("f", '{"label": "MAYBE"}')]
    return judge.judge(claims, spark.createDataFrame(said, "claim_id string, reply string")).select("claim_id", "status", "verdict", F.col("confidence").cast("decimal(3,2)").cast("double").alias("confidence"))


@query(values([("d", 0, "It goes on here.", 1), ("d", 1, "New start", 2)], "doc, paragraph, content, page"))
def merged_pages(spark: SparkSession) -> DataFrame:
    rows = [("d", 0, 1, "It goes"), ("d", 1, 2, "on here."), ("d", 2, 2, "New start")]
    out = structure.merge_across_pages(spark.createDataFrame(rows, "doc string, ord int, page int, content string"), "doc")
    return out.select("doc", F.col("paragraph").cast("int").alias("paragraph"), "content", "page")


@query(values([("a", 0, 1.0), ("b", 0, 0.0), ("c", 1, 0.75)], "kind, n, ratio"))
def sequence_ratios(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([("a", 0, "same", "same"), ("b", 0, "abc", "xyz"), ("c", 1, "abcd", "bcde")], "kind string, n int, x string, y string")
    return df.select("kind", "n", text.sequence_ratio("x", "y").alias("ratio"))


@query(values([("ﬁ Straße: a net-\nwork—x", "fi strasse a network x", "10.1/q", "1710.10723")], "given, title, doi, arxiv_id"))
def normal_forms(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([("ﬁ Straße: a net-\nwork—x", "https://doi.org/10.1/Q).", "CoRR, abs/1710.10723v2")], "given string, d string, a string")
    return df.select("given", text.normalize_title(F.col("given")).alias("title"), text.normalize_doi(F.col("d")).alias("doi"), text.extract_arxiv(F.col("a")).alias("arxiv_id"))


@query(values([(1, True), (2, False), (3, True), (4, False), (5, False)], "pair, agree"))
def author_sets(spark: SparkSession) -> DataFrame:
    rows = [
        (1, ["Epping, Bastian", "Schaub, Michael"], ["Michael T. Schaub", "Bastian Epping"]), (2, ["Smith, Jane"], ["John Smith"]), (3, ["Vaswani, A.", "Mikolov, Tomáš"], ["Ashish Vaswani", "Tomas Mikolov"]),
        (4, ["Li, Ann"], ["Ann Li", "Bo Ek"]), (5, [], [])]
    return spark.createDataFrame(rows, "pair int, a array<string>, b array<string>").select("pair", audit.same_people(F.col("a"), F.col("b")).alias("agree"))


SIDE = "struct<title:string,authors:array<string>,year:int,venue:string,doi:string>"


def _audited(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    ok = ("Deep Learning of Graphs", ["Li, Ann", "Ek, Bo"], 2020, "Journal of Graphs", "")
    other = lambda **x: tuple({**dict(zip(("title", "authors", "year", "venue", "doi"), ok, strict=True)), **x}.values())
    rows = [
        ("same", ok, ok, []), ("year", other(year=2019), ok, []), ("recovered", other(year=2019), ok, ["year"]), ("given", other(authors=["Li, Amy", "Ek, Bo"]), ok, []),
        ("venue", ok, other(venue="Lecture Notes"), []), ("arxiv", other(venue="arXiv preprint 2010.1"), other(venue="arXiv (Cornell)"), []), ("cut", other(authors=["Li, Ann", "others"]), ok, []),
        ("missing", other(venue=""), ok, []), ("case", other(title="Deep learning of graphs!"), ok, [])]
    pairs = spark.createDataFrame(rows, f"ref_id string, left {SIDE}, right {SIDE}, recovered array<string>")
    refs = spark.createDataFrame([(r[0], "t") for r in rows] + [("untitled", " "), ("nobody", "t"), ("two", "t"), ("broken", "t"), ("unasked", "t")], "ref_id string, title string")
    outcomes = spark.createDataFrame([(r[0], "found") for r in rows] + [("nobody", "not_found"), ("two", "ambiguous"), ("broken", "failed"), ("untitled", "found")], "ref_id string, outcome string")
    return refs, outcomes, pairs


@query(values([
    ("same", "VERIFIED"), ("year", "METADATA_MISMATCH"), ("recovered", "NEEDS_REVIEW"), ("given", "NEEDS_REVIEW"), ("venue", "NEEDS_REVIEW"), ("arxiv", "VERIFIED"), ("cut", "METADATA_MISMATCH"), ("missing", "NEEDS_REVIEW"),
    ("case", "VERIFIED"), ("untitled", "NEEDS_REVIEW"), ("nobody", "NOT_FOUND"), ("two", "NEEDS_REVIEW"), ("broken", "LOOKUP_FAILED"), ("unasked", "LOOKUP_FAILED")], "ref_id, audit_status"))
def audited_references(spark: SparkSession) -> DataFrame:
    refs, outcomes, pairs = _audited(spark)
    return audit.audit_references(refs, outcomes, audit.compare_external(pairs, "ref_id")[1], "ref_id")


@query(values([
    ("given", "authors", "MISMATCH"), ("given", "doi", "NOT_CHECKED"), ("given", "title", "MATCH"), ("given", "venue", "MATCH"), ("given", "year", "MATCH"),
    ("missing", "authors", "MATCH"), ("missing", "doi", "NOT_CHECKED"), ("missing", "title", "MATCH"), ("missing", "venue", "INPUT_MISSING"), ("missing", "year", "MATCH")], "ref_id, field, status"))
def audit_field_checks(spark: SparkSession) -> DataFrame:
    return audit.compare_external(_audited(spark)[2], "ref_id")[0].where("ref_id in ('given', 'missing')")


@query(values([("parsed", "title,year"), ("typed", "year")], "kind, fields"))
def recovered_field_names(spark: SparkSession) -> DataFrame:
    rows = [("parsed", "parser", ("T", [], None, "", ""), ("T", [], 2020, "", "")), ("typed", "bibtex", ("T", ["A"], None, "", ""), ("T", ["A"], 2020, "", ""))]
    df = spark.createDataFrame(rows, f"kind string, source string, stated {SIDE}, read {SIDE}")
    return df.select("kind", F.array_join(audit.recovered_fields(F.col("source"), F.col("stated"), F.col("read")), ",").alias("fields"))


@query(values([("c1", 0, 1), ("c1", 1, 3), ("c2", 0, 2), ("c3", 0, 4), ("c4", 0, 5), ("c4", 0, 6)], "claim_id, part, reference_id"))
def author_year_links(spark: SparkSession) -> DataFrame:
    refs = [
        ("p", 1, "Müller, J., Ek, B., & Oz, C. (2020). A title. J."), ("p", 2, "Li, A., & Ek, B. (2019a). Other."), ("p", 3, "World Health Organization. (n.d.). Report."), ("p", 4, "Van Li, A. (2018). Alone."),
        ("p", 5, "Ek, B. (2001). One."), ("p", 6, "Ek, B. (2002, May 3). Two."), ("p", 7, "No date here.")]
    said = [("p", "c1", "(Muller et al., 2020; see World Health Organization, n.d.)"), ("p", "c2", "(Li & Ek, 2019a)"), ("p", "c3", "(Van Li, 2018)"), ("p", "c4", "(Ek, 2001, 2002)"), ("p", "c5", "(Li et al., 2019a)"), ("p", "c6", "[1]")]
    keys = linking.author_year_keys(spark.createDataFrame(refs, "paper string, reference_id int, raw_text string"), "paper")
    cited = linking.cited_author_years(spark.createDataFrame(said, "paper string, claim_id string, marker string"), "paper")
    return linking.match_author_years(cited, keys, "paper").select("claim_id", "part", "reference_id")


@query(values([("(Li, 2020)", 1, "a"), ("(Ek, 2020)", 2, None), ("\\cite{B}", 1, "b"), ("\\cite{a,b}", 0, None), ("[d]", 2, None)], "marker, candidates, key"))
def marker_entry_links(spark: SparkSession) -> DataFrame:
    entries = [("p", "a", ["Li, Ann"], 2020), ("p", "b", ["Bo Ek"], 2020), ("p", "c", ["Ek, Cy"], 2020), ("p", "D", ["Oz, E"], 2001), ("p", "d", ["Oz, F"], 2002)]
    markers = spark.createDataFrame([("p", m) for m in ("(Li, 2020)", "(Ek, 2020)", "\\cite{B}", "\\cite{a,b}", "[1, 2]", "[d]")], "paper string, marker string")
    return linking.marker_entries(markers, spark.createDataFrame(entries, "paper string, key string, authors array<string>, year int"), "paper").drop("paper")


@query(values([("doi", "P1", 1.0), ("title", "P2", 1.0), ("sub", "P3", 0.85)], "key, paper_id, score"))
def entry_paper_links(spark: SparkSession) -> DataFrame:
    papers = [
        ("P1", "Something", ["Ann Li"], 2020, "10.1/A"), ("P2", "Graph Auto- encoders for Trees", ["Bo Ek"], 2019, None), ("P3", "Learning Deep Graphs", ["Cy Oz"], 2018, ""),
        ("P4", "Twin Title Words", ["X Y"], 2000, ""), ("P5", "Twin Title Words", ["X Z"], 2001, "")]
    entries = [
        ("doi", "Other", ["Li, Ann"], 1999, "10.1/a"), ("title", "Graph Autoencoders for Trees", ["Ek, Bo"], None, ""), ("sub", "Learning Deep Graphs: Extended version", ["Oz, Cy"], 2018, ""),
        ("twin", "Twin Title Words", [], None, ""), ("far", "Cooking deep", ["Nobody"], 1990, ""), ("conflict", "Something", ["Li, Ann"], 2020, "10.1/b")]
    kind = "title string, authors array<string>, year int, doi string"
    out = linking.entry_papers(spark.createDataFrame(entries, "key string, " + kind), spark.createDataFrame(papers, "paper_id string, " + kind), "key")
    return out.withColumn("score", F.round("score", 2))


@query(values([("Deep Learning for Graph", "k1"), ("twins", "k2")], "title, key"))
def fuzzy_title_entries(spark: SparkSession) -> DataFrame:
    entries = spark.createDataFrame([("p", 0, "k1", "{Deep} Learning for Graphs"), ("p", 1, "k2", "Twins"), ("p", 2, "k3", "twins!"), ("q", 0, "k4", "Cooking")], "paper string, ord int, key string, title string")
    wanted = spark.createDataFrame([("p", "Deep Learning for Graph"), ("p", "twins"), ("p", "Cooking"), ("p", "Deep")], "paper string, title string")
    return linking.by_title(entries, wanted, "paper").select("title", "key")


@query(values([("d", 1, 1, "Introduction", "Text one.", 0), ("d", 2, 1, "Introduction", "2 Methods", 1), ("d", 4, 2, None, "Far page.", 0)], "paper, ord, page, heading, content, display_index"))
def document_views(spark: SparkSession) -> DataFrame:
    rows = [("d", 0, 0, "Introduction"), ("d", 1, 1, "Text  one."), ("d", 2, 1, "2 Methods"), ("d", 3, 2, "  "), ("d", 4, 9, "Far page.")]
    return linking.document_view(spark.createDataFrame(rows, "paper string, ord int, page int, content string"), spark.createDataFrame([("d", 2)], "paper string, pages int"), "paper")


@query(values([(1, "10.1000/a(b)c", "See", False), (2, "10.1000/x", "at", False), (3, "", "nothing here", False), (4, "", "http://a.b/c", True)], "n, doi, rest, url"))
def doi_and_url_forms(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(1, "See https://doi.org/10.1000/a(b)c))."), (2, "at doi: 10.1000/x, p. 2"), (3, " nothing here"), (4, "http://a.b/c")], "n int, x string")
    return df.select("n", text.balanced_doi(F.col("x")).alias("doi"), text.without_doi(F.col("x")).alias("rest"), text.is_http_url(F.col("x")).alias("url"))


@query(values([("b|![y](2)|c|![x](1) |d",)], "kept"))
def image_lines(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([("![x](1)\nb\n![y](2)\nc\n![x](1) \nd",)], "x string")
    return df.select(F.replace(text.keep_last_images(F.col("x")), F.lit("\n"), F.lit("|")).alias("kept"))
