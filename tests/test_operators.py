import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sourcegrain.functions import sets, text
from sourcegrain.operators import audit, citations, compare, containment, judge, metrics, references, resolve, retrieval, structure
from sourcegrain.sources import bibtex, tables
from sourcegrain.streaming import queue


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sets_with_an_empty_side(spark):
    df = spark.createDataFrame([([], ["a"]), (["a", "b"], ["a"]), ([], [])], "a array<string>, b array<string>")
    out = df.select(sets.longer_overlap(F.col("a"), F.col("b")), sets.share_of_first(F.col("a"), F.col("b")), sets.dice(F.col("a"), F.col("b")))
    assert rows(out) == rows(spark.createDataFrame([(0.0, 0.0, 0.0), (0.5, 0.5, 2 / 3), (0.0, 0.0, 0.0)]))


def test_ratios_over_nothing_are_null(spark):
    empty = spark.createDataFrame([], "e string, p string")
    assert metrics.kappa(empty, "e", "p").collect() == [] or metrics.kappa(empty, "e", "p").first()["kappa"] is None
    assert spark.range(1).select(metrics.bar(F.lit(None).cast("double"), 0.8)).first()[0] == "n/a"


def test_nearest_rank_percentiles(spark):
    out = metrics.timing(spark.range(1, 11).selectExpr("double(id) v"), "v", [[]]).first()
    assert (out["median"], out["p95"], out["most"]) == (5.0, 10.0, 10.0)


def test_latex_and_folding(spark):
    df = spark.createDataFrame([(r"M{\"u}ller \o{} \c{c} Łukasz",)], "x string")
    assert df.select(text.decode_latex("x"), text.accent_fold("x")).first() == ("Müller ø ç Łukasz", "muller o c lukasz")


def test_sequence_ratio_is_difflibs(spark):
    pairs = [("a b c", "a c b"), ("x" * 300, "x" * 250), ("", ""), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(text.sequence_ratio("a", "b")).collect()] == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


@pytest.mark.parametrize(("given", "found"), [("arXiv:1710.10723v2", "1710.10723"), ("CoRR, abs/1308.3432", "1308.3432"), ("arXiv: cs/0701001", "cs/0701001"), ("2019", "")])
def test_arxiv_ids(spark, given, found):
    assert spark.createDataFrame([(given,)], "x string").select(text.extract_arxiv(F.col("x"))).first()[0] == found


def test_bibtex_nesting_macros_comments(spark):
    raw = '@string{a={One}} @comment{x} @book{K, title={A {B {C}}}, publisher = a # " Two", year="1850 or 1999"} @misc{u, title={open'
    out = list(bibtex.entries(raw))
    assert [(e["key"], e["title"], e["publisher"], e["year"]) for e in out] == [("K", "A B C", "One Two", 1999), ("u", "open", "", None)]


def test_bib_lookup_ignores_case(spark):
    entries = bibtex.parse(spark.createDataFrame([("f", "@a{Key, title={x}} @a{KEY, title={y}}")], "path string, text string"))
    out = bibtex.by_key(entries, spark.createDataFrame([("key",)], "wanted string")).collect()
    assert [(r["wanted"], r["title"]) for r in out] == [("key", "x")]


def test_exact_then_folded(spark):
    left = spark.createDataFrame([("Aa",), ("b",), ("C",)], "key string")
    right = spark.createDataFrame([("aa", 1), ("b", 2)], "key string, v int")
    assert rows(resolve.exact_then_folded(left, right, "key")) == [("Aa", 1, True), ("C", None, False), ("b", 2, True)]


def test_overlaps_match_brute_force(spark):
    a = [(1, s, s + n) for s, n in ((0, 5), (5, 30), (40, 1), (7, 0))]
    b = [(1, s, s + n) for s, n in ((4, 2), (30, 20), (40, 1), (100, 5))]
    got = resolve.overlaps(spark.createDataFrame(a, "k int, start_a int, end_a int"), spark.createDataFrame(b, "k int, start_b int, end_b int"), ["k"], 10)
    want = sorted((x[1], y[1]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2]))
    assert sorted((r["start_a"], r["start_b"]) for r in got.collect()) == want


def test_same_work_is_transitive(spark):
    df = spark.createDataFrame([("g", 1, "a", "x"), ("g", 2, "a", "y"), ("g", 3, "b", "y"), ("g", 4, None, "z"), ("h", 5, "a", "x")], "g string, n int, p string, q string")
    assert rows(resolve.same_work(df, "g", "n", [F.col("p"), F.col("q")])) == [("g", 1, 1), ("g", 2, 1), ("g", 3, 1), ("g", 4, 4), ("h", 5, 5)]


def test_top_k_in_blocks_is_one_search(spark):
    v = spark.createDataFrame([(i, [float((i * k) % 7) for k in range(1, 4)]) for i in range(40)], "id long, v array<double>")
    claims, passages = v.where("id % 5 = 0").toDF("claim_id", "claim_vec"), v.toDF("passage_id", "passage_vec")
    once, blocks = (rows(retrieval.top_k_everywhere(claims, passages, 3, block)) for block in (4096, 3))
    assert once == blocks and len(once) == 24


def test_containment_of_any_length(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "quic"), (3, "")], "doc int, text string")
    needles = spark.createDataFrame([(1, "ick brown fox ju"), (2, "quic"), (3, "k b"), (4, "absent words in here")], "item int, needle string")
    assert rows(containment.containing(texts, needles, "item", "doc")) == [(1, 1), (2, 1), (2, 2), (3, 1)]


def test_recovered_mismatch_withholds_but_does_not_accuse(spark):
    checks = [(1, "title", "MATCH", False), (1, "year", "MISMATCH", True), (2, "year", "MISMATCH", False), (3, "venue", "MISMATCH", False), (4, "title", "MATCH", False)]
    out = audit.statuses(spark.createDataFrame(checks, "k int, field string, status string, recovered boolean"), "k")
    assert rows(out) == [(1, "NEEDS_REVIEW"), (2, "METADATA_MISMATCH"), (3, "NEEDS_REVIEW"), (4, "VERIFIED")]
    assert audit.run_status(out.limit(0)).first()["run_status"] == "empty"


def test_verdict_only_where_judged(spark):
    claims = spark.createDataFrame([("a", "", 1), ("b", "x", 1)], "claim_id string, claim string, n_passages int")
    out = judge.judge(claims, spark.createDataFrame([("b", '{"label":"PARTIAL"}')], "claim_id string, reply string"))
    assert rows(out.select("claim_id", "status", "verdict")) == [("a", "EMPTY_CLAIM", None), ("b", "JUDGED", "PARTIAL")]
    assert judge.broken(out).count() == 0


def test_lexical_evidence(spark):
    claims = spark.createDataFrame([("p", "c", "graphs help models")], "paper string, claim_id string, claim string")
    passages = spark.createDataFrame([("p", 0, "models of graphs"), ("p", 1, "cooking"), ("q", 2, "graphs help models")], "paper string, passage_id int, content string")
    out = judge.lexical_evidence(claims, passages, "paper").collect()
    assert [(r["passage_id"], r["rank"], r["verdict"]) for r in out] == [(0, 1, "SUPPORT"), (1, 2, "SUPPORT")]


def test_markers_need_every_number(spark):
    claims = spark.createDataFrame([("p", "a", "[1, 2]"), ("p", "b", "[1, 9]")], "paper string, claim_id string, marker string")
    refs = spark.createDataFrame([("p", 1), ("p", 2)], "paper string, reference_id int")
    assert {r["claim_id"] for r in citations.cite_numbers(claims, refs, "paper").collect()} == {"a"}


def test_single_key(spark):
    df = spark.createDataFrame([(r"\cite{a}",), (r"\citep[p. 1]{a, b}",), ("[1]",)], "m string")
    assert [r[0] for r in df.select(citations.single_key(F.col("m"))).collect()] == ["a", None, None]


def test_paragraphs_by_gap_and_page(spark):
    blocks = [("d", 0, 1, 0.0, 10.0, "one"), ("d", 1, 1, 12.0, 22.0, "two"), ("d", 2, 1, 40.0, 50.0, "three"), ("d", 3, 2, 0.0, 10.0, "four")]
    out = structure.paragraphs(spark.createDataFrame(blocks, "d string, ord int, page int, y0 double, y1 double, content string"), "d")
    assert [r["content"] for r in out.orderBy("paragraph").collect()] == ["one two", "three", "four"]


def test_two_columns_and_reading_order(spark):
    blocks = [("d", 1, 0, 300.0, 0.0), ("d", 1, 1, 10.0, 15.0), ("d", 1, 2, 10.0, 100.0)]
    out = structure.two_columns(spark.createDataFrame(blocks, "d string, page int, ord int, x0 double, y0 double"), "d", 600.0)
    assert [r["ord"] for r in out.orderBy("place").collect()] == [1, 0, 2]
    elements = [("d", 1, 0, 300.0, 700.0), ("d", 1, 1, 50.0, 100.0), ("d", 1, 2, 50.0, 700.0), ("d", 1, 3, None, None)]
    placed = structure.column_order(spark.createDataFrame(elements, "d string, page int, ord int, x0 double, y1 double"), "d")
    assert [r["ord"] for r in placed.orderBy("place").collect()] == [2, 1, 0, 3]


def test_markdown_pages(spark):
    md = "# Head\n\n<!-- ct-page 3 -->\n- item [x](u)\n\n```\n\ntext `code`\n<!-- ct-page 4 -->\nend"
    out = structure.markdown_blocks(spark.createDataFrame([("d", md)], "d string, text string"), "d").orderBy("ord").collect()
    assert [(r["page"], r["content"]) for r in out] == [(2, "Head"), (3, "item x"), (3, "text code"), (4, "end")]


def test_tree_is_flattened_depth_first(spark):
    tree = {"kids": [{"type": "list", "page number": 2, "list items": [{"type": "li", "content": "a"}]}, {"type": "p", "content": "b", "page number": 3}]}
    out = structure.flatten_tree(spark.createDataFrame([("f", json.dumps(tree)), ("g", "{bad")], "path string, text string"))
    assert rows(out) == [("f", 0, "li", "a", 2), ("f", 1, "p", "b", 3)]


def test_section_needs_entries_after_its_heading(spark):
    elements = [("d", 0, 1, "References"), ("d", 1, 4, "References"), *[("d", k, 5, f"[{k}] Li, A. T.") for k in range(2, 6)]]
    out = references.find_section(spark.createDataFrame(elements, "d string, ord int, page int, content string"), "d").collect()
    assert [(r["ord"], r["ahead"]) for r in out] == [(1, 4)]


def test_structured_fields_win(spark):
    entries = spark.createDataFrame([("r", "Given", [], None, "", "", "", "Ann Li. Read title. 2019.")], "ref_id string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, raw_text string")
    out = references.as_queries(entries).first()
    assert (out["title"], out["authors"], out["year"]) == ("Given", ["Ann Li"], 2019)


def test_summary_counts(spark):
    checks = spark.createDataFrame([(1, "MISMATCH"), (1, "BIB_MISSING"), (2, "MATCH")], "k int, status string")
    assert rows(compare.summary(checks, "k")) == [(1, True, 1, 1), (2, False, 0, 0)]


def test_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "p.json").write_text(json.dumps({"paper_id": "p", "paragraphs": [{"text": "x", "page_start": 1, "page_end": 1}, {"text": " ", "page_start": 1, "page_end": 1}]}))
    (tmp_path / "docs" / "p.references.json").write_text("{}")
    (tmp_path / "docs" / "broken.json").write_text("{")
    docs = tables.read_documents(spark, f"file://{tmp_path}/docs")
    assert rows(tables.corpus(docs).select("paper_id", "passage_index", "content")) == [("p", 0, "x")]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "up" / "b.pdf").write_bytes(b"no")
    assert tables.uploads(spark, f"file://{tmp_path}/up", 100).count() == 1
    (tmp_path / "bib").mkdir()
    (tmp_path / "bib" / "x.bib").write_bytes(b"@a{k, title={\xff}}")
    assert bibtex.read(spark, f"file://{tmp_path}/bib").first()["title"] == "�"


def test_upsert_and_newest(spark):
    old = spark.createDataFrame([("a", "2020-01-01 00:00:00", 1), ("b", "2021-01-01 00:00:00", 1)], "paper_id string, created_at string, v int")
    new = spark.createDataFrame([("a", "2022-01-01 00:00:00", 2)], "paper_id string, created_at string, v int")
    assert [r["paper_id"] for r in tables.newest(tables.upsert(old, new, "paper_id")).collect()] == ["a", "b"]


def test_parse_queue_goes_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bib").write_text("@a{one, title={x}}")
    spec = (lambda df: df.select("key"), f"{tmp_path}/out", f"{tmp_path}/state")
    queue.run_queue(queue.bib_stream(spark, str(tmp_path / "in")), *spec).awaitTermination()
    (tmp_path / "in" / "b.bib").write_text("@a{two, title={y}}")
    queue.run_queue(queue.bib_stream(spark, str(tmp_path / "in")), *spec).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["one", "two"]
