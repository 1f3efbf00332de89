"""The engine's operators on the driver's tables, each with the SQL that must give the same rows.

The tables hold no bibliographies, so operators run on columns of the same shape: part names stand
for titles, orders and their line items for two records of one work, embeddings for claims and
passages, events for timed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrain.functions import sets
from sourcegrain.operators import audit, classes, metrics, resolve, retrieval, windows

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def put(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d.rstrip('/')}/{t}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_SCORES = """WITH q AS (SELECT vec_id AS claim_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT claim_id, vec_id AS passage_id, round(list_inner_product(q.e, CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings WHERE vec_id <> claim_id),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, passage_id) AS rank FROM s)"""


def _nearest(t) -> DataFrame:
    e = t("embeddings")
    claims = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("claim_id"), F.col("embedding").alias("claim_vec"))
    passages = e.select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("passage_vec"))
    found = retrieval.top_k_everywhere(claims, passages, 6).where("claim_id <> passage_id")
    return retrieval.top_k(found.drop("rank"), "claim_id", "passage_id", "score", 5)


@query(_SCORES + " SELECT claim_id, passage_id, CAST(rank AS INT) AS rank, round(score, 5) AS score FROM r WHERE rank <= 5")
def topk_cosine_passages(t) -> DataFrame:
    return _nearest(t).select("claim_id", "passage_id", "rank", F.round("score", 5).alias("score"))


@query("""WITH c AS (SELECT vec_id AS claim_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT c.label, claim_id, vec_id AS passage_id, round(list_inner_product(e, CAST(embedding AS DOUBLE[])), 9) AS score FROM c JOIN embeddings p ON p.label = c.label),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, passage_id) AS rank FROM s)
SELECT claim_id, passage_id, CAST(rank AS INT) AS rank, round(score, 5) AS score FROM r WHERE rank <= 3""")
def topk_within_paper(t) -> DataFrame:
    e = t("embeddings")
    claims = e.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("claim_id"), F.col("embedding").alias("claim_vec"))
    passages = e.select("label", F.col("vec_id").alias("passage_id"), F.col("embedding").alias("passage_vec"))
    return retrieval.top_k_in_paper(claims, passages, "label", 3).select("claim_id", "passage_id", "rank", F.round("score", 5).alias("score"))


@query(_SCORES + """, f AS (SELECT claim_id, min(rank) FILTER (WHERE p.label = c.label) AS hit FROM r JOIN embeddings p ON p.vec_id = passage_id JOIN embeddings c ON c.vec_id = claim_id WHERE rank <= 5 GROUP BY claim_id)
SELECT count(*) AS n_claims, count_if(hit = 1) / CAST(count(*) AS DOUBLE) AS recall_at_1, count_if(hit <= 5) / CAST(count(*) AS DOUBLE) AS recall_at_5,
CASE WHEN count_if(hit <= 5) / CAST(count(*) AS DOUBLE) >= 0.8 THEN 'met' WHEN count_if(hit <= 5) / CAST(count(*) AS DOUBLE) < 0.5 THEN 'no-go' ELSE 'below' END AS bar FROM f""")
def recall_at_k_by_label(t) -> DataFrame:
    e = t("embeddings").select("vec_id", "label")
    joined = _nearest(t).join(e.toDF("passage_id", "pl"), "passage_id").join(e.toDF("claim_id", "cl"), "claim_id")
    hits = joined.groupBy("claim_id").agg(F.min(F.when(F.col("pl") == F.col("cl"), F.col("rank"))).alias("hit"))
    at = lambda k: metrics.ratio(F.count_if(F.col("hit") <= k), F.count("*"))
    return hits.agg(F.count("*").alias("n_claims"), at(1).alias("recall_at_1"), at(5).alias("recall_at_5")).withColumn("bar", metrics.bar(F.col("recall_at_5"), 0.8, 0.5))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents WHERE lang = 'en'),
f AS (SELECT doc_id, ord, length(regexp_extract_all(para, '[A-Za-z]{3,}')) >= 4 AS prose FROM p WHERE trim(para) <> ''),
g AS (SELECT *, max(prose) OVER (PARTITION BY doc_id) AS anyp FROM f)
SELECT doc_id, count(*) AS n_indexed, count_if(prose) AS n_prose FROM g WHERE prose OR NOT anyp GROUP BY doc_id""")
def prose_passages(t) -> DataFrame:
    d = t("documents").where("lang = 'en'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "para")).where("trim(para) <> ''")
    return retrieval.prose_or_all(d, "doc_id", "para").groupBy("doc_id").agg(F.count("*").alias("n_indexed"), F.count_if(retrieval.is_prose(F.col("para"))).alias("n_prose"))


@query("""WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_brand FROM part),
s AS (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, len(list_intersect(list_distinct(a.w), list_distinct(b.w))) AS k, len(list_distinct(a.w)) AS n, len(list_distinct(b.w)) AS m
FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT a_id, b_id, round(k / CAST(greatest(n, m) AS DOUBLE), 6) AS title_similarity, round(k / CAST(n AS DOUBLE), 6) AS venue_share, round(2.0 * k / (n + m), 6) AS dice FROM s WHERE k >= 1""")
def title_similarity_pairs(t) -> DataFrame:
    words = lambda name: F.array_distinct(F.split(name, " "))
    measures = {"title_similarity": sets.longer_overlap, "venue_share": sets.share_of_first, "dice": sets.dice}
    facts = lambda a, b: {k: F.round(f(words(a), words(b)), 6) for k, f in measures.items()}
    return classes.expanded(t("part"), ["p_brand"], "p_name", "p_partkey", facts, lambda a, b: F.arrays_overlap(words(a), words(b)))


def _edit_ratio(a, b):
    """1 less the distance over the longer length; not a number for two empty names, as in the SQL."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.levenshtein(a, b) + F.lit(float("nan"))).otherwise(1 - F.levenshtein(a, b) / longest)


@query("""SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS distance,
round(1 - levenshtein(a.p_name, b.p_name) / CAST(greatest(length(a.p_name), length(b.p_name)) AS DOUBLE), 6) AS ratio
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def levenshtein_titles(t) -> DataFrame:
    facts = lambda a, b: {"distance": F.levenshtein(a, b), "ratio": F.round(_edit_ratio(a, b), 6)}
    return classes.expanded(t("part"), ["p_brand", "p_size"], "p_name", "p_partkey", facts)


@query("""WITH s AS (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, round(1 - levenshtein(a.p_name, b.p_name) / CAST(greatest(length(a.p_name), length(b.p_name)) AS DOUBLE), 9) AS score
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rk FROM s)
SELECT a_id, b_id, score FROM r WHERE rk = 1 AND score >= 0.3""")
def fuzzy_best_match(t) -> DataFrame:
    found = classes.best_partners(t("part"), "p_brand", ["p_name"], "p_partkey", lambda a, b: F.round(_edit_ratio(a["p_name"], b["p_name"]), 9), 0.3)
    return windows.first_of(found, ["a_id"], [F.desc("score"), F.asc("b_id")])


@query("""WITH w AS (SELECT s_suppkey, replace(s_name, 'Supplier', 'Customer') AS key FROM supplier),
p AS (SELECT s_suppkey, key, c_name FROM w JOIN customer ON starts_with(c_name, key) AND substr(c_name, 1, 12) = substr(key, 1, 12)),
b AS (SELECT key, max(c_name) FILTER (WHERE c_name = key) AS exact, count(DISTINCT c_name) AS n, min(c_name) AS anyone FROM p GROUP BY key)
SELECT w.s_suppkey, w.key, coalesce(n, 0) AS n_candidates, coalesce(exact, CASE WHEN n = 1 THEN anyone END) AS resolved FROM w LEFT JOIN b USING (key)""")
def unique_prefix_join(t) -> DataFrame:
    wanted = t("supplier").select("s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("key"))
    return resolve.unique_prefix(wanted, t("customer"), "key", "c_name", 12)


@query("""WITH s AS (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, CAST(0.5 + CASE WHEN a.p_size = b.p_size THEN 0.15 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 0.25 ELSE 0 END AS DOUBLE) AS score
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS nx FROM s WHERE score >= 0.65 WINDOW w AS (PARTITION BY a_id ORDER BY score DESC, b_id))
SELECT a_id, b_id, score FROM r WHERE rk = 1 AND (nx IS NULL OR round(score - nx, 6) >= 0.1)""")
def scored_join_with_margin(t) -> DataFrame:
    part = lambda x, y, weight: F.when(x == y, weight).otherwise(0.0)
    score = lambda a, b: F.round(F.least(F.lit(1.0), 0.5 + part(a["p_size"], b["p_size"], 0.15) + part(a["p_type"], b["p_type"], 0.25)), 6)
    pairs = classes.best_partners(t("part"), "p_brand", ["p_size", "p_type"], "p_partkey", score, 0.65, k=2, meet=["p_size", "p_type"])
    return resolve.best_with_margin(pairs, "a_id", "b_id", "score", 0.65, 0.1)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def deepest_run_wins(t) -> DataFrame:
    return windows.first_of(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def first_occurrence_dedup(t) -> DataFrame:
    return windows.first_of(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.asc("event_id")])


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def keep_last_dedup(t) -> DataFrame:
    return windows.first_of(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.desc("event_id")])


@query("""SELECT c_custkey, 'settled' AS pass, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1
UNION ALL SELECT c_custkey, 'second' AS pass, 0 AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def exclude_settled_second_pass(t) -> DataFrame:
    c, o = t("customer"), t("orders")
    first = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.lit("settled").alias("pass"), F.count("*").alias("n"))
    rest = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("second").alias("pass"), F.lit(0).cast("long").alias("n"))
    return first.unionByName(rest)


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS k, p_brand AS g, p_type AS a, p_size AS b FROM part),
e AS (SELECT x.k AS u, y.k AS v FROM n x JOIN n y ON x.g = y.g AND x.k <> y.k AND (x.a = y.a OR x.b = y.b)),
c(k, r) AS (SELECT k, k FROM n UNION SELECT e.v, c.r FROM c JOIN e ON e.u = c.k)
SELECT n.g AS p_brand, n.k AS p_partkey, min(c.r) AS work FROM n JOIN c ON c.k = n.k GROUP BY 1, 2""")
def same_work_components(t) -> DataFrame:
    return resolve.same_work(t("part").select("p_brand", "p_partkey", "p_type", "p_size"), "p_brand", "p_partkey", [F.col("p_type"), F.col("p_size").cast("string")])


_PAIR = """WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total, count(*) AS n, min(l_linestatus) AS status, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey, o_totalprice, o_orderstatus, year(o_orderdate) AS y, total, status, year(shipped) AS sy FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
f AS (SELECT o_orderkey, 'title' AS field, CASE WHEN total IS NULL THEN 'PDF_MISSING' WHEN abs(o_totalprice - total) <= 0.2 * o_totalprice THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM p
UNION ALL SELECT o_orderkey, 'year', CASE WHEN sy IS NULL THEN 'PDF_MISSING' WHEN y = sy THEN 'MATCH' ELSE 'MISMATCH' END FROM p
UNION ALL SELECT o_orderkey, 'authors', CASE WHEN status IS NULL THEN 'PDF_MISSING' WHEN o_orderstatus = status THEN 'MATCH' ELSE 'MISMATCH' END FROM p
UNION ALL SELECT o_orderkey, 'venue', CASE WHEN o_orderstatus = 'P' OR status IS NULL THEN 'NOT_CHECKED' ELSE 'MATCH' END FROM p)"""


def _checks(t) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("total"), F.min("l_linestatus").alias("status"), F.max("l_shipdate").alias("shipped"))
    p = t("orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rule = lambda missing, ok: F.when(missing, "PDF_MISSING").when(ok, "MATCH").otherwise("MISMATCH")
    return audit.long_checks(p, "o_orderkey", {
        "title": rule(F.col("total").isNull(), F.abs(F.col("o_totalprice") - F.col("total")) <= 0.2 * F.col("o_totalprice")),
        "year": rule(F.col("shipped").isNull(), F.year("o_orderdate") == F.year("shipped")),
        "authors": rule(F.col("status").isNull(), F.col("o_orderstatus") == F.col("status")),
        "venue": F.when((F.col("o_orderstatus") == "P") | F.col("status").isNull(), "NOT_CHECKED").otherwise("MATCH"),
    })


@query(_PAIR + " SELECT * FROM f")
def field_checks_long(t) -> DataFrame:
    return _checks(t)


_STATUS = """, s AS (SELECT o_orderkey, CASE WHEN bool_or(field <> 'venue' AND status = 'MISMATCH') THEN 'METADATA_MISMATCH' WHEN bool_and(status = 'MATCH') THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS audit_status FROM f GROUP BY 1)"""


@query(_PAIR + _STATUS + " SELECT * FROM s")
def audit_status(t) -> DataFrame:
    return audit.statuses(_checks(t), "o_orderkey")


@query(_PAIR + _STATUS + ", d AS (SELECT unnest(['VERIFIED','NEEDS_REVIEW','METADATA_MISMATCH','AMBIGUOUS','NOT_FOUND','LOOKUP_FAILED']) AS audit_status) SELECT audit_status, count(o_orderkey) AS n FROM d LEFT JOIN s USING (audit_status) GROUP BY 1")
def audit_counts_zero_filled(t) -> DataFrame:
    return audit.counts(audit.statuses(_checks(t), "o_orderkey"))


@query("""SELECT l_orderkey, count(*) AS n_members FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) k ON l_partkey = p_partkey GROUP BY 1 HAVING bool_and(p_partkey IS NOT NULL)""")
def relational_division_markers(t) -> DataFrame:
    known = t("part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return resolve.all_known(t("lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", known)


@query("""WITH d AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type FROM events),
a AS (SELECT user_id, event_id AS a_id, s AS start_a, s + 7200 AS end_a FROM d WHERE event_type = (SELECT min(event_type) FROM events)),
b AS (SELECT user_id, event_id AS b_id, s AS start_b, s + 3600 AS end_b FROM d WHERE event_type <> (SELECT min(event_type) FROM events))
SELECT a.user_id, a_id, b_id, greatest(start_a, start_b) AS start_both, least(end_a, end_b) AS end_both FROM a JOIN b ON a.user_id = b.user_id AND greatest(start_a, start_b) < least(end_a, end_b)""")
def span_overlap_join(t) -> DataFrame:
    e = t("events")
    least = e.agg(F.min("event_type").alias("least")).first()["least"]
    s = e.select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"), "event_type")
    a = s.where(F.col("event_type") == least).select("user_id", F.col("event_id").alias("a_id"), F.col("s").alias("start_a"), (F.col("s") + 7200).alias("end_a"))
    b = s.where(F.col("event_type") != least).select("user_id", F.col("event_id").alias("b_id"), F.col("s").alias("start_b"), (F.col("s") + 3600).alias("end_b"))
    return resolve.overlaps(a, b, ["user_id"], 7200).select("user_id", "a_id", "b_id", F.greatest("start_a", "start_b").alias("start_both"), F.least("end_a", "end_b").alias("end_both"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY 1, 2""")
def paragraph_islands(t) -> DataFrame:
    e = t("events").select("user_id", "ts", "event_id")
    e = e.withColumn("before", windows.previous("ts", ["user_id"], ["ts", "event_id"]))
    marked = windows.with_islands(e, ["user_id"], ["ts", "event_id"], F.col("ts") > F.col("before") + F.expr("INTERVAL 6 HOUR"))
    return marked.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx FROM orders)
SELECT o_custkey, 'missing' AS kind, o_orderkey + 1 AS first_missing, nx - 1 AS last_missing FROM n WHERE nx > o_orderkey + 1""")
def numbering_gaps(t) -> DataFrame:
    return windows.numbering_gaps(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("""WITH f AS (SELECT user_id, event_id, coalesce(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING), 0) AS ahead FROM events)
SELECT user_id, event_id, CAST(ahead AS BIGINT) AS ahead FROM f""")
def forward_window_count(t) -> DataFrame:
    return t("events").select("user_id", "event_id", windows.count_ahead(F.col("value") > 50, ["user_id"], ["ts", "event_id"], 25).alias("ahead"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, count(*) AS n, count_if(regexp_matches(line, '^[A-Z]')) / CAST(count(*) AS DOUBLE) AS upper_share, count_if(regexp_matches(line, '[.]$')) / CAST(count(*) AS DOUBLE) AS closed_share, count_if(contains(line, '|')) / CAST(count(*) AS DOUBLE) AS table_share FROM l GROUP BY 1)
SELECT doc_id, n, CASE WHEN table_share >= 0.3 THEN 'table' WHEN upper_share >= 0.8 AND closed_share >= 0.8 THEN 'prose' WHEN closed_share >= 0.5 THEN 'mixed' ELSE 'unknown' END AS style FROM s""")
def decision_cascade_style(t) -> DataFrame:
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    share = lambda c: F.count_if(c) / F.count("*")
    s = lines.groupBy("doc_id").agg(
        F.count("*").alias("n"), share(F.rlike("line", F.lit("^[A-Z]"))).alias("u"), share(F.rlike("line", F.lit(r"\.$"))).alias("c"), share(F.contains("line", F.lit("|"))).alias("b"))
    return s.select("doc_id", "n", F.when(F.col("b") >= 0.3, "table").when((F.col("u") >= 0.8) & (F.col("c") >= 0.8), "prose").when(F.col("c") >= 0.5, "mixed").otherwise("unknown").alias("style"))


@query("""SELECT quality, count_if(toxic = 0) AS n_0, count_if(toxic = 1) AS n_1 FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality""")
def confusion_matrix(t) -> DataFrame:
    return metrics.confusion(t("labels"), "quality", "toxic", [0, 1])


@query("""WITH c AS (SELECT DISTINCT l_returnflag AS k FROM lineitem UNION SELECT DISTINCT CASE WHEN l_quantity > 25 THEN 'R' ELSE 'N' END FROM lineitem),
x AS (SELECT l_returnflag AS e, CASE WHEN l_quantity > 25 THEN 'R' ELSE 'N' END AS p FROM lineitem),
s AS (SELECT k AS class, count_if(e = k) AS support, count_if(e = k AND p = k) AS hits, count_if(p = k) AS said FROM c, x GROUP BY k),
r AS (SELECT class, support, hits / CAST(nullif(said, 0) AS DOUBLE) AS precision, hits / CAST(nullif(support, 0) AS DOUBLE) AS recall FROM s)
SELECT class, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 9) AS f1 FROM r""")
def class_scores(t) -> DataFrame:
    x = t("lineitem").select(F.col("l_returnflag").alias("e"), F.when(F.col("l_quantity") > 25, "R").otherwise("N").alias("p"))
    return metrics.class_scores(x, "e", "p").select("class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH m AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END) AS po,
(count_if(quality = 0) * CAST(count_if(toxic = 0) AS DOUBLE) + count_if(quality = 1) * CAST(count_if(toxic = 1) AS DOUBLE)) / (CAST(count(*) AS DOUBLE) * count(*)) AS pe FROM labels)
SELECT n, round(po, 9) AS observed, round(pe, 9) AS chance, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 9) AS kappa FROM m""")
def cohen_kappa(t) -> DataFrame:
    return metrics.kappa(t("labels"), "quality", "toxic").select("n", *[F.round(c, 9).alias(c) for c in ("observed", "chance", "kappa")])


@query("""WITH v AS (SELECT unnest([0, 1, 2, 3]) AS step, unnest([1000.0, 1300.0, 1600.0, 1900.0]) AS threshold),
x AS (SELECT step, threshold, p_partkey, p_retailprice >= threshold AS ok FROM part, v),
f AS (SELECT *, coalesce(ok <> lag(ok) OVER (PARTITION BY p_partkey ORDER BY step), false) AS flip FROM x)
SELECT CAST(step AS INT) AS step, CAST(threshold AS DOUBLE) AS threshold, count_if(ok) AS n_passed, count_if(flip) AS n_flips, count(*) AS n_cases FROM f GROUP BY 1, 2""")
def threshold_sweep_flips(t) -> DataFrame:
    return metrics.sweep(t("part"), "p_partkey", "p_retailprice", F.col("p_retailprice") >= F.col("threshold"), [1000.0, 1300.0, 1600.0, 1900.0])


@query("""SELECT event_type, user_id % 5 AS bucket, count(value) AS n, min(value) AS least, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most
FROM events GROUP BY GROUPING SETS ((), (event_type), (bucket))""")
def timing_percentiles_grouping_sets(t) -> DataFrame:
    e = t("events").withColumn("bucket", F.col("user_id") % 5)
    return metrics.timing(e, "value", [[], ["event_type"], ["bucket"]])


@query("""WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1),
s AS (SELECT month, n, q, lead(n) OVER (ORDER BY month) - n AS dn, lead(q) OVER (ORDER BY month) - q AS dq FROM m)
SELECT month, n, q, round(dq / nullif(dn, 0), 6) AS slope FROM s WHERE dq / nullif(dn, 0) IS NOT NULL""")
def scaling_slopes(t) -> DataFrame:
    m = t("lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))
    return metrics.slopes(m, "month", "n", "q").withColumn("slope", F.round("slope", 6))


@query("""SELECT doc_id, concat('claim-', substr(sha1(concat_ws('|', CAST(doc_id AS VARCHAR), lang, text)), 1, 16)) AS claim_id FROM documents""")
def sha1_ids(t) -> DataFrame:
    return t("documents").select("doc_id", F.concat(F.lit("claim-"), F.left(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "text")), F.lit(16))).alias("claim_id"))


@query("""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n]+', ' ', 'g')) AS k FROM documents),
r AS (SELECT md5(k) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM n GROUP BY k) SELECT doc_id, copies FROM r""")
def dedupe_docs_normalized(t) -> DataFrame:
    d = t("documents").select("doc_id", F.sha2(F.trim(F.regexp_replace(F.lower("text"), "[ \\t\\n]+", " ")), 256).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("key")


@query("""WITH c AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM conversations)
SELECT conv_id, turn, length(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS n_tokens FROM c WHERE role = 'user' AND seen = 1""")
def claim_turns(t) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = t("conversations").withColumn("seen", F.max(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w)).where("role = 'user' and seen = 1")
    return c.select("conv_id", "turn", F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))).cast("long").alias("n_tokens"))


@query("""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS n_chars FROM pages""")
def html_markdown_clean(t) -> DataFrame:
    x = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"[ \t\r\n]+", " "))
    return t("pages").select("page_id", F.length(x).cast("long").alias("n_chars"))


@query("""WITH p AS (SELECT c_mktsegment AS seg, CAST(count_if(c_acctbal > 0) AS DOUBLE) AS good, count(*) AS n FROM customer GROUP BY 1)
SELECT seg, n, round(100 * good / nullif(n, 0), 2) AS verified_percent FROM p""")
def percent_of_total(t) -> DataFrame:
    p = t("customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("good"))
    return p.select("seg", "n", F.round(100 * metrics.ratio(F.col("good"), F.col("n")), 2).alias("verified_percent"))


@query("""SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer""")
def shared_ids_intersect(t) -> DataFrame:
    return t("supplier").select(F.col("s_nationkey").alias("k")).intersect(t("customer").select(F.col("c_nationkey").alias("k")))


@query("""SELECT p_partkey FROM part EXCEPT ALL SELECT DISTINCT l_partkey FROM lineitem""")
def unused_pins_except(t) -> DataFrame:
    return t("part").select("p_partkey").exceptAll(t("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct())


@query("""SELECT n_name, c_name, c_acctbal FROM (SELECT n_name, c_name, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE r <= 3""")
def contenders_top3(t) -> DataFrame:
    top = windows.first_of(t("customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_name")], 3)
    return top.join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "c_name", "c_acctbal")


@query("""WITH b AS (SELECT item_id, left(lower(text), 60) AS k FROM benchmark) SELECT item_id, min(doc_id) AS first_doc, count(*) AS n_docs FROM b JOIN documents ON contains(lower(documents.text), k) GROUP BY 1""")
def passage_containment_rank(t) -> DataFrame:
    from sourcegrain.operators import containment

    items = t("benchmark").select("item_id", F.left(F.lower("text"), F.lit(60)).alias("needle"))
    found = containment.containing(t("documents").select("doc_id", F.lower("text").alias("text")), items, "item_id", "doc_id")
    return found.groupBy("item_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))
