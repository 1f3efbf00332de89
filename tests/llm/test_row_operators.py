"""Operators that judge each document by itself, or with a small model, against brute force."""

import base64
import gc
import hashlib
import math
import random
import re
import weakref
from collections import Counter
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sourcegrain.llm import bpe_transducer, decontaminate, language_id, quality_rules, secret_scan, url_filter

WORD = r"[^\x20\x09-\x0D]+"
P = pytest.importorskip("public_tokenizers")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def entropy_spans(text, base):
    out = []
    for m in re.finditer(secret_scan.CANDIDATE, text):
        c = m.group()
        if any(a in c.lower() for a in secret_scan.ALLOW) or re.match(secret_scan.UUID, c) or not re.search("[0-9]", c) or not re.search("[A-Za-z]", c):
            continue
        hits = []
        for i in range(len(c) - secret_scan.WINDOW + 1):
            w = c[i : i + secret_scan.WINDOW]
            n = sum(x.isdigit() for x in w)
            s = sum(secret_scan.weight(k) for k in Counter(w).values())
            if 0 < n < len(w) and any(set(w) <= set(chars) and s <= secret_scan.weight(len(w)) - round(bits * len(w) * secret_scan.UNIT) for _, chars, bits in secret_scan.CLASSES):
                hits.append(i)
        if hits:
            span = (m.start() + hits[0], 3, m.start() + hits[-1] + secret_scan.WINDOW)
            if not any(b[0] < span[2] and span[0] < b[2] for b in base):
                out.append(span)
    return out


def test_secrets_match_brute_force(awkward, texts, nothing):
    got = by_id(secret_scan.op1_secret_scan(awkward))
    for doc, text in texts:
        base = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        said = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        for r in got[doc]:
            assert r["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
            assert r["spans"] == said(base + entropy_spans(text, base))
    assert got[90_012][0]["n_entropy"] == 1
    assert secret_scan.op1_secret_scan(nothing).count() == 0


def test_failing_match_hides_what_it_covers(spark):
    out = secret_scan.op1_secret_scan(spark.createDataFrame([(1, "token=secret: abcdefghij")], "doc_id long, text string")).first()
    assert out["n_assign"] == 0


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("HTTP://A.Example.ORG?x://b/c", "a.example.org", "", None, "allow"), ("http://org/en/1", "org", "/en/1", "org/", "allow"),
    ("x://example.org/es/3", "example.org", "/es/3", "example.org/es/", "block"), ("x://m.example.org/en/12#t", "m.example.org", "/en/12", "example.org/en/1", "block"),
    ("x://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("x://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"), ("x://a.com/de/1?q", "a.com", "/de/1", "com/de/", "block"),
    ("x://telecom/de/1", "telecom", "/de/1", None, "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    r = url_filter.op2_url_filter(spark.createDataFrame([(1, url, "h")], "page_id long, url string, html string")).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def plain_templates(urls):
    """Template and share of each (host, path) of a list of (host, path, label), a tree at a time."""
    u = url_filter

    def tree(counts, hope):
        template = dict.fromkeys(counts, "")
        segments = {}
        for k in counts:
            parts = [x for x in k[1].split("/") if x]
            segments[k] = parts[: u.LEVELS] + (["/".join(parts[u.LEVELS :])] if len(parts) > u.LEVELS else [])
        for level in range(u.LEVELS + 1):
            kids = {}
            for k, (n, a, b) in counts.items():
                if len(segments[k]) > level:
                    x = kids.setdefault((k[0], template[k]), {}).setdefault(segments[k][level], [0, 0, 0, 0])
                    for i, v in enumerate((n, a, b, n * hope[k])):
                        x[i] += v
            names = {}
            for node, some in kids.items():
                whole = [sum(x[i] for x in some.values()) for i in range(4)]
                for seg, (n, a, b, g) in some.items():
                    name = "=" + seg
                    if len(some) >= u.FAN and len(some) >= u.SHARE * whole[0]:
                        name = "*"
                    elif len(some) > 1:
                        rest = [x - y for x, y in zip(whole, (n, a, b, g), strict=True)]
                        b1, n1 = b + u.SMOOTH * g / n, a + b + u.SMOOTH
                        b2, n2 = rest[2] + u.SMOOTH * rest[3] / rest[0], rest[1] + rest[2] + u.SMOOTH
                        pool = (b1 + b2) / (n1 + n2)
                        if abs(b1 / n1 - b2 / n2) < u.Z * math.sqrt(max(pool * (1 - pool), 1e-9) * (1 / n1 + 1 / n2)):
                            name = "+"
                    names[node, seg] = name
            template = {k: t if len(segments[k]) <= level else t + "/" + names[(k[0], t), segments[k][level]] for k, t in template.items()}
        sums = {}
        for k, (n, a, b) in counts.items():
            x = sums.setdefault((k[0], template[k]), [0, 0, 0, 0])
            for i, v in enumerate((n, a, b, n * hope[k])):
                x[i] += v
        return {k: (template[k], (sums[k[0], template[k]][2] + u.SMOOTH * sums[k[0], template[k]][3] / sums[k[0], template[k]][0]) / (sums[k[0], template[k]][1] + sums[k[0], template[k]][2] + u.SMOOTH)) for k in counts}

    own, all_ = {}, {}
    for host, path, label in urls:
        for table, k in ((own, (host, path)), (all_, ("", path))):
            x = table.setdefault(k, [0, 0, 0])
            x[0] += 1
            x[1] += label == "allow"
            x[2] += label == "block"
    a, b = (sum(x[i] for x in own.values()) for i in (1, 2))
    first = tree(all_, dict.fromkeys(all_, (b + 1) / (a + b + 2)))
    return tree(own, {k: first["", k[1]][1] for k in own})


def test_templates_match_plain_python(spark):
    rng = random.Random(4)
    urls = [f"https://h{rng.randrange(6)}.example.{rng.choice(('com', 'org', 'net'))}/{rng.choice(('en', 'de', 'fr', 'es', 'x/y/z/u/v', ''))}/{rng.randrange(400)}{rng.choice(('', '/', '?a=1'))}" for _ in range(900)] + [None, "none", "x://a.com", "https://h1.example.com/de/1"] * 2
    pages = spark.createDataFrame([(k, u, "h", "x", 1) for k, u in enumerate(urls)], "page_id long, url string, template string, salt string, hope int")
    rows = url_filter.op2_url_filter(pages).collect()
    assert len(rows) == len(urls)
    label = lambda r: next((x[3] for x in url_filter.RULES if x[0] == r["rule"]), None)
    want = plain_templates([(r["host"], r["path"], label(r)) for r in rows])
    for r in rows:
        template, share = want[r["host"], r["path"]]
        assert (r["template"], r["blocked_share"]) == (template, pytest.approx(share))
        assert r["verdict"] == (label(r) or ("block" if share >= url_filter.PURITY else "allow"))
    assert {"allow", "block"} == {r["verdict"] for r in rows if r["rule"] is None}
    assert url_filter.op2_url_filter(pages.limit(0)).count() == 0


def test_what_is_blocked_elsewhere_is_blocked_where_no_rule_is(spark):
    rows = [f"x://h{k % 7}.example.org/es/{k}" for k in range(60)] + [f"x://b.net/{x}/{k}" for k in range(9) for x in ("es", "fr")] + [f"x://c.com/fr/{k}" for k in range(20)]
    out = url_filter.op2_url_filter(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    assert {(r["path"][:4], r["verdict"]) for r in out if r["host"] == "b.net"} == {("/es/", "block"), ("/fr/", "allow")}


def test_languages(spark, awkward, nothing):
    got = language_id.op3_language_id(awkward).join(awkward.select("doc_id", "lang").distinct(), "doc_id").collect()
    clear = [r for r in got if r["doc_id"] < 90_000 and r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in clear) >= 0.9 * len(clear)
    by = {r["doc_id"]: r for r in got}
    assert {by[k]["lang_pred"] for k in (90_001, 90_002, 90_003, 90_004)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.op3_language_id(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert language_id.op3_language_id(unlabelled).first()["lang_pred"] == "und"


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 30])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert code.shape[0] == n and len({tuple(x) for x in code}) == n


@pytest.fixture(scope="module")
def codecs():
    tiktoken = pytest.importorskip("tiktoken")
    raw = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe_transducer.Codec(bpe_transducer.Tables(raw), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(awkward, texts, codecs, nothing):
    own, other = codecs
    got = by_id(bpe_transducer.op5_byte_bpe(awkward))
    for doc, text in texts:
        ids = other.encode_ordinary(text)
        assert own.decode(ids) == text
        for r in got[doc]:
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_transducer.op5_byte_bpe(nothing).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab -'s1\n", max_size=80) | st.integers(1, 400).map(lambda n: "ah" * n))
def test_bpe_of_any_text(codecs, text):
    own, other = codecs
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text


def test_codec_goes_with_its_tables():
    """A worker must not hold what one query's tasks share once other queries run in it."""
    tables = bpe_transducer.Tables(b"\n".join(base64.b64encode(bytes((i,))) + b" %d" % i for i in range(256)))
    codec = bpe_transducer.codec(tables, P.PATTERN, 10)
    assert bpe_transducer.codec(tables, P.PATTERN, 10) is codec
    assert bpe_transducer.codec(tables, P.PATTERN, 11) is not codec
    gone = weakref.ref(bpe_transducer.codec(tables, P.PATTERN, 12))
    del tables, codec
    gc.collect()
    assert gone() is None


def test_pipeline_workers_keep_no_codec(monkeypatch):
    """More workers than cores take turns at a stage's tasks; idle ones must not hold memos and tables."""
    docs, kept = mock.MagicMock(), []
    docs.sparkSession.sparkContext.broadcast = lambda x: kept.append(x) or mock.Mock(value=x)
    monkeypatch.setattr(bpe_transducer, "id_text", lambda d: mock.Mock(mapInArrow=lambda run, schema: run))
    task = corpus_pipeline.encode(None, docs, "")
    codecs = lambda: {id(x) for x in gc.get_objects() if type(x) is bpe_transducer.Codec}
    before = codecs()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", ""])], names=["doc_id", "text"])
    assert [r["n_tokens"] > 0 for out in task(iter([batch])) for r in out.to_pylist()] == [True, False]
    assert codecs() <= before
    assert all(type(x) is bytes for x in kept)


def test_bpe_of_long_texts_and_few_memos(spark, codecs, monkeypatch):
    """Texts beyond a slice pass in stretches, and memos that run over change nothing."""
    own, other = codecs
    monkeypatch.setattr(bpe_transducer, "FLUSH", 1000)
    monkeypatch.setattr(bpe_transducer, "SLICE", 3000)
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcé 's🙂\n1", k=n)) for n in (0, 10, 2999, 20_000)] + ["word " * 400_000]
    small = bpe_transducer.Codec(own.tables, P.PATTERN, 50)
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    for text, row in zip(texts, bpe_transducer._encoded(small, part, True).to_pylist(), strict=True):
        ids = other.encode_ordinary(text)
        assert row["ids"] == ids and row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_tokens_hold_where_they_meet_as_merging_says(codecs, data):
    tables = codecs[0].tables
    a, b = (data.draw(st.integers(0, len(tables.tokens) - 1)) for _ in range(2))
    assert tables.seam_holds(a, b) == (tables._merged(tables.tokens[a] + tables.tokens[b], 1 << 30) == [a, b])


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=12))
def test_utf8_machine_replaces_as_the_standard_says(raw):
    out, rest = bpe_transducer.advance(b"", raw)
    assert out + "�" * bool(rest) == raw.decode("utf-8", "replace")


def test_quality_counts_match_brute_force(awkward, texts, nothing):
    got = by_id(quality_rules.op6_quality_rules(awkward))
    for doc, text in texts:
        w = re.findall(WORD, text)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        for r in got[doc]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.op6_quality_rules(nothing).count() == 0


def test_em_matches_plain_python(spark):
    random.seed(2)
    patterns = [([random.choice((-1, 0, 1)) for _ in range(quality_rules.N_RULES)], random.randrange(1, 40)) for _ in range(12)]
    patterns = list({tuple(v): (v, n) for v, n in patterns}.values())
    got = quality_rules.fit_label_model(spark.createDataFrame(patterns, "votes array<int>, n long")).first()
    prior, good, bad = 0.8, [list(quality_rules.START) for _ in range(quality_rules.N_RULES)], [list(quality_rules.START[::-1]) for _ in range(quality_rules.N_RULES)]
    for _ in range(quality_rules.ROUNDS):
        post = []
        for v, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[j][x + 1] / bad[j][x + 1]) for j, x in enumerate(v))
            post.append(n / (1 + math.exp(-odds)))
        n_all, n_good = sum(n for _, n in patterns), sum(post)
        share = lambda mass, of, start: (mass + 3 * start) / (of + 3)
        held = lambda j, x, f: sum(f(p, n) for p, (v, n) in zip(post, patterns, strict=True) if v[j] == x)
        good, bad = (
            [[share(held(j, x, lambda p, n: p), n_good, quality_rules.START[x + 1]) for x in (-1, 0, 1)] for j in range(quality_rules.N_RULES)],
            [[share(held(j, x, lambda p, n: n - p), n_all - n_good, quality_rules.START[1 - x]) for x in (-1, 0, 1)] for j in range(quality_rules.N_RULES)])
        prior = min(0.95, max(0.05, (n_good + 4) / (n_all + 5)))
    assert got["prior"] == pytest.approx(prior) and got["good"] == pytest.approx(sum(good, [])) and got["bad"] == pytest.approx(sum(bad, []))


def test_labelled_quality_is_followed(spark):
    d = "/root/testdata/sf0.01"
    out = quality_rules.op6_quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["kept"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.9 and share[0] < 0.2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=8), st.text("abc", max_size=12))
def test_best_fit_is_the_nearest_stretch(item, text):
    d, a, b = decontaminate.best_fit(item, text, 99)
    assert d == min(distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)) == distance(item, text[a:b])


def test_leaks_exact_and_edited(spark, awkward, sf_dir, nothing):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    known = [(r["item_id"], decontaminate.normalise(pa.array([r["text"]], pa.string()))[0].as_py()) for r in items.collect()]
    random.seed(3)
    planted = []
    for k, (item, s) in enumerate(known):
        c = list(s)
        for _ in range(len(s) // 20):
            i = random.randrange(len(c))
            c[i : i + random.choice((0, 1, 1))] = random.choice(("", "x", "y"))
        planted.append((100_000 + k, "some words before.\n" + "".join(c).upper() + "!! and after", item))
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op8_decontaminate(docs, items).collect()}
    plain = {r["doc_id"]: decontaminate.normalise(pa.array([r["text"]], pa.string()))[0].as_py() for r in docs.collect()}
    assert {(doc, item) for doc, t in plain.items() for item, s in known if s in t} <= got
    assert sum((doc, item) in got for doc, _, item in planted) >= 0.9 * len(planted)
    assert all(doc in {p[0] for p in planted} or decontaminate.best_fit(dict(known)[item], plain[doc], len(dict(known)[item]) // 10) for doc, item in got)
    assert decontaminate.op8_decontaminate(nothing, items).count() == 0 and decontaminate.op8_decontaminate(docs, items.limit(0)).count() == 0


def test_leaks_of_short_items_clashing_columns_and_long_texts(spark):
    items = spark.createDataFrame([(1, "Über allem!"), (2, "12"), (3, "--"), (4, "the question that fills a long text to its end"), (5, None)], "item_id long, text string")
    long_ = "no such word here " * 120_000 + "The question, that fills a long text to its end"
    docs = spark.createDataFrame([(1, "12 über, allem 112 12", "a"), (2, "über allemal 1 2", "b"), (3, None, "c"), (4, long_, "d")], "doc_id long, text string, leaks_0 string")
    out = {r["doc_id"]: r for r in decontaminate.with_leaks(docs.withColumn("leaks", F.lit(1)), items).collect()}
    assert [tuple(x) for x in out[1]["leaks"]] == [(1, 0, 3, 13), (2, 0, 0, 2), (2, 0, 18, 20)] and out[1]["leaks_0"] == "a"
    assert out[2]["leaks"] == out[3]["leaks"] == []
    assert [(x["item_id"], x["distance"]) for x in out[4]["leaks"]] == [(4, 0)]


@pytest.mark.parametrize("least, most", [(24, 40), (40, 64), (64, 80), (80, 105), (105, 160), (160, 500)])
@pytest.mark.parametrize("spread", [True, False])
def test_leaks_of_every_length_at_the_edits_allowed(spark, least, most, spread):
    """Recall at EDITS, edits at random places and spread evenly, of passages that exact search accepts."""
    rng = random.Random(least)
    known = [(r["item_id"], decontaminate.normalise(pa.array([r["text"]], pa.string()))[0].as_py()) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    if least < 80:
        known = [(i, s[: rng.randrange(least, most)].strip()) for i, s in known]
    known = [(i, s) for i, s in known if least <= len(s) < most]
    index, found, all_ = decontaminate.Index(known), 0, 0
    for n in range(80):
        k = n % len(known)
        item, s = known[k]
        c, edits = list(s), int(decontaminate.EDITS * len(s))
        for j in [int((e + 0.5) * len(s) / edits) for e in range(edits)] if spread else rng.sample(range(len(s)), edits):
            c[j] = rng.choice("qxzjk")
        text = "before it " + "".join(c) + " and words behind it"
        raw = np.frombuffer(text.encode(), np.uint8)
        places = [at for _, x, at in index.hits(raw, np.array([0, len(raw)])) if x == k]
        spans = [index.around(np.int64(k), np.int64(at)) for at in places]
        assert decontaminate.best_fit(s, text, edits)
        found += any(decontaminate.best_fit(s, raw[a:b].tobytes().decode(errors="ignore"), edits) is not None for a, b in spans)
        all_ += 1
    assert found >= 0.9 * all_


@settings(max_examples=200, deadline=None)
@given(st.text("abcdé ", min_size=24, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.sampled_from(["", "x", "éa"])), max_size=6), st.integers(0, 40))
def test_grams_asked_for_stand_in_every_passage(item, edits, before):
    text = list(item)
    for i, x in edits:
        text[i % len(text)] = x
    passage, raw = "".join(text), item.encode()
    known = {raw[i : i + decontaminate.GRAM] for i in range(len(raw) - decontaminate.GRAM + 1)}
    over = ("z" * before + passage).encode()
    d = distance(item, passage)
    assert sum(over[i : i + decontaminate.GRAM] in known for i in range(len(over))) >= decontaminate.least_shared(item, d)
