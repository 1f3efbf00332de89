"""Operators that compare documents with each other, against brute force, and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sourcegrain.llm import components, katz_lm, line_dedup, minhash_dedup, suffix_dedup
from sourcegrain.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_line_dedup_matches_brute_force(spark, texts, nothing):
    docs = {}
    for doc, text in texts:
        if doc is not None:
            docs.setdefault(doc, text)
    out = line_dedup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    seen, gone = [], defaultdict(set)
    holders = defaultdict(list)
    for doc in sorted(docs):
        for pos, line in enumerate(docs[doc].split("\n")):
            s = set(re.findall(WORD, line.lower()))
            if len(s) < line_dedup.MIN_TOKENS:
                continue
            shared = Counter(k for w in s for k in holders[w])
            if any(100 * c >= line_dedup.THRESHOLD * (len(s) + len(seen[k]) - c) for k, c in shared.items()):
                gone[doc].add(pos)
            for w in s:
                holders[w].append(len(seen))
            seen.append(s)
    for r in out.collect():
        lines = docs[r["doc_id"]].split("\n")
        assert (r["n_lines"], r["n_removed"]) == (len(lines), len(gone[r["doc_id"]]))
        assert r["text"] == "\n".join(x for k, x in enumerate(lines) if k not in gone[r["doc_id"]])
    assert line_dedup.op4_line_dedup(nothing).count() == 0


def test_line_dedup_keeps_every_row(awkward):
    assert line_dedup.op4_line_dedup(awkward).count() == awkward.count()


def test_line_dedup_tells_rows_without_or_with_one_id_apart(spark):
    clean, other, again = "one clean line stands here\nand another one follows it", "some boiler plate line here\nwith words of its own", "some boiler plate line here\nbut a different second line"
    rows = [(None, clean), (None, other), (None, again), (None, again), (5, "five has this line alone\nsix words are in this one"), (5, "some boiler plate line here\nlast words of the second five")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed"] for r in out) == 4 and len(out) == 6
    left = Counter(x for r in out for x in r["text"].split("\n") if x)
    assert left == Counter({x for _, t in rows for x in t.split("\n")})
    assert sorted(r["n_removed"] for r in out if r["doc_id"] == 5) == [0, 1]


def test_line_dedup_removes_exact_copies_of_short_lines(spark, sf_dir):
    odd = [(90_001, "Die.\n\n \nAll rights reserved.\ndie."), (90_002, "没有空格的一行很长的文字\n\nAll rights reserved."), (90_003, "Die.\n没有空格的一行很长的文字\nDie. \n")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    lost = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in line_dedup.op4_line_dedup(docs).collect()}
    left = {90_001: (0, odd[0][1]), 90_002: (1, "没有空格的一行很长的文字\n"), 90_003: (2, "Die. \n")}
    assert lost == {k: (n, hashlib.sha256(t.encode()).hexdigest()) for k, (n, t) in left.items()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [x for r in line_dedup.dedup_lines(docs, short_copies=True).collect() for x in r["text"].split("\n") if re.search(WORD, x)]
    assert len(kept) == len(set(kept))
    assert {x for r in docs.collect() for x in (r["text"] or "").split("\n") if re.search(WORD, x) and len(set(re.findall(WORD, x.lower()))) < line_dedup.MIN_TOKENS} <= set(kept)


def shingles(text):
    w = re.findall(WORD, text.translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_minhash_matches_brute_force(awkward, texts, nothing):
    sets = {}
    for doc, text in texts:
        if doc is not None:
            sets[doc] = shingles(text)
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    for r in minhash_dedup.op9_minhash_dedup(awkward).collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert minhash_dedup.op9_minhash_dedup(nothing).count() == 0


def test_second_round_links_what_leaders_miss(spark):
    """A chain, in which the least document resembles only the second."""
    words = [f"v{k}" for k in range(300)]
    docs = [(k, " ".join(words[20 * k : 20 * k + 200])) for k in range(5)]
    out = minhash_dedup.op9_minhash_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["component_id"] for r in out.collect()} == {0}


def test_screening_keeps_similar_pairs():
    """At similarity 0.75 a pair fails the screen with a chance of about MISS."""
    for seen in (32, 64, 96, 128):
        m = minhash_dedup.least_agreement(seen)
        assert 0 < m < 0.75 * seen
        assert sum(math.comb(seen, k) * 0.75**k * 0.25 ** (seen - k) for k in range(m)) < 1e-5


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 20)] + [(50, 60), (60, 55), (70, 71)]
    out = components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()
    assert {(r["node"], r["component"]) for r in out} == {*((k, 0) for k in range(1, 21)), (60, 50), (55, 50), (71, 70)}


def removed(texts):
    raw = [t.encode() for _, t in texts]
    count = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = {}
    for (doc, _), b in zip(texts, raw, strict=True):
        keep = bytearray(b"\1" * len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                keep[i : i + 200] = bytes(200)
        spans = sum(not keep[i] and (i == 0 or keep[i - 1] == 1) for i in range(len(b)))
        out.setdefault(doc, []).append((len(b), len(b) - sum(keep), spans, hashlib.sha256(bytes(c for c, k in zip(b, keep, strict=True) if k)).hexdigest()))
    return out


@pytest.mark.parametrize("per_shard", [6000, 5])
def test_substrings_match_brute_force(awkward, texts, per_shard):
    want = removed(texts)
    got = suffix_dedup.dedup_substrings(awkward, per_shard).withColumn("kept", F.sha2("kept", 256))
    for r in got.collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) in want[r["doc_id"]]


def test_substrings_of_nothing(nothing):
    assert suffix_dedup.op7_suffix_dedup(nothing).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    data = np.concatenate((rng.integers(97, 99, 500), np.full(600, 97), rng.integers(97, 100, 300))).astype(np.uint8)
    order, words = suffix_dedup.suffix_array(data)
    raw = data.tobytes() + bytes(suffix_dedup.DEPTH)
    cut = [raw[i : i + suffix_dedup.DEPTH] for i in order]
    assert cut == sorted(cut) and sorted(order) == list(range(len(data)))
    got = suffix_dedup.common_prefixes(order, words)
    for k in range(1, len(order)):
        same = next((i for i, (x, y) in enumerate(zip(cut[k - 1], cut[k], strict=True)) if x != y), suffix_dedup.DEPTH)
        assert min(got[k], 200) == min(same, 200)


def test_katz_matches_plain_python_and_sums_to_one(awkward, texts, nothing):
    tokens = [(doc, [*re.findall(WORD, t.translate(LOWER)), "</s>"]) for doc, t in texts]
    out_of = lambda doc: doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2
    one, two, hist = Counter(), Counter(), Counter()
    for doc, w in tokens:
        if not out_of(doc):
            one.update(w)
            for v, x in zip(["<s>", *w], w, strict=False):
                two[v, x] += 1
                hist[v] += 1
    total, types = sum(one.values()), len(one)

    def discount(c):
        n = [0, *(sum(v == r for v in c.values()) for r in range(1, 7))]
        common = 6 * n[6] / n[1]
        d = {r: ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, 6)}
        return d if all(0 < x < 1 for x in d.values()) else {r: (r - 0.5) / r for r in d}

    d1, d2 = discount(one), discount(two)
    p1 = {w: d1.get(c, 1) * c / total for w, c in one.items()}
    rest = 1 - sum(p1.values())
    after = defaultdict(list)
    for (v, w), c in two.items():
        after[v].append((w, d2.get(c, 1) * c))
    alpha, factor = {}, {}
    for v, seen in after.items():
        mass = sum(m for _, m in seen)
        factor[v] = 1 / (hist[v] + 1) if hist[v] - mass < 1e-9 * hist[v] else 1 / hist[v]
        alpha[v] = (1 - mass * factor[v]) / (1 - sum(p1[w] for w, _ in seen))
    prob = lambda v, w: d2.get(two[v, w], 1) * two[v, w] * factor[v] if (v, w) in two else alpha.get(v, 1.0) * p1.get(w, rest)
    for v in ("<s>", "the", "of"):
        assert sum(prob(v, w) for w in p1) + alpha[v] * rest == pytest.approx(1)
    want = defaultdict(list)
    for doc, w in tokens:
        want[doc].append((out_of(doc), len(w), sum(one[x] > 0 for x in w), sum(math.log10((one[x] + 1) / (total + types + 1)) for x in w), sum(math.log10(prob(v, x)) for v, x in zip(["<s>", *w], w, strict=False))))
    for r in katz_lm.op10_katz_lm(awkward).collect():
        assert r["train_tokens"] == total
        assert any((r["held_out"], r["n_tokens"], r["n_known"]) == x[:3] and r["base_score"] == pytest.approx(x[3]) and r["score"] == pytest.approx(x[4]) for x in want[r["doc_id"]])
    assert katz_lm.op10_katz_lm(nothing).count() == 0


def test_pack_round_trip():
    x = [np.arange(5, dtype=np.uint64) ** 9, np.array([], np.int64), np.array([True, False]), np.linspace(0, 1, 7)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(x, katz_lm.unpack(katz_lm.pack(*x)), strict=True))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = {r["doc_id"] for r in docs.collect()}
    scratch = Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= before and now
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name in ("language_id", "line_dedup"):
            assert sum(labels.get(d) == 1 for d in before - now) <= 0.05 * len(before)
        before = now
    assert {"doc_id", "n_tokens", "ids"} <= set(docs.columns)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == before


def test_pipeline_of_odd_rows(spark, sf_dir, awkward, nothing):
    """Nulls, empty texts, repeated rows, clashing columns and long texts pass every stage."""
    plain = [r for r in awkward.collect() if r["doc_id"] is None or r["doc_id"] < 40 or r["doc_id"] > 90_000]
    long_ = (70_000, "the house and the garden of the people are here and there in the town " * 30_000, "en", "s", 1, "x", 1, 2, 3)
    docs = spark.createDataFrame([*plain, *plain, long_], awkward.schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, name).save(stage(spark, docs, sf_dir))
    rows = docs.collect()
    assert len({(r["doc_id"], r["ids_sha256"]) for r in rows}) == len(rows)
    ids = {r["doc_id"] for r in rows}
    assert {None, 70_000} <= ids and not {90_001, 90_002, 90_003, 90_004} & ids and len(ids & {90_005, 90_006, 90_007}) == 1
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
