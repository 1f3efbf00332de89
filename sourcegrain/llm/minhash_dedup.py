"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Each document becomes its set of distinct 5-word shingles and a signature of 128 minima. Documents
   with one and the same set are one class, represented by the least doc_id, from here on.
2. Signatures are banded (32 bands of 4): at similarity 0.75 a pair shares no band with probability
   (1 - 0.75 ** 4) ** 32 = 5e-6.
3. First round: each representative is compared with the least one of each of its buckets, and keeps
   the candidate whose signature agrees most. Second round: in buckets whose members have come into
   several components, the pairs across components. Pairs inside a component can't change the
   result, so a large group of near copies costs as many pairs as it has members, not their square;
   and pairs are not made where the shingles held by no other candidate, or bit maps of the sets, rule
   the similarity out already.
4. A candidate pair is compared 32 minima at a time; it is dropped once the posterior probability of
   similarity >= 0.75 (uniform prior) is under MISS. Survivors are confirmed on their full sets.
5. Components of the confirmed links, by star contractions.

Nothing but counts reaches the driver. Buckets and classes are joined by plain equi-joins that
adaptive execution may split; no task holds a whole bucket.

Cases: null or empty text, or text without a word, has an empty set and links with nothing; fewer
than five words are one shingle, of that length; repeated rows fall into one class; rows that share
a doc_id count as one document; a row without doc_id is linked with nothing, its component is null
and it is kept; ties between leaders go to the least doc_id; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, SpanHash, id_text, lower_ascii, mix, text_slices, word_spans
from .components import components

WIDTH = 5
SHARE = 75  # percent: intersection against union
HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
STEP = 32
MISS = 1e-6

#: Bits of the maps that bound how many shingles two sets share.
MAP_BITS = 1024
_MAP = [f"m{k}" for k in range(MAP_BITS // 64)]

_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64))


def least_agreement(seen: int, miss: float = MISS) -> int:
    """Fewest of `seen` minima that must agree for P(similarity >= 0.75 | agreement) >= miss; the
    posterior of a uniform prior is a binomial sum."""
    t, total = SHARE / 100, 0.0
    for m in range(seen + 1):
        total += math.comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
        if total >= miss:
            return m
    return seen


def shingles(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    low = lower_ascii(data)
    s, e, counts = word_spans(low, off)
    with np.errstate(over="ignore"):
        words = SpanHash(low)(s, e) if len(s) else np.empty(0, np.uint64)
        n = len(words) - WIDTH + 1
        whole = np.zeros(max(n, 0), np.uint64)
        for k in range(WIDTH):
            whole = mix(whole + words[k : k + max(n, 0)] * np.uint64(2 * k + 3))
        at = 0
        for c in counts.tolist():
            if c >= WIDTH:
                yield np.unique(whole[at : at + c - WIDTH + 1])
            elif c:
                x = np.uint64(c)
                for w in words[at : at + c]:
                    x = mix(x * np.uint64(31) + w)
                yield np.array([x], np.uint64)
            else:
                yield np.empty(0, np.uint64)
            at += c


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x HASHES minima; the sets must not be empty."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            out[:, j] = np.minimum.reduceat((x * _A[j] + _B[j]) >> np.uint64(32), starts)
    return out


def _class(x: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([mix(x + np.uint64(5)).sum(), mix(x ^ np.uint64(0xA5A5A5A5)).sum() + np.uint64(len(x))], np.uint64).tobytes()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, off, data in text_slices(batch, 2 << 20):
            sets = list(shingles(data, off))
            full = [i for i, x in enumerate(sets) if len(x)]
            sigs = signature([sets[i] for i in full]) if full else []
            by = dict(zip(full, sigs, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([_class(x) if len(x) else None for x in sets], pa.binary()),
                 pa.array([by[i].tobytes() if i in by else None for i in range(len(sets))], pa.binary())],
                names=["doc_id", "n_shingles", "class", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, off, data in text_slices(batch, 2 << 20):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([x.tobytes() for x in shingles(data, off)], pa.binary())], names=["node", "hashes"])


_LEAST = [(k, least_agreement(k)) for k in range(STEP, HASHES + 1, STEP)]


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that sequential comparison leaves, with how many minima agree."""
    for batch in batches:
        rows = np.arange(batch.num_rows)
        agree = np.zeros(batch.num_rows, np.int64)
        if len(rows):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            for k, least in _LEAST:
                agree[rows] += (x[rows, k - STEP : k] == y[rows, k - STEP : k]).sum(1)
                rows = rows[agree[rows] >= least]
        kept = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept), pa.array(agree[rows], pa.int64())], names=["a", "b", "agree"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= SHARE * (len(x) + len(y) - both):
                rows.append(i)
        kept = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])


def _screen(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    sig = reps.select("node", "sig")
    left = pairs.join(sig.toDF("a", "sig_a"), "a")
    return left.join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_plausible, "a long, b long, agree long")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = pairs.select("a", "b").join(sets.toDF("a", "x"), "a")
    return left.join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_confirmed, "a long, b long")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, raw in zip(batch.column("node").to_pylist(), batch.column("hashes"), strict=True):
            x = np.frombuffer(raw.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), node))], names=["hash", "node"])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set as a map of MAP_BITS bits, one for each shingle's hash."""
    for batch in batches:
        out = np.zeros((batch.num_rows, MAP_BITS // 64), np.uint64)
        for i, raw in enumerate(batch.column("hashes")):
            x = np.frombuffer(raw.as_buffer(), np.uint64) % np.uint64(MAP_BITS)
            np.bitwise_or.at(out[i], (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array(out[:, k].view(np.int64)) for k in range(out.shape[1])]], names=["node", *_MAP])


def _own_shingles(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, own, map): how many shingles of a node none of the other nodes placed has, and its bit map.
    Two sets can't share more than either has besides its own, nor more than either has besides those
    whose bits the other lacks: exact bounds that spare heavily edited copies of a large group most of
    their comparisons. Doc_ids with several texts go without."""
    one = sets.groupBy("node").agg(F.count("*").alias("k")).where("k = 1").select("node")
    held = sets.join(placed.select("node").distinct(), "node", "left_semi").mapInArrow(_explode, "hash long, node long")
    lone = held.groupBy("hash").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
    own = lone.groupBy("node").agg(F.count("*").cast("int").alias("own"))
    maps = sets.join(placed.select("node").distinct(), "node", "left_semi").mapInArrow(_maps, "node long, " + ", ".join(f"{c} long" for c in _MAP))
    return maps.join(own, "node", "left").join(one, "node", "left_semi")


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = id_text(docs)
    rows = scratch.save(texts.mapInArrow(_summaries, "doc_id long, n_shingles long, class binary, sig binary"))
    named = rows.where("class is not null and doc_id is not null")
    reps = scratch.save(named.groupBy("class").agg(
        F.min("doc_id").alias("node"), F.max("n_shingles").cast("int").alias("n"), F.max("sig").alias("sig")))

    bands = F.array(*[F.xxhash64(F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS), F.lit(b)) for b in range(BANDS)])
    banded = reps.select("node", "n", F.explode(bands).alias("band"))
    leads = scratch.save(banded.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("band", "lead"))
    members = scratch.save(banded.join(leads, "band").select("band", "lead", "node", "n"))
    scratch.drop(leads)

    # the full sets of all representatives that share a bucket with another
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = scratch.save(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "node long, hashes binary"))

    led = members.where("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    first = _screen(led, reps).groupBy("b").agg(F.max(F.struct(F.col("agree"), -F.col("a"))).alias("best"))
    tried = scratch.save(first.select((-F.col("best.col2")).alias("a"), "b"))
    links = scratch.save(_confirm(tried, sets))
    found = scratch.save(components(links.toDF("u", "v"), scratch))

    # buckets that hold several components: all pairs across them, but for those compared already
    placed = members.join(found, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("comp"))
    parts = placed.groupBy("band", "comp").agg(F.count("*").alias("size"))
    open_ = scratch.save(parts.groupBy("band").agg(F.max(F.struct("size", "comp")).alias("most"), F.count("*").alias("parts"))
                         .where("parts > 1").select("band", F.col("most.comp").alias("main")))
    placed = scratch.save(placed.join(open_, "band"))
    placed = placed.join(_own_shingles(placed, sets), "node", "left").withColumn("free", F.col("n") - F.coalesce("own", F.lit(0)))
    placed = scratch.save(placed.where(f"100 * free >= {SHARE} * n").drop("own"))
    minor = placed.where("comp <> main").select("band", F.col("node").alias("p"), F.col("n").alias("np"), F.col("free").alias("fp"), F.col("comp").alias("cp"), *[F.col(m).alias("p" + m) for m in _MAP])
    other = placed.select("band", F.col("node").alias("q"), F.col("n").alias("nq"), F.col("free").alias("fq"), F.col("comp").alias("cq"), "main", *[F.col(m).alias("q" + m) for m in _MAP])
    lacks = lambda x, y: "coalesce(" + " + ".join(f"bit_count({x}{m} & ~{y}{m})" for m in _MAP) + ", 0)"
    most = f"least(fp, fq, np - {lacks('p', 'q')}, nq - {lacks('q', 'p')})"
    across = minor.join(other, "band").where(
        f"cp <> cq and (cq = main or p < q) and 100 * least(fp, fq) >= {SHARE} * (np + nq - least(fp, fq)) and 100 * {most} >= {SHARE} * (np + nq - {most})")
    pairs = across.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = scratch.save(_confirm(scratch.save(_screen(pairs, reps)), sets))
    final = components(links.union(more).toDF("u", "v"), scratch)

    nodes = scratch.save(reps.select("class", "node").join(final, "node", "left").select("class", F.coalesce("component", "node").alias("component")))
    out = rows.select("doc_id", "n_shingles", "class").join(nodes, "class", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_minhash_dedup(docs: DataFrame) -> DataFrame:
    return link_documents(docs)
