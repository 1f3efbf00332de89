"""Language-model scoring: a Katz backoff bigram model, trained and evaluated without ever moving a
row for each token.

Tokens are numbered within batches of documents. A batch asks, once for each distinct word and word
pair it holds, the part of the model's tables that owns the pair's 64-bit hash:

1. Each batch sends its sorted distinct keys with their training counts, cut by hash range. A part
   sums them, which is the table of counts, counts the counts, and answers each batch with the whole
   corpus's count of every key asked for. One batch is told to own each seen pair.
2. The counts of counts give the Good-Turing discounts d_r for r up to LIMIT (Katz's form, in which
   larger counts stay as they are).
3. Batches sum, over the pairs they own and by first word, the discounted mass and the unigram
   probabilities of the seen second words; parts add these up to the backoff weight
   alpha(v) = (1 - sum P(w|v)) / (1 - sum P(w)) over seen w, so each history's distribution sums to
   one exactly.
4. Batches evaluate P(w|v) = d_c c(v,w) / c(v) where the pair was seen, else alpha(v) P(w).

What is unseen in the unigram table falls to one class of unknown words, which has the discounted
mass. Where no count is small enough to be discounted, one more event is reserved for the unseen.
Where the counts of counts are too few for Good-Turing (a d_r outside 0 to 1), a half is taken off
each count up to LIMIT.

All groups are bounded: a batch by BATCH bytes of text, a part by its share of the hash range. A
frequent word or pair is one key of each batch. Tables between the steps are written to the shared
folder, so lost executors cost a step's tasks.

Cases: null or empty text is one end token; repeated rows count as often as they occur; rows without
doc_id are trained on; with nothing to train on every token is unknown, with probability one; an
empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, SpanHash, id_text, lower_ascii, mix, text_slices, word_spans

LIMIT = 5
BATCH, PART = 8 << 20, 16 << 20
END, START = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BE6546B64)

_ROWS = "batch long, part long, kind string, body binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; integers lie byte plane by byte plane, so high zero bytes vanish."""
    held = [(x.dtype.str, len(x), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()) for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(held, 5))


def unpack(body: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(body)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n))
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def unsteps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)


def pairs(words: np.ndarray, first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pair keys, each token's place among them, and the word numbers of the pairs;
    a document's first token follows START, which has number len(keys)."""
    before = np.empty(len(words), np.int64)
    before[1:] = words[:-1]
    before[first] = len(keys)
    code, at = np.unique(before * (len(keys) + 1) + words, return_inverse=True)
    v, w = code // (len(keys) + 1), code % (len(keys) + 1)
    with np.errstate(over="ignore"):
        hashed = mix(np.append(keys, START)[v] * np.uint64(0x9E3779B97F4A7C15) + keys[w])
    order = np.argsort(hashed, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return hashed[order], rank[at], v[order], w[order]


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the hash ranges of the parts begin in sorted keys, and the end."""
    edges = np.array([(1 << 64) * p // parts for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    b, p, k, x = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(p, pa.int64()), pa.array(k, pa.string()), pa.array(x, pa.binary())], names=["batch", "part", "kind", "body"])


def _number_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of documents as numbers of the batch's own sorted word keys (kind docs)."""

    def flush(batch: int, docs: list[tuple]) -> pa.RecordBatch:
        ids, nameless, held, lengths = (np.concatenate([d[k] for d in docs]) for k in range(4))
        keys, words = np.unique(np.concatenate([d[4] for d in docs]), return_inverse=True)
        return _record([(batch, -1, "docs", pack(ids, nameless, held, lengths, steps(keys), words.astype(np.uint32)))])

    batch, size, docs = TaskContext.get().partitionId() << 24, 0, []
    for arrow in batches:
        for part, off, data in text_slices(arrow, 2 << 20):
            low = lower_ascii(data)
            s, e, counts = word_spans(low, off)
            words = SpanHash(low)(s, e) if len(s) else np.empty(0, np.uint64)
            ids = pc.fill_null(part.column("doc_id"), 0).to_numpy()
            nameless = pc.is_null(part.column("doc_id")).to_numpy(zero_copy_only=False)
            docs.append((ids, nameless, part.column("held").to_numpy(zero_copy_only=False).astype(bool), counts + 1, np.insert(words, np.cumsum(counts), END)))
            size += len(data) + 8 * len(ids)
            if size >= BATCH:
                yield flush(batch, docs)
                batch, size, docs = batch + 1, 0, []
    if docs:
        yield flush(batch, docs)


def ask(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch's requests (kinds words and pairs): its distinct keys and their training counts, cut by
    the parts' hash ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in batches:
            for batch, body in zip(arrow.column("batch").to_pylist(), arrow.column("body"), strict=True):
                _, _, held, lengths, keys, words = unpack(body.as_buffer())
                keys, words = unsteps(keys), words.astype(np.int64)
                first = np.cumsum(np.append(0, lengths[:-1]))
                weight = np.repeat(~held, lengths)
                asked = [("words", keys, np.bincount(words, weight, len(keys)))]
                pair_keys, at, _, _ = pairs(words, first, keys)
                asked.append(("pairs", pair_keys, np.bincount(at, weight, len(pair_keys))))
                for kind, x, n in asked:
                    cut = _cuts(x, parts)
                    rows = [(batch, p, kind, pack(steps(x[a:b]), n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                    for i in range(0, len(rows), 256):
                        yield _record(rows[i : i + 256])

    return run


_COUNTED = "batch long, part long, kind string, body binary, counts array<long>"


def _count(frame: pd.DataFrame) -> pd.DataFrame:
    """One part of the tables: sums, answers, and counts of counts (tokens, types, N_1 .. N_6)."""
    out = []
    for kind, rows in frame.groupby("kind"):
        blocks = [unpack(x) for x in rows["body"]]
        keys, n = np.concatenate([unsteps(b[0]) for b in blocks]), np.concatenate([b[1] for b in blocks]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        new = np.append(True, keys[order][1:] != keys[order][:-1])
        at = np.cumsum(new) - 1
        total = np.bincount(at, n[order]).astype(np.int64)
        seen = order[n[order] > 0]
        group = at[n[order] > 0]
        owner = np.zeros(len(keys), bool)
        owner[seen[np.append(True, group[1:] != group[:-1])[: len(group)]]] = True
        answer = np.empty(len(keys), np.int64)
        answer[order] = total[at]
        first = 0
        some = [int(total.sum()), int((total > 0).sum()), *[int((total == r).sum()) for r in range(1, LIMIT + 2)]]
        for batch, part, (x, _) in zip(rows["batch"], rows["part"], blocks, strict=True):
            last = first + len(x)
            out.append((batch, part, kind, pack(answer[first:last].astype(np.uint64), owner[first:last]), some if first == 0 else None))
            first = last
    return pd.DataFrame(out, columns=["batch", "part", "kind", "body", "counts"])


class Discount:
    """Good-Turing discounts from (tokens, types, N_1 ...), and the mass they leave."""

    def __init__(self, counts: list[int]):
        self.tokens, self.types, *n = counts
        self.rate = np.ones(LIMIT + 2)
        r = np.arange(1, LIMIT + 1)
        with np.errstate(all="ignore"):
            n = np.array(n, float)
            common = (LIMIT + 1) * n[LIMIT] / n[0]
            d = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common)
        ok = np.isfinite(d).all() and (d > 0).all() and (d < 1).all()
        self.rate[1 : LIMIT + 1] = d if ok else (r - 0.5) / r
        left = float((n[:LIMIT] * r * (1 - self.rate[1 : LIMIT + 1])).sum())
        self.scale, self.left = (1.0, left / self.tokens) if left > 0 else (self.tokens / (self.tokens + 1), 1 / (self.tokens + 1))

    def discounted(self, c: np.ndarray) -> np.ndarray:
        return self.rate[np.minimum(c, LIMIT + 1)] * c

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words with these counts; those never seen share what is left."""
        return np.where(c > 0, self.discounted(c) * self.scale / max(self.tokens, 1), self.left)


class Batch:
    """A batch's documents and the answers to its requests."""

    def __init__(self, frame: pd.DataFrame):
        kinds = dict(list(frame.sort_values("part").groupby("kind")))
        ids, self.nameless, held, lengths, keys, words = unpack(kinds["docs"]["body"].iloc[0])
        self.ids, self.held, self.lengths, self.keys, self.words = ids, held, lengths, unsteps(keys), words.astype(np.int64)
        self.first = np.cumsum(np.append(0, lengths[:-1]))
        _, self.at, self.v, self.w = pairs(self.words, self.first, self.keys)
        joined = lambda kind, k: np.concatenate([unpack(x)[k] for x in kinds[kind]["body"]])
        self.count, self.pair_count = (joined(k, 0).astype(np.int64) for k in ("words", "pairs"))
        self.owner = joined("pairs", 1)
        self.weights = None
        if "alpha" in kinds:
            self.weights = joined("alpha", 0), joined("alpha", 1)


def _masses(words: Discount, parts: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For each history of the batch, what its own seen pairs add: unigram probabilities and counts, cut by the history's part; the histories asked for are all of the batch."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = Batch(frame)
        n = len(b.keys) + 1
        own = b.owner & (b.pair_count > 0)
        v, c = b.v[own], b.pair_count[own]
        lower = np.bincount(v, words.unigram(b.count[b.w[own]]), n)
        # the counts themselves: pairs seen 1 to LIMIT times, and the sum of the larger counts
        counts = [np.bincount(v[c == r], minlength=n) for r in range(1, LIMIT + 1)]
        counts.append(np.bincount(v, np.where(c > LIMIT, c, 0), n))
        keys = np.append(b.keys, START)
        order = np.argsort(keys)
        keys, lower, counts = keys[order], lower[order], [x[order].astype(np.uint64) for x in counts]
        cut = _cuts(keys, parts)
        rows = [(frame["batch"].iloc[0], p, "mass", pack(steps(keys[a:e]), lower[a:e], *[x[a:e] for x in counts])) for p, (a, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > a]
        return pd.DataFrame(rows, columns=["batch", "part", "kind", "body"])

    return run


def _alphas(two: Discount) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Backoff weights of a part's histories, and the histories' counts (one more where no count is
    small enough to leave anything), for each batch in the order it asked."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = [unpack(x) for x in frame["body"]]
        known, at = np.unique(np.concatenate([unsteps(b[0]) for b in blocks]), return_inverse=True)
        lower, *counts = (np.bincount(at, np.concatenate([b[k] for b in blocks]).astype(float), len(known)) for k in range(1, LIMIT + 3))
        seen = [(r * x, two.rate[r]) for r, x in enumerate(counts[:LIMIT], 1)] + [(counts[LIMIT], 1.0)]
        hist, mass = sum(x for x, _ in seen), sum(x * d for x, d in seen)
        with np.errstate(all="ignore"):
            total = np.where(hist - mass < 1e-9 * hist, hist + 1, hist)
            alpha = np.where(hist > 0, (1 - mass / total) / np.maximum(1 - lower, 1e-300), 1.0)
        total = np.where(hist > 0, total, 0).astype(np.uint64)
        out, first = [], 0
        for batch, part, b in zip(frame["batch"], frame["part"], blocks, strict=True):
            last = first + len(b[0])
            out.append((batch, part, "alpha", pack(alpha[at[first:last]], total[at[first:last]])))
            first = last
        return pd.DataFrame(out, columns=["batch", "part", "kind", "body"])

    return run


def _scores(words: Discount, two: Discount) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = Batch(frame)
        order = np.argsort(np.append(b.keys, START))
        alpha, factor = np.empty(len(order)), np.zeros(len(order))
        alpha[order], total = b.weights
        factor[order] = np.divide(1.0, total, out=np.zeros(len(total)), where=total > 0)
        c = b.pair_count
        with np.errstate(divide="ignore"):
            log = np.log10(np.where(c > 0, two.discounted(c) * factor[b.v], alpha[b.v] * words.unigram(b.count[b.w])))
        base = np.log10((b.count + 1) / (words.tokens + words.types + 1))
        sums = lambda x: np.add.reduceat(x, b.first)
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(b.ids.astype(np.int64), b.nameless.astype(bool)), "held_out": b.held, "n_tokens": b.lengths,
            "n_known": sums((b.count > 0)[b.words].astype(np.int64)), "train_tokens": words.tokens, "base_score": sums(base[b.words]), "score": sums(log[b.at])})

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """Scores of all documents under the model of those whose crc32(doc_id as text) mod `mod` is not
    `rest`."""
    scratch = Scratch(docs.sparkSession, "katz")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))
    texts = id_text(docs).withColumn("held", held)
    size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = int(size // PART) + 1
    documents = scratch.save(texts.mapInArrow(_number_tokens, _ROWS))
    counted = scratch.save(documents.mapInArrow(ask(parts), _ROWS).groupBy("part").applyInPandas(_count, _COUNTED))
    sums = {r["kind"]: r for r in counted.where("counts is not null").groupBy("kind").agg(
        *[F.sum(F.get("counts", F.lit(k))).alias(f"c{k}") for k in range(LIMIT + 3)]).collect()}
    zero = [0] * (LIMIT + 3)
    words, two = (Discount([sums[k][f"c{i}"] for i in range(LIMIT + 3)] if k in sums else zero) for k in ("words", "pairs"))
    known = documents.union(counted.drop("counts"))
    masses = scratch.save(known.groupBy("batch").applyInPandas(_masses(words, parts), _ROWS))
    alphas = scratch.save(masses.groupBy("part").applyInPandas(_alphas(two), _ROWS))
    scratch.drop(masses)
    return known.union(alphas).groupBy("batch").applyInPandas(_scores(words, two), _SCORED)


def op10_katz_lm(docs: DataFrame) -> DataFrame:
    return score_documents(docs)
