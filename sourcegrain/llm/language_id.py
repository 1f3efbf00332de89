"""Language identification by error-correcting output codes.

Each language gets a codeword; for each bit, one binary classifier over hashed byte n-grams predicts
on which side of the bit a text's language lies. Decoding sums, over the bits, the exponential loss
of the classifiers' margins against each codeword, weighted by how reliable a bit's classifier was on
that language in training, and takes the nearest codeword. A text whose two nearest codewords lie
close together is flagged as ambiguous.

The classifiers are fitted on about SAMPLE_ROWS labelled rows (a documented bound, drawn by a hash of
text and label, in equal shares for all languages, so a rare one is there too); what reaches the driver
is one table of BUCKETS counts a language. Prediction is per row, over whole texts.

Cases: null text, or text without a letter, is `und` with score 0; with no labelled rows everything
is `und`; with one language every text with a letter gets it; ties go to the alphabetically first
language; repeated rows are judged alike; an empty table gives an empty table; a very long text is read
STRETCH bytes at a time; further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hand_back, id_text, mix, text_slices

SAMPLE_ROWS = 20_000
SAMPLE_PARTS = 8
SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 14
STRETCH, GROUP = 1 << 19, 32
SHARPNESS = 4.0
AMBIGUOUS = 0.60  # least score of a clear prediction, as a share of the way from 1 / languages to 1
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all splits of up to six languages, else the farthest apart of a
    hundred pseudo-random draws of about ten bits a doubling."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        bits = [b for b in itertools.product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, float).T
    width = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for draw in range(100):
        with np.errstate(over="ignore"):
            x = mix(np.arange(n * width, dtype=np.uint64) + np.uint64(draw * n * width + 1))
        code = np.where((x >> np.uint64(17)) & np.uint64(1), 1.0, -1.0).reshape(n, width)
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = (width - (code @ code.T)) / 2 + np.eye(n) * width
        if apart.min() > far:
            best, far = code, apart.min()
    return best


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def grams(data: np.ndarray, off: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and the bucket of each byte n-gram that begins before `upto`; letters only,
    everything else in ASCII reads as a blank, and n-grams of blanks alone do not count."""
    x = _FOLD[data].astype(np.uint32)
    rows, buckets = [], []
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    code, blank = np.zeros(len(x), np.uint32), np.ones(len(x), bool)
    shift = np.uint32(32 - 14)
    for size in range(1, max(SIZES) + 1):
        n = len(x) - size + 1
        if n <= 0:
            break
        code = code[:n] * np.uint32(257) + x[size - 1 :] + np.uint32(size == 1)
        blank = blank[:n] & (x[size - 1 :] == 32)
        ok = (row[:n] == row[size - 1 :]) & ~blank
        ok[upto:] = False
        h = ((code * np.uint32(2654435761)) ^ np.uint32(size * 0x9E3779)) * np.uint32(0x85EBCA6B) >> shift
        rows.append(row[:n][ok])
        buckets.append(h[ok].astype(np.int32))
    return np.concatenate(rows), np.concatenate(buckets)


def stretches(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All n-grams of the rows, from STRETCH bytes at a time, so that a long row needs no more memory."""
    for a in range(0, len(data), STRETCH):
        b = min(a + STRETCH + max(SIZES) - 1, len(data))
        yield grams(data[a:b], np.clip(off, a, b) - a, STRETCH)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with the bytes and offsets of their lower-cased texts."""
    for batch in batches:
        for part, _, _ in text_slices(batch, STRETCH):
            low = pa.RecordBatch.from_arrays([pc.utf8_lower(part.column("text"))], names=["text"])
            (_, off, data), = text_slices(low, 1 << 62)
            yield part, data, off
    hand_back()


def _margins(data: np.ndarray, off: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Rows x bits: the mean weight of a row's n-grams for each bit's classifier, scaled, and the bias;
    from the histograms of GROUP rows at a time, which are small enough for the processor's caches."""
    rows, out = len(off) - 1, []
    for i in range(0, rows, GROUP):
        j = min(i + GROUP, rows)
        h = np.zeros((j - i) * BUCKETS, np.int64)
        for row, bucket in stretches(data[off[i] : off[j]], off[i : j + 1] - off[i]):
            h += np.bincount(row.astype(np.int64) * BUCKETS + bucket, minlength=len(h))
        h = h.reshape(j - i, BUCKETS).astype(np.float32)
        out.append((h @ weights.T) / np.maximum(h.sum(1, keepdims=True), 1))
    return np.concatenate(out).astype(float) * SHARPNESS + bias


class Model:
    """langs, codewords, the bit classifiers' weights, and the bits' reliability for each language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        # add-one smoothed distributions a language; each side of a bit is the mean of its languages
        p = (counts + 1) / (counts + 1).sum(1, keepdims=True)
        bits = self.code.shape[1]
        self.weights = np.zeros((bits, BUCKETS), np.float32)
        for b in range(bits):
            up, down = p[self.code[:, b] > 0], p[self.code[:, b] < 0]
            if len(up) and len(down):
                self.weights[b] = np.log(up.mean(0)) - np.log(down.mean(0))
        # the bias puts the threshold half way between the mean margins of a bit's two sides
        mean = p @ self.weights.T * SHARPNESS
        up = [mean[self.code[:, b] > 0, b].min(initial=np.inf) for b in range(bits)]
        down = [mean[self.code[:, b] < 0, b].max(initial=-np.inf) for b in range(bits)]
        self.bias = np.array([-(u + d) / 2 if np.isfinite(u + d) else 0.0 for u, d in zip(up, down, strict=True)])
        self.trust = np.ones_like(self.code)

    def reliability(self, right: np.ndarray, seen: np.ndarray) -> None:
        """right: languages x bits, how many sample rows a bit's classifier got right; seen: rows."""
        self.trust = (right + 1) / (seen[:, None] + 2)

    def decode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword, and its share of the loss weights, for each row."""
        margin = np.clip(_margins(data, off, self.weights, self.bias), -4, 4)
        trust = self.trust / self.trust.sum(1, keepdims=True)
        loss = (np.exp(-margin[:, None, :] * self.code[None]) * trust[None]).sum(2)
        near = np.exp(-SHARPNESS * loss)
        near /= near.sum(1, keepdims=True)
        best = near.argmax(1)
        return best, near[np.arange(len(best)), best]


def fit(labelled: DataFrame, scratch: Scratch) -> Model | None:
    """A model from rows (text, lang), lang not null; every language has its share of the sample."""
    spark = labelled.sparkSession
    seen = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    if not seen:
        return None
    langs, quota = sorted(seen), -(-SAMPLE_ROWS // len(seen))
    index = {x: i for i, x in enumerate(langs)}
    shares = spark.createDataFrame([(x, min(1_000_003, quota * 1_000_003 // n + 1)) for x, n in seen.items()], "lang string, share long")
    draw = F.pmod(F.xxhash64("text", "lang", F.lit(7)), F.lit(1_000_003)) < F.col("share")
    sample = scratch.save(labelled.join(F.broadcast(shares), "lang").where(draw).select("text", "lang").repartition(SAMPLE_PARTS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part, data, off in _features(batches):
            which = np.array([index[x] for x in part.column("lang").to_pylist()])
            present, local = np.unique(which, return_inverse=True)
            h = np.zeros(len(present) * BUCKETS)
            for row, bucket in stretches(data, off):
                h += np.bincount(local[row] * BUCKETS + bucket, minlength=len(h))
            for k, x in zip(present.tolist(), h.reshape(-1, BUCKETS), strict=True):
                sums[k] = sums.get(k, 0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["k", "v"])

    counts = np.zeros((len(langs), BUCKETS))
    for r in sample.mapInArrow(count, "k int, v binary").toLocalIterator():
        counts[r["k"]] += np.frombuffer(r["v"])
    model = Model(langs, counts)
    shared = spark.sparkContext.broadcast(model)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        right, seen_rows = np.zeros(m.code.shape), np.zeros(len(langs))
        for part, data, off in _features(batches):
            which = np.array([index[x] for x in part.column("lang").to_pylist()])
            signs = np.sign(_margins(data, off, m.weights, m.bias))
            np.add.at(right, which, signs == m.code[which])
            np.add.at(seen_rows, which, 1)
        yield pa.RecordBatch.from_arrays([pa.array([right.tobytes()], pa.binary()), pa.array([seen_rows.tobytes()], pa.binary())], names=["right", "seen"])

    rows = sample.mapInArrow(test, "right binary, seen binary").collect()
    model.reliability(
        sum(np.frombuffer(r["right"]).reshape(model.code.shape) for r in rows), sum(np.frombuffer(r["seen"]) for r in rows))
    scratch.drop(sample)
    return model


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous and the columns in `keep`; score is 0 for `und`."""
    rows = id_text(docs, tuple(c for c in keep if c != "text")).withColumn("letters", F.rlike("text", F.lit(r"\p{L}")))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        floor = 1 / len(m.langs)
        clear = floor + AMBIGUOUS * (1 - floor) if len(m.langs) > 1 else 0.0
        for part, data, off in _features(batches):
            best, score = m.decode(data, off)
            known = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            names = [m.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(known & (score < clear)),
                 *[part.column(c) for c in keep]],
                names=["doc_id", "lang_pred", "score", "ambiguous", *keep])

    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean" + kinds)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest`; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def fit_on(docs: DataFrame) -> Model | None:
    """fit() on the rows that are labelled and not held out."""
    scratch = Scratch(docs.sparkSession, "language")
    seen = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 3, 1) & F.col("text").isNotNull())
    return fit(seen.select("text", F.col("lang").cast("string").alias("lang")), scratch)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit_on(docs))


def op3_language_id(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")
