"""Suffix-array dedup: removes every byte covered by a 200-byte string that starts anywhere else too.

Equal strings must meet in one shard, so each 200-byte window of a document goes by its anchor: the
least hash among the 32-byte strings inside it, which equal windows share. Neighbouring windows with
one anchor form a run, about one for each 85 bytes of text.

1. Runs are counted by anchor. Where an anchor occurs once, no window of its run is repeated.
2. Equal runs (by two 64-bit hashes, of the anchor and of the run's bytes) collapse. Runs that occur
   twice or more are repeated as a whole.
3. The bytes of one representative of each run whose anchor has several different runs go to shards
   by anchor. A shard builds the suffix array of its bytes by Larsson-Sadakane refinement and the
   common prefixes by Kasai's method, both in numpy, and so finds which windows are repeated.
4. An anchor with more than RUNS different runs is spread over several shards. Each pair of these
   merges by binary search of the one's windows in the other's suffix array.
5. Repeated windows come back as byte intervals, which are united per document.

Texts are shuffled twice (to cut out representatives, and for the result), never all windows. No task
holds more than a shard; group sizes only decide how many shards there are.

Cases: null or empty text, and texts under 200 bytes, lose nothing; repeated rows are copies of each
other and lose everything from 200 bytes on; a string that recurs inside one document counts; rows
without doc_id are judged like others; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, SpanHash, id_text, mix, text_slices, words64

WINDOW, GRAM = 200, 32
DEPTH = 256  # bytes by which suffixes are ordered
#: Windows of a run at most; longer stretches with one anchor are cut, which changes no result.
LONGEST = 256
#: Runs of a shard, about 300 bytes each.
RUNS = 6000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    w = words64(data)
    n = max(0, len(data) - GRAM + 1)
    with np.errstate(over="ignore"):
        h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
        for k, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
            h += w[k : k + n] * np.uint64(c)
        return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, k = x, 1
    while 2 * k <= width:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - k : width - k + n])


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, hash of the bytes, start, windows, and whether the anchor stands twice in the run."""
    nothing = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    if len(data) < WINDOW:
        return nothing
    h = gram_hashes(data)
    least = sliding_min(h, WINDOW - GRAM + 1)
    ends = np.repeat(off[1:], np.diff(off))[: len(least)]
    v = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends)
    if not len(v):
        return nothing
    new = np.ones(len(v), bool)
    new[1:] = (np.diff(v) != 1) | (least[v[1:]] != least[v[:-1]])
    first = np.flatnonzero(new)
    inside = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
    first = np.flatnonzero(inside % LONGEST == 0)
    start, count = v[first], np.diff(np.append(first, len(v)))
    anchor = least[start]
    stop = start + count + WINDOW - 1
    # the places of anchors: where a gram's hash is the anchor of a run around it
    mask = np.uint64((1 << 22) - 1)
    cells = np.zeros(1 << 22, bool)
    cells[anchor & mask] = True
    at = np.flatnonzero(cells[h & mask])
    known = np.unique(anchor)
    code = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
    same = known[code] == h[at]
    places = np.sort((code[same].astype(np.int64) << 36) | at[same])
    mine = np.searchsorted(known, anchor).astype(np.int64) << 36
    twice = np.searchsorted(places, mine | (stop - GRAM + 1)) - np.searchsorted(places, mine | start) > 1
    return anchor, SpanHash(data)(start, stop), start, count, twice


def _found_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, off, data in text_slices(batch, 1 << 20):
            anchor, body, start, count, twice = runs(data, off)
            row = np.searchsorted(off, start, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64)), part.column("doc").take(pa.array(row)), part.column("sum").take(pa.array(row)),
                 pa.array(start - off[row]), pa.array(count.astype(np.int32)), pa.array(twice)],
                names=["anchor", "body", "doc", "sum", "start", "count", "twice"])


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first DEPTH bytes (Larsson-Sadakane: groups of equal prefixes are
    refined by the group of the suffix `h` further on, h doubling; sorted groups stay untouched), and
    the eight-byte words of the padded data."""
    n = len(data)
    words = words64(np.concatenate((data, np.zeros(DEPTH + 64, np.uint8))))
    key = words[:n].byteswap()
    order = np.argsort(key, kind="stable")
    group = np.empty(n + 1, np.int64)
    group[n] = -1
    starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    sizes = np.diff(np.append(starts, n))
    group[order] = np.repeat(starts, sizes)
    h = 8
    open_ = np.repeat(sizes > 1, sizes)
    where = np.flatnonzero(open_)
    while len(where) and h < DEPTH:
        members = order[where]
        own, next_ = group[members], group[np.minimum(members + h, n)]
        by = np.lexsort((next_, own))
        members, own, next_ = members[by], own[by], next_[by]
        order[where] = members
        new = np.append(True, (own[1:] != own[:-1]) | (next_[1:] != next_[:-1]))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(where)))
        group[members] = np.repeat(where[first], sizes)
        where = where[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order, words


def common_prefixes(order: np.ndarray, words: np.ndarray, lane: int = 64) -> np.ndarray:
    """Of each suffix and the one before it in order, the common prefix up to DEPTH bytes (Kasai: in
    text order it shrinks by one at most from suffix to suffix), for many stretches of the text at
    once. Suffixes equal in all DEPTH bytes stand in no certain order, so after these the comparison
    begins anew."""
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = -1
    out = np.zeros(n, np.int64)
    lanes = np.arange(0, n, lane)
    k = np.zeros(len(lanes), np.int64)
    for step in range(lane):
        at = lanes + step
        lanes_in = at < n
        at, k = at[lanes_in], k[lanes_in]
        k = np.where(k >= DEPTH, 0, np.maximum(k - 1, 0))
        lanes = lanes[lanes_in]
        other = before[at]
        k[other < 0] = 0
        todo = np.flatnonzero((other >= 0) & (k < DEPTH))
        while len(todo):
            diff = words[at[todo] + k[todo]] ^ words[other[todo] + k[todo]]
            equal = diff == 0
            low = diff[~equal]
            same = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64) // 8
            k[todo[~equal]] += same
            todo = todo[equal]
            k[todo] += 8
            todo = todo[k[todo] < DEPTH]
        out[at] = k
    return out[order]


class Shard:
    """The bytes of several runs, their suffix array, and which windows recur among them."""

    def __init__(self, strings: list[bytes], counts: np.ndarray):
        self.counts = counts
        self.base = np.cumsum([0, *map(len, strings)])[:-1]
        data = np.frombuffer(b"".join(strings), np.uint8)
        self.order, self.words = suffix_array(data)
        self.window = np.zeros(len(data), bool)
        for b, c in zip(self.base, counts, strict=True):
            self.window[b : b + c] = True
        kind = np.cumsum(common_prefixes(self.order, self.words) < WINDOW)
        held = self.window[self.order]
        often = np.bincount(kind[held], minlength=int(kind[-1]) + 1 if len(kind) else 1)
        self.repeated = np.zeros(len(data), bool)
        self.repeated[self.order] = held & (often[kind] > 1)

    def found_in(self, other: Shard) -> np.ndarray:
        """Which of our windows stand in the other shard too, by binary search in its order."""
        mine = np.flatnonzero(self.window)
        theirs = other.order[other.window[other.order]]
        lo, hi = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs))
        while (busy := np.flatnonzero(lo < hi)).size:
            mid = (lo[busy] + hi[busy]) // 2
            less = _compare(other.words, theirs[mid], self.words, mine[busy]) < 0
            lo[busy[less]] = mid[less] + 1
            hi[busy[~less]] = mid[~less]
        ok = lo < len(theirs)
        ok[ok] = _compare(other.words, theirs[lo[ok]], self.words, mine[ok]) == 0
        out = np.zeros(len(self.window), bool)
        out[mine[ok]] = True
        return out

    def intervals(self, repeated: np.ndarray) -> list[list[int]]:
        """For each run its stretches of repeated windows: start, end, start, end, ..."""
        out = []
        for b, c in zip(self.base, self.counts, strict=True):
            flags = np.concatenate(([False], repeated[b : b + c], [False]))
            out.append(np.flatnonzero(flags[1:] != flags[:-1]).tolist())
        return out


def _compare(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for the WINDOW bytes at each place of a against those of b."""
    out = np.zeros(len(at), np.int8)
    left = np.arange(len(at))
    for k in range(0, WINDOW, 8):
        x, y = a[at[left] + k].byteswap(), b[bt[left] + k].byteswap()
        out[left] = (x > y).astype(np.int8) - (x < y)
        left = left[x == y]
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each document."""
    for batch in batches:
        for part, off, data in text_slices(batch, 4 << 20):
            rows = []
            for r, wanted in enumerate(part.column("wanted").to_pylist()):
                raw = data[off[r] : off[r + 1]]
                rows += [(x["anchor"], x["body"], x["count"], raw[x["start"] : x["start"] + x["count"] + WINDOW - 1].tobytes()) for x in wanted]
            if rows:
                a, b, c, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(s, pa.binary())], names=["anchor", "body", "count", "string"])


_MARKED = "anchor long, body long, marks array<int>"


def _mark(frame: pd.DataFrame) -> pd.DataFrame:
    shard = Shard(frame["string"].tolist(), frame["count"].to_numpy())
    return pd.DataFrame({"anchor": frame["anchor"], "body": frame["body"], "marks": shard.intervals(shard.repeated)})


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """One pair of shards of an anchor: the windows of either that stand in the other."""
    out = []
    sides = [f for _, f in frame.groupby("salt")]
    if len(sides) == 2:
        shards = [Shard(f["string"].tolist(), f["count"].to_numpy()) for f in sides]
        for f, own, other in zip(sides, shards, shards[::-1], strict=True):
            out.append(pd.DataFrame({"anchor": f["anchor"], "body": f["body"], "marks": own.intervals(own.found_in(other))}))
    return pd.concat(out) if out else pd.DataFrame({"anchor": [], "body": [], "marks": []})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, off, data in text_slices(batch, 4 << 20):
            rows = []
            for r, gone in enumerate(part.column("gone").to_pylist()):
                raw = data[off[r] : off[r + 1]]
                keep = np.ones(len(raw) + 2, bool)
                for x in gone or ():
                    keep[x["a"] + 1 : x["b"] + 1] = False
                spans = int((keep[:-1] & ~keep[1:]).sum())
                keep = keep[1:-1]
                rows.append((len(raw), len(raw) - int(keep.sum()), spans, raw[keep].tobytes()))
            n, removed, spans, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_runs(found: DataFrame, texts: DataFrame, scratch: Scratch, per_shard: int = RUNS) -> DataFrame:
    """(doc, sum, a, b): byte intervals of repeated windows."""
    counted = found.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("body").alias("lo"), F.max("body").alias("hi"), F.max("twice").alias("twice")).where("n > 1 or twice")
    shared = scratch.save(counted.select("anchor", F.expr("lo <> hi or twice").alias("several")))
    kept = scratch.save(found.drop("twice").join(shared, "anchor"))
    scratch.drop(found)
    same = scratch.save(kept.groupBy("anchor", "body").agg(
        F.count("*").alias("n"), F.max("several").alias("several"), F.min(F.struct("doc", "sum", "start", "count")).alias("rep")))
    reps = same.where("several").select("anchor", "body", "rep.*")
    per_anchor = reps.groupBy("anchor").agg(F.count("*").alias("runs"))
    hot = scratch.save(per_anchor.where(F.col("runs") > per_shard).select("anchor", F.ceil(F.col("runs") / per_shard).cast("int").alias("salts")))
    wanted = reps.groupBy("doc", "sum").agg(F.collect_list(F.struct("anchor", "body", "start", "count")).alias("wanted"))
    strings = scratch.save(texts.join(wanted, ["doc", "sum"]).select("text", "wanted").mapInArrow(_cut, "anchor long, body long, count int, string binary"))
    shards = max(1, -(-strings.count() // per_shard))
    placed = strings.join(hot, "anchor", "left").withColumn("salt", F.when(F.col("salts").isNull(), -1).otherwise(F.expr("pmod(xxhash64(body), salts)")).cast("int"))
    shard = F.when(F.col("salts").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.col("anchor"))
    placed = placed.withColumn("shard", shard)
    marked = placed.select("shard", "salt", "anchor", "body", "count", "string").groupBy("shard", "salt").applyInPandas(_mark, _MARKED)
    pairs = placed.where("salts is not null").select(
        "anchor", "body", "count", "string", "salt",
        F.explode(F.filter(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: s != F.col("salt"))).alias("with"))
    pairs = pairs.select("anchor", "body", "count", "string", "salt", F.least("salt", "with").alias("i"), F.greatest("salt", "with").alias("j"))
    merged = pairs.groupBy("anchor", "i", "j").applyInPandas(_merge, _MARKED)
    marks = scratch.save(marked.union(merged).where(F.size("marks") > 0))
    scratch.drop(strings)
    whole = same.where("n > 1").select("anchor", "body", F.lit(None).cast("array<int>").alias("marks"))
    told = scratch.save(whole.union(marks.join(whole, ["anchor", "body"], "left_anti")))
    hits = kept.select("anchor", "body", "doc", "sum", "start", "count").join(told, ["anchor", "body"])
    pieces = F.when(F.col("marks").isNull(), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("count") + WINDOW - 1).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("marks") - 2, F.lit(2)), lambda i: F.struct(
            (F.col("start") + F.get("marks", i)).alias("a"), (F.col("start") + F.get("marks", i + 1) + WINDOW - 1).alias("b"))))
    return hits.select("doc", "sum", F.inline(pieces))


def dedup_substrings(docs: DataFrame, per_shard: int = RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes as `kept`."""
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = id_text(docs).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.crc32(F.col("text").cast("binary")).alias("sum"))
    found = scratch.save(texts.select("text", "doc", "sum").mapInArrow(_found_runs, "anchor long, body long, doc long, sum long, start long, count int, twice boolean"))
    gone = repeated_runs(found, texts, scratch, per_shard)
    gone = scratch.save(gone.groupBy("doc", "sum").agg(F.collect_list(F.struct("a", "b")).alias("gone")))
    return texts.join(gone, ["doc", "sum"], "left").select("doc_id", "text", "gone").mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
