"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are lower-cased, and runs of anything but letters and digits become one blank. Every word of an
item begins a block, if LEAST bytes of the item are left. A CGK walk reads a block (or, in a document,
the bytes from each word on) and copies bytes to its output, moving on or staying as a random bit
for (step, byte) says, so that few edits leave most of the output equal: edit distance becomes
Hamming distance. Tables of randomly chosen output positions (bit sampling), over several walks, find
the windows whose samples equal a block's; a passage with an unedited block is found for certain,
others with the recall that the number of tables sets. The windows are those of all words. A hit goes
on if the document holds as many of the item's GRAM-byte strings around it as any passage within EDITS
must (an edit changes GRAM of them, in bytes), and is then verified exactly, by the edit distance of
the whole item to the best-fitting stretch of the document around the hit.

Documents are scanned row by row, without a shuffle. The benchmark's tables are broadcast in shares
of at most SHARE_BYTES of text; a larger benchmark takes several scans, with the same result.

Cases: null or empty text has no passages; an item of fewer than MIN_BYTES normalised bytes is found
only where it stands word for word (edited, it would be met by chance), one without a letter or digit
not at all; items that normalise alike are found each; repeated rows are judged alike; ties between
places go to the first; empty tables give an empty table; a very long text is scanned WINDOWS words at
a time; further columns are kept as they are, but one named as the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, hand_back, id_text, mix, text_slices, words64

#: Edits allowed, as a share of the item's characters.
EDITS = 0.10
MIN_BYTES = 24
WALKS, TABLES, SAMPLES = 2, 3, 8
#: Output length of a walk: over the blocks of a long item, and of a short one.
LONG, SHORT = 48, 20
#: Bytes of an item that a block needs, by the output length of its walk.
LEAST = {LONG: 20, SHORT: 12}
SHARE_BYTES = 4 << 20
GRAM = 5
CELLS = 1 << 20
WINDOWS = 1 << 15
#: Bytes of text whose grams are hashed at once.
SLICE = 1 << 20


def normalise(texts: pa.Array) -> pa.Array:
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"[^\p{L}\p{N}]+", " "))


def _bits(walk: int, steps: int) -> np.ndarray:
    """steps x 256 random bits: whether the walk moves on from this byte at this step."""
    x = mix(np.arange(steps * 256, dtype=np.uint64) + np.uint64(walk * 1_000_003 + 17))
    return ((x >> np.uint64(11)) & np.uint64(1)).astype(np.int32).reshape(steps, 256)


def _samples(walk: int, table: int, steps: int) -> np.ndarray:
    """Which output positions a table compares."""
    x = mix(np.arange(steps, dtype=np.uint64) + np.uint64(walk * 7919 + table * 104_729 + 3))
    return np.sort(np.argsort(x, kind="stable")[:SAMPLES])


def keys(data: np.ndarray, starts: np.ndarray, steps: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each table, the sampled outputs of the walks from each start as 64-bit keys; data must go
    on for `steps` bytes after the last start."""
    for walk in range(WALKS):
        bits = _bits(walk, steps)
        chosen = [_samples(walk, t, steps) for t in range(TABLES)]
        wanted = set(np.concatenate(chosen).tolist())
        at, out = starts.astype(np.int32), {}
        for step in range(max(wanted) + 1):
            byte = data[at]
            if step in wanted:
                out[step] = byte.astype(np.uint64)
            at = at + bits[step][byte]
        for t, positions in enumerate(chosen):
            key = np.zeros(len(starts), np.uint64)
            for p in positions.tolist():
                key = (key << np.uint64(8)) | out[p]
            yield walk * TABLES + t, mix(key + np.uint64((walk * TABLES + t + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, for as many positions as have eight bytes."""
    return (mix(words64(data) & np.uint64((1 << 8 * GRAM) - 1)) >> np.uint64(32)).astype(np.uint32)


def least_shared(item: str, most: int) -> int:
    """How many of the item's byte grams stand in any passage within `most` edits of it."""
    return len(item.encode()) - GRAM + 1 - most * (GRAM - 1 + max(len(c.encode()) for c in item))


def word_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    begins = np.zeros(len(data) + 1, bool)
    begins[off[:-1]] = True
    begins[1:] |= np.append(data == 32, False)[: len(data)]
    return np.flatnonzero(begins[: len(data)])


def best_fit(item: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch of text nearest to the whole item, if within `most`
    edits; Myers' bit vectors, forwards for the end and backwards for the start."""

    def ends(pattern: str, over: str, free: bool) -> tuple[int, int]:
        n = len(pattern)
        ones, top = (1 << n) - 1, 1 << (n - 1)
        peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            peq[c] = peq.get(c, 0) | 1 << i
        pv, mv, score, best = ones, 0, n, (n, 0)
        for j, c in enumerate(over, 1):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & ones, pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = (ph << 1 | (not free)) & ones, (mh << 1) & ones
            pv, mv = mh | ~(xv | ph) & ones, ph & xv
            if score < best[0]:
                best = score, j
        return best

    distance, end = ends(item, text, True)
    if distance > most:
        return None
    back = text[max(0, end - len(item) - distance) : end][::-1]
    _, length = ends(item[::-1], back, False)
    return distance, end - length, end


class Index:
    """The blocks of the items under their table keys."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, s) for i, s in items if len(s.encode()) >= MIN_BYTES]
        self.by_steps = {}
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, s in items:
            if 0 < (n := len(s.encode())) < MIN_BYTES:
                self.short.setdefault(n, {}).setdefault(s.encode(), []).append(i)
        raws = [np.frombuffer(s.encode() + bytes(8 - GRAM), np.uint8) for _, s in self.items]
        self.size = np.array([len(s.encode()) for _, s in self.items], np.int64)
        self.most = np.array([int(EDITS * len(s)) for _, s in self.items], np.int64)
        self.need = np.array([least_shared(s, int(EDITS * len(s))) for _, s in self.items], np.int64)
        self.mask = np.uint32(max(CELLS, 1 << int(16 * sum(map(len, raws)) + 1).bit_length()) - 1)
        self.grams = np.zeros(int(self.mask) + 1, bool)
        for k, raw in enumerate(raws):
            self.grams[self.cell(np.full(1, k), grams(raw))] = True
        for steps in (LONG, SHORT):
            blocks = []
            for k, (_, s) in enumerate(self.items):
                raw = s.encode()
                if (len(raw) >= 64) != (steps == LONG):
                    continue
                blocks += [(k, j, raw) for j in range(len(raw)) if j == 0 or raw[j - 1] == 32 and j + LEAST[steps] <= len(raw)]
            if blocks:
                data = np.frombuffer(b"".join(raw + bytes(steps + 1) for _, _, raw in blocks), np.uint8)
                base = np.cumsum([0, *[len(raw) + steps + 1 for _, _, raw in blocks[:-1]]])
                starts = base + np.array([j for _, j, _ in blocks])
                all_keys = [(np.full(len(blocks), t), x, np.arange(len(blocks))) for t, x in keys(data, starts, steps)]
                x, b = np.concatenate([x for _, x, _ in all_keys]), np.concatenate([b for _, _, b in all_keys])
                order = np.argsort(x, kind="stable")
                cells = np.zeros(CELLS, bool)
                cells[x & np.uint64(CELLS - 1)] = True
                self.by_steps[steps] = x[order], b[order], cells, np.array([(k, j) for k, j, _ in blocks])

    def cell(self, k: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Where an item's gram stands in the table."""
        return gram + (k * 0x9E3779B1 & 0xFFFFFFFF).astype(np.uint32) & self.mask

    def around(self, k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where to where a row has to be looked at for item k that begins at about `at`."""
        most = self.most[k]
        return np.maximum(0, at * 16 - most - 16), at * 16 + self.size[k] + most + 48

    def near(self, hits: np.ndarray, gram: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of hits (row, item, place), those around which enough of the item's grams stand."""
        row, k, at = hits.T
        lo, hi = self.around(k, at)
        lo, hi = lo + off[row], np.minimum(hi + off[row], off[row + 1])
        enough = np.zeros(len(hits), bool)
        order = np.argsort(hi - lo, kind="stable")
        for a in range(0, len(order), 1024):
            some = order[a : a + 1024]
            pos = lo[some, None] + np.arange(max(0, int((hi - lo)[some[-1]])))
            met = self.grams[self.cell(k[some, None], gram[np.minimum(pos, len(gram) - 1)])]
            enough[some] = (met & (pos < hi[some, None])).sum(1) >= self.need[k[some]]
        return hits[enough]

    def hits(self, data: np.ndarray, off: np.ndarray) -> set[tuple[int, int, int]]:
        """(row, item, about where the item would begin, in units of 16 bytes)."""
        out: set[tuple[int, int, int]] = set()
        starts = word_starts(data, off)
        padded = np.concatenate((data, np.zeros(LONG + 1, np.uint8)))
        gram = grams(padded)
        for steps, (known, block, cells, where) in self.by_steps.items():
            for a in range(0, len(starts), WINDOWS):
                some, found = starts[a : a + WINDOWS], []
                rows = np.searchsorted(off, some, "right") - 1
                for _, x in keys(padded, some, steps):
                    maybe = np.flatnonzero(cells[x & np.uint64(CELLS - 1)])
                    lo, hi = np.searchsorted(known, x[maybe], "left"), np.searchsorted(known, x[maybe], "right")
                    n = hi - lo
                    w = np.repeat(maybe, n)
                    k, at = where[block[np.arange(len(w)) + np.repeat(lo - np.cumsum(n) + n, n)]].T
                    found.append(np.stack((rows[w], k, (some[w] - off[rows[w]] - at) // 16), 1))
                out.update(map(tuple, self.near(np.unique(np.concatenate(found), axis=0), gram, off).tolist()))
        return out


    def verbatim(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item id, start, end) of the short items that stand between blanks, in bytes of the row."""
        if not self.short:
            return
        starts, span = word_starts(data, off), SpanHash(data)
        begins = starts + (data[starts] == 32)
        rows = np.searchsorted(off, starts, "right") - 1
        for n, known in self.short.items():
            ends = begins + n
            whole = np.flatnonzero(ends <= off[rows + 1])
            whole = whole[(ends[whole] == off[rows[whole] + 1]) | (np.append(data, 32)[ends[whole]] == 32)]
            raw = np.frombuffer(b"".join(known), np.uint8)
            at = np.arange(len(known)) * n
            wanted = SpanHash(raw)(at, at + n)
            for w in whole[np.isin(span(begins[whole], ends[whole]), wanted)].tolist():
                a, b, row = int(begins[w]), int(ends[w]), int(rows[w])
                for item in known.get(data[a:b].tobytes(), ()):
                    yield row, item, a - int(off[row]), b - int(off[row])


def _items(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The normalised items, in shares of bounded size."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    shares, size = [[]], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        s = normalise(pa.array([r["text"]], pa.string()))[0].as_py()
        if size + len(s) > SHARE_BYTES:
            shares.append([])
            size = 0
        shares[-1].append((r["item_id"], s))
        size += len(s)
    return shares


_INDEX: list = []


def index_of(share: list[tuple[int, str]]) -> Index:
    """The index of a share of items, made once a worker."""
    if not _INDEX or _INDEX[0] is not share:
        _INDEX[:] = [share, Index(share)]
    return _INDEX[1]


LEAKS = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def with_leaks(docs: DataFrame, items: DataFrame, name: str = "leaks") -> DataFrame:
    """docs (with a column text) and one more column: an array of (item_id, distance, start, end), the
    places in code points of the normalised text, by item and place."""
    docs = docs.drop(name)
    lead = name
    while any(c.lower().startswith(lead.lower()) for c in docs.columns):
        lead += "_"
    out = docs
    for n, share in enumerate(_items(items)):
        shared = docs.sparkSession.sparkContext.broadcast(share)
        column = f"{lead}{n}"
        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields], f"`{column}` {LEAKS}"])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, column=column) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                plain = pa.RecordBatch.from_arrays([normalise(batch.column("text")), pa.array(np.arange(batch.num_rows))], names=["text", "row"])
                found: list[dict] = [{} for _ in range(batch.num_rows)]
                for part, off, data in text_slices(plain, SLICE):
                    texts, base = part.column("text"), part.column("row")[0].as_py()
                    for row, k, at in sorted(index.hits(data, off)):
                        item_id, item = index.items[k]
                        most, (lo, hi) = int(index.most[k]), (int(x) for x in index.around(np.int64(k), np.int64(at)))
                        raw = data[off[row] : off[row + 1]].tobytes()
                        before = raw[:lo].decode(errors="ignore")
                        fit = best_fit(item, raw[lo:hi].decode(errors="ignore"), most)
                        if fit:
                            d, a, b = fit
                            found[base + row][item_id, len(before) + a] = (d, len(before) + b)
                    for row, item_id, a, b in index.verbatim(data, off):
                        place = [len(data[off[row] : off[row] + x].tobytes().decode()) for x in (a, b)]
                        found[base + row][item_id, place[0]] = (0, place[1])
                lists = [[{"item_id": i, "distance": d, "start": a, "end": b} for (i, a), (d, b) in sorted(x.items())] for x in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, kind)], names=[*batch.schema.names, column])
            hand_back()

        out = out.mapInArrow(run, schema)
    parts = [c for c in out.columns if c not in docs.columns]
    return out.select(*docs.columns, F.array_sort(F.array_distinct(F.concat(*parts))).alias(name))


def op8_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each passage found: doc_id, item_id, distance, start_at, end_at."""
    leaks = with_leaks(id_text(docs), items).select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.item_id", "leak.distance", F.col("leak.start").alias("start_at"), F.col("leak.end").alias("end_at"))
