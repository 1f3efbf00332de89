"""What the training-data operators share: table access, scratch tables, expression helpers and
zero-copy views of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters between words: blank and code points 9 to 13.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text (null text becomes empty), all other columns cut, whatever their names."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in extra],
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once per row however often body names it."""
    return F.transform(F.array(value), body)[0]


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share. Only a session in one process may do without naming it: nobody
    else reads what it writes."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(scratch_root, "own", None) or "file://" + tempfile.mkdtemp(prefix="sourcegrain-")
        scratch_root.own = root
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        with self._own_shuffles():
            df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        del df  # else its plan, and with it the shuffle files, would outlive release()
        self.release()
        return out

    @contextlib.contextmanager
    def _own_shuffles(self) -> Iterator[None]:
        """While a table is written, Spark deletes the shuffle files of the query as it ends: they have done
        their work, and else stay until the driver happens to collect its garbage."""
        conf = self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            conf.set(CLEANUP, before)

    def release(self) -> None:
        """For what was broadcast, and where the setting above is unknown: lets Spark's cleaner see which
        plans nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Deletes a table nothing will read again; a failure to delete does no harm."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(
    batch: pa.RecordBatch, limit: int = 4 << 20, text: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about `limit` bytes of text (one row at least), each with the byte
    offsets of its rows (length n+1, from 0) and its concatenated UTF-8 bytes."""
    col = pc.fill_null(batch.column(text), "").cast(pa.large_binary())
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, len(col))
        yield batch.slice(i, j - i), off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


def hand_back() -> None:
    """Gives freed memory back to the machine; a worker that idles would else hold on to it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


C1 = np.uint64(0x9E3779B97F4A7C15)
C2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * C1
    x = x ^ (x >> np.uint64(29))
    x = x * C2
    return x ^ (x >> np.uint64(32))


def words64(data: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there on as one integer; len(data) - 7 of them."""
    n = len(data) - 7
    if n <= 0:
        return np.empty(0, np.uint64)
    raw, out = np.ascontiguousarray(data), np.empty(n, np.uint64)
    for k in range(min(8, n)):
        part = out[k::8]
        part[:] = np.frombuffer(raw, np.uint64, len(part), k)
    return out


_P = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_PI = pow(_P, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * C2)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    k, step = 1, np.uint64(base)
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * step
        step = step * step
        k += m
    return out


class SpanHash:
    """64-bit hashes of any byte spans of one buffer, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * powers(n, _P)[:n], out=self.sums[1:])
            self.back = powers(n + 1, _PI)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + mix((end - start).astype(np.uint64)))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated rows, and how many words each row has; no word
    crosses a row."""
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    inside = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.diff(np.searchsorted(s, off))
