"""What several operators of this package need: scratch tables and hashing of word windows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="memgate-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, few: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    `few` is for tables of ids: they are written by no more tasks than run at a time, twice over, as files cost more than
    their rows. The files go when the session's JVM ends; discard() frees them earlier."""
    spark = df.sparkSession
    if few:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/memgate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def reread(df: DataFrame) -> DataFrame:
    """A materialized table as a frame of its own, for joins with what came from it."""
    return df.sparkSession.read.schema(df.schema).parquet(df._scratch)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hot_join(big: DataFrame, small: DataFrame, key: str, count: str) -> DataFrame:
    """big joined with small, a materialized table that has each key once and, in `count`, how many rows of big hold it.

    Keys of more than 1/256 of all rows, of which there are fewer than 256, are broadcast; so no task gets one of them whole."""
    total = small.agg(F.sum(count)).first()[0] or 0
    hot = [r[0] for r in small.filter(F.col(count) * 256 > total).select(key).collect()]
    if not hot:
        return big.join(small, key)
    rest = big.filter(~F.col(key).isin(hot)).join(small.filter(~F.col(key).isin(hot)), key)
    return rest.unionByName(big.filter(F.col(key).isin(hot)).join(F.broadcast(small.filter(F.col(key).isin(hot))), key))


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Let Arrow batches hold at most so many texts, so that a batch of long ones stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    return spark


def text_slices(batches, size: int = 1 << 21, more: int = 0):
    """(first column, texts as bytes) of Arrow batches, about `size` bytes at a time, with so many more columns; a null text is empty."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).fill_null(b"")
        total = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
            yield batch.column(0).slice(at, to - at).to_pylist(), texts.slice(at, to - at).to_pylist(), *(batch.column(2 + k).slice(at, to - at) for k in range(more))
            at = to
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and an executor's share is small."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


# ---- hashing of words and word windows, vectorised over a batch of texts

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Multipliers of the words of a window, odd 64-bit constants of well-known mixers.
STEPS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB)]
#: Texts are hashed in groups of about so many bytes, so that the arrays stay in cache.
GROUP = 1 << 18


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
        k += m
    return out


class WordHasher:
    """64-bit hashes of all words of a group of texts.

    A word's hash is a polynomial over its bytes, modulo 2**64, then mixed; it is taken from prefix sums, so no Python
    code runs per word. `values` gives each byte's value, `blank` the bytes that separate words."""

    def __init__(self, fold: np.ndarray, blank: np.ndarray):
        self.values = mix(np.arange(1, 257, dtype=U) * U(BASE))[fold]
        self.blank = blank
        self.up = self.down = np.ones(1, U)

    def __call__(self, texts: list[bytes]):
        """Hashes, starts and ends (in the joined bytes) of the words, and for each text the index of its first word, closed by the count."""
        raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        if len(self.up) < len(data):
            n = 1 << len(data).bit_length()
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        inside = ~self.blank[data]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.empty(len(data) + 1, U)
        sums[0] = 0
        np.cumsum(self.values[data] * self.up[: len(data)], dtype=U, out=sums[1:])
        words = mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U))
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=first[1:])
        return words, start, end, np.searchsorted(start, first), data


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words[i:i+size] for each i."""
    n = max(len(words) - size + 1, 0)
    out = np.zeros(n, U)
    for k in range(size if n else 0):
        out += words[k : k + n] * STEPS[k]
    return mix(out)


def groups(texts, size: int = GROUP):
    """Consecutive slices (from, to) of texts of about `size` bytes; a longer text stands alone."""
    at = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > size:
            yield at, k
            at, total = k, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
