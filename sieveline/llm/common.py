"""Helpers that the operators of this subpackage share: scratch tables, word boundaries, rolling hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word is a maximal run of bytes other than space, tab, LF, VT, FF, CR (as ``[^\x20\x09-\x0D]+``).
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are hashed in pieces of about so many bytes, which bounds a worker's arrays; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20

U64 = np.uint64
_BYTE_BASE, _WORD_BASE = U64(0x9E3779B97F4A7C55), U64(0xD6E8FEB86659FD93)
OTHER_BASE = U64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- scratch tables
def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        made = getattr(spark, "_sieveline_scratch", None)
        if made is None:
            made = spark._sieveline_scratch = f"file://{tempfile.mkdtemp(prefix='sieveline-')}"
            atexit.register(shutil.rmtree, made.removeprefix("file://"), ignore_errors=True)
        root = made
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/sieveline-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that later stages don't depend on its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sieveline_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: all that came from them is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._sieveline_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(df: DataFrame, size: int = 256 << 20) -> int:
    """Into how many ranges to deal df: the shuffle partitions, or more where the plan knows that df has more than ``size`` bytes for each
    (as text; files are taken to hold it three times packed)."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(partitions(df.sparkSession), -(-3 * known // size) if known < 1 << 60 else 1)


def n_words(text):
    """Column: number of words of a text, 0 for null."""
    trimmed = F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(
        F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+")).cast("long")
    )


def least_hashed(rows: DataFrame, by: str, n: int) -> DataFrame:
    """At most n rows, those of least hash of ``by``. Only rows under a bound that some 2 n + 100 of all are expected to
    meet are ranked, so what the tasks send to be merged is bounded together and doesn't grow with their number."""
    total = rows.count()
    if total > 2 * n + 100:
        rows = rows.where(F.xxhash64(by) < F.lit(int((2 * n + 100) / total * 2.0**64) - 2**63))
    return rows.orderBy(F.xxhash64(by), by).limit(n)


# ---------------------------------------------------------------- workers
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def thrifty(kernel: Callable) -> Callable:
    """A kernel of batches that gives freed memory back after each batch and at its end: a worker is used again by later
    stages, and would hold the most that any stage before needed."""

    def fed(batches):
        for batch in batches:
            yield batch
            del batch
            give_back()

    def run(batches):
        give_back()
        yield from kernel(fed(batches))
        give_back()

    return run


# ---------------------------------------------------------------- texts as bytes
def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column one after another, and where each begins (n + 1 offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a 64-bit value over all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(10, int(n).bit_length())
        have = np.ones(size, U64)
        have[1:] = base
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


_inverse: dict[int, np.uint64] = {int(_WORD_BASE): U64(pow(int(_WORD_BASE), -1, 1 << 64))}


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of all documents, and each document's first word (n + 1 offsets)."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = len(data) > 0 and inside[0], len(data) > 0 and inside[-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut  # a word ends where its document does
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BYTE_BASE) -> np.ndarray:
    """A 64-bit Rabin-Karp hash of each word's bytes, mixed; another odd base makes another, independent hash."""
    if not len(starts):
        return np.zeros(0, U64)
    length = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(length[:-1], out=first[1:])
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    source = place + np.repeat(starts, length)
    value = (data[source].astype(U64) + U64(1)) * powers(base, int(length.max()))[place]
    return mix(np.add.reduceat(value, first) + length.astype(U64))


class Rolling:
    """Rabin-Karp hashes of word ranges: prefix sums of word hash times a power of the base."""

    def __init__(self, hashes: np.ndarray, seed: int = 0):
        if seed:
            hashes = mix(hashes ^ U64(seed))
        self.n = len(hashes)
        self.total = np.zeros(self.n + 1, U64)
        np.cumsum(hashes * powers(_WORD_BASE, self.n), out=self.total[1:])

    def ranges(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words first..last-1; equal word sequences have equal hashes wherever they stand."""
        back = powers(_inverse[int(_WORD_BASE)], self.n + 1)[first]
        return mix((self.total[last] - self.total[first]) * back + (last - first).astype(U64))

    def windows(self, width: int) -> np.ndarray:
        n = self.n - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        back = powers(_inverse[int(_WORD_BASE)], n)
        return mix((self.total[width:] - self.total[:n]) * back + U64(width))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
