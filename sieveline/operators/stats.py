"""Resampling statistics with hash-drawn weights: no row is copied per replicate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

_POISSON = np.cumsum([np.exp(-1.0) / x for x in (1, 1, 2, 6, 24, 120, 720, 5040)])  # P(N <= k), rate 1
#: Draws are (a * c + b) mod PRIME, a and b from a hash of the row, c = r * TURN mod PRIME of replicate r: independent between rows, and in pairs between replicates.
#: From one replicate to the next a draw advances by a * TURN mod PRIME, round a circle of PRIME places, here of 2**64: the remainder is left to the overflow of 64 bits.
#: A draw stands a quarter of a place past its own (_circle), and rounding moves it by under r / 2**64 of the circle, so no draw crosses a mark.
PRIME, TURN = 2**31 - 1, 1_103_515_245
#: Rows and replicates of a block, which stays in the cache.
ROWS, REPLICATES = 512, 64
_HALF, _ONE = np.uint64(1 << 63), np.float64(1.0).view(np.uint64)


def _circle(quarters: np.ndarray) -> np.ndarray:
    """Quarters of a place, below 4 * PRIME, on the circle of 2**64."""
    high, rest = np.divmod(quarters << 30, PRIME)
    return (high.astype(np.uint64) << np.uint64(32)) + (rest.astype(np.uint64) << np.uint64(32)) // np.uint64(PRIME)


def _mark(level: float) -> np.uint64:
    """The first place that, divided by PRIME, is at least the level."""
    place = int(level * PRIME) - 2
    while place / PRIME < level:
        place += 1
    return np.uint64((place << 64) // PRIME)


_MARKS = np.array([_mark(x) for x in _POISSON])
#: Marks reached, by a draw's first CELL bits, or -1 where a mark lies within.
CELL = 12
_FIRST = np.arange(1 << CELL, dtype=np.uint64) << np.uint64(64 - CELL)
_LAST = _FIRST + np.uint64((1 << 64 - CELL) - 1)
_LOW, _HIGH = (np.searchsorted(_MARKS, x, "right") for x in (_FIRST, _LAST))
_REACHED = np.where(_LOW == _HIGH, _LOW, -1).astype(float)


def row_draws(idx: str, seed: int):
    """Columns a and b of a row."""
    return [F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{k}:"), F.col(idx).cast("string"))), 1, 7), 16, 10).cast("long").alias(k) for k in "ab"]


def _signs(at: np.ndarray) -> np.ndarray:
    """-1 in the upper half of the circle, else 1; at, of 64 bits as a float is, becomes the result."""
    np.bitwise_and(at, _HALF, out=at)
    return np.bitwise_or(at, _ONE, out=at).view(np.float64)


def _counts(at: np.ndarray) -> np.ndarray:
    """How many marks each draw has reached."""
    n = _REACHED.take((at >> np.uint64(64 - CELL)).astype(np.intp))
    near = np.flatnonzero(n < 0)
    n.ravel()[near] = np.searchsorted(_MARKS, at.ravel()[near], "right")
    return n


def _partial(replicates: int, signs: bool):
    def run(batches):
        top, base = np.zeros(replicates), np.zeros(replicates)
        ahead = np.arange(REPLICATES, dtype=np.uint64)[:, None]
        for batch in batches:
            a, b = (batch.column(n).to_numpy(zero_copy_only=False) for n in "ab")
            x = batch.column("x").to_numpy(zero_copy_only=False).astype(float)
            step = a * TURN % PRIME
            start, step = _circle(4 * ((step + b) % PRIME) + 1), _circle(4 * step)
            if signs:
                start += _HALF  # draws under a half turn the sign
            for i in range(0, len(a), ROWS):
                xs, at, by = x[i : i + ROWS], start[i : i + ROWS], step[i : i + ROWS]
                steps, block = ahead * by, by * np.uint64(REPLICATES)
                for r in range(0, replicates, REPLICATES):
                    k = min(REPLICATES, replicates - r)
                    w = _signs(steps[:k] + at) if signs else _counts(steps[:k] + at)
                    top[r : r + k] += w @ xs
                    base[r : r + k] += len(xs) if signs else w.sum(axis=1)
                    at = at + block
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(top), pa.array(base)], names=["replicate", "top", "base"])

    return run


def _sums(df: DataFrame, idx: str, x: str, replicates: int, seed: int, signs: bool) -> DataFrame:
    part = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), *row_draws(idx, seed)).mapInArrow(_partial(replicates, signs), "replicate int, top double, base double")
    return part.groupBy("replicate").agg(F.sum("top").alias("top"), F.sum("base").alias("base"))


def bootstrap(df: DataFrame, x: str, idx: str = "idx", replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Mean with its 95 % percentile interval under Poisson weights; each task sends one row per replicate."""
    means = _sums(df, idx, x, replicates, seed, False).select(F.try_divide("top", "base").alias("m"))
    point = df.agg(F.avg(x).alias("estimate"))
    return point.crossJoin(means.agg(F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper")))  # one row each


def paired_drop(df: DataFrame, inside: str, outside: str, idx: str = "idx", replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Mean difference of two columns of the same rows with its 95 % interval: both means of a replicate use the same weights."""
    return bootstrap(df.withColumn("_d", F.col(inside) - F.col(outside)), "_d", idx, replicates, seed)


def sign_flip(df: DataFrame, d: str, idx: str = "idx", flips: int = 10_000, seed: int = 42) -> DataFrame:
    """Two-sided paired permutation p value of a mean difference."""
    point = df.agg(F.avg(d).alias("mean_d"), F.abs(F.sum(d)).alias("s"))
    sums = _sums(df, idx, d, flips, seed, True)
    return sums.crossJoin(F.broadcast(point)).groupBy("mean_d").agg(((F.count_if(F.abs("top") >= F.col("s") - 1e-12) + 1) / (F.count("*") + 1)).alias("p_value"))


def benjamini_hochberg(df: DataFrame, p: str = "p_value", q: float = 0.05) -> DataFrame:
    """Adjusted p values over a family of tests (a small table)."""
    m = F.count("*").over(Window.partitionBy())
    raw = df.withColumn("_a", F.col(p) * m / F.rank().over(Window.orderBy(p)))
    up = Window.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_a").over(up))).withColumn("rejected", F.col("p_adjusted") <= q).drop("_a")


def wilson(k, n, z: float = 1.96):
    """Lower and upper end of the interval of a share."""
    p = k / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def described(df: DataFrame) -> DataFrame:
    """A row a column: rows, nulls, distinct values, and of numbers their mean, least and greatest."""
    numbers = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")}
    aggs = []
    for i, c in enumerate(df.columns):
        nothing = F.lit(None).cast("double")
        mean, low, high = (F.round(F.avg(c), 4), F.min(c).cast("double"), F.max(c).cast("double")) if c in numbers else (nothing, nothing, nothing)
        aggs.append(F.struct(F.lit(c).alias("name"), F.count("*").alias("n"), (F.count("*") - F.count(c)).alias("nulls"), F.count_distinct(c).alias("n_unique"), mean.alias("mean"), low.alias("low"), high.alias("high")).alias(f"c{i}"))
    return df.agg(*aggs).select(F.explode(F.array(*(f"c{i}" for i in range(len(aggs))))).alias("r")).select("r.*")
