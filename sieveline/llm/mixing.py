"""Mixing sources to target weights by pivotal dependent rounding.

Each source's share of the whole is found by filling: weights share the total, a share stops at ``CAP`` times its source's
size and the excess goes to the others by weight. Every document then has a fractional number of copies, target / source size.
Its whole part is certain; the fractional parts are rounded in pairs: two documents exchange mass, size for size, until one of
them is integral, in a direction drawn so that each keeps its expectation. The source's words stay exactly on target meanwhile.
Groups of ``FAN_IN`` documents are rounded in parallel and leave one fractional document each; those are dealt into groups
again, level by level, until one is left, which a draw decides. A source's error is thus below one document's size.

Sources are dealt into groups by a hash, so a hot source is many groups; the levels shrink by FAN_IN. Sources stay a table, however many there are: only
sums over all of them go to the driver.

Defined results: null text has size 0 and null source is a source, the last; documents of size 0 are taken or left by their own draw, and of
all-empty sources target and taken are 0; rows that repeat a doc_id are rounded one by one; draws depend on the seed, doc_id, size and the row's place in its group, which
(doc_id, text, size) alone decide, so reruns agree; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sieveline.llm import common as C
from sieveline.operators.ordering import numbered

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
FAN_IN = 4096
SEED = 20_240_601


def fill(sizes: list[float], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of total by weight, none above cap times its size."""
    share, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    rest = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                share[i] = rest * weights[i] / weight
            break
        for i in over:
            share[i] = cap * sizes[i]
        rest -= sum(share[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return share


def _draws(ids: np.ndarray, salt: int) -> np.ndarray:
    return (C.mix(C.mix(ids.astype(np.int64).view(C.U64) + C.U64(salt)) ^ C.U64(SEED)) >> C.U64(11)).astype(np.float64) / 2.0**53


def pivot(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractional parts of one group; returns them and the place of the one that is left fractional, or -1."""
    x = part.astype(float).copy()
    open_ = np.flatnonzero((x > 1e-12) & (x < 1 - 1e-12))
    x[x <= 1e-12], x[x >= 1 - 1e-12] = 0.0, 1.0
    held = -1
    for j in open_.tolist():
        if size[j] <= 0:
            x[j] = float(draw[j] < x[j])
        elif held < 0:
            held = j
        else:
            i, a, b = held, float(size[held]), float(size[j])
            up, down = min(1 - x[i], x[j] * b / a), min(x[i], (1 - x[j]) * b / a)
            move = up if draw[j] * (up + down) < down else -down
            x[i] += move
            x[j] -= move * a / b
            held = -1
            for k in (i, j):
                if 1e-9 < x[k] < 1 - 1e-9:
                    held = k
                else:
                    x[k] = round(x[k])
    return x, held


def _level(salt: int, last: bool):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "th"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        draw = _draws(group["doc_id"].fillna(-1).to_numpy(np.int64) * 31 + group["size"].to_numpy(np.int64) + np.arange(len(group)), salt)
        x, held = pivot(group["size"].to_numpy(np.float64), group["part"].to_numpy(np.float64), draw)
        if last and held >= 0:
            x[held], held = float(draw[held] < x[held]), -1
        group["part"] = x
        group["open"] = np.arange(len(group)) == held
        return group[["doc_id", "th", "src", "size", "whole", "part", "open"]]

    return run


_ROW = "doc_id long, th long, src long, size long, whole int, part double, open boolean"


def shares(sources: DataFrame, total: float, cap: float = CAP) -> float:
    """sources (size, weight): the share that each unit of weight gets while no source gets more than cap times its size; infinite where all do.

    As ``fill``, by sums over all sources in a few rounds: a source that is full at some level stays so at higher ones.
    """
    level, full = 0.0, F.lit(cap) * F.col("size")
    while True:
        over = full < F.lit(level) * F.col("weight")
        taken, open_ = sources.agg(F.sum(F.when(over, full).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not open_:
            return float("inf")
        if (total - taken) / open_ <= level:
            return level
        level = (total - taken) / open_


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Per document: doc_id, th (a hash of its text), source, size, source_size, target (its source's), copies."""
    sized = C.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "source", C.n_words(F.col("text")).alias("size")), "sized")
    found = C.stored(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).withColumn("last", F.col("source").isNull()), "sources")
    found = C.stored(numbered(found, ["last", "source"], "src").drop("last"), "numbered")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("src"), F.lit(len(weights))) + 1).cast("int"))
    found = found.withColumn("weight", weight)
    n, most, total = found.agg(F.count("*"), F.max("n"), F.sum("size")).first()
    level = shares(found, float(total or 0), cap)
    target = F.least(F.lit(cap) * F.col("size"), F.lit(level) * F.col("weight"))
    plan = found.select("source", "src", F.col("size").alias("source_size"), target.alias("target"), F.coalesce(F.try_divide(target, F.col("size").cast("double")), F.lit(0.0)).alias("rate"))
    if n <= 10_000:  # a row of some 60 bytes each
        plan = F.broadcast(plan)
    whole = F.floor(F.col("rate") + 1e-12)
    rated = sized.join(plan.withColumnRenamed("source", "_source"), sized["source"].eqNullSafe(F.col("_source"))).select(
        "doc_id", "th", "src", "size", whole.cast("int").alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("part")
    )
    most, level, done, left = most or 0, 0, None, rated
    while True:
        groups = max(1, -(-most // FAN_IN))
        keyed = left.withColumn("grp", F.pmod(F.xxhash64("doc_id", "th", F.lit(level)), F.lit(groups)).cast("int"))
        rows = C.stored(keyed.groupBy("src", "grp").applyInPandas(_level(level + 1, groups == 1), _ROW), "level")
        fixed = rows.where("not open").drop("open")
        done = fixed if done is None else done.unionByName(fixed)
        if groups == 1:
            break
        left, most, level = rows.where("open").drop("open"), groups, level + 1
    out = done.withColumn("copies", F.col("whole") + F.col("part").cast("int"))
    return out.join(plan, "src").select("doc_id", "th", "source", "size", "source_size", "target", "copies")


def mixture(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), copies, source."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: a row for each copy, none for those left out. Rows that repeat a doc_id and its text stand for one
    document, which is taken as often as they are together. Any further column is kept, whatever its name."""
    key, own, same, text, times = (C.free(docs, n) for n in ("key", "own", "same", "th", "times"))
    lowest = F.lit(-(2**63))  # null ids meet, too
    take = copies(docs).groupBy(F.coalesce("doc_id", lowest).alias(key), F.col("th").alias(text)).agg(F.sum("copies").cast("int").alias(times)).where(F.col(times) > 0)
    keyed = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), lowest)).withColumn(same, F.xxhash64("text"))
    both = keyed.join(take.hint("merge"), (F.col(own) == F.col(key)) & (F.col(same) == F.col(text))).dropDuplicates([own, same])
    return both.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
