"""Exact deduplication, overlap between corpora, and their accounting, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sieveline.operators import ordering as O, sampling as S
from sieveline.schema import ratio


def same(names: list[str], other: str = "_o_"):
    """Condition that columns equal those of the other side, whose names begin with ``other``; null equals null."""
    met = F.lit(True)
    for c in names:
        met = met & F.col(c).eqNullSafe(F.col(f"{other}{c}"))
    return met


def keep_first(df: DataFrame, key: str = "h", scope: list[str] = ("split",), order: str = "idx") -> DataFrame:
    """The row of least order per key within scope; rows without a key are copies of each other. A minimum joined back: copies meet in
    partial aggregates, not in one window."""
    names = [*scope, key]
    first = df.groupBy(*names).agg(F.min(order).alias(order)).select(*(F.col(c).alias(f"_o_{c}") for c in [*names, order]))
    return df.join(first, same([*names, order]), "left_semi")


def duplicate_groups(df: DataFrame, key: str = "h", scope: list[str] = ("split",), order: str = "idx") -> DataFrame:
    """Groups of more than one row: size, first, last and a digest of members; members themselves stay rows of df."""
    return df.groupBy(*scope, key).agg(F.count("*").alias("n"), F.min(order).alias("first_idx"), F.max(order).alias("last_idx"), F.sum(order).alias("sum_idx")).where("n > 1")


def group_members(df: DataFrame, key: str = "h", scope: list[str] = ("split",), order: str = "idx") -> DataFrame:
    """Sorted index lists of duplicate groups, for groups known to be small."""
    return df.groupBy(*scope, key).agg(F.sort_array(F.collect_list(order)).alias("members")).where("size(members) > 1")


def manifest(df: DataFrame, key: str = "h", scope: str = "split") -> DataFrame:
    """n_original, n_kept, n_removed, n_groups per scope; two partial aggregations."""
    per = df.groupBy(scope, key).agg(F.count("*").alias("n"))
    return per.groupBy(scope).agg(F.sum("n").alias("n_original"), F.count("*").alias("n_kept"), (F.sum("n") - F.count("*")).alias("n_removed"), F.count_if(F.col("n") > 1).alias("n_groups"))


def overlap(a: DataFrame, b: DataFrame, key: str = "h") -> DataFrame:
    """Rows of a whose key occurs in b."""
    return a.join(b.select(key).distinct(), key, "left_semi")


def decontaminate(a: DataFrame, b: DataFrame, key: str = "h") -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def integrity(df: DataFrame, kept: DataFrame, key: str = "h", scope: str = "split") -> DataFrame:
    """Per scope: rows, kept rows, whether no key was kept twice, and whether the rows are the kept ones and the copies of a kept key."""
    flagged = df.select(scope, key, F.lit(1).alias("o"), F.lit(0).alias("k")).unionByName(kept.select(scope, key, F.lit(0).alias("o"), F.lit(1).alias("k")))
    per = flagged.groupBy(scope, key).agg(F.sum("o").alias("o"), F.sum("k").alias("k"))
    return per.groupBy(scope).agg(
        F.sum("o").alias("n_original"), F.sum("k").alias("n_kept"), (F.max("k") <= 1).alias("unique_ok"), ((F.sum("k") == F.count("*")) & (F.min(F.col("o") - F.col("k")) >= 0)).alias("count_ok")
    )


def positions(kept: DataFrame, scope: str = "split", order: str = "idx") -> DataFrame:
    """Position of each kept row in its scope's order, from 0."""
    return O.numbered(kept, [order], "pos", [scope])


def to_raw(prepared: DataFrame, kept: DataFrame | None, scope: str = "split") -> DataFrame:
    """Rows at a position (pos) of a prepared corpus with the idx that they had in the raw one: by the map of positions, or the position itself
    without a map. Raises where the map has another number of rows in any scope."""
    if kept is None:
        return prepared.withColumn("idx", F.col("pos"))
    a = prepared.groupBy(scope).agg(F.count("*").alias("a"))
    b = kept.groupBy(scope).agg(F.count("*").alias("b"))
    if wrong := a.join(b, scope, "left").where("not a <=> b").head(1):
        raise ValueError(f"the map and the rows of {wrong[0][0]} differ in number: {wrong[0]['b']} and {wrong[0]['a']}")
    return prepared.join(kept.select(scope, "pos", "idx"), [scope, "pos"])


def sampled_overlap(a: DataFrame, b: DataFrame, n: int = 20_000, seed: int = 42, key: str = "h", tissue: str = "tissue", least: float = 0.35) -> DataFrame:
    """Overlap of samples of two corpora, of all rows and of rows with tissue on both sides: counts of b's rows and rates."""
    build = S.sample(a.select("idx", key, tissue), n, seed)
    hits = build.groupBy(key).agg(F.lit(1).alias("_any"), F.max((F.col(tissue) >= least).cast("int")).alias("_rich"))
    rows = S.sample(b.select("idx", key, tissue), n, seed).join(hits, key, "left")
    rich = F.col(tissue) >= least
    out = rows.agg(
        F.count("*").alias("n"), F.count("_any").alias("overlap"), F.count_if(rich).alias("tissue_n"), F.count_if(rich & (F.col("_rich") == 1)).alias("tissue_overlap")
    )
    return out.select("*", F.round(ratio(F.col("overlap"), F.col("n")), 6).alias("rate"), F.round(F.col("tissue_overlap") / F.greatest(F.col("tissue_n"), F.lit(1)), 6).alias("tissue_rate"))


def overlap_report(corpora: dict[str, DataFrame], key: str = "h", scope: str = "split") -> DataFrame:
    """direction, split, n_samples, n_overlap, overlap_rate of every ordered pair of corpora; rows count, not distinct keys."""
    out = None
    for x, a in corpora.items():
        for y, b in corpora.items():
            if x != y:
                seen = b.select(key).distinct().withColumn("_hit", F.lit(1))
                per = a.join(seen, key, "left").groupBy(scope).agg(F.count("*").alias("n_samples"), F.count("_hit").alias("n_overlap"))
                per = per.select(F.lit(f"{x}_vs_{y}").alias("direction"), scope, "n_samples", "n_overlap", F.round(ratio(F.col("n_overlap"), F.col("n_samples")), 6).alias("overlap_rate"))
                out = per if out is None else out.unionByName(per)
    return out
