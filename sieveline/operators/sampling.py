"""Deterministic sampling in the order of a seeded hash, splits without leakage, and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.functions import kernels as K
from sieveline.operators import ordering as O


def key(seed: int, column: str = "idx") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def sample(df: DataFrame, n: int, seed: int = 42, column: str = "idx") -> DataFrame:
    """n rows of least hash: a top-n, no full sort."""
    return df.orderBy(key(seed, column), column).limit(n)


def per_group(df: DataFrame, group: list[str], n: int, seed: int = 42, column: str = "idx") -> DataFrame:
    """n rows per group. Spark's group limit keeps n per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(key(seed, column), column)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def balanced(df: DataFrame, n: int, label: str = "label", seed: int = 42, column: str = "idx") -> DataFrame:
    """Half positives as far as there are any, the rest negatives."""
    half = per_group(df.where(F.col(label) == 1), [label], n // 2, seed, column)
    taken = half.agg(F.count("*").alias("taken"))
    rest = per_group(df.where(F.col(label) == 0), [label], n, seed, column).crossJoin(F.broadcast(taken)).where(F.col("rn") <= n - F.col("taken")).drop("taken")  # taken is one row
    return half.unionByName(rest).drop("rn")


def stratum_seed(seed: int, dataset: int = 0, split: int = 0) -> int:
    """Seeds of their own for the splits and datasets of one run."""
    return seed + split * 10_007 + dataset * 123


def extremes(df: DataFrame, column: str, share: float, n: int, least: bool = True) -> DataFrame:
    """n rows at the edge of a tail: the greatest of those at or below a percentile, or with least=False the n greatest of all."""
    if least:
        cut = O.percentiles(df, column, [share], names=["_cut"])
        df = df.crossJoin(F.broadcast(cut)).where(F.col(column) <= F.col("_cut")).drop("_cut")  # one row
    return df.orderBy(F.desc(column), "idx").limit(n)


def above(df: DataFrame, column: str, threshold: float, n: int) -> DataFrame:
    """The n greatest of the rows over a threshold."""
    return df.where(F.col(column) > threshold).orderBy(F.desc(column), "idx").limit(n)


def first_matches(df: DataFrame, condition: Column, n: int = 12, among: int = 200) -> DataFrame:
    """The first n rows that fit among the first rows by idx."""
    return df.orderBy("idx").limit(among).where(condition).orderBy("idx").limit(n)


def group_holdout(df: DataFrame, group: str, share: float, seed: int = 42) -> DataFrame:
    """Adds holdout: whole groups, max(1, share of them rounded half to even), by least hash. Groups are ranked by ranges of their hash."""
    groups = df.select(group).distinct()
    n = max(1, round(groups.count() * share))
    ranked = O.numbered(groups.withColumn("_k", key(seed, group)), ["_k", group], "_rn")
    held = ranked.where(F.col("_rn") < n).select(F.col(group).alias("_g"), F.lit(True).alias("_h"))
    return df.join(held, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("holdout", F.coalesce("_h", F.lit(False))).drop("_g", "_h")


def nonempty_splits(df: DataFrame, splits: tuple[str, ...] = ("train", "valid", "test"), column: str = "split") -> DataFrame:
    """df, or an error with the counts of all split names, null too, where one of the splits has no rows."""
    counts = {r[0]: r[1] for r in df.groupBy(column).count().collect()}  # a handful of names
    if any(not counts.get(s) for s in splits):
        raise ValueError(f"a split is empty: {counts}")
    return df


def official_splits(meta: DataFrame, valid: str = "id_val") -> DataFrame:
    """Rows in train, valid and test, by split_name or else by recoded split and centre; valid names what serves as validation."""
    if valid not in ("id_val", "val"):
        raise ValueError("valid must be id_val or val")
    if "split_name" not in meta.columns:
        if "split" not in meta.columns:
            raise ValueError("split_name or split is needed")
        center = F.col("center").cast("int") if "center" in meta.columns else F.lit(None).cast("int")
        meta = meta.withColumn("split_name", split_recode(F.col("split"), center))
    name = F.col("split_name")
    out = meta.withColumn("split", F.when(name == valid, "valid").when(name.isin("train", "test"), name))
    return nonempty_splits(out).where("split is not null")


def assigned_splits(meta: DataFrame, group: str = "patient_node", share: float = 0.1, seed: int = 42, valid: Column | None = None) -> DataFrame:
    """train, valid and test: validation rows are given (split = 1 unless said otherwise), and of the others whole groups are held out for test."""
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    valid = F.coalesce(F.col("split") == 1 if valid is None else valid, F.lit(False))
    flagged = meta.withColumn("_valid", valid)
    held = group_holdout(flagged.where("not _valid"), group, share, seed).withColumn("split", F.when(F.col("holdout"), "test").otherwise("train")).drop("holdout", "_valid")
    out = held.unionByName(flagged.where("_valid").drop("_valid").withColumn("split", F.lit("valid")))
    return nonempty_splits(out, ("train", "test"))


def split_recode(code: Column, center: Column) -> Column:
    named = F.when(code == 0, "train").when(code == 1, "id_val").when(code == 2, "test").when(code == 3, "val")
    return F.when(center == 1, "val").when(center == 2, "test").otherwise(named)


def normal_id(v: Column) -> Column:
    """Integers in canonical form, other ids trimmed."""
    return F.coalesce(F.trim(v).try_cast("bigint").cast("string"), F.trim(v))


def error_buckets(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """A row per bucket of each prediction: FP, FN, high-entropy errors and hits, confident errors; buckets overlap.

    p and 1 - p tie in entropy, and the cut may fall among them: a last bit of p or of the logarithm decides who is in."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    df = df.withColumn("y_hat", (F.col(p) >= 0.5).cast("int")).withColumn("confidence", F.greatest(F.col(p), 1 - F.col(p))).withColumn("entropy", K.entropy(q))
    tau = F.broadcast(O.percentiles(df, "entropy", [0.9], names=["tau"]))  # one row
    df = df.crossJoin(tau)
    wrong, high = F.col("y_hat") != F.col(y), F.col("entropy") >= F.col("tau")
    tags = {"FP": wrong & (F.col("y_hat") == 1), "FN": wrong & (F.col("y_hat") == 0), "high_entropy_error": wrong & high, "high_entropy_correct": ~wrong & high, "confident_error": wrong & (F.col("confidence") >= 0.9)}
    return df.withColumn("bucket", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tags.items())))))
