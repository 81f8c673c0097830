"""Ordered quality gates, anomaly flags, and percentile routing over feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sieveline.functions import kernels as K, pixels as X
from sieveline.operators import ordering as O

# The gate's, the flags' and the guardrail's thresholds.
GATE = {"solid": 0.04, "black": 0.5, "tissue": 0.35}
FLAGS = {"std": 1e-6, "ratio": 0.95, "blur": 1e-3, "contrast": 0.05, "tissue": 0.2}
DRIFT = 0.03


def features(df: DataFrame, px: str = "px", side: int = 4) -> DataFrame:
    """Adds every feature of ``kernels.FEATURES`` of an array column, in one pass."""
    names = [c for c in df.columns if c not in K.FEATURES]
    return df.select(*names, K.feature_struct(px, side).alias("_f")).select(*names, "_f.*")


def planes(df: DataFrame, px: str = "px") -> DataFrame:
    """Adds the arrays gray, luma and sat."""
    return df.selectExpr("*", f"{X.gray(px)} as gray", f"{X.luma(px)} as luma", f"{X.saturation(px)} as sat")


def gate(solid: float = GATE["solid"], black: float = GATE["black"], tissue: float = GATE["tissue"]) -> Column:
    """The first failing reason, null if none fails: too little contrast, too many dark elements, too little tissue."""
    return F.when(F.col("std_gray") < solid, "solid_color").when(F.col("black") >= black, "high_black").when(F.col("tissue") < tissue, "low_tissue")


def gate_documented(solid: float = GATE["solid"], black: float = GATE["black"], tissue: float = GATE["tissue"]) -> Column:
    """The gate as reports describe it: luma instead of the channel mean, dark pixels by luma, tissue by saturation alone."""
    return F.when(F.col("std_luma") < solid, "solid_color").when(F.col("black_luma") >= black, "high_black").when(F.col("tissue_proxy") < tissue, "low_tissue")


def anomalies(legacy: bool = True) -> Column:
    """The flags that apply, in a fixed order; an image that is all white or all black has no flag of its ratios. legacy: the share of
    gray tissue is taken of all three channels' elements, so that it is a third at most."""
    white, black = F.col("min_px") >= 254 / 255, F.col("max_px") <= 1 / 255
    share = F.col("tissue_gray") / (3 if legacy else 1)
    found = {
        "zero_std": F.col("std_px") <= FLAGS["std"],
        "all_white": white,
        "all_black": black & ~white,
        "high_black_ratio": (F.col("black_strict") >= FLAGS["ratio"]) & ~white & ~black,
        "high_white_ratio": (F.col("white_strict") >= FLAGS["ratio"]) & ~white & ~black,
        "low_blur_score": F.col("blur") <= FLAGS["blur"],
        "low_contrast": F.col("std_gray") <= FLAGS["contrast"],
        "low_tissue": share < FLAGS["tissue"],
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in found.items())))


def blank_like(flags: Column) -> Column:
    """Whether any flag says that there is nothing to see."""
    return F.arrays_overlap(flags, F.array(*map(F.lit, ("zero_std", "all_white", "all_black", "high_white_ratio", "high_black_ratio"))))


def guardrail() -> Column:
    return (F.col("mean_r") < 0.08) | (F.col("pink") < 0.01) | (F.col("sat_mean") < 0.03)


def candidate(tissue: float = 0.5) -> Column:
    """Whether an image may be a reference: neither solid nor dark, and with tissue."""
    return (F.col("std_gray") >= GATE["solid"]) & (F.col("black") < GATE["black"]) & (F.col("tissue") >= tissue)


def tail(df: DataFrame, columns: list[str], q: float, by: str = "split") -> DataFrame:
    """Adds in_tail: at or below the q percentile of any column within its group; thresholds are one row per group. The columns are kept
    while their percentiles are found, so that what made them (kernels, normalisers) runs once for that and once for the result."""
    hit, narrow = F.lit(False), df.select(by, *columns).persist()
    for c in columns:
        cut = O.percentiles(narrow, c, [q], [by], [f"_{c}"]).withColumnRenamed(by, f"_by_{c}")
        df = df.join(cut, F.col(by).eqNullSafe(F.col(f"_by_{c}")), "left").drop(f"_by_{c}")
        hit = hit | F.coalesce(F.col(c) <= F.col(f"_{c}"), F.lit(False))
    return df.withColumn("in_tail", hit).drop(*(f"_{c}" for c in columns))


def balance(df: DataFrame, label: str = "label", by: str = "split", reason: Column | None = None) -> DataFrame:
    """Share of positives before and after the gate per group, and whether it moved by more than ``DRIFT``."""
    kept = (gate() if reason is None else reason).isNull()
    drift = F.abs(F.col("a") - F.col("b"))
    per = df.groupBy(by).agg(F.avg((F.col(label) >= 0.5).cast("double")).alias("b"), F.avg(F.when(kept, (F.col(label) >= 0.5).cast("double"))).alias("a"))
    return per.select(by, F.round("b", 6).alias("before"), F.round("a", 6).alias("after"), F.round(drift, 6).alias("drift"), (drift > DRIFT).alias("alert"))
