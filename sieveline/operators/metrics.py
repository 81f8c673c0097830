"""Classification and calibration metrics over prediction tables, grouped by any columns.

Rank metrics aggregate by distinct score and take running sums by ranges of scores, so that no task sees all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.operators import ordering as O
from sieveline.schema import ratio

GRID = 60


def _by_score(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    return df.groupBy(*by, p).agg(F.sum(F.col(y).cast("double")).alias("tp"), F.count("*").cast("double").alias("n"))


def roc_auc(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Mann-Whitney with ties as halves; null for one class."""
    per = _by_score(df, by, y, p).withColumn("neg", F.col("n") - F.col("tp"))
    per = O.running(per, [p], {"upto": "neg"}, by)
    wins = F.sum(F.col("tp") * (F.col("upto") - F.col("neg") / 2))
    return per.groupBy(*by).agg(F.round(F.try_divide(wins, F.sum("tp") * F.sum("neg")), 6).alias("roc_auc"))


def cumulative(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Per distinct score, from the greatest: tp, n, and the positives (c_tp) and rows (c_n) at or above it; recall and its step from the score before."""
    per = _by_score(df, by, y, p).withColumn("_down", -F.col(p))
    per = O.running(per, ["_down"], {"c_tp": "tp", "c_n": "n"}, by).drop("_down")
    all_ = per.groupBy(*by).agg(F.sum("tp").alias("_all")).select(*(F.col(c).alias(f"_by_{c}") for c in by), "_all")
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    both = per.join(all_, met) if by else per.crossJoin(F.broadcast(all_))  # one row without groups
    return both.withColumn("recall", F.try_divide("c_tp", "_all")).withColumn("step", F.try_divide("tp", "_all")).drop("_all", *(f"_by_{c}" for c in by))


def average_precision(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    per = cumulative(df, by, y, p)
    return per.groupBy(*by).agg(F.round(F.sum(F.col("step") * F.col("c_tp") / F.col("c_n")), 6).alias("average_precision"))


def average_rank(df: DataFrame, by: list[str] = (), p: str = "p") -> DataFrame:
    """Adds r: the mean of the places that rows of one score take."""
    per = df.groupBy(*by, p).agg(F.count("*").alias("_n"))
    per = O.running(per, [p], {"_c": "_n"}, by)
    per = per.select(*by, p, (F.col("_c") - F.col("_n") + 1 + (F.col("_n") - 1) / F.lit(2.0)).alias("r"))
    return df.join(per, [*by, p])


def confusion(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    hit, real = F.col(p) >= threshold, F.col(y) == 1
    return df.groupBy(*by).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))


def class_metrics(df: DataFrame, by: list[str] = (), **kw) -> DataFrame:
    c = confusion(df, by, **kw)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    pr, rc, sp = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    out = {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": pr, "recall": rc, "specificity": sp, "f1": ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (rc + sp) / 2}
    return c.select(*by, *(F.round(v, 6).alias(k) for k, v in out.items()))


def matthews(df: DataFrame, by: list[str] = (), **kw) -> DataFrame:
    """Correlation of decision and label, 0 where it isn't defined."""
    c = confusion(df, by, **kw)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(*by, F.round(F.coalesce(F.try_divide(tp * tn - fp * fn, spread), F.lit(0.0)), 6).alias("mcc"))


def brier_logloss(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    return df.groupBy(*by).agg(F.round(F.avg((q - F.col(y)) * (q - F.col(y))), 6).alias("brier"), F.round(F.avg(loss), 6).alias("log_loss"))


def ece_bins(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p", bins: int = 15) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins).cast("int"), F.lit(bins - 1))
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))


def all_bins(df: DataFrame, bins: int = 15, **kw) -> DataFrame:
    """Every bin, empty ones with null means."""
    found = ece_bins(df, bins=bins, **kw)
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"))


def ece(df: DataFrame, by: list[str] = (), **kw) -> DataFrame:
    per = ece_bins(df, by, **kw)
    return per.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"))


def temperatures(grid: int = GRID, low: float = 0.2, high: float = 5.0) -> list[float]:
    return [low * (high / low) ** (i / (grid - 1)) for i in range(grid)]


def _losses(ts: list[float], by: int):
    """Sums over the rows of each group of the loss at every temperature; one row a group and task."""
    grid = np.array(ts)

    def run(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            z, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("z", "y"))
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(by)), strict=True)) if by else None
            places = {}
            for i, k in enumerate(keys or ()):
                places.setdefault(k, []).append(i)
            for k, at in places.items() if by else [((), np.arange(len(z)))]:
                for a in range(0, len(at), 4096):
                    own = np.asarray(at[a : a + 4096])
                    zz, yy = z[own], y[own]
                    ok = ~(np.isnan(zz) | np.isnan(yy))
                    with np.errstate(over="ignore"):
                        q = np.clip(1 / (1 + np.exp(-zz[ok, None] / grid)), 1e-7, 1 - 1e-7)
                    part = -np.log(np.where(yy[ok, None] == 1, q, 1 - q)).sum(axis=0)
                    held = sums.setdefault(k, [np.zeros(len(grid)), 0])
                    held[0] += part
                    held[1] += int(ok.sum())
        for k, (total, n) in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v], batch.schema.field(i).type) for i, v in enumerate(k)), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=[*batch.schema.names[:by], "sums", "rows"])

    return run


def temperature_losses(df: DataFrame, by: list[str] = (), y: str = "y", z: str = "z", grid: int = GRID, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """by, i, t, nll: mean loss of every temperature of the grid, in one pass; each task sends one row a group."""
    ts = temperatures(grid, low, high)
    rows = df.select(*by, F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema) if by else ""
    parts = rows.mapInArrow(_losses(ts, len(by)), f"{head}sums array<double>, rows long")
    flat = parts.select(*by, "rows", F.posexplode("sums").alias("i", "s")).groupBy(*by, "i").agg((F.sum("s") / F.sum("rows")).alias("nll"))
    return flat.select(*by, "i", F.element_at(F.array(*map(F.lit, ts)), F.col("i") + 1).alias("t"), "nll")


def fit_temperature(df: DataFrame, by: list[str] = (), y: str = "y", z: str = "z", grid: int = GRID) -> DataFrame:
    """The grid's temperature of least mean loss, the smaller on ties; raw_nll is the loss without scaling."""
    best = F.min(F.struct(F.round("nll", 9).alias("nll"), "i", "t"))
    fitted = temperature_losses(df, by, y, z, grid).groupBy(*by).agg(best.alias("b"))
    return fitted.select(*by, F.round("b.t", 6).alias("temperature"), F.round("b.nll", 6).alias("nll"))


def raw_loss(df: DataFrame, by: list[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    """Mean loss at temperature 1."""
    q = F.least(F.greatest(1 / (1 + F.exp(-F.col(z))), F.lit(1e-7)), F.lit(1 - 1e-7))
    return df.groupBy(*by).agg(F.round(F.avg(-F.log(F.when(F.col(y) == 1, q).otherwise(1 - q))), 6).alias("raw_nll"))


def transfer(df: DataFrame, arm: str, test: str, metric: str, inside: str, outside: str, lower_is_better: bool = False) -> DataFrame:
    """Pivoted metric with its absolute and relative drop from inside to outside; null where either is missing."""
    wide = df.groupBy(arm).pivot(test, [inside, outside]).agg(F.first(metric))
    a, b = F.col(str(inside)), F.col(str(outside))
    drop = b - a if lower_is_better else a - b
    return wide.select(arm, F.round(a, 6).alias("inside"), F.round(b, 6).alias("outside"), F.round(drop, 6).alias("drop_abs"), F.round(drop / (F.abs(a) + 1e-8), 6).alias("drop_rel"))


def summary(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """One row a group: n, AUC, average precision, Brier score, log loss and ECE."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"))
    for part in (roc_auc(df, by, y, p), average_precision(df, by, y, p), brier_logloss(df, by, y, p), ece(df, by, y=y, p=p)):
        out = out.join(part, by, "left")
    return out


def pass_summary(df: DataFrame, row: str = "idx", p: str = "q") -> tuple[DataFrame, DataFrame]:
    """Mean and deviation of each row over its passes, and the means of both over all rows."""
    per = df.groupBy(row).agg(F.avg(p).alias("m"), F.stddev_pop(p).alias("sd"))
    return per, per.agg(F.avg("m").alias("mean_m"), F.stddev_pop("m").alias("std_m"), F.avg("sd").alias("mean_sd"), F.stddev_pop("sd").alias("std_sd"))
