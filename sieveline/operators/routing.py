"""Stain routing: a router fitted to a bounded sample, normalisers applied to rows, and the replacement of implausible tails."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sieveline.functions import kernels as K, stain as T
from sieveline.operators import ordering as O, quality as Q, sampling as S

ROUTING = ("tissue", "mean_r", "mean_g", "mean_b", "blue_dom", "pink", "sat_mean")


def row_features(rgb: np.ndarray) -> np.ndarray:
    """The seven routing features of one image."""
    found = K.features(rgb[None])
    return np.array([found[n][0] for n in ROUTING])


# ---------------------------------------------------------------- the router
def scaler(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations; a constant column has deviation 1."""
    std = rows.std(axis=0)
    return rows.mean(axis=0), np.where(std > 0, std, 1.0)


def kmeans(z: np.ndarray, k: int = 4, starts: int = 20, seed: int = 42, rounds: int = 300, tolerance: float = 1e-4) -> np.ndarray:
    """Centres of the best of several runs of Lloyd's algorithm from k-means++ starts; equal data and seed give equal centres."""
    draw, best, least = np.random.default_rng(seed), None, np.inf
    limit = tolerance * z.var(axis=0).mean()
    for _ in range(starts):
        centres = z[[draw.integers(len(z))]]
        while len(centres) < k:
            far = ((z[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
            pick = np.searchsorted(np.cumsum(far), draw.random() * far.sum()) if far.sum() > 0 else draw.integers(len(z))
            centres = np.vstack([centres, z[min(int(pick), len(z) - 1)]])
        for _ in range(rounds):
            own = ((z[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            new = np.stack([z[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
            moved, centres = ((new - centres) ** 2).sum(), new
            if moved <= limit:
                break
        loss = ((z[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()
        if loss < least - 1e-12:
            best, least = centres, loss
    return best[np.lexsort(best.T[::-1])]


def assignment(cost: np.ndarray) -> tuple[int, ...]:
    """Columns of the cheapest one-to-one assignment of rows, the first in order on ties; for a handful of rows."""
    return min(permutations(range(cost.shape[1]), cost.shape[0]), key=lambda p: (round(sum(cost[i, j] for i, j in enumerate(p)), 12), p))


@dataclass
class Router:
    """Clusters of feature space: one is routed by nearest colour, each other one has a reference of its own."""

    mean: np.ndarray
    std: np.ndarray
    centres: np.ndarray
    merge: int
    packs: dict[int, int]

    @classmethod
    def fit(cls, rows: np.ndarray, anchor: np.ndarray, references: np.ndarray, k: int = 4, seed: int = 42) -> Router:
        """rows: features of images that passed the gate; anchor: the features that choose the merge cluster."""
        if len(rows) < k:
            raise ValueError(f"{len(rows)} images for {k} clusters")
        mean, std = scaler(rows)
        centres = kmeans((rows - mean) / std, k, seed=seed)
        merge = int(((centres - (anchor - mean) / std) ** 2).sum(axis=1).argmin())
        rest = [c for c in range(k) if c != merge]
        cost = np.linalg.norm(centres[rest][:, None] - (references - mean) / std, axis=2)
        return cls(mean, std, centres, merge, dict(zip(rest, assignment(cost), strict=True)))

    def cluster(self) -> Column:
        """The nearest centre of a row with feature columns, the first on ties; centres are literals of the plan."""
        z = [(F.col(n) - F.lit(float(m))) / F.lit(float(s)) for n, m, s in zip(ROUTING, self.mean, self.std, strict=True)]
        gaps = [F.struct(F.round(sum(((x - F.lit(float(c))) * (x - F.lit(float(c))) for x, c in zip(z, centre, strict=True)), F.lit(0.0)), 9).alias("d"), F.lit(i).alias("i")) for i, centre in enumerate(self.centres)]
        return F.array_min(F.array(*gaps))["i"]

    def pack(self, colours: list[np.ndarray]) -> Column:
        """Index of the reference: the cluster's, or in the merge cluster the one of least L1 distance in mean colour."""
        cluster, out = self.cluster(), nearest(colours)
        for c, j in self.packs.items():
            out = F.when(cluster == c, F.lit(j)).otherwise(out)
        return out


def nearest(colours: list[np.ndarray], columns: tuple[str, ...] = ("mean_r", "mean_g", "mean_b")) -> Column:
    """Index of the reference colour with the least L1 distance, the first on ties."""
    gaps = [F.struct(F.round(sum((F.abs(F.col(n) - F.lit(float(v))) for n, v in zip(columns, c, strict=True)), F.lit(0.0)), 9).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(colours)]
    return F.array_min(F.array(*gaps))["j"]


def fit_router(features: DataFrame, anchor: np.ndarray, references: np.ndarray, n: int = 20_000, seed: int = 42, k: int = 4) -> Router:
    """From a sample of at most n images; those that fail the gate don't count."""
    drawn = S.sample(features.select("idx", "std_gray", "black", *ROUTING), n, seed).where(Q.gate().isNull()).orderBy("idx")
    rows = np.array([list(r) for r in drawn.select(*ROUTING).collect()]).reshape(-1, len(ROUTING))  # n rows at most
    return Router.fit(rows, anchor, references, k, seed)


# ---------------------------------------------------------------- normalisers on rows
def normalised(df: DataFrame, packs: list[T.Pack], px: str = "px", side: int = 4, pack: Column | None = None, threshold: Column | None = None, method: str = "adaptive") -> DataFrame:
    """Adds norm_px and code. method: adaptive (needs the threshold of blue dominance), macenko, reinhard, vahadane or luminosity."""

    def one(x: np.ndarray, j: int, cut: float) -> tuple[np.ndarray, int]:
        own = packs[j]
        if method == "adaptive":
            return T.adaptive(x, own, cut)
        tool = {"macenko": own.macenko, "reinhard": own.reinhard, "vahadane": own.vahadane, "luminosity": None}[method]
        return T.classical(x, tool, T.REINHARD if method == "reinhard" else T.MACENKO)

    @F.arrow_udf("struct<norm_px: array<double>, code: int>")
    def run(x: pa.Array, which: pa.Array, cut: pa.Array) -> pa.Array:
        batch = K.batch_of(x, side)
        done = [one(im, j, c) for im, j, c in zip(batch, which.to_pylist(), cut.to_pylist(), strict=True)]
        images = np.stack([d[0] for d in done]) if done else np.zeros((0, side, side, 3))
        return pa.StructArray.from_arrays([K.list_of(images), pa.array([d[1] for d in done], pa.int32())], names=["norm_px", "code"])

    pack = F.lit(0) if pack is None else pack
    threshold = F.lit(0.0) if threshold is None else threshold
    names = [c for c in df.columns if c not in ("norm_px", "code")]
    return df.select(*names, run(F.col(px), pack.cast("int"), threshold.cast("double")).alias("_n")).select(*names, "_n.*")


def thresholds(features: DataFrame, share: float = 0.25, n: int = 30_000, seed: int = 42, by: str = "split") -> DataFrame:
    """by, threshold: the percentile of blue dominance on at most n rows of each group."""
    drawn = S.per_group(features.select(by, "idx", "blue_dom"), [by], n, seed).select(by, "blue_dom").persist()  # n rows a group
    return O.percentiles(drawn, "blue_dom", [share], [by], ["threshold"])


def replaced_tail(df: DataFrame, share: float = 0.02, by: str = "split", px: str = "px", side: int = 4) -> DataFrame:
    """Rows whose normalised image is in the low tail of red or of pink in its group get luminosity alone, code and all; adds in_tail."""
    names = df.columns
    made = df.select(*names, K.feature_struct("norm_px", side).alias("_f")).select(*names, F.col("_f.mean_r").alias("_out_r"), F.col("_f.pink").alias("_out_pink"))
    found = Q.tail(made, ["_out_r", "_out_pink"], share, by)
    plain = K.image_column(lambda x: np.floor(np.clip(T.luminosity(x), 0, 1) * 255) / 255, side)
    found = found.withColumn("_plain", plain(F.when(F.col("in_tail"), F.col(px))))  # null, and not computed, outside the tail
    return found.select(
        *(c for c in names if c not in ("norm_px", "code")),
        F.when(F.col("in_tail"), F.col("_plain")).otherwise(F.col("norm_px")).alias("norm_px"),
        F.when(F.col("in_tail"), F.lit(T.LUMINOSITY)).otherwise(F.col("code")).alias("code"),
        "in_tail",
    )


def usage(df: DataFrame, by: str = "split") -> DataFrame:
    """Count and rate of every code in every group, zero where it doesn't occur."""
    counts = df.groupBy(by).agg(F.count("*").alias("_all"), *(F.count_if(F.col("code") == k).alias(f"_{k}") for k in range(len(T.CODES))))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("code"), F.lit(name).alias("name"), F.col(f"_{k}").alias("n")) for k, name in enumerate(T.CODES))))
    return counts.select(by, "_all", rows.alias("r")).select(by, "r.code", "r.name", "r.n", F.round(F.coalesce(F.try_divide(F.col("r.n").cast("double"), F.col("_all").cast("double")), F.lit(0.0)), 6).alias("rate"))


# ---------------------------------------------------------------- effect and comparison
def distance(reference: np.ndarray, columns: tuple[str, ...] = ("mean_r", "mean_g", "mean_b")) -> Column:
    return sum((F.abs(F.col(n) - F.lit(float(v))) for n, v in zip(columns, reference, strict=True)), F.lit(0.0))


def effect(before: DataFrame, after: DataFrame, reference: np.ndarray, n: int = 2000, seed: int = 42) -> DataFrame:
    """Distances to the reference colour before and after, red and pink, spread, outliers and purple images, on at most n rows that both have (by idx)."""
    a = S.sample(before.select("idx", distance(reference).alias("d0"), F.col("mean_r").alias("r0"), F.col("pink").alias("k0")), n, seed)
    both = a.join(after.select("idx", distance(reference).alias("d1"), "mean_r", "mean_g", "mean_b", "pink", "min_px", "max_px"), "idx")
    return both.agg(
        F.count("*").alias("n"), F.round(F.avg("d0"), 6).alias("distance_before"), F.round(F.avg("d1"), 6).alias("distance_after"), F.round(F.avg(F.col("d1") - F.col("d0")), 6).alias("delta"),
        F.round(F.avg("r0"), 6).alias("red_before"), F.round(F.avg("mean_r"), 6).alias("red_after"), F.round(F.avg("k0"), 6).alias("pink_before"), F.round(F.avg("pink"), 6).alias("pink_after"),
        *(F.round(F.stddev_pop(f"mean_{c}"), 6).alias(f"std_{c}") for c in "rgb"),
        F.count_if(outlier()).alias("outliers"), F.count_if(purple()).alias("purple"), F.round(F.avg("min_px"), 6).alias("low"), F.round(F.avg("max_px"), 6).alias("high"),
    )


def outlier() -> Column:
    return (F.col("mean_r") < 0.2) | (F.col("mean_r") > 0.8) | (F.col("mean_b") < 0.2) | (F.col("mean_b") > 0.8)


def purple() -> Column:
    return (F.col("mean_r") < 0.2) | (F.col("pink") < 0.05)


def compared(old: DataFrame, new: DataFrame, references: dict[str, np.ndarray], n: int = 20_000, seed: int = 42) -> DataFrame:
    """One row: mean distance of either run to each reference, spread by channel, and the paired distance of the two runs' mean colours,
    over at most n rows. Raises where the runs have different numbers of rows."""
    a, b = old.count(), new.count()
    if a != b:
        raise ValueError(f"runs of {a} and {b} rows aren't comparable")
    names = ("mean_r", "mean_g", "mean_b")
    left = S.sample(old.select("idx", *(F.col(c).alias(f"old_{c}") for c in names)), n, seed)
    both = left.join(new.select("idx", *(F.col(c).alias(f"new_{c}") for c in names)), "idx")
    out = [F.count("*").alias("n")]
    for side in ("old", "new"):
        columns = tuple(f"{side}_{c}" for c in names)
        out += [F.round(F.avg(distance(v, columns)), 6).alias(f"{side}_to_{k}") for k, v in references.items()]
        out += [F.round(F.stddev_pop(c), 6).alias(f"{side}_std_{c[-1]}") for c in columns]
    gap = sum((F.abs(F.col(f"old_{c}") - F.col(f"new_{c}")) for c in names), F.lit(0.0))
    return both.agg(*out, F.round(F.avg(gap), 6).alias("paired"))


def reference(features: DataFrame, n: int = 30_000, seed: int = 42, tissue: float = 0.5, weights: tuple[float, ...] = (1.0, 1.5, 1.0, 1.5), shares: tuple[float, ...] = (0.5, 0.5, 0.5, 0.5)) -> DataFrame:
    """idx, d: the candidate nearest to the candidates' percentiles of tissue, red, green and blue by weighted squares, the first on ties."""
    names = ("tissue", "mean_r", "mean_g", "mean_b")
    good = S.sample(features.select("idx", "std_gray", "black", *names), n, seed).where(Q.candidate(tissue))
    mid = good.agg(*(F.percentile(c, q).alias(f"m_{c}") for c, q in zip(names, shares, strict=True)))  # over the bounded sample; one row
    gap = sum((F.lit(w) * (F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c, w in zip(names, weights, strict=True)), F.lit(0.0))
    return good.crossJoin(F.broadcast(mid)).select("idx", F.round(gap, 9).alias("d")).orderBy("d", "idx").limit(1)
