"""Compositions of the operators: dedup, decontamination, quality and routing, benchmark matrices, splits, audits, review bundles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sieveline.functions import kernels as K, stain as T
from sieveline.operators import dedup as D, ordering as O, quality as Q, routing as R, sampling as S
from sieveline.sources import readers, sinks

#: The fifteen numbers that an audit reports of each image, by their feature columns.
AUDIT = {
    "mean_r": "mean_r", "mean_g": "mean_g", "mean_b": "mean_b", "std_r": "std_r", "std_g": "std_g", "std_b": "std_b", "mean_gray": "mean_luma", "std_gray": "std_luma",
    "sat_mean": "sat_mean", "tissue_proxy_ratio_sat_gt_0p12": "tissue_proxy", "black_ratio_gray_lt_0p05": "black_luma", "blue_dominance_ratio_b_gt_r": "blue_dom",
    "pink_proxy_ratio": "pink_proxy", "min_pixel": "min_px", "max_pixel": "max_px",
}


def content_hash(px: str = "px"):
    """Column: SHA-256 of an image's bytes."""
    return F.expr(f"sha2(array_join(transform({px}, x -> cast(floor(least(greatest(x, 0d), 1d) * 255d) as int)), ','), 256)")


# ---------------------------------------------------------------- deduplication and overlap
def deduplicate(corpus: DataFrame, kept_path: str | None = None, root: str | None = None, manifest_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept rows and the manifest; kept indices, the rewritten corpus and the manifest's document are written where a path is given."""
    kept, per_split = D.keep_first(corpus), D.manifest(corpus)
    if kept_path:
        sinks.kept_indices(kept, kept_path)
    if root:
        sinks.write_splits(kept, None, root)
    if manifest_path:
        sinks.dedup_manifest(corpus.sparkSession, manifest_path, "corpus", kept_path or "", per_split)
    return kept, per_split


def verified(corpus: DataFrame, kept: DataFrame) -> bool:
    """Whether a deduplication holds in every split."""
    return all(r["unique_ok"] and r["count_ok"] for r in D.integrity(corpus, kept).collect())


def decontaminate(corpus: DataFrame, other: DataFrame, splits: tuple[str, ...] = (), root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of corpus whose content isn't anywhere in other, and per split n_original, n_kept, n_removed. Raises where a required split has no
    rows on either side; writes the kept corpus where a path is given."""
    for name, side in (("corpus", corpus), ("other", other)):
        have = {r[0] for r in side.select("split").distinct().collect()}
        if missing := [s for s in splits if s not in have]:
            raise ValueError(f"{name} has no rows of {', '.join(missing)}")
    kept = D.decontaminate(corpus, other)
    before, after = corpus.groupBy("split").agg(F.count("*").alias("n_original")), kept.groupBy("split").agg(F.count("*").alias("n_kept"))
    report = before.join(after, "split", "left").select("split", "n_original", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), (F.col("n_original") - F.coalesce("n_kept", F.lit(0))).alias("n_removed"))
    if root:
        sinks.write_splits(kept, None, root)
    return kept, report


# ---------------------------------------------------------------- quality, normalisation, report
def process(patches: DataFrame, packs: list[T.Pack], side: int, method: str = "adaptive", router: R.Router | None = None, share: float = 0.25, tail: float = 0.02, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the gate with their normalised image (norm_px, code, in_tail), and a report a split.

    Candidates restrict the rows (split, idx). Adaptive results in the low tail of red or pink of their split are replaced by luminosity alone; other
    methods have no guardrails and no tail.
    """
    if candidates is not None:
        patches = patches.join(candidates.select("split", "idx").distinct(), ["split", "idx"], "left_semi")
    judged = Q.features(patches, side=side).withColumn("reason", Q.gate())
    kept = judged.where("reason is null")
    pack = router.pack([p.mean_rgb for p in packs]) if router else None
    if method == "adaptive":
        cut = R.thresholds(kept, share).withColumnRenamed("split", "_split")
        rows = R.normalised(kept.join(F.broadcast(cut), F.col("split").eqNullSafe(F.col("_split"))).drop("_split"), packs, side=side, pack=pack, threshold=F.col("threshold"))  # a row a split
        rows = R.replaced_tail(rows, tail, side=side)
    else:
        rows = R.normalised(kept, packs, side=side, pack=pack, method=method).withColumn("threshold", F.lit(None).cast("double")).withColumn("in_tail", F.lit(False))
    return rows, process_report(judged, rows, packs[0].mean_rgb, side)


def process_report(judged: DataFrame, rows: DataFrame, reference: np.ndarray, side: int) -> DataFrame:
    """Per split: counts before and after, removals by reason, class balance and its drift, code counts, replaced rows, distances to the reference before and after."""
    before = judged.groupBy("split").agg(
        F.count("*").alias("n_before"), F.count_if(F.col("reason").isNull()).alias("n_after"), *(F.count_if(F.col("reason") == r).alias(f"removed_{r}") for r in ("solid_color", "high_black", "low_tissue"))
    )
    names = [c for c in rows.columns if c not in K.FEATURES]
    made = rows.select("split", "code", "in_tail", R.distance(reference).alias("d0"), K.feature_struct("norm_px", side).alias("f"))
    made = made.select("split", "code", "in_tail", "d0", R.distance(reference, ("f.mean_r", "f.mean_g", "f.mean_b")).alias("d1"))
    after = made.groupBy("split").agg(
        *(F.count_if(F.col("code") == k).alias(n) for k, n in enumerate(T.CODES)), F.count_if("in_tail").alias("tail_replaced"), F.round(F.avg("d0"), 6).alias("distance_before"), F.round(F.avg("d1"), 6).alias("distance_after")
    )
    out = before.join(after, "split", "left")
    return out.join(Q.balance(judged, reason=F.col("reason")).select("split", "before", "after", "drift", "alert"), "split", "left") if "label" in names else out


def dataset_summary(report: DataFrame) -> DataFrame:
    """The report's counts over all splits."""
    return report.agg(*(F.sum(c).alias(c) for c in report.columns if c.startswith(("n_", "removed_")) or c in T.CODES or c == "tail_replaced"))


METHODS = ("macenko", "reinhard", "adaptive_single_ref", "adaptive_multi_ref", "adaptive_multi_ref_aug", "vahadane")


def subset(patches: DataFrame, sizes: dict[str, int], side: int, seed: int = 42) -> DataFrame:
    """Balanced samples of the splits that pass the gate: one subset for all methods."""
    out = None
    for i, (split, n) in enumerate(sizes.items()):
        part = S.balanced(patches.where(F.col("split") == split), n, seed=seed + i)
        out = part if out is None else out.unionByName(part)
    names = patches.columns
    return Q.features(out, side=side).where(Q.gate().isNull()).select(*names)


def benchmark(patches: DataFrame, packs: list[T.Pack], router: R.Router, root: str, sizes: dict[str, int], side: int, seed: int = 42, methods: tuple[str, ...] = METHODS) -> list[str]:
    """Every method on every split of one shared subset, each pair a folder. Finished steps are skipped on a rerun; the slowest method comes last.
    Returns the steps that this run did."""
    spark, progress, ran = patches.sparkSession, sinks.Progress(patches.sparkSession, f"{root}/prepare_progress.json"), []
    base = f"{root}/subset"
    if not (progress.done("subset") and sinks.done(spark, base)):
        subset(patches, sizes, side, seed).write.mode("overwrite").parquet(base)
        progress.mark("subset")
        ran.append("subset")
    rows = spark.read.parquet(base)
    for method in methods:
        for split in sizes:
            step, out = f"{method}:{split}", f"{root}/{method}/{split}"
            if progress.done(step) and sinks.done(spark, out):
                continue
            own = rows.where(F.col("split") == split)
            if method == "adaptive_multi_ref_aug":
                found = spark.read.parquet(f"{root}/adaptive_multi_ref/{split}")
                if split == "train":
                    found = jittered(found, side, seed + 999)
            elif method.startswith("adaptive"):
                many = method == "adaptive_multi_ref"
                found = process(own, packs if many else packs[:1], side, router=router if many else None)[0].select("split", "idx", "label", F.col("norm_px").alias("px"), "code")
            else:
                found = R.normalised(own, packs[:1], side=side, method=method).select("split", "idx", "label", F.col("norm_px").alias("px"), "code")
            found.write.mode("overwrite").parquet(out)
            progress.mark(step)
            ran.append(step)
    return ran


def jittered(rows: DataFrame, side: int, seed: int, px: str = "px") -> DataFrame:
    """px with gain, bias and saturation drawn by a hash of idx."""
    @F.arrow_udf("array<double>")
    def run(x: pa.Array, one: pa.Array, two: pa.Array, three: pa.Array) -> pa.Array:
        draws = np.stack([c.to_numpy(zero_copy_only=False) for c in (one, two, three)], axis=1)
        return K.list_of(K.jitter(K.batch_of(x, side), draws))

    draw = [((F.xxhash64(F.lit(seed + k), F.col("idx")) / 2.0**64) + 0.5) for k in range(3)]
    return rows.withColumn(px, run(F.col(px), *draw))


# ---------------------------------------------------------------- corpora from metadata
def build_corpus(meta: DataFrame, images: DataFrame, root: str, side: int, column: str = "path", columns: list[str] = ()) -> DataFrame:
    """Metadata rows with a split meet their images by path and are written split by split; returns label counts a split. Every image must have
    the asked side, and every row an image."""
    rows = readers.by_path(meta, images.select(column, "px", "height", "width"), column)
    found = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if((F.col("height") != side) | (F.col("width") != side)).alias("bad")).collect()
    expected = {r["split"]: r["n"] for r in meta.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if any(r["bad"] for r in found) or {r["split"]: r["n"] for r in found} != expected:
        raise ValueError(f"images of other shapes or missing: {[r.asDict() for r in found]} of {expected}")
    order = O.numbered(rows.withColumn("_p", F.col(column)), ["_p"], "idx", ["split"]).drop("_p")
    labelled = order.withColumn("label", F.col("label").cast("double")).withColumn("px", F.transform("px", lambda x: x / 255.0))
    sinks.write_splits(labelled, None, root, meta=[c for c in columns if c in labelled.columns])
    return label_stats(labelled)


def label_stats(df: DataFrame, by: list[str] = ("split",), label: str = "label") -> DataFrame:
    """n_samples, n_positive, n_negative, frac_positive (null without rows), and the count of each label value."""
    counts = df.groupBy(*by, F.col(label).cast("string").alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col(label) > 0.5).alias("p"), F.count_if(F.col(label) <= 0.5).alias("q"))
    return counts.groupBy(*by).agg(
        F.sum("n").alias("n_samples"), F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"), F.round(F.try_divide(F.sum("p").cast("double"), F.sum("n").cast("double")), 6).alias("frac_positive"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "n"))))).alias("label_value_counts"),
    )


# ---------------------------------------------------------------- audits
def per_image(corpus: DataFrame, side: int) -> DataFrame:
    """The fifteen numbers of each image, its index and label."""
    return Q.features(corpus, side=side).select("split", F.col("idx").alias("index"), F.col("label").cast("double").alias("label"), *(F.col(c).alias(n) for n, c in AUDIT.items()))


def described(stats: DataFrame, by: list[str] = ("split",), metrics: list[str] = tuple(AUDIT)) -> DataFrame:
    """by, metric, mean, std (population), low, high; nulls where there are no values."""
    long = stats.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("r")).select(*by, "r.*")
    return long.groupBy(*by, "metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


def audit(corpora: dict[str, DataFrame], side: int, n: int = 4000, seed: int = 42, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """The comparison of corpora by split: label counts over all rows; means and duplicate share over at most n rows of each, drawn with a seed of its own."""
    out = None
    for i, (name, corpus) in enumerate(corpora.items()):
        labels = label_stats(corpus).drop("label_value_counts")
        for j, split in enumerate(splits):
            drawn = S.sample(corpus.where(F.col("split") == split), n, S.stratum_seed(seed, i, j))
            rows = per_image(drawn, side).join(drawn.select(F.col("idx").alias("index"), content_hash().alias("h")), "index")
            shown = rows.agg(
                *(F.round(F.avg(m), 6).alias(a) for m, a in (("mean_r", "sampled_mean_r"), ("mean_g", "sampled_mean_g"), ("mean_b", "sampled_mean_b"), ("tissue_proxy_ratio_sat_gt_0p12", "sampled_tissue_proxy_mean"), ("black_ratio_gray_lt_0p05", "sampled_black_ratio_mean"), ("blue_dominance_ratio_b_gt_r", "sampled_blue_dom_mean"))),
                F.round(F.try_divide((F.count("*") - F.count_distinct("h")).cast("double"), F.count("*").cast("double")), 6).alias("sampled_duplicate_fraction"),
            ).withColumn("split", F.lit(split))
            part = labels.where(F.col("split") == split).join(shown, "split").select(F.lit(name).alias("dataset"), "*")
            out = part if out is None else out.unionByName(part)
    return out


def quality_moments(features: DataFrame) -> DataFrame:
    """Per split and measure: mean, deviation from sums and sums of squares, least and greatest, and how many are low."""
    low = {"blur": Q.FLAGS["blur"], "std_gray": Q.FLAGS["contrast"]}
    rows = features.select("split", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v"), F.lit(low.get(m)).cast("double").alias("cut")) for m in ("blur", "std_gray", "mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b")))).alias("r")).select("split", "r.*")
    spread = F.sqrt(F.greatest(F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v"), F.lit(0.0)))
    return rows.groupBy("split", "measure").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.round(spread, 6).alias("std"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), F.max("cut").alias("low_threshold"), F.count_if(F.col("v") <= F.col("cut")).alias("low_count")
    )


def quality_report(corpus: DataFrame, side: int) -> DataFrame:
    """One row a split: sizes, imbalance, flags and how often each occurs, duplicate groups and the rows in them."""
    rows = Q.features(corpus, side=side).select("split", "idx", "label", Q.anomalies().alias("flags"), content_hash().alias("h"))
    base = rows.groupBy("split").agg(
        F.count("*").alias("n_samples"), F.count_if(F.col("label") >= 0.5).alias("positive"), F.count_if(F.col("label") < 0.5).alias("negative"), F.count_if(F.size("flags") > 0).alias("n_anomalous"), F.count_if(Q.blank_like(F.col("flags"))).alias("n_blank_like")
    )
    base = base.withColumn("imbalance", F.when(F.col("positive") == 0, float("inf")).otherwise(F.round(F.try_divide(F.col("negative").cast("double"), F.col("positive").cast("double")), 4)))
    flags = rows.select("split", F.explode("flags").alias("f")).groupBy("split", "f").count().groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("f", "count")))).alias("anomaly_counts"))
    groups = D.duplicate_groups(rows).groupBy("split").agg(F.count("*").alias("n_duplicate_groups"), F.sum("n").alias("n_images_in_duplicate_groups"))
    out = base.join(flags, "split", "left").join(groups, "split", "left")
    return out.na.fill(0, ["n_duplicate_groups", "n_images_in_duplicate_groups"])


def flattened(report: DataFrame) -> DataFrame:
    """A report's nested counts as rows: split, section, name, value."""
    plain = [F.struct(F.lit("class_balance").alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("n_samples", "positive", "negative", "imbalance")]
    plain += [F.struct(F.lit("duplicates").alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("n_duplicate_groups", "n_images_in_duplicate_groups")]
    flags = F.transform(F.map_entries(F.coalesce("anomaly_counts", F.create_map().cast("map<string,bigint>"))), lambda e: F.struct(F.lit("anomalies").alias("section"), e["key"].alias("name"), e["value"].cast("double").alias("value")))
    return report.select("split", F.explode(F.concat(F.array(*plain), flags)).alias("r")).select("split", "r.*")


def cleaned(corpus: DataFrame, side: int) -> DataFrame:
    """Rows without any flag that aren't later copies of an equal image in their split. The first of a group of copies counts as kept even where a flag removes it."""
    rows = Q.features(corpus, side=side).select(*corpus.columns, Q.anomalies().alias("_flags"), content_hash().alias("_h"))
    return D.keep_first(rows, key="_h").where(F.size("_flags") == 0).drop("_flags", "_h")


def paired_count(x: DataFrame, y: DataFrame) -> DataFrame:
    """n_x, n_y, n: rows of arrays and labels, and how many of them can be paired by place."""
    a, b = x.agg(F.count("*").alias("n_x")), y.agg(F.count("*").alias("n_y"))
    return a.crossJoin(b).withColumn("n", F.least("n_x", "n_y"))  # one row each


# ---------------------------------------------------------------- review
def review(predictions: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """A sample of each error bucket with case ids and a global order: buckets by name, cases as they were drawn."""
    picked = S.per_group(S.error_buckets(predictions), ["bucket"], n, seed)
    return picked.withColumn("case_id", F.format_string("%s_%03d", "bucket", F.col("rn") - 1)).withColumn("review_order", F.row_number().over(Window.orderBy("bucket", "rn")))  # five buckets of n rows


def bucket_summary(buckets: DataFrame, n: int) -> DataFrame:
    few = F.lit(n).cast("long")
    return buckets.groupBy("bucket").agg(F.count("*").alias("available_n"), F.least(F.count("*"), few).alias("sampled_n"), F.greatest(F.lit(0).cast("long"), few - F.count("*")).alias("shortfall"))


def export_review(predictions: DataFrame, root: str, n: int = 50, seed: int = 42, kept: DataFrame | None = None, images: DataFrame | None = None, side: int | None = None, size: int | None = None, facts: dict | None = None) -> DataFrame:
    """Draws the cases, finds each one's row of the raw corpus (kept: split, pos, idx) and its picture (images: h5_index, px), and writes the bundle."""
    buckets = S.error_buckets(predictions)
    cases = review(predictions, n, seed).withColumnRenamed("idx", "h5_index")
    if kept is not None:
        cases = D.to_raw(cases.withColumn("pos", F.col("h5_index")), kept).withColumnRenamed("idx", "raw_h5_index").drop("pos")
    else:
        cases = cases.withColumn("raw_h5_index", F.col("h5_index"))
    names = ["case_id", "h5_index", "raw_h5_index", "bucket", F.col("y").alias("y_true"), "y_hat", F.col("p").alias("p_cal"), "confidence", "entropy", F.col("tau").alias("tau_H_90pct_split"), "review_order"]
    cases = cases.select(*names)
    if images is not None:
        cases = cases.join(images.select("h5_index", "px"), "h5_index", "left")
    sinks.review_bundle(cases, bucket_summary(buckets, n), root, {"n_total": predictions.count(), "threshold": 0.5, **(facts or {})}, side, size)
    return cases


def reference(patches: DataFrame, side: int, seed: int = 42, n: int = 30_000) -> DataFrame:
    """The candidate nearest to the candidates' medians."""
    return R.reference(Q.features(patches, side=side), n, seed).select("idx")


def conditions(arms: dict[str, str]) -> list[dict[str, str]]:
    """Every pair of a trained arm and a test corpus, with its id, its direction and where its scores are expected."""
    out = []
    for i, (train, a) in enumerate(arms.items()):
        for test, b in [(train, a), *((t, p) for t, p in arms.items() if t != train)]:
            out.append({"condition": f"C{len(out) + 1}", "trained": train, "tested": test, "direction": "inside" if train == test else "outside", "scores": f"{a}/scores_{test}.npz", "corpus": b})
    return out


def condition_table(spark: SparkSession, arms: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([tuple(c.values()) for c in conditions(arms)], "condition string, trained string, tested string, direction string, scores string, corpus string")


def statuses(checkpoints: DataFrame, outputs: DataFrame) -> DataFrame:
    """split, status from the rows of the quality step's checkpoint (split, kept) and of the outputs (split, x, y); either may lack a split."""
    both = checkpoints.join(outputs, "split", "full")
    ready, made = F.col("kept").isNotNull(), F.col("x").isNotNull() | F.col("y").isNotNull()
    whole = F.col("x").isNotNull() & (F.col("x") == F.col("y")) & (F.col("x") == F.col("kept"))
    return both.select("split", F.when(ready & whole, "DONE").when(ready, "step 1 done").when(made, "partial").otherwise("not started").alias("status"))
