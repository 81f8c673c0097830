"""Sinks: split corpora, kept indices, manifests, reports, pictures and review bundles.

Tables go through Spark's committing writers. Documents of bounded size (reports, galleries of a sample) are written under a temporary name and renamed.
"""

from __future__ import annotations

import html
import json
import math
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from sieveline.functions import kernels as K
from sieveline.operators import sampling as S
from sieveline.schema import finite


# ---------------------------------------------------------------- single documents
def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file, whole or not at all."""
    fs = spark._jvm.org.apache.hadoop.fs
    target, part = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(part, True)
    out.write(bytearray(data))
    out.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"can't rename to {path}")


def json_safe(x):
    """Plain values for JSON: NaN and infinities are null, rows and arrays are objects and lists, at any depth."""
    if isinstance(x, Row):
        x = x.asDict()
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, np.ndarray)):
        return [json_safe(v) for v in x]
    if isinstance(x, np.generic):
        x = x.item()
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if x is None or isinstance(x, (str, int, float, bool)) else str(x)


def write_json(spark: SparkSession, path: str, document) -> None:
    write_bytes(spark, path, json.dumps(json_safe(document), indent=2, allow_nan=False).encode())


def safe(column: Column, kind: T.DataType) -> Column:
    """The column with NaN and infinities as null, inside structs, arrays and map values, too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(safe(column[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return column


def manifest(df: DataFrame, path: str) -> None:
    """JSON rows in one part file, NaN and infinities as null at any depth."""
    df.select(*(safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema)).coalesce(1).write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    """One part file with a header, also where there are no rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


# ---------------------------------------------------------------- corpora
def partitioned(df: DataFrame, path: str, by: list[str], codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", codec).partitionBy(*by).parquet(path)


def kept_indices(kept: DataFrame, path: str) -> None:
    kept.select("split", "idx").write.mode("overwrite").partitionBy("split").parquet(path)


def dedup_manifest(spark: SparkSession, path: str, source: str, kept_path: str, per_split: DataFrame) -> dict:
    """The accounting of a deduplication as one document; per_split has a row a split."""
    rows = {r["split"]: {**{k: r[k] for k in ("n_original", "n_kept", "n_removed")}, "indices_file": f"{kept_path}/split={r['split']}"} for r in per_split.collect()}
    document = {"version": 1, "source": source, "splits": rows}
    write_json(spark, path, document)
    return document


def write_splits(corpus: DataFrame, kept: DataFrame | None, root: str, meta: list[str] = (), splits: tuple[str, ...] = ("train", "valid", "test"), codec: str = "gzip") -> DataFrame:
    """A corpus of kept rows as the loader reads it: arrays, labels and metadata of each split apart; a split without rows isn't written. Returns rows a split.

    Rows are renumbered in the order of their idx, which stays as raw_idx with the labels.
    """
    from sieveline.operators import dedup as D

    rows = corpus if kept is None else corpus.join(kept.select("split", "idx").distinct(), ["split", "idx"], "left_semi")
    placed = D.positions(rows)
    counts = {r[0]: r[1] for r in rows.groupBy("split").count().collect()}
    for split in splits:
        if counts.get(split):
            own = placed.where(F.col("split") == split).withColumn("raw_idx", F.col("idx")).withColumn("idx", F.col("pos"))
            own.select("idx", "px").write.mode("overwrite").option("compression", codec).parquet(f"{root}/{split}_x.parquet")
            own.select("idx", F.col("label").cast("float").alias("label"), "raw_idx").write.mode("overwrite").option("compression", codec).parquet(f"{root}/{split}_y.parquet")
            if meta:
                csv(own.select("idx", *meta), f"{root}/{split}_meta.csv")
    return corpus.sparkSession.createDataFrame([(s, counts.get(s, 0)) for s in splits], "split string, n long")


def checkpoint(kept: DataFrame, root: str, split: str) -> DataFrame:
    """Kept rows of the quality step, read back, so that a rerun goes on from there."""
    path = f"{root}/checkpoint_{split}"
    if not done(kept.sparkSession, path):
        kept.write.mode("overwrite").parquet(path)
    return kept.sparkSession.read.parquet(path)


def sample_pack(rows: DataFrame, path: str, n: int = 60, seed: int = 123) -> None:
    """Originals, results, labels and codes of a few rows for inspection."""
    S.sample(rows, n, seed).coalesce(1).write.mode("overwrite").parquet(path)


def predictions(df: DataFrame, path: str) -> None:
    """Scores in single precision, one row an idx."""
    names = ("y_true", "logits", "prob_sigmoid", "logits_temperature_scaled", "prob_after_temperature", "temperature_T", "prob_mc_mean", "prob_mc_std")
    df.select("idx", *(F.col(c).cast("float").alias(c) for c in names if c in df.columns)).write.mode("overwrite").parquet(path)


def stain_reference(spark: SparkSession, path: str, idx: int, tissue: float, candidates: int, sampled: int) -> None:
    write_json(spark, path, {"reference_train_index": idx, "REFERENCE_MIN_TISSUE": tissue, "n_candidates": candidates, "n_sample": sampled})


# ---------------------------------------------------------------- progress
def done(spark: SparkSession, path: str) -> bool:
    """Whether a step's output was committed, so that a rerun can skip it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Progress:
    """The steps that a run has finished, in a document that survives it; marking a step twice changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        from sieveline.sources.readers import json_or_none

        self.spark, self.path = spark, path
        found = json_or_none(spark, path, "completed_steps array<string>")
        self.steps = list(found["completed_steps"] or ()) if found else []

    def done(self, step: str) -> bool:
        return step in self.steps

    def mark(self, step: str) -> None:
        if step not in self.steps:
            self.steps.append(step)
            write_json(self.spark, self.path, {"completed_steps": self.steps})


# ---------------------------------------------------------------- pictures and review
def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB picture."""
    h, w, _ = rgb.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def picture(px, side: int, size: int | None = None) -> bytes:
    """A flattened image as PNG, resized where asked."""
    x = np.asarray(px, np.float64).reshape(side, side, 3)
    if size and size != side:
        x = K.resize(K.unit(x, 1.0 + 1e-6), size, size)
    return png(K.to_u8_half_even(x))


def escaped(value: Column) -> Column:
    """Text as HTML shows it."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def gallery(cases: DataFrame, columns: list[str]) -> DataFrame:
    """One HTML fragment per bucket; a bucket holds a bounded sample of cases."""
    cells = F.concat(*(x for c in columns for x in (F.lit("<td>"), escaped(F.col(c)), F.lit("</td>"))))
    rows = F.array_sort(F.collect_list(F.struct("review_order", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("row"))))
    return cases.groupBy("bucket").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r: r["row"]), ""), F.lit("</table>")).alias("html"))


CHECKLIST = ("tissue_scarcity", "artifact_burden", "borderline_morphology", "small_focus_lesion", "color_stain_atypia", "patch_context_limit")


def checklist(cases: DataFrame) -> DataFrame:
    """An empty form for each case in review order."""
    blank = [F.lit(None).cast("string").alias(f"chk_{c}_Present_Absent_Unclear") for c in CHECKLIST]
    return cases.select("case_id", "h5_index", "bucket", "review_order", *blank, F.lit(None).cast("string").alias("free_text_note")).orderBy("review_order")


def review_bundle(cases: DataFrame, summary: DataFrame, root: str, facts: dict, side: int | None = None, size: int | None = None) -> None:
    """A folder for human review of a bounded sample: cases, form, summary, gallery, notes, and pictures where cases have px."""
    spark = cases.sparkSession
    rows = cases.orderBy("review_order").collect()  # the sample's size
    names = [c for c in cases.columns if c != "px"]
    csv(cases.select(*names).orderBy("review_order"), f"{root}/selected_cases")
    csv(checklist(cases), f"{root}/review_labels_template")
    write_json(spark, f"{root}/bucket_sampling_summary.json", {**facts, "buckets": [r.asDict() for r in summary.orderBy("bucket").collect()]})
    parts = ["<!doctype html><meta charset='utf-8'><title>Review</title>"]
    held = None
    for r in rows:
        if r["bucket"] != held:
            held = r["bucket"]
            parts.append(f"<h2>{html.escape(str(held))}</h2>")
        caption = html.escape(", ".join(f"{n}: {r[n]}" for n in names))
        image = ""
        if side and "px" in cases.columns and r["px"] is not None:
            name = f"figures/{r['case_id']}.png"
            write_bytes(spark, f"{root}/{name}", picture(r["px"], side, size))
            image = f"<img src='{html.escape(name)}' alt=''>"
        parts.append(f"<figure>{image}<figcaption>{caption}</figcaption></figure>")
    write_bytes(spark, f"{root}/gallery.html", "\n".join(parts).encode())
    notes = ["Open gallery.html in a browser.", "Fill in review_labels_template: Present, Absent or Unclear for each item.", "Rows follow the gallery, buckets in order of their names.", f"Cases: {len(rows)}"]
    write_bytes(spark, f"{root}/README_REVIEW.txt", "\n".join(notes).encode())
