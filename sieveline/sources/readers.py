"""Sources: tables by name, corpora by split, typed CSV/JSON/XML, images, prediction archives, file inventories, and a range-partitioned array source."""

from __future__ import annotations

import gzip
import io
import os
import shutil
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sieveline.operators import ordering as O, sampling as S
from sieveline.schema import require_columns

SPLITS = ("train", "valid", "test")
#: Folder of each split in a corpus that keeps its splits apart.
FOLDERS = {"train": "training", "valid": "val", "test": "test"}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


# ---------------------------------------------------------------- files
def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, mb, gb of the files below path, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.round(F.col("length") / 2**20, 2).alias("mb"), F.round(F.col("length") / 2**30, 2).alias("gb"))


def inventory_total(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.round(F.sum("bytes") / 2**20, 2), F.lit(0.0)).alias("mb"))


def missing_files(rows: DataFrame, files: DataFrame, column: str = "path") -> DataFrame:
    return rows.join(files.select(column).distinct(), column, "left_anti")


def sampled_missing(rows: DataFrame, files: DataFrame, column: str = "path", n: int = 2000, seed: int = 0) -> DataFrame:
    """checked, missing: how many of at most n rows, drawn by hash, name a file that isn't there."""
    drawn = S.sample(rows.select(column), n, seed, column)
    return drawn.join(files.select(column, F.lit(1).alias("there")).distinct(), column, "left").agg(F.count("*").alias("checked"), F.count_if(F.col("there").isNull()).alias("missing"))


def require_files(rows: DataFrame, files: DataFrame, column: str = "path", n: int = 2000) -> tuple[int, int]:
    """(checked, missing) of sampled_missing; raises where any is missing."""
    checked, missing = sampled_missing(rows, files, column, n).first()
    if missing:
        raise FileNotFoundError(f"{missing} of {checked} sampled files are missing")
    return checked, missing


def find_variant(folder: str, name: str) -> str | None:
    """A file of that name, or the first by name that begins like it and has .gz in it, as downloads name second copies."""
    exact = os.path.join(folder, name)
    if os.path.isfile(exact):
        return exact
    stem = name.replace(".gz", "")
    found = sorted(f for f in (os.listdir(folder) if os.path.isdir(folder) else ()) if ".gz" in f and f.startswith(stem))
    return next((p for p in (os.path.join(folder, f) for f in found) if os.path.isfile(p)), None)


def gunzip(spark: SparkSession, source: str, target: str, files: list[tuple[str, str]], copies: list[tuple[str, str]] = (), remove: bool = False) -> DataFrame:
    """Unpack archives into split folders, one task a file: files and copies are (folder, name without .gz). Targets that exist are
    skipped, archives go afterwards with remove. Returns name and what was done; both folders are mounted by every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for folder, name, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out = os.path.join(target, folder, name)
                found = find_variant(source, f"{name}.gz") if packed else os.path.join(source, name)
                if os.path.exists(out):
                    done.append("skipped")
                elif found is None or not os.path.isfile(found):
                    done.append("missing")
                else:
                    os.makedirs(os.path.dirname(out), exist_ok=True)
                    part = f"{out}.{os.getpid()}.part"
                    with gzip.open(found, "rb") if packed else open(found, "rb") as one, open(part, "wb") as two:
                        shutil.copyfileobj(one, two)
                    os.replace(part, out)  # a task that is run again leaves a whole file
                    if remove and packed:
                        os.remove(found)
                    done.append("written")
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(done, pa.string())], names=["name", "status"])

    todo = [(f, n, True) for f, n in files] + [(f, n, False) for f, n in copies]
    return spark.createDataFrame(todo, "folder string, name string, packed boolean").repartition(max(1, len(todo))).mapInArrow(run, "name string, status string")


def staged(source: str, target: str, attempts: int = 5, wait: float = 1.0, transient: tuple[int, ...] = (5, 11, 103, 110, 116)) -> str:
    """Copy one file under a temporary name and rename it; errors that pass (of input, output, time, stale handles) are tried again."""
    for k in range(attempts):
        try:
            part = f"{target}.part"
            shutil.copyfile(source, part)
            os.replace(part, target)
            return target
        except OSError as e:
            if e.errno not in transient or k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("attempts must be positive")


# ---------------------------------------------------------------- corpora
def corpus(spark: SparkSession, root: str, splits: list[str] | None = None) -> DataFrame:
    """A corpus partitioned by dataset and split; splits prunes partitions."""
    df = require_columns(spark.read.parquet(root), ["split"])
    return df.where(F.col("split").isin(*splits)) if splits else df


def split_paths(spark: SparkSession, root: str, splits: tuple[str, ...] = SPLITS, parts: tuple[str, ...] = ("x", "y")) -> dict[str, dict[str, str]]:
    """The files of each split that is there with all its parts, in the given order: ``root/folder/part.parquet`` where the splits have folders,
    else ``root/split_part.parquet``. Other splits are left out."""
    apart = exists(spark, f"{root}/{FOLDERS['train']}")
    found = {}
    for split in splits:
        paths = {p: f"{root}/{FOLDERS.get(split, split)}/{p}.parquet" if apart else f"{root}/{split}_{p}.parquet" for p in parts}
        if all(exists(spark, p) for p in paths.values()):
            found[split] = paths
    return found


def load_corpus(spark: SparkSession, root: str, splits: tuple[str, ...] = SPLITS, meta: bool = True) -> DataFrame:
    """All splits in one table: split, idx, px, label and the metadata's columns. Arrays and labels meet on idx; rows that only one of them has don't appear.

    Raises where a split is missing. Metadata (a CSV with a column idx beside each split) is optional.
    """
    paths = split_paths(spark, root, splits)
    if missing := [s for s in splits if s not in paths]:
        raise FileNotFoundError(f"no arrays and labels of {', '.join(missing)} in {root}")
    out = None
    for split, at in paths.items():
        rows = spark.read.parquet(at["x"]).join(spark.read.parquet(at["y"]), "idx")
        csv = at["x"].removesuffix("x.parquet") + "meta.csv"
        if meta and exists(spark, csv):
            rows = rows.join(spark.read.csv(csv, header=True, inferSchema=True).withColumn("idx", F.col("idx").cast("long")), "idx", "left")
        rows = rows.select(F.lit(split).alias("split"), "*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def arms(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """arm, split, n of several corpora; raises where one lacks a split."""
    out = None
    for arm, root in roots.items():
        n = load_corpus(spark, root, meta=False).groupBy("split").agg(F.count("*").alias("n")).select(F.lit(arm).alias("arm"), "split", "n")
        out = n if out is None else out.unionByName(n)
    return out


def gather(df: DataFrame, ids: DataFrame, column: str = "idx") -> DataFrame:
    """The rows with the listed ids; a positional gather without its sorting and its inverse permutation."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def batches(df: DataFrame, size: int, seed: int = 42, column: str = "idx") -> DataFrame:
    """Adds batch: max(1, n // size) batches of a seeded shuffle; rows beyond the last whole batch have none.

    Rows are numbered by ranges of their hash and the ranges' counts, without one task that sees them all.
    """
    n = df.count()
    keyed = df.withColumn("_key", S.key(seed, column))
    numbered = O.numbered(keyed, ["_key", column], "_row").drop("_key")
    whole = max(1, n // size)
    return numbered.withColumn("batch", F.when(F.col("_row") < whole * size, F.floor(F.col("_row") / size))).drop("_row")


def local_batches(df: DataFrame, size: int) -> Iterator[list]:
    """Rows for a training loop, a bounded number of partitions at a time on the driver."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


# ---------------------------------------------------------------- typed text files
def metadata_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    return require_columns(spark.read.csv(path, header=True, schema=schema), required)


def metadata_or_subset(spark: SparkSession, path: str, schema: str, subset: str | None = None, required: list[str] = ()) -> DataFrame:
    """The full metadata, or a subset manifest that replaces it; both must be there, and the manifest must have the required columns."""
    for p in filter(None, (path, subset)):
        if not exists(spark, p):
            raise FileNotFoundError(p)
    if subset is None:
        return spark.read.csv(path, header=True, schema=schema)
    named = spark.read.csv(subset, header=True)
    require_columns(named, required)
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    return named.select(*(F.expr(f"try_cast(`{c}` as {kinds[c].simpleString()})").alias(c) if c in kinds else F.col(c) for c in named.columns))


def bucket_csv(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.csv(path, header=True), ["bucket"])


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Config and manifest files; broken ones become nulls."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def json_or_none(spark: SparkSession, path: str, schema: str):
    """The first document of a file, or None where there is no file."""
    return json_documents(spark, path, schema).first() if exists(spark, path) else None


def temperature(config: DataFrame, column: str = "temperature") -> DataFrame:
    """The fitted temperature, 1 where it is missing or not positive."""
    t = F.expr(f"try_cast({column} as double)")
    return config.select(F.when(t > 0, t).otherwise(F.lit(1.0)).alias("temperature"))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """Annotation XML: name and vertices; vertices that don't parse are skipped, polygons under three go."""
    schema = "_Name string, Coordinates struct<Coordinate array<struct<_Order string, _X string, _Y string>>>"
    raw = spark.read.format("xml").option("rowTag", "Annotation").schema(schema).load(path)
    points = F.expr("filter(transform(Coordinates.Coordinate, c -> struct(try_cast(c._X as double) as x, try_cast(c._Y as double) as y)), p -> p.x is not null and p.y is not null)")
    return raw.select(F.col("_Name").alias("annotation_id"), points.alias("points")).where("size(points) >= 3")


# ---------------------------------------------------------------- images
def images(spark: SparkSession, path: str, height: int | None = None, width: int | None = None, glob: str = "*.png") -> DataFrame:
    """path, height, width, px (flattened RGB on 0..255) of image files, decoded by Spark's image source. A file that can't be read, or whose shape
    is another than asked, fails the job."""
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = []
            for r in batch.to_pylist():
                h, w, c = r["height"], r["width"], r["nChannels"]
                if h is None or h <= 0 or c not in (1, 3, 4) or (height, width) != (None, None) and (h, w) != (height, width):
                    raise ValueError(f"{r['origin']}: {h} x {w} x {c} isn't an image of {height} x {width}")
                x = np.frombuffer(r["data"], np.uint8).reshape(h, w, c)
                rgb = np.repeat(x, 3, axis=2) if c == 1 else x[:, :, 2::-1]  # blue comes first in the source
                found.append((r["origin"], h, w, rgb.astype(np.int32).ravel()))
            names = ["path", "height", "width", "px"]
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return raw.select("image.*").mapInArrow(run, "path string, height int, width int, px array<int>")


def by_path(rows: DataFrame, files: DataFrame, column: str = "path") -> DataFrame:
    """Metadata rows with the file that each names by the end of its path; scheme and root don't matter."""
    tail = F.element_at(F.split(F.col(column), "/"), -1)
    return rows.withColumn("_tail", tail).join(files.withColumn("_tail", tail).withColumnRenamed(column, "_file"), "_tail").where(F.col("_file").endswith(F.col(column))).drop("_tail", "_file")


# ---------------------------------------------------------------- archives of arrays
def archive(spark: SparkSession, path: str, columns: dict[str, str], required: list[str] = (), scalars: tuple[str, ...] = ()) -> DataFrame:
    """Rows idx and the named arrays (flattened) of .npz files, each read by one task. Missing required keys and arrays of unequal
    length fail the job; other keys that aren't there are null, scalars are repeated in every row."""
    kinds = {"double": pa.float64(), "float": pa.float32(), "long": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "string": pa.string()}
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if missing := sorted(set(required) - set(data.files)):
                    raise ValueError(f"{name} lacks {', '.join(missing)}; it has {', '.join(sorted(data.files))}")
                arrays = {c: data[c].reshape(-1) for c in columns if c in data.files}
                sizes = {len(x) for c, x in arrays.items() if c not in scalars}
                if len(sizes) > 1:
                    raise ValueError(f"{name} has arrays of lengths {sorted(sizes)}")
                n = sizes.pop() if sizes else 0
                for a in range(0, n, 65_536):
                    m = min(65_536, n - a)
                    part = [pa.array([name] * m), pa.array(np.arange(a, a + m))]
                    for c, kind in columns.items():
                        x = arrays.get(c)
                        part.append(pa.nulls(m, kinds[kind]) if x is None else pa.array(np.repeat(x[:1], m) if c in scalars else x[a : a + m]).cast(kinds[kind]))
                    yield pa.RecordBatch.from_arrays(part, names=["file", "idx", *columns])

    return files.mapInArrow(run, f"file string, idx long, {', '.join(f'{c} {k}' for c, k in columns.items())}")


PREDICTIONS = {"y_true": "double", "logits": "double", "prob_sigmoid": "double", "logits_temperature_scaled": "double", "prob_after_temperature": "double", "temperature_T": "double", "prob_mc_mean": "double", "prob_mc_std": "double"}


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return archive(spark, path, PREDICTIONS, ["y_true", "prob_after_temperature"], ("temperature_T",))


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Kept positions of a checkpoint of the quality step."""
    return archive(spark, path, {"kept_indices": "long"}, ["kept_indices"]).select("file", F.col("idx").alias("pos"), F.col("kept_indices").alias("idx"))


class ArraySource(DataSource):
    """Rows of a 2-D (or higher) array file as (idx, px), split by row ranges. Format ``sieveline_array``.

    Options: path (.npy, memory-mapped; .npz; HDF5 where h5py can be imported), key (dataset; its first one if absent), rows_per_task. A
    task reads slices of at most ``STEP`` rows and hands them over as Arrow batches.
    """

    @classmethod
    def name(cls) -> str:
        return "sieveline_array"

    def schema(self) -> str:
        return "idx long, px array<double>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))


class ArrayReader(DataSourceReader):
    STEP = 256

    def __init__(self, options: dict):
        self.path, self.key, self.step = options["path"], options.get("key", "x"), int(options.get("rows_per_task", 2048))

    def _open(self):
        if self.path.endswith(".npy"):
            return np.load(self.path, mmap_mode="r")
        if self.path.endswith(".npz"):
            file = np.load(self.path)
            return file[self.key if self.key in file.files else file.files[0]]
        import h5py

        file = h5py.File(self.path, "r")
        return file[self.key if self.key in file else next(iter(file))]

    def partitions(self) -> list[InputPartition]:
        n = len(self._open())
        return [InputPartition((a, min(a + self.step, n))) for a in range(0, n, self.step)]

    def read(self, partition: InputPartition):
        first, last = partition.value
        data = self._open()
        for a in range(first, last, self.STEP):
            part = np.asarray(data[a : min(a + self.STEP, last)], np.float64)
            flat = part.reshape(len(part), -1)
            at = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(flat))), pa.ListArray.from_arrays(at, pa.array(flat.reshape(-1)))], names=["idx", "px"])


def padded(value: Column, width: int = 3) -> Column:
    """A number as digits with zeros before it, anything else as it is."""
    v = F.trim(value)
    return F.when(v.rlike("^[0-9]+$"), F.lpad(v, F.greatest(F.length(v), F.lit(width)), F.lit("0"))).otherwise(v)


def patch_path(patient: Column, node: Column, x: Column, y: Column, pad: bool = True) -> Column:
    """Where a patch is stored by its key; pad writes the patient with three digits."""
    who = padded(patient) if pad else patient
    return F.concat(F.lit("patches/patient_"), who, F.lit("_node_"), node, F.lit("/patch_patient_"), who, F.lit("_node_"), node, F.lit("_x_"), x, F.lit("_y_"), y, F.lit(".png"))
