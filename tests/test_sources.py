"""Readers and writers on files that the tests make."""

import gzip
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import kernels as K
from sieveline.operators import dedup as D
from sieveline.sources import readers as R, sinks as W

SIDE = 4


@pytest.fixture(scope="module")
def corpus(spark):
    draw = np.random.default_rng(3)
    rows = [(s, i, draw.random(48).tolist(), float(i % 3 == 0), f"p{i % 4}") for s, n in (("train", 12), ("valid", 5), ("test", 4)) for i in range(n)]
    return spark.createDataFrame(rows, "split string, idx long, px array<double>, label double, patient string")


@pytest.fixture
def written(spark, corpus, tmp_path):
    W.write_splits(corpus, corpus.where("idx % 4 <> 1"), str(tmp_path / "c"), meta=["patient"])
    return str(tmp_path / "c")


def test_split_corpus_round_trip(spark, corpus, written):
    back = R.load_corpus(spark, written)
    kept = corpus.where("idx % 4 <> 1")
    assert back.count() == kept.count()
    rows = {(r.split, r.raw_idx): (r.idx, r.label, r.patient, r.px) for r in back.collect()}
    for r in kept.collect():
        idx, label, patient, px = rows[r.split, r.idx]
        assert (label, patient, px) == (r.label, r.patient, r.px) and idx == sum(k % 4 != 1 for k in range(r.idx))
    assert {(r.arm, r.split, r.n) for r in R.arms(spark, {"raw": written}).collect()} == {("raw", "train", 9), ("raw", "valid", 4), ("raw", "test", 3)}
    assert list(R.split_paths(spark, written, ("test", "other", "train"))) == ["test", "train"]


def test_loader_wants_every_split(spark, corpus, tmp_path):
    W.write_splits(corpus.where("split <> 'valid'"), None, str(tmp_path / "c"))
    with pytest.raises(FileNotFoundError, match="valid"):
        R.load_corpus(spark, str(tmp_path / "c"))
    n = {r.split: r.n for r in W.write_splits(corpus.where("split = 'test'"), None, str(tmp_path / "d")).collect()}
    assert n == {"train": 0, "valid": 0, "test": 4} and not os.path.exists(tmp_path / "d/train_x.parquet")


def test_folders_of_splits(spark, corpus, tmp_path):
    for split, folder in R.FOLDERS.items():
        own = corpus.where(F.col("split") == split)
        own.select("idx", "px").write.parquet(str(tmp_path / folder / "x.parquet"))
        own.select("idx", "label").write.parquet(str(tmp_path / folder / "y.parquet"))
    assert R.load_corpus(spark, str(tmp_path)).groupBy("split").count().count() == 3


def test_gunzip(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for name in ("a.bin.gz", "b.bin (1).gz"):
        with gzip.open(tmp_path / "in" / name, "wb") as f:
            f.write(name.encode())
    (tmp_path / "in" / "m.csv").write_text("x\n1\n")
    ask = lambda **kw: {r.name: r.status for r in R.gunzip(spark, str(tmp_path / "in"), str(tmp_path / "out"), [("training", "a.bin"), ("val", "b.bin"), ("val", "c.bin")], [("training", "m.csv")], **kw).collect()}
    assert ask() == {"a.bin": "written", "b.bin": "written", "c.bin": "missing", "m.csv": "written"}
    assert (tmp_path / "out/training/a.bin").read_bytes() == b"a.bin.gz" and (tmp_path / "out/val/b.bin").read_bytes() == b"b.bin (1).gz"
    assert ask() == {"a.bin": "skipped", "b.bin": "skipped", "c.bin": "missing", "m.csv": "skipped"}
    os.remove(tmp_path / "out/training/a.bin")
    ask(remove=True)
    assert not os.path.exists(tmp_path / "in/a.bin.gz") and R.find_variant(str(tmp_path / "in"), "nothing.gz") is None


def test_staging_tries_again(tmp_path, monkeypatch):
    (tmp_path / "a").write_text("x")
    assert R.staged(str(tmp_path / "a"), str(tmp_path / "b")) and (tmp_path / "b").read_text() == "x"
    calls = []

    def fails(*_):
        calls.append(1)
        raise OSError(5, "input/output")

    monkeypatch.setattr(R.shutil, "copyfile", fails)
    with pytest.raises(OSError):
        R.staged(str(tmp_path / "a"), str(tmp_path / "c"), attempts=3, wait=0)
    assert len(calls) == 3


def test_images_are_decoded(spark, tmp_path):
    draw, pictures = np.random.default_rng(1), {}
    for k in range(5):
        pictures[f"{k}.png"] = draw.integers(0, 256, (6, 6, 3)).astype(np.uint8)
        (tmp_path / f"{k}.png").write_bytes(W.png(pictures[f"{k}.png"]))
    found = {r.path.rsplit("/", 1)[1]: r.px for r in R.images(spark, str(tmp_path), 6, 6).collect()}
    assert found == {n: x.ravel().tolist() for n, x in pictures.items()}
    with pytest.raises(Exception, match="isn't an image of 9 x 9"):
        R.images(spark, str(tmp_path), 9, 9).collect()
    files = R.inventory(spark, str(tmp_path), "*.png")
    total = R.inventory_total(files).first()
    assert (total.files, total.bytes) == (5, sum(os.path.getsize(tmp_path / n) for n in pictures))
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("path"))
    rows = spark.createDataFrame([("0.png",), ("9.png",)], "path string")
    assert R.sampled_missing(rows, there).first() == (2, 1) and [r.path for r in R.missing_files(rows, there).collect()] == ["9.png"]
    with pytest.raises(FileNotFoundError, match="1 of 2"):
        R.require_files(rows, there)
    assert R.require_files(rows.where("path = '0.png'"), there) == (1, 0)


def test_picture_of_floats(spark, tmp_path):
    x = np.linspace(0, 1, 48)
    (tmp_path / "p.png").write_bytes(W.picture(x, SIDE))
    assert R.images(spark, str(tmp_path)).first().px == K.to_u8_half_even(x.reshape(1, 4, 4, 3)).ravel().tolist()
    (tmp_path / "p.png").write_bytes(W.picture(x, SIDE, 8))
    assert R.images(spark, str(tmp_path)).first().height == 8


def test_prediction_archives(spark, tmp_path):
    y, p = np.array([0, 1, 1]), np.array([[0.1], [0.7], [0.9]], np.float32)
    np.savez(tmp_path / "a.npz", y_true=y, prob_after_temperature=p, temperature_T=np.array([1.5]))
    rows = R.predictions(spark, str(tmp_path / "a.npz")).orderBy("idx").collect()
    assert [(r.idx, r.y_true, round(r.prob_after_temperature, 4), r.temperature_T, r.logits) for r in rows] == [(0, 0.0, 0.1, 1.5, None), (1, 1.0, 0.7, 1.5, None), (2, 1.0, 0.9, 1.5, None)]
    np.savez(tmp_path / "b.npz", y_true=y)
    with pytest.raises(Exception, match="lacks prob_after_temperature"):
        R.predictions(spark, str(tmp_path / "b.npz")).collect()
    np.savez(tmp_path / "c.npz", y_true=y, prob_after_temperature=p[:2])
    with pytest.raises(Exception, match="lengths"):
        R.predictions(spark, str(tmp_path / "c.npz")).collect()
    np.savez(tmp_path / "d.npz", kept_indices=np.array([4, 8]))
    assert [(r.pos, r.idx) for r in R.checkpoint(spark, str(tmp_path / "d.npz")).orderBy("pos").collect()] == [(0, 4), (1, 8)]


def test_array_source_in_slices(spark, tmp_path):
    spark.dataSource.register(R.ArraySource)
    x = np.arange(700 * 6.0).reshape(700, 2, 3)
    np.save(tmp_path / "x.npy", x)
    np.savez(tmp_path / "x.npz", other=x, x=x + 1)
    for name, want in (("x.npy", x), ("x.npz", x + 1)):
        rows = spark.read.format("sieveline_array").option("path", str(tmp_path / name)).option("rows_per_task", 300).load()
        assert rows.rdd.getNumPartitions() == 3
        assert [r.px for r in rows.orderBy("idx").collect()] == want.reshape(700, 6).tolist()


def test_polygons_and_documents(spark, tmp_path):
    point = lambda x, y: f"<Coordinate Order='0' X='{x}' Y='{y}'/>"
    xml = "<A><Annotations>" + "".join(f"<Annotation Name='{n}'><Coordinates>{''.join(point(*p) for p in ps)}</Coordinates></Annotation>" for n, ps in {"a": [(0, 0), (2, 0), ("bad", 1), (2, 2)], "b": [(0, 0), (1, 1)]}.items()) + "</Annotations></A>"
    (tmp_path / "p.xml").write_text(xml)
    rows = R.polygons(spark, str(tmp_path / "p.xml")).collect()
    assert [(r.annotation_id, [(q.x, q.y) for q in r.points]) for r in rows] == [("a", [(0, 0), (2, 0), (2, 2)])]
    (tmp_path / "t.json").write_text('{"temperature": -1}')
    assert R.temperature(R.json_documents(spark, str(tmp_path / "t.json"), "temperature string")).first()[0] == 1.0
    (tmp_path / "u.json").write_text('{"temperature": "2.5"}')
    assert R.temperature(R.json_documents(spark, str(tmp_path / "u.json"), "temperature string")).first()[0] == 2.5
    assert R.json_or_none(spark, str(tmp_path / "none.json"), "a int") is None


def test_metadata_and_subset(spark, tmp_path):
    (tmp_path / "m.csv").write_text("patient,node,tumor\n004,1,0\n020,2,1\n")
    (tmp_path / "s.csv").write_text("patient,node,split_name\n004,x,train\n")
    schema = "patient string, node int, tumor int"
    assert [r.patient for r in R.metadata_or_subset(spark, str(tmp_path / "m.csv"), schema).collect()] == ["004", "020"]
    sub = R.metadata_or_subset(spark, str(tmp_path / "m.csv"), schema, str(tmp_path / "s.csv"), ["split_name"]).collect()
    assert [(r.patient, r.node, r.split_name) for r in sub] == [("004", None, "train")]
    with pytest.raises(ValueError, match="tumor"):
        R.metadata_or_subset(spark, str(tmp_path / "m.csv"), schema, str(tmp_path / "s.csv"), ["tumor"])
    with pytest.raises(FileNotFoundError):
        R.metadata_or_subset(spark, str(tmp_path / "no.csv"), schema)
    with pytest.raises(ValueError, match="bucket"):
        R.bucket_csv(spark, str(tmp_path / "m.csv"))
    with pytest.raises(ValueError, match="label"):
        R.metadata_csv(spark, str(tmp_path / "m.csv"), schema, ["label"])
    path = spark.range(1).select(R.patch_path(F.lit("4"), F.lit("1"), F.lit("7"), F.lit("9")).alias("a"), R.patch_path(F.lit("4"), F.lit("1"), F.lit("7"), F.lit("9"), False).alias("b")).first()
    assert path.a == "patches/patient_004_node_1/patch_patient_004_node_1_x_7_y_9.png" and "patient_4_" in path.b


def test_batches_and_handoff(spark):
    df = spark.range(100).withColumnRenamed("id", "idx")
    out = R.batches(df, 16).collect()
    assert sorted(r.batch for r in out if r.batch is not None) == sorted(list(range(6)) * 16) and sum(r.batch is None for r in out) == 4
    assert [len(b) for b in R.local_batches(df, 40)] == [40, 40, 20]
    assert R.gather(df, df.where("idx in (3, 5)")).count() == 2


def test_reports_have_no_nan(spark, tmp_path):
    schema = "a double, s struct<x: double, y: array<double>>, m map<string, double>"
    df = spark.createDataFrame([(float("nan"), (float("inf"), [1.0, float("nan")]), {"k": -float("inf"), "l": 2.0}), (1.5, None, None)], schema)
    W.manifest(df, str(tmp_path / "m"))
    rows = sorted(spark.read.schema(schema).json(str(tmp_path / "m")).collect(), key=lambda r: r.a or 0)
    assert rows[0].a is None and rows[0].s.x is None and rows[0].s.y == [1.0, None] and rows[0].m == {"k": None, "l": 2.0} and rows[1].a == 1.5
    W.write_json(spark, str(tmp_path / "r.json"), {"a": math.nan, "b": [np.float32(2), {"c": np.inf}], "d": df.first()})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": None, "b": [2.0, {"c": None}], "d": {"a": None, "s": {"x": None, "y": [1.0, None]}, "m": {"k": None, "l": 2.0}}}
    W.write_json(spark, str(tmp_path / "r.json"), {})
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".part")]
    W.csv(df.select("a").where("a < 0"), str(tmp_path / "e"))
    assert next((tmp_path / "e").glob("*.csv")).read_text().strip() == "a"


def test_progress_and_checkpoint(spark, tmp_path):
    log = W.Progress(spark, str(tmp_path / "p.json"))
    log.mark("one")
    log.mark("one")
    again = W.Progress(spark, str(tmp_path / "p.json"))
    assert again.steps == ["one"] and again.done("one") and not again.done("two")
    first = W.checkpoint(spark.range(3), str(tmp_path), "train")
    assert first.count() == 3 and W.checkpoint(spark.range(9), str(tmp_path), "train").count() == 3  # not computed again


def test_manifest_and_indices(spark, corpus, tmp_path):
    hashed = corpus.withColumn("h", F.md5((F.col("idx") % 4).cast("string")))
    kept = D.keep_first(hashed)
    W.kept_indices(kept, str(tmp_path / "k"))
    doc = W.dedup_manifest(spark, str(tmp_path / "m.json"), "c", str(tmp_path / "k"), D.manifest(hashed))
    assert json.loads((tmp_path / "m.json").read_text()) == doc and doc["splits"]["train"]["n_original"] == 12 and doc["splits"]["train"]["n_removed"] == 8
    assert spark.read.parquet(str(tmp_path / "k")).count() == sum(s["n_kept"] for s in doc["splits"].values())
    W.stain_reference(spark, str(tmp_path / "s.json"), 7, 0.5, 10, 100)
    assert json.loads((tmp_path / "s.json").read_text())["reference_train_index"] == 7
    W.sample_pack(corpus, str(tmp_path / "q"), 6)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 6
    W.predictions(spark.createDataFrame([(1, 0.5, 1.0, "x")], "idx long, logits double, y_true double, other string"), str(tmp_path / "pr"))
    assert spark.read.parquet(str(tmp_path / "pr")).dtypes == [("idx", "bigint"), ("y_true", "float"), ("logits", "float")]
    W.partitioned(corpus, str(tmp_path / "part"), ["split"])
    assert R.corpus(spark, str(tmp_path / "part"), ["test"]).count() == 4


def test_html_is_escaped(spark):
    rows = spark.createDataFrame([("FP", 1, "<b>&'\"")], "bucket string, review_order int, case_id string")
    assert W.gallery(rows, ["case_id"]).first().html == "<table><tr><td>&lt;b&gt;&amp;&#39;&quot;</td></tr></table>"
