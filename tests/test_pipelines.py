"""Composed pipelines end to end on small corpora, and the streaming extension."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import stain as T
from sieveline.operators import quality as Q, routing as R
from sieveline.plans import pipelines as P
from sieveline.sources import readers, sinks
from sieveline.streaming import incremental as I
from tests.test_kernels import STAINS, stained

SIDE = 40


@pytest.fixture(scope="module")
def patches(spark):
    rows = []
    for i in range(24):
        x = stained(STAINS, i, 0.6 + 0.03 * i)
        if i % 8 == 5:
            x = np.full_like(x, 0.4)
        if i % 8 == 6:
            x[:25] = 0.02
        rows.append((("train", "valid", "test")[i % 3], i, x.ravel().tolist(), float(i % 2)))
    return spark.createDataFrame(rows, "split string, idx long, px array<double>, label double").repartition(4).cache()


@pytest.fixture(scope="module")
def pack():
    return T.Pack.fit(stained(STAINS, 100), vahadane=True)


def test_process(patches, pack):
    rows, report = P.process(patches, [pack], SIDE)
    kept = {r.idx: r for r in rows.collect()}
    images = {r.idx: np.array(r.px).reshape(SIDE, SIDE, 3) for r in patches.collect()}
    reasons = {r.idx: r.reason for r in Q.features(patches, side=SIDE).select("idx", Q.gate().alias("reason")).collect()}
    assert reasons[5] == "solid_color" and reasons[6] == "high_black" and set(kept) == {i for i, r in reasons.items() if r is None}
    for split in ("train", "valid", "test"):
        own = [i for i in kept if kept[i].split == split]
        cut = np.percentile([(images[i][..., 2] > images[i][..., 0]).mean() for i in own], 25)
        made = {i: T.adaptive(images[i], pack, cut) for i in own}
        red, pink = ({i: f(x) for i, (x, _) in made.items()} for f in (lambda x: x[..., 0].mean(), lambda x: (x[..., 0] > x[..., 2]).mean()))
        tail = {i for i in own if red[i] <= np.percentile(list(red.values()), 2) or pink[i] <= np.percentile(list(pink.values()), 2)}
        for i in own:
            want = np.floor(T.luminosity(images[i]) * 255) / 255 if i in tail else made[i][0]
            assert kept[i].in_tail == (i in tail) and kept[i].code == (T.LUMINOSITY if i in tail else made[i][1])
            assert np.allclose(np.array(kept[i].norm_px), want.ravel(), atol=1 / 254)
    for r in report.collect():
        assert r.n_before == 8 and r.n_before - r.n_after == r.removed_solid_color + r.removed_high_black + r.removed_low_tissue
        assert sum(r[c] for c in T.CODES) == r.n_after and r.tail_replaced <= r.luminosity_only
    assert P.dataset_summary(report).first().n_before == 24


def test_other_methods_and_candidates(patches, pack):
    some = patches.where("idx < 6").select("split", "idx")
    rows, _ = P.process(patches, [pack], SIDE, method="macenko", candidates=some)
    assert {r.code for r in rows.collect()} <= {T.MACENKO, T.LUMINOSITY} and rows.where("idx >= 6").count() == 0


def test_router_on_rows(patches, pack):
    feats = Q.features(patches, side=SIDE)
    anchor = R.row_features(stained(STAINS, 0))
    refs = np.stack([R.row_features(stained(STAINS, k)) for k in (1, 2, 3)])
    router = R.fit_router(feats, anchor, refs)
    packs = [T.Pack.fit(stained(STAINS, k)) for k in (1, 2, 3)]
    rows, _ = P.process(patches, packs, SIDE, router=router)
    z = {r.idx: (np.array([r[n] for n in R.ROUTING]) - router.mean) / router.std for r in feats.collect()}
    for r in rows.withColumn("pack", router.pack([p.mean_rgb for p in packs])).collect():
        c = int(((z[r.idx] - router.centres) ** 2).sum(axis=1).argmin())
        colour = np.array([r.mean_r, r.mean_g, r.mean_b])
        assert r["pack"] == (int(np.argmin([np.abs(colour - p.mean_rgb).sum() for p in packs])) if c == router.merge else router.packs[c])


def test_benchmark_goes_on_where_it_stopped(patches, pack, tmp_path):
    router = R.Router(np.zeros(7), np.ones(7), np.zeros((4, 7)), 0, {1: 0, 2: 1, 3: 2})
    packs, sizes, methods = [pack] * 3, {"train": 4, "valid": 4}, ("macenko", "adaptive_multi_ref", "adaptive_multi_ref_aug")
    first = P.benchmark(patches, packs, router, str(tmp_path), sizes, SIDE, methods=methods[:1])
    assert first == ["subset", "macenko:train", "macenko:valid"]
    rest = P.benchmark(patches, packs, router, str(tmp_path), sizes, SIDE, methods=methods)
    assert rest == [f"{m}:{s}" for m in methods[1:] for s in sizes]
    assert P.benchmark(patches, packs, router, str(tmp_path), sizes, SIDE, methods=methods) == []
    spark = patches.sparkSession
    plain, aug = ({r.idx: r.px for r in spark.read.parquet(f"{tmp_path}/{m}/train").collect()} for m in methods[1:])
    assert set(plain) == set(aug) and all(plain[i] != aug[i] for i in plain)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/{methods[1]}/valid").select("idx", "code").collect()} == {tuple(r) for r in spark.read.parquet(f"{tmp_path}/{methods[2]}/valid").select("idx", "code").collect()}


def test_deduplicate_and_decontaminate(spark, tmp_path):
    rows = [("train", i, "abac"[i], [0.1 * i] * 3, 1.0) for i in range(4)] + [("test", 9, "a", [0.5] * 3, 0.0)]
    a = spark.createDataFrame(rows, "split string, idx long, h string, px array<double>, label double")
    kept, manifest = P.deduplicate(a, str(tmp_path / "k"), str(tmp_path / "c"), str(tmp_path / "m.json"))
    assert P.verified(a, kept) and not P.verified(a, a)
    assert {(r.split, r.n_kept, r.n_removed) for r in manifest.collect()} == {("train", 3, 1), ("test", 1, 0)}
    assert readers.load_corpus(spark, str(tmp_path / "c"), ("train", "test")).count() == 4 and json.loads((tmp_path / "m.json").read_text())["splits"]["test"]["n_kept"] == 1
    other = spark.createDataFrame([("train", "b")], "split string, h string")
    left, report = P.decontaminate(a, other, ("train",))
    assert left.count() == 4 and {(r.split, r.n_original, r.n_kept, r.n_removed) for r in report.collect()} == {("train", 4, 3, 1), ("test", 1, 1, 0)}
    with pytest.raises(ValueError, match="other has no rows of test"):
        P.decontaminate(a, other, ("train", "test"))


def test_build_corpus(spark, tmp_path):
    draw = np.random.default_rng(0)
    for k in range(6):
        (tmp_path / "img").mkdir(exist_ok=True)
        (tmp_path / f"img/{k}.png").write_bytes(sinks.png(draw.integers(0, 256, (4, 4, 3)).astype(np.uint8)))
    meta = spark.createDataFrame([(f"img/{k}.png", ("train", "valid", "test")[k % 3], k % 2, f"p{k}") for k in range(6)], "path string, split string, label int, patient string")
    images = readers.images(spark, str(tmp_path / "img"), 4, 4)
    stats = P.build_corpus(meta, images, str(tmp_path / "out"), 4, columns=["patient"])
    assert {(r.split, r.n_samples, r.n_positive) for r in stats.collect()} == {("train", 2, 1), ("valid", 2, 1), ("test", 2, 1)}
    back = readers.load_corpus(spark, str(tmp_path / "out"))
    assert {(r.split, r.idx, r.patient) for r in back.collect()} == {("train", 0, "p0"), ("train", 1, "p3"), ("valid", 0, "p1"), ("valid", 1, "p4"), ("test", 0, "p2"), ("test", 1, "p5")}
    with pytest.raises(ValueError, match="missing"):
        P.build_corpus(meta, images.where("path not like '%0.png'"), str(tmp_path / "o2"), 4)


def test_review_bundle(spark, tmp_path):
    rows = [(i, i % 2, (0.95 if i % 7 else 0.2) if i % 3 else 0.49) for i in range(60)]
    preds = spark.createDataFrame(rows, "idx long, y int, p double").withColumn("split", F.lit("test"))
    kept = spark.createDataFrame([("test", i, 10 * i) for i in range(60)], "split string, pos long, idx long")
    pictures = spark.createDataFrame([(i, [i / 60] * 48) for i in range(60)], "h5_index long, px array<double>")
    cases = P.export_review(preds, str(tmp_path), 3, images=pictures, side=4, size=8, facts={"condition": "C<1>"})
    found = cases.collect()
    assert {r.bucket for r in found} >= {"FP", "FN", "confident_error"} and all(r.raw_h5_index == r.h5_index for r in found)
    with_map = P.export_review(preds.drop("split").withColumn("split", F.lit("test")), str(tmp_path / "b"), 2).collect()
    assert len(with_map) <= 10
    csv = spark.read.csv(str(tmp_path / "selected_cases"), header=True)
    assert csv.count() == len(found) and "px" not in csv.columns
    assert len(spark.read.csv(str(tmp_path / "review_labels_template"), header=True).columns) == 11
    summary = json.loads((tmp_path / "bucket_sampling_summary.json").read_text())
    assert summary["n_total"] == 60 and all(b["sampled_n"] + b["shortfall"] == 3 for b in summary["buckets"])
    page = (tmp_path / "gallery.html").read_text()
    assert page.count("<figure>") == len(found) and page.index("<h2>FN") < page.index("<h2>FP")
    assert len(list((tmp_path / "figures").glob("*.png"))) == len(found) and (tmp_path / "README_REVIEW.txt").exists()
    assert P.review(preds, 3).count() == len(found) and kept.count() == 60


def test_conditions_and_status(spark):
    found = P.conditions({"A": "runs/a", "B": "runs/b"})
    assert [(c["condition"], c["trained"], c["tested"]) for c in found] == [("C1", "A", "A"), ("C2", "A", "B"), ("C3", "B", "B"), ("C4", "B", "A")]
    checks = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "split string, kept long")
    outs = spark.createDataFrame([("a", 5, 5), ("b", 3, 3), ("d", 2, None), ("e", None, None)], "split string, x long, y long")
    assert {r.split: r.status for r in P.statuses(checks, outs).collect()} == {"a": "DONE", "b": "step 1 done", "c": "step 1 done", "d": "partial", "e": "not started"}


def test_incremental_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "h string, t int").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("b",)], "h string")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, out in (("dedup", I.dedup_stream(stream)), ("overlap", I.overlap_stream(stream, known))):
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120) is not False
    assert sorted(r.h for r in spark.table("dedup").collect()) == ["a", "b", "c"] and [r.h for r in spark.table("overlap").collect()] == ["b"]
