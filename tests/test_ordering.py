"""Positions, running sums and percentiles in ranges against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import dedup as D, metrics as M, ordering as O, sampling as S


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    return [(i, draw.choice("ab"), draw.choice([None, 0.5, draw.random(), draw.random()]), draw.randint(0, 3)) for i in range(900)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "idx long, g string, v double, n long").repartition(5)


def order(r):
    return (r[2] is not None, r[2] or 0.0, r[0])


def test_numbered(df, rows):
    found = {r.idx: r.at for r in O.numbered(df, ["v", "idx"], "at", ranges=9).collect()}
    assert found == {r[0]: k for k, r in enumerate(sorted(rows, key=order))}
    by = {r.idx: r.at for r in O.numbered(df, ["v", "idx"], "at", ["g"], 9).collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[1] == g), key=order)
        assert all(by[r[0]] == k for k, r in enumerate(own))
    assert O.numbered(df.where("idx < 0"), ["v"], "at").count() == 0


def test_running(df, rows):
    found = {r.idx: r.s for r in O.running(df, ["idx"], {"s": "n"}, ranges=7).collect()}
    assert found == {r[0]: int(c) for r, c in zip(rows, np.cumsum([r[3] for r in rows]), strict=True)}


def test_percentiles(df, rows):
    found = O.percentiles(df, "v", [0.02, 0.5, 0.9, 1.0], ["g"], list("wxyz"), 9).collect()
    for r in found:
        own = [x[2] for x in rows if x[1] == r.g and x[2] is not None]
        assert np.allclose([r.w, r.x, r.y, r.z], np.percentile(own, [2, 50, 90, 100]))
    one = O.percentiles(df, "v", [0.25]).first()[0]
    assert np.isclose(one, np.percentile([x[2] for x in rows if x[2] is not None], 25))
    assert O.percentiles(df.where("idx < 0"), "v", [0.5]).first()[0] is None


def test_no_task_sees_all(df):
    plan = M.roc_auc(df.selectExpr("n % 2 as y", "v as p"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 2  # the totals of the ranges, and the last row


def test_ranks_against_all_pairs(spark, rows):
    own = [(r[0], r[3] % 2, r[2]) for r in rows if r[2] is not None]
    df = spark.createDataFrame(own, "idx long, y long, p double")
    pos, neg = [p for _, y, p in own if y], [p for _, y, p in own if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(M.roc_auc(df).first()[0] - auc) < 1e-6
    ranks = {r.idx: r.r for r in M.average_rank(df).collect()}
    for i, _, p in own[:50]:
        assert ranks[i] == sum(q < p for *_, q in own) + (sum(q == p for *_, q in own) + 1) / 2
    mark = [r.mark for r in sorted(O.milestones(df, ["idx"]).collect())]
    assert mark == list(range(1, 11))


def test_temperature_by_group(spark):
    draw = random.Random(2)
    rows = [(g, int(draw.random() < 1 / (1 + np.exp(-z / (1 + g)))), z) for g in (0, 1, 2) for z in [draw.gauss(0, 3) for _ in range(800)]]
    df = spark.createDataFrame(rows, "g int, y int, z double").repartition(4)
    for r in M.fit_temperature(df, ["g"]).collect():
        own = [(y, z) for g, y, z in rows if g == r.g]
        losses = [np.mean([-np.log(np.clip(q if y else 1 - q, 1e-7, None)) for y, z in own for q in [np.clip(1 / (1 + np.exp(-z / t)), 1e-7, 1 - 1e-7)]]) for t in M.temperatures()]
        assert np.isclose(r.temperature, M.temperatures()[int(np.argmin(losses))], atol=1e-5) and np.isclose(r.nll, min(losses), atol=1e-5)


def test_keep_first_with_null_keys(spark):
    df = spark.createDataFrame([("t", 0, None), ("t", 1, None), ("t", 2, "a"), ("u", 3, None), ("t", 4, "a")], "split string, idx long, h string")
    kept = D.keep_first(df)
    assert sorted(r.idx for r in kept.collect()) == [0, 2, 3]
    assert {(r.split, r.n_kept) for r in D.manifest(df).collect()} == {("t", 2), ("u", 1)}
    assert all(r.unique_ok and r.count_ok for r in D.integrity(df, kept).collect())
    short = {r.split: (r.unique_ok, r.count_ok) for r in D.integrity(df, kept.where("idx > 0")).collect()}
    assert short["t"] == (True, False) and short["u"] == (True, True)
    assert not D.integrity(df, df).where("split = 't'").first().unique_ok


def test_map_of_positions(spark):
    raw = spark.createDataFrame([("t", 5), ("t", 9), ("t", 12)], "split string, idx long")
    kept = D.positions(raw)
    prepared = spark.createDataFrame([("t", 0), ("t", 1), ("t", 2)], "split string, pos long")
    assert sorted((r.pos, r.idx) for r in D.to_raw(prepared, kept).collect()) == [(0, 5), (1, 9), (2, 12)]
    assert [r.idx for r in D.to_raw(prepared, None).orderBy("pos").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        D.to_raw(prepared, kept.where("pos < 2"))


def test_splits_fail_when_empty(spark):
    meta = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "idx long, patient_node string, split int")
    with pytest.raises(ValueError):
        S.assigned_splits(meta, share=1.5)
    with pytest.raises(ValueError):
        S.assigned_splits(meta)  # one group to train on and test with
    with pytest.raises(ValueError, match="empty"):
        S.official_splits(meta)
    more = spark.createDataFrame([(i, f"g{i % 25}", int(i % 5 == 0)) for i in range(200)], "idx long, patient_node string, split int")
    out = S.assigned_splits(more).collect()
    test = {r.patient_node for r in out if r.split == "test"}
    assert len(out) == 200 and test.isdisjoint(r.patient_node for r in out if r.split == "train")
    assert S.stratum_seed(42, 1, 2) == 42 + 20014 + 123 and S.above(more, "idx", 190, 3).count() == 3
    assert [r.idx for r in S.first_matches(more, F.col("idx") % 50 == 0, 3, 120).collect()] == [0, 50, 100]
