"""Hand-computed cases: ties, empty bins, edges, splits."""

import math
import time

import numpy as np
import pyarrow as pa

from sieveline.operators import dedup as D, metrics as M, sampling as S, stats as T
from pyspark.sql import functions as F


def test_keep_first_and_groups(spark):
    df = spark.createDataFrame([("t", i, h) for i, h in enumerate("abaca")], "split string, idx long, h string")
    assert sorted(r.idx for r in D.keep_first(df).collect()) == [0, 1, 3]
    assert [r.members for r in D.group_members(df).collect()] == [[0, 2, 4]]
    assert sorted(r.idx for r in D.keep_first(D.keep_first(df)).collect()) == [0, 1, 3]
    both = df.unionByName(spark.createDataFrame([("u", 9, "a")], df.schema))
    assert D.keep_first(both).where("h = 'a'").count() == 2


def test_overlap_counts_rows(spark):
    a = spark.createDataFrame([("h1",), ("h2",)], "h string")
    b = spark.createDataFrame([("h1",), ("h1",), ("h3",)], "h string")
    assert D.overlap(b, a).count() == 2
    assert [r.h for r in D.decontaminate(b, a).collect()] == ["h3"]


def test_rank_metrics_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.8)], "y int, p double")
    assert M.roc_auc(df).first()[0] == 0.875
    assert abs(M.average_precision(df).first()[0] - 5 / 6) < 1e-6
    assert M.roc_auc(df.where("y = 1")).first()[0] is None


def test_ece_bins_and_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0)], "y int, p double")
    rows = sorted(M.all_bins(df).collect())
    assert len(rows) == 15 and rows[0].n == 1 and rows[14].n == 1 and sum(r.conf is None for r in rows) == 13


def test_temperature_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0)], "y int, z double")
    assert M.fit_temperature(df).first().temperature == 0.2


def test_buckets_overlap(spark):
    df = spark.createDataFrame([(0, 0, 0.51), (1, 1, 0.99)], "idx long, y int, p double")
    assert {"FP", "high_entropy_error"} <= {r.bucket for r in S.error_buckets(df).where("idx = 0").collect()}


def test_group_holdout_rounds_half_to_even(spark):
    df = spark.range(25).withColumnRenamed("id", "g")
    assert S.group_holdout(df, "g", 0.1).where("holdout").count() == 2


def plain_draws(a, b, replicates):
    return (a[:, None] * (np.arange(1, replicates + 1, dtype=np.int64) * 1_103_515_245 % T.PRIME) + b[:, None]) % T.PRIME / T.PRIME


def resampled(a, b, x, replicates, signs):
    return next(T._partial(replicates, signs)([pa.RecordBatch.from_arrays([pa.array(c) for c in (x, a, b)], names=["x", "a", "b"])]))


def test_draws_to_the_last_place():
    """Whole-numbered x give exact sums: draws at and beside the marks and the ends of the circle, and others."""
    rng = np.random.default_rng(4)
    marks = [0, 2**30, T.PRIME - 1, *(int(v * T.PRIME) + k for v in T._POISSON for k in (0, 1))]
    a = rng.integers(0, 2**28, 1500)
    b = np.array([(marks[i % len(marks)] + i // len(marks) % 3 - 1 - a[i] * ((1 + i % 999) * 1_103_515_245 % T.PRIME)) % T.PRIME for i in range(1500)])  # replicate 1 + i % 999 of row i is at a mark, or one beside it
    x = rng.integers(-50, 50, 1500).astype(float)
    u = plain_draws(a, b, 1000)
    for signs, w in ((True, np.where(u < 0.5, -1.0, 1.0)), (False, np.searchsorted(T._POISSON, u.ravel(), "right").reshape(u.shape).astype(float))):
        out = resampled(a, b, x, 1000, signs)
        assert np.array_equal(out.column("top").to_numpy(), x @ w) and np.array_equal(out.column("base").to_numpy(), np.abs(w).sum(axis=0))


def test_draws_cost_little():
    """Neither divisions nor searches per draw."""
    rng = np.random.default_rng(4)
    a, b, x = rng.integers(0, 2**28, 2048), rng.integers(0, 2**28, 2048), rng.random(2048)

    def seconds(f):
        took = []
        for _ in range(3):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    plain = seconds(lambda: [plain_draws(a[i : i + 256], b[i : i + 256], 2000) < 0.5 for i in range(0, 2048, 256)])
    assert seconds(lambda: resampled(a, b, x, 2000, True)) < plain / 2
    assert seconds(lambda: resampled(a, b, x, 2000, False)) < plain * 0.8


def test_resampling(spark):
    df = spark.range(500).selectExpr("id as idx", "cast(id % 10 as double) as x")
    r = T.bootstrap(df, "x", replicates=200).first()
    assert r.lower < 4.5 < r.upper and r.estimate == 4.5
    again = T.bootstrap(df.repartition(7), "x", replicates=200).first()
    assert math.isclose(r.lower, again.lower, abs_tol=1e-9)
    assert T.sign_flip(df.withColumn("d", F.lit(1.0)), "d", flips=200).first().p_value < 0.02
