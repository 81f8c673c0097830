"""Every catalog query against its SQL twin, at the smallest scale."""

import os
from datetime import datetime

import pytest

from sieveline.plans.catalog import QUERIES, SQL
from tests.oracle import differs

ROOT = "/root/testdata/sf0.001"
BUCKETS = ["ag_bucket_summary", "flt_error_buckets", "wn_bucket_ordinal"]


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, ROOT)
    if name in SQL:
        assert differs(df, ROOT, SQL[name]) is None
    else:
        assert df.count() > 0


#: Values v and 80 - v whose equal entropies differ by rounding: in DuckDB only, in Spark's own exp and log only, in both the other way round.
@pytest.mark.parametrize("pair", [(2.52, 77.48), (77.48, 2.52), (7.27, 72.73), (72.73, 7.27), (1.48, 78.52), (78.52, 1.48)])
@pytest.mark.parametrize("name", BUCKETS)
def test_ties_at_the_cut(spark, tmp_path, name, pair):
    """Of 100 rows the cut falls among the 90th and 91st, of which one value of a pair has five and the other one below or above them."""
    values = [490.0] * 87 + [-8000.0, pair[0]] + [pair[1]] * 5 + [40.0] * 6
    rows = [(i, datetime(2024, 1, 1), i, "a", v, "{}") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert differs(QUERIES[name](spark, str(tmp_path)), str(tmp_path), SQL[name]) is None
