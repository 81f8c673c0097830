"""The queries that SQL can express agree with DuckDB on whole tables, and on a fixture of planted copies."""

import pytest

from sieveline.llm import oracle, queries
from tests.oracle import differs
from tests.llm.test_operators import SCHEMA, words

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_tables(spark, name):
    assert differs(queries.queries()[name](spark, ROOT), ROOT, oracle.SQL[name]) is None


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Copies, chains of near copies, passages that several documents share, short, empty and null texts."""
    base, passage = words(200, 1), words(70, 2)
    chain = [" ".join(words(4 * k, 90 + k) + base[4 * k :]) for k in range(6)]
    shared = [" ".join(words(12 + k, 10 + k) + passage[k : 60 + k] + words(5, 30 + k)) for k in range(8)]
    texts = [*chain, *shared, chain[2], shared[3], None, "", " \t", "one two", "one  two", " ".join(["same"] * 120), " ".join(["same"] * 160)]
    root = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(k * 13 % 101, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA).write.parquet(f"{root}/documents.parquet")
    return root


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_planted(spark, planted, name):
    assert differs(queries.queries()[name](spark, planted), planted, oracle.SQL[name]) is None
