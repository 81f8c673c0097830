"""Stand-in views over the test tables, in Spark and (DUCK) in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sieveline.functions import kernels as K
from sieveline.sources.readers import table

_SPLIT = "case when {k} % 10 = 8 then 'valid' when {k} % 10 = 9 then 'test' else 'train' end"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(
        "doc_id as idx", f"{_SPLIT.format(k='doc_id')} as split", "sha2(text, 256) as h",
        "case when cast(substr(source, 4) as int) < 10 then 'A' else 'B' end as dataset", "lang", "source", "text",
    )


def patch(spark: SparkSession, d: str) -> DataFrame:
    e = "cast(embedding[case when vec_id % 7 = 0 then (i div 3) * 3 else i end] as double)"
    px = f"transform(sequence(0, 47), i -> least(greatest(3d * {e} * ((vec_id % 10) / 9d) + 0.08d * (label - 4.5d) + 0.5d, 0d), 1d))"
    return table(spark, d, "embeddings").selectExpr("vec_id as idx", f"{px} as px", "cast(label >= 5 as int) as label", f"{_SPLIT.format(k='vec_id')} as split", "vec_id % 2 as dataset", "label as class")


def pred(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id as idx", "cast(value + (event_id * 7919) % 101 > 90 as int) as y", "(value - 40d) / 10d as z", "1d / (1d + exp(-((value - 40d) / 10d))) as p",
        "user_id % 4 as arm", f"{_SPLIT.format(k='event_id')} as split", "event_id % 3 as test",
    )


def pred_bits(spark: SparkSession, d: str) -> DataFrame:
    """pred, its p to the last bit that of DUCK: for cuts among equal values."""
    df = pred(spark, d)
    return df.withColumn("p", K.logistic("z")).select(df.columns)


def pred_big(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "cast(l_extendedprice + ((l_orderkey * 7919 + l_linenumber * 31) % 60000) > 80000 as int) as y",
        "(l_extendedprice - 50000d) / 5000d as z", "1d / (1d + exp(-((l_extendedprice - 50000d) / 5000d))) as p",
    )


def meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "o_orderkey as idx", "cast(o_custkey as string) as patient", "o_orderpriority as node", "o_orderkey % 4 as split_code", "c_nationkey % 5 as center", "o_custkey as patient_id"
    )


DUCK = {
    "v_docs": f"select doc_id as idx, {_SPLIT.format(k='doc_id')} as split, sha256(text) as h, case when cast(substr(source, 4) as int) < 10 then 'A' else 'B' end as dataset, lang, source, text from documents",
    "v_patch": "select vec_id as idx, [least(greatest(3e0 * (case when vec_id % 7 = 0 then embedding[(i // 3) * 3 + 1] else embedding[i + 1] end)::double * ((vec_id % 10) / 9e0) + 0.08e0 * (label - 4.5e0) + 0.5e0, 0e0), 1e0) for i in range(48)] as px, "
    f"cast(label >= 5 as int) as label, {_SPLIT.format(k='vec_id')} as split, vec_id % 2 as dataset, label as class from embeddings",
    "v_pred": f"select event_id as idx, cast(value + (event_id * 7919) % 101 > 90 as int) as y, (value - 40e0) / 10e0 as z, 1e0 / (1e0 + exp(-((value - 40e0) / 10e0))) as p, user_id % 4 as arm, {_SPLIT.format(k='event_id')} as split, event_id % 3 as test from events",
    "v_pred_big": "select cast(l_extendedprice + ((l_orderkey * 7919 + l_linenumber * 31) % 60000) > 80000 as int) as y, (l_extendedprice - 50000e0) / 5000e0 as z, 1e0 / (1e0 + exp(-((l_extendedprice - 50000e0) / 5000e0))) as p from lineitem",
    "v_meta": "select o_orderkey as idx, cast(o_custkey as varchar) as patient, o_orderpriority as node, o_orderkey % 4 as split_code, c_nationkey % 5 as center, o_custkey as patient_id from orders join customer on o_custkey = c_custkey",
}


def duck(sql: str) -> str:
    """sql with the views that it names put before it."""
    if sql.startswith("with "):
        return sql
    used = [k for k in DUCK if f"{k} " in f"{sql} " or f"{k})" in sql or f"{k}\n" in sql]
    return f"with {', '.join(f'{k} as ({DUCK[k]})' for k in used)} {sql}" if used else sql
