"""Packing: length buckets whose bounds minimise padding, and batches of a token budget inside each bucket.

A document's tokens are cut into sequences of at most ``CONTEXT`` tokens. The global histogram of sequence lengths has CONTEXT rows at
most; on it, dynamic programming finds the ``BUCKETS`` bounds with the least padding (every sequence is padded to its bucket's
bound). A batch of a bucket takes budget // bound sequences, numbered over the whole bucket: sequences are numbered within
shards, and shards are offset by the counts of those before, so that only each bucket's last batch is short. A hot bucket is many shards.

Defined results: tokens are the ids of a tokenizer with the end id after each text, or words where none is given; a sequence is the span of its document's
tokens from start on; null and empty texts (with words: those without any) have no sequence and don't appear; sequences of rows that repeat a doc_id are numbered apart;
equal padding prefers the smaller bounds; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from sieveline.llm import common as C
from sieveline.llm.token_store import token_counts

CONTEXT = 2048
BUCKETS = 8
BUDGET = 65_536
SHARD = 8192


def bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of the ascending lengths, with the least total padding."""
    n = len(lengths)
    if not n:
        return []
    length = np.array(lengths, np.float64)
    many = np.concatenate([[0.0], np.cumsum(np.array(counts, np.float64))])
    best = length * many[1:]  # padded size of lengths 0..j in one bucket
    choice = [np.zeros(n, np.int64)]
    for _ in range(min(buckets, n) - 1):
        new, cut = best.copy(), np.full(n, -1)
        for j in range(1, n):
            cost = best[:j] + length[j] * (many[j + 1] - many[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], cut[j] = cost[i], i
        choice.append(cut)
        best = new
    out, j, level = [], n - 1, len(choice) - 1
    while True:
        out.append(int(lengths[j]))
        while level and choice[level][j] < 0:
            level -= 1
        if not level:
            return out[::-1]
        j, level = int(choice[level][j]), level - 1


def pack(docs: DataFrame, tokenizer: str | None = None, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Per sequence: doc_id, part, start and n_tokens (its span of the document's tokens), bucket, bucket_length, padding, batch, slot."""
    sized = token_counts(docs, tokenizer) if tokenizer else docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.n_words(F.col("text")).alias("n"))
    sized = sized.where("n > 0")
    cut = sized.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(context)))))
    rows = C.stored(cut.select("doc_id", "part", F.least(F.col("n") - F.col("part") * context, F.lit(context)).cast("int").alias("n_tokens")), "lengths")
    histogram = sorted(rows.groupBy("n_tokens").count().collect())
    edges = bounds([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    total = sum(r[1] for r in histogram)
    shards = max(1, -(-total // SHARD))
    which, size = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, e in reversed(list(enumerate(edges))):
        which, size = F.when(F.col("n_tokens") <= e, i).otherwise(which), F.when(F.col("n_tokens") <= e, e).otherwise(size)
    placed = rows.select("*", which.alias("bucket"), size.alias("bucket_length"), F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int").alias("shard"))
    counts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("rows"))
    ahead = C.stored(counts.withColumn("ahead", F.sum("rows").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("rows")).drop("rows"), "ahead")
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "part", "n_tokens")) - 1
    per = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1)).cast("long")
    return (
        placed.withColumn("number", number)
        .join(ahead, ["bucket", "shard"])
        .withColumn("number", F.col("number") + F.col("ahead"))
        .select(
            "doc_id", "part", (F.col("part") * context).alias("start"), "n_tokens", "bucket", "bucket_length", (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
            F.floor(F.col("number") / per).cast("long").alias("batch"), F.pmod(F.col("number"), per).cast("long").alias("slot"),
        )
    )


def batch_tokens(packed: DataFrame, tokens: DataFrame) -> DataFrame:
    """The sequences with their ids: packed (of documents with unique doc_ids) and a token store (doc_id, ids)."""
    both = packed.join(tokens.select(F.col("doc_id").alias("_id"), F.col("ids").alias("_ids")), F.col("doc_id").eqNullSafe(F.col("_id")))
    return both.withColumn("ids", F.slice("_ids", (F.col("start") + 1).cast("int"), F.col("n_tokens"))).drop("_id", "_ids")
