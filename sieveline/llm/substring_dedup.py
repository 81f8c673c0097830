"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark; repeated windows become removal intervals.

Every window of ``width`` words is hashed by a rolling polynomial. Consecutive windows that share their least ``GRAM``-word hash form a
*run*; equal windows have equal least hashes, so windows of runs with different keys never match and need not meet. Runs are
counted first, by key, then by the hash of all the words that they span: a run that occurs as a whole in an earlier document
is removed as a whole, and only the first occurrence of each distinct run of a repeated key sends its windows' own (128-bit)
hashes to be counted; the two halves come from word hashes of different bases. The removed windows of a document merge into maximal intervals.

Hot passages meet in partial aggregations and in joins of two plain shuffles, which Spark splits when they are skewed; no
group is gathered but the intervals of one document.

Defined results: null or empty text has no words and keeps the empty text; a text shorter than the window is kept whole; rows
without doc_id neither remove nor lose words; rows that repeat a doc_id are taken to repeat its text and are judged alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.llm import common as C

WIDTH = 50
GRAM = 16
_RUNS = "k long, ctx long, ctx2 long, id long, s int, e int"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    span, least = 1, x
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _runs(width: int):
    gram = min(GRAM, width)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            data, offsets = C.text_bytes(batch.column("text"))
            for a, b in C.pieces(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = C.words_of(part, at)
                roll = C.Rolling(C.word_hashes(part, starts, ends))
                grams = roll.windows(gram)
                if len(grams) < width - gram + 1:
                    continue
                other = C.Rolling(C.word_hashes(part, starts, ends, C.OTHER_BASE), 0x5DEECE66D)
                least = _sliding_min(grams, width - gram + 1)  # one value for each window of all words
                doc = np.repeat(np.arange(b - a), np.diff(first))[: len(least)]
                ok = np.arange(len(least)) + width <= first[doc + 1]
                here = np.flatnonzero(ok)
                if not len(here):
                    continue
                new = np.ones(len(here), bool)
                new[1:] = (least[here[1:]] != least[here[:-1]]) | (np.diff(here) != 1) | (doc[here[1:]] != doc[here[:-1]])
                begin = here[new]
                end = np.append(here[np.flatnonzero(new)[1:] - 1], here[-1]) + 1
                own = doc[begin]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(C.signed(least[begin])),
                        pa.array(C.signed(roll.ranges(begin, end + width - 1))),
                        pa.array(C.signed(other.ranges(begin, end + width - 1))),
                        pa.array(ids[a:b][own].astype(np.int64)),
                        pa.array((begin - first[own]).astype(np.int32)),
                        pa.array((end - first[own]).astype(np.int32)),
                    ],
                    names=["k", "ctx", "ctx2", "id", "s", "e"],
                )

    return run


def _windows(width: int):
    """Hashes of the windows of the listed runs of each document."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            runs = batch.column("runs").to_pylist()
            data, offsets = C.text_bytes(batch.column("text"))
            for a, b in C.pieces(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = C.words_of(part, at)
                hashes = C.word_hashes(part, starts, ends)
                one, two = C.Rolling(hashes).windows(width), C.Rolling(C.word_hashes(part, starts, ends, C.OTHER_BASE), 0x5DEECE66D).windows(width)
                span = [(i, r["s"], r["e"]) for i in range(a, b) for r in runs[i]]
                if not span:
                    continue
                doc, s, e = (np.array(x, np.int64) for x in zip(*span, strict=True))
                n = e - s
                skip = np.cumsum(n) - n
                pos = np.arange(int(n.sum())) - np.repeat(skip, n) + np.repeat(s, n)
                own = np.repeat(doc, n)
                place = first[own - a] + pos
                yield pa.RecordBatch.from_arrays(
                    [pa.array(C.signed(one[place])), pa.array(C.signed(two[place])), pa.array(ids[own].astype(np.int64)), pa.array(pos.astype(np.int32))],
                    names=["h1", "h2", "id", "pos"],
                )

    return run


def removal_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, cuts: the word ranges (s, e) of a document that are covered by windows which also start in an earlier document.

    The ranges of a document may touch or overlap; ``merge`` makes them maximal.
    """
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    runs = C.stored(named.where("text is not null").mapInArrow(C.thrifty(_runs(width)), _RUNS), "runs")
    shared = C.stored(
        runs.groupBy("k")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), ((F.min("ctx") < F.max("ctx")) | (F.min("ctx2") < F.max("ctx2"))).alias("several"))
        .where("lo < hi")
        .select("k", "several"),
        "shared",
    )
    found = C.stored(runs.join(shared, "k"), "found")
    owner = C.stored(found.groupBy("k", "ctx", "ctx2").agg(F.min("id").alias("owner")), "owner")
    judged = C.stored(found.join(owner, ["k", "ctx", "ctx2"]), "judged")
    whole = judged.where("id > owner").select("id", "s", (F.col("e") + (width - 1)).alias("e"))
    first = judged.where("id = owner and several").groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("runs"))
    windows = C.stored(named.join(first, "id").mapInArrow(C.thrifty(_windows(width)), "h1 long, h2 long, id long, pos int"), "windows")
    earliest = C.stored(
        windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("hi"), "earliest"
    )
    single = windows.join(earliest, ["h1", "h2"]).where("id > lo").select("id", F.col("pos").alias("s"), (F.col("pos") + width).alias("e"))
    return whole.unionByName(single).groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("cuts"))


def merge(cuts: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal intervals."""
    out: list[list[int]] = []
    for s, e in sorted((c["s"], c["e"]) for c in cuts or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _kept(text: str | None, cuts: list[dict] | None) -> tuple[int, int, bytes]:
    words = (text or "").encode().split()
    n, gone = len(words), 0
    for s, e in reversed(merge(cuts)):
        del words[s:e]
    gone = n - len(words)
    return n, gone, b" ".join(words)


def _digest(batches):
    for batch in batches:
        rows = [_kept(t.as_py(), c.as_py()) for t, c in zip(batch.column("text"), batch.column("cuts"), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def substring_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = removal_intervals(docs, width)
    both = docs.join(cuts, docs.doc_id == cuts.id, "left").select("doc_id", "text", "cuts")
    return both.mapInArrow(C.thrifty(_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _rewrite(drop_empty: bool, column: str):
    def run(batches):
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), np.ones(len(batch), bool)
            for i, cuts in enumerate(batch.column(column).to_pylist()):
                if cuts:
                    texts[i] = _kept(texts[i], cuts)[2].decode()
                    keep[i] = not drop_empty or texts[i] != ""
            names = [n for n in batch.schema.names if n != column]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return run


def remove_substrings(docs: DataFrame, width: int = WIDTH, drop_empty: bool = True) -> DataFrame:
    """The documents without their repeated passages: a text that loses words is its kept words joined by one space.

    Untouched texts stay as they are. With drop_empty, a document that lost all its words goes. n_chars, where there is such
    a column, follows the text.
    """
    key, column = C.free(docs, "cut_id"), C.free(docs, "cuts")
    cuts = removal_intervals(docs.select("doc_id", "text"), width).select(F.col("id").alias(key), F.col("cuts").alias(column))
    both = docs.join(cuts.hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    out = both.mapInArrow(C.thrifty(_rewrite(drop_empty, column)), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
