"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

A term is a word (``common.WORD``), its weight the number of times it occurs. For each of ``SAMPLES`` samples a term draws r and c from Gamma(2, 1) and b from U(0, 1): a
hash chooses among 2**LOT draws prepared by quantiles; t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the term of least a, with its t, is the sample (of
several with the least a, the one of the least hash). Two documents agree in a sample with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima. A sample is kept as 16 bits of a hash of
(term, t), four hex digits.

The next document by doc_id is found without gathering the table: documents are dealt into ranges whose first ids are known, and the first document of each range is also sent
to the range before it (the very first to the last). Only those range bounds, one per partition, go to the driver.

Defined results: null text is empty; an empty text has the fingerprint of zeros and is like other empty texts only; rows with equal doc_id follow each other
by a hash of their text, null doc_ids come first; a single document follows itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.llm import common as C

SAMPLES = 128
#: Rows of draws that are held at a time, of SAMPLES numbers each.
ROWS = 65_536
#: Rows that are kept from block to block.
KEPT = 65_536
#: Bits of a word's hash that tell terms apart; the others number the texts of a block while its words are sorted.
TERM = 52
#: Bits that choose (r, ln c, b) among the prepared draws.
LOT = 18
_TURN = C.U64(0x9E3779B97F4A7C15)


def _prepared() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2**LOT draws of r and c from Gamma(2, 1) and b from U(0, 1): the middles of equal steps of probability, each shuffled on its own.
    The gamma quantiles are found by Newton's method on 1 - (1 + x) exp(-x)."""
    n = 1 << LOT
    p = (np.arange(n) + 0.5) / n
    x = np.where(p < 0.5, np.sqrt(2 * p), 2.0 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), 1e-9)
    shuffle = np.random.default_rng(20_100_601).permutation
    return x[shuffle(n)].astype(np.float32), np.log(x[shuffle(n)]).astype(np.float32), p[shuffle(n)].astype(np.float32)


class Sampler:
    """A hash of (term, sample) chooses its draws among the prepared ones, so that a term of weight 1 costs one lookup a sample."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.seeds = (C.mix(np.arange(1, samples + 1, dtype=C.U64) * C.U64(0x2545F4914F6CDD1D)) >> C.U64(32)).astype(np.uint32)
        self.r, self.log_c, self.b = _prepared()
        self.log_a = self.log_c - self.r * (1 - self.b)  # of weight 1, where t is 0
        self.kept, self.kept_rows = np.zeros(1, C.U64), np.zeros((1, samples), np.float32)  # 0 is no pair

    def lots(self, term: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Places of the prepared draws of each pair that the two make by broadcasting."""
        x = (term >> C.U64(32)).astype(np.uint32) ^ seed
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x += (term >> C.U64(64 - TERM)).astype(np.uint32)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x >>= np.uint32(32 - LOT)
        return x

    def draw(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """ln a of each (term, sample)."""
        out = np.empty((len(term), self.samples), np.float32)
        for i in range(0, len(term), 64):  # what a step needs stays in the processor's cache
            lot = self.lots(term[i : i + 64, None], self.seeds[None, :])
            part = out[i : i + 64]
            self.log_a.take(lot, out=part, mode="clip")
            many = np.flatnonzero(weight[i : i + 64] > 1)
            if len(many):
                rest = slice(many[0], None)  # the first of these and all after it
                lot, log_w = lot[rest], np.log(weight[i : i + 64][rest]).astype(np.float32)[:, None]
                r, b = self.r.take(lot), self.b.take(lot)
                log_w = log_w / r
                log_w += b
                np.floor(log_w, out=log_w)
                log_w -= b
                log_w += np.float32(1)
                log_w *= r
                np.subtract(self.log_c.take(lot), log_w, out=part[rest])
        return out

    def rows_of(self, pair: np.ndarray, term: np.ndarray, weight: np.ndarray, many: np.ndarray) -> np.ndarray:
        """As draw, for distinct pairs of term and weight in ascending order; rows of those that occur often are kept for later blocks."""
        at = np.minimum(np.searchsorted(self.kept, pair), len(self.kept) - 1)
        known = self.kept[at] == pair
        out, new = np.empty((len(pair), self.samples), np.float32), np.flatnonzero(~known)
        out[known] = self.kept_rows[at[known]]
        # terms of weight 1 stand together
        new = new[np.argsort(weight[new] > 1, kind="stable")]
        out[new] = self.draw(term[new], weight[new])
        often = np.flatnonzero(~known & (many > 2))
        if len(often):
            if len(self.kept) + len(often) > KEPT:
                often = np.flatnonzero((known | (many > 2)))[:KEPT]
                self.kept, self.kept_rows = pair[often], out[often]
            else:
                keys = np.concatenate([self.kept, pair[often]])
                order = np.argsort(keys, kind="stable")
                self.kept, self.kept_rows = keys[order], np.concatenate([self.kept_rows, out[often]])[order]
        return out

    def code(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """16 bits of each sample's term and t; never 0. The last axis is samples."""
        lot = self.lots(term, self.seeds)
        t = np.floor(np.log(weight).astype(np.float32) / self.r.take(lot) + self.b.take(lot)).astype(np.int64)
        return np.maximum(C.mix(term + t.view(C.U64) * _TURN) >> C.U64(48), C.U64(1)).astype(np.uint16)

    def sign(self, term: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Samples of bags: the terms and weights of bag i stand from first[i] to first[i + 1], terms ascending."""
        n, at = len(first) - 1, np.zeros((len(first) - 1, self.samples), np.int64)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(first, first[i] + ROWS, "right")) - 1)
            a, z = int(first[i]), int(first[j])
            if z - a > ROWS:  # one long bag
                best = np.full(self.samples, np.inf, np.float32)
                for k in range(a, z, ROWS):
                    log_a = self.draw(term[k : min(z, k + ROWS)], weight[k : min(z, k + ROWS)])
                    low = log_a.argmin(axis=0)
                    value = log_a[low, np.arange(self.samples)]
                    less = value < best
                    best, at[i] = np.where(less, value, best), np.where(less, k + low, at[i])
            elif z > a:
                pair = C.mix(term[a:z] + weight[a:z].astype(C.U64))  # terms have no low bits, weights no high ones
                pair, one, row, many = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                log_a = self.rows_of(pair, term[a:z][one], weight[a:z][one], many)
                for d in range(i, j):
                    s, e = first[d] - a, first[d + 1] - a
                    if e > s:
                        at[d] = first[d] + log_a.take(row[s:e], axis=0).argmin(axis=0)
            i = j
        out = np.zeros((n, self.samples), np.uint16)
        some = np.flatnonzero(np.diff(first))
        for i in range(0, len(some), 64):
            pick = some[i : i + 64]
            out[pick] = self.code(term[at[pick]], weight[at[pick]])
        return out


_held: list[Sampler] = []


def sampler() -> Sampler:
    if not _held:
        _held.append(Sampler())
    return _held[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written(sign: np.ndarray) -> str:
    return sign.astype(">u2").tobytes().hex()


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of each text, ascending, how often each occurs, and where each text's begin."""
    data, offsets = C.text_bytes(pa.array(texts, pa.large_string()))
    terms, weights, counts = [np.zeros(0, C.U64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    number = C.U64(64 - TERM)
    for low, high in C.pieces(offsets):
        for a in range(low, high, 1 << (64 - TERM)):
            b = min(high, a + (1 << (64 - TERM)))
            part = data[offsets[a] : offsets[b]]
            starts, ends, first = C.words_of(part, offsets[a : b + 1] - offsets[a])
            key = C.word_hashes(part, starts, ends) >> number
            key |= np.repeat(np.arange(b - a, dtype=C.U64) << C.U64(TERM), np.diff(first))
            key.sort()
            new = np.ones(len(key), bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            at = np.flatnonzero(new)
            terms.append(key[at] << number)
            weights.append(np.diff(np.append(at, len(key))))
            counts.append(np.bincount((key[at] >> C.U64(TERM)).astype(np.int64), minlength=b - a))
    return np.concatenate(terms), np.concatenate(weights), np.cumsum(np.concatenate(counts))


def fingerprint(texts: list[str | None]) -> np.ndarray:
    return sampler().sign(*bags(texts))


def edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n] if n else text


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _digest(batches):
    held: list[tuple] = []  # own rows whose next document isn't seen yet come last
    closed, size = None, 0

    def settle(rows):
        """rows: (doc_id, text), the last one only as the next of the one before."""
        texts = [t for _, t in rows]
        new = [edited(t, n) for t, n in zip(texts, texts[1:], strict=False)]
        signs = fingerprint([t for both in zip(texts, [*new, None], strict=True) for t in both])  # a text and its edited text share most draws
        plain, other = signs[0::2], signs[1::2]
        out = [
            (i, len(t), hashlib.sha256(e.encode()).hexdigest(), written(a), written(b), likeness(a, b), likeness(a, c))
            for (i, t), e, a, b, c in zip(rows, new, plain, other, plain[1:], strict=False)
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    for batch in batches:
        for i, ahead, t in zip(batch.column("doc_id").to_pylist(), batch.column("ahead").to_pylist(), batch.column("text"), strict=True):
            if closed:
                continue
            held.append((i, t.as_py() or ""))
            closed, size = ahead, size + len(held[-1][1])
            if len(held) > 1024 or size > 2 << 20 or ahead:
                if len(held) > 1:
                    yield settle(held)
                held = held[-1:]
                size = len(held[0][1])


def _deal(ids: np.ndarray, hashes: np.ndarray, split: np.ndarray):
    """Adds the partition of each document, and sends the first document of a range also to the range before it. Range k begins with (ids[k], hashes[k]);
    split: whether ids[k] fills several ranges, so that its hash counts."""
    last = len(ids) - 1

    def run(batches):
        for batch in batches:
            own_id = np.array([_LOWEST if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            own_hash = batch.column("hash").to_numpy(zero_copy_only=False)
            own = np.searchsorted(ids, own_id, "right") - 1
            for r in np.flatnonzero(split[own] & (ids[own] == own_id)).tolist():
                low = np.searchsorted(ids, own_id[r], "left")
                own[r] = low + np.searchsorted(hashes[low : own[r] + 1], own_hash[r], "right") - 1
            first = np.flatnonzero((ids[own] == own_id) & (~split[own] | (hashes[own] == own_hash)))
            rows = pa.array(np.concatenate([np.arange(len(own)), first]))
            part = np.concatenate([own, np.where(own[first] == 0, last, own[first] - 1)])
            ahead = np.concatenate([np.zeros(len(own), bool), np.ones(len(first), bool)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in ("doc_id", "text", "hash")), pa.array(part.astype(np.int32)), pa.array(ahead)], names=["doc_id", "text", "hash", "part", "ahead"]
            )

    return run


_LOWEST = -(2**63)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, ahead: sorted by doc_id within partitions, each of which ends with the document after its last one (ahead).

    A doc_id that many rows have, null for one, fills several ranges of the hashes of its texts.
    """
    n = C.ranges(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text"))
    key = F.coalesce("doc_id", F.lit(_LOWEST))
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", F.array(*(F.lit(i / n) for i in range(n))), max(10_000, 20 * n)), F.min("k")).first()
    if cuts[1] is None:
        return docs.select("doc_id", "text", F.lit(False).alias("ahead"))
    ids, many = np.unique(np.array([*cuts[0], cuts[1]], np.int64), return_counts=True)
    many[0] -= 1  # the least doc_id is among the quantiles, too
    hot = {int(v): int(m) for v, m in zip(ids, many, strict=True) if m > 1}
    starts = [(int(v), _LOWEST, False) for v in ids if int(v) not in hot]
    if hot:  # the ranges' true first hashes: at most n rows
        share = F.lit(0)
        for v, m in hot.items():
            share = F.when(F.col("k") == v, F.floor((F.col("hash") / 2.0**64 + 0.5) * m)).otherwise(share)
        found = docs.select(key.alias("k"), "hash").where(F.col("k").isin(list(hot))).groupBy("k", share.alias("share")).agg(F.min("hash").alias("low")).collect()
        starts += [(r["k"], r["low"], True) for r in found]
    starts.sort()
    deal = _deal(np.array([x[0] for x in starts], np.int64), np.array([x[1] for x in starts], np.int64), np.array([x[2] for x in starts]))
    dealt = docs.mapInArrow(deal, "doc_id long, text string, hash long, part int, ahead boolean")
    return dealt.repartitionById(len(starts), F.col("part")).sortWithinPartitions("ahead", F.asc_nulls_first("doc_id"), "hash", "text").select("doc_id", "text", "ahead")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, its edited text's, and their likenesses."""
    return with_next(docs).mapInArrow(_digest, _OUT)
