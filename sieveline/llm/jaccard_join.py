"""N-gram Jaccard join: a MinHash LSH forest finds candidates, the shingle sets themselves decide.

Shingles are the runs of five words (a shorter text is one shingle); documents with equal sets are one class from the start, so
copies are never paired. Each distinct set has ``TREES`` signatures of ``DEPTH`` minimum hashes. A tree is the sorted prefix
trie of its signatures: the sets under one trie node of depth d share its first d values. The forest is read from whole signatures upwards: the
sets under the nodes of a depth are joined into candidate clusters, and the members of a cluster are compared exactly: intersections are counted by products of
incidence blocks. Each link found, of similarity j, tells how many like it this depth misses: it is found with p = 1 - (1 - j**d)**TREES, so it stands for
1 / p links. While the share of links found by that estimate is under ``RECALL``, prefixes are shortened by one value, and only clusters that grew are compared again; the
depth at which a pair at the threshold itself is found with that probability (4 for 0.9999) is the last. Without any link the forest is read down to there.

Clusters whose sets don't fit one task are cut into blocks and each pair of blocks is a task of its own. Pairs are counted where they are found and never become rows.

Defined results: words are as in ``common.WORD``, case and punctuation count; null texts and texts without words form one class of the empty set, which
links to nothing; rows that repeat a doc_id are sets of their own where their texts differ, and such a doc_id has a row for each of its rows; n_copies counts rows;
null doc_ids belong to a class but are never its id, which is null where no member has one; empty tables give empty results.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.llm import common as C
from sieveline.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 5
RECALL = 0.9999
#: Shingles of a block of a large cluster, and of a task's work on two blocks: 2 * BLOCK.
BLOCK = 1 << 16


def found_share(likeness, depth: int, trees: int = TREES):
    """Probability that sets of this similarity share a prefix of that length in some tree."""
    return 1 - (1 - likeness**depth) ** trees


def forest_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which sets of the threshold's similarity meet in some tree with the target probability."""
    while depth > 1 and found_share(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def _shingles(part: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    starts, ends, first = C.words_of(part, at)
    roll = C.Rolling(C.word_hashes(part, starts, ends))
    grams, out = roll.windows(words), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(roll.ranges(np.array([a]), np.array([b])) if b > a else np.zeros(0, C.U64))
    return out


def _sign(words: int, trees: int, depth: int, last: int):
    """Adds h1, h2, n of each text's set, and keys: the trie nodes of each tree at each depth from the whole signature down to ``last``."""
    n, levels = trees * depth, depth - last + 1
    seeds = C.mix(np.arange(1, n + 1, dtype=C.U64) * C.U64(0xA0761D6478BD642F))
    turn, times = (seeds >> C.U64(32)).astype(np.uint32)[:, None], (seeds.astype(np.uint32) | np.uint32(1))[:, None]

    def signature(sets: np.ndarray) -> np.ndarray:
        x = (sets >> C.U64(16)).astype(np.uint32)[None, :]
        least = np.full(n, 0xFFFFFFFF, np.uint32)
        for i in range(0, x.shape[1], 4096):
            y = (x[:, i : i + 4096] ^ turn) * times
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            least = np.minimum(least, y.min(axis=1))
        return least.reshape(trees, depth)

    salt = C.mix(np.arange(1, trees + 1, dtype=C.U64))

    def run(batches):
        for batch in batches:
            data, offsets = C.text_bytes(batch.column("text"))
            for a, b in C.pieces(offsets):
                sets = _shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                one = np.array([s.sum(dtype=C.U64) if len(s) else 0 for s in sets], C.U64)
                two = np.array([C.mix(s ^ C.U64(0x94D049BB)).sum(dtype=C.U64) if len(s) else 0 for s in sets], C.U64)
                keys = np.zeros((b - a, levels, trees), C.U64)
                for i, s in enumerate(sets):
                    if len(s):
                        sig, key = signature(s), salt
                        for d in range(depth):
                            key = C.mix(key ^ (sig[:, d].astype(C.U64) + C.U64(0x9E3779B97F4A7C15)))
                            if d + 1 >= last:
                                keys[i, depth - 1 - d] = key
                width = levels * trees
                flat = pa.ListArray.from_arrays(np.arange(0, (b - a) * width + 1, width, dtype=np.int32), pa.array(C.signed(keys.reshape(-1))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), batch.column("th").slice(a, b - a), pa.array(C.signed(one)), pa.array(C.signed(two)), pa.array([len(s) for s in sets], pa.int32()), flat],
                    names=["id", "th", "h1", "h2", "n", "keys"],
                )

    return run


def _sets(words: int):
    """The shingle set of each text as bytes."""

    def run(batches):
        for batch in batches:
            data, offsets = C.text_bytes(batch.column("text"))
            for a, b in C.pieces(offsets):
                sets = _shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("sid").slice(a, b - a), batch.column("cluster").slice(a, b - a), batch.column("blocks").slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["sid", "cluster", "blocks", "grams"],
                )

    return run


def _pair_mask(sets: list[np.ndarray], side: np.ndarray, threshold: Fraction, across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """n x n: True where the two sets reach the threshold, for i < j; across: of different sides only. And the similarities of those pairs."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    many = np.bincount(term) > 1
    keep = many[term]
    row, term = row[keep], np.cumsum(many)[term[keep]] - 1
    order = np.argsort(term, kind="stable")
    row, term = row[order], term[order]
    common = np.zeros((n, n), np.float32)
    width = max(64, min(4096, (1 << 24) // n))
    total = int(term[-1]) + 1 if len(term) else 0
    for t in range(0, total, width):
        a, b = np.searchsorted(term, [t, t + width])
        block = np.zeros((n, min(width, total - t)), np.float32)
        block[row[a:b], term[a:b] - t] = 1
        common += block @ block.T
    both = common.astype(np.int64)
    either = size[:, None] + size[None, :] - both
    near = both * threshold.denominator >= either * threshold.numerator
    near &= np.tri(n, k=-1, dtype=bool).T
    if across:
        near &= side[:, None] != side[None, :]
    return near, both[near] / either[near]


def _verify(threshold: float, depths: list[int], trees: int):
    """Streams rows sorted by (cluster, i, j); one group at a time is held, of two blocks at most. missed: how many links that
    the forest misses at each depth the found ones stand for, kept with one set of each group."""
    exact = Fraction(str(threshold))

    def one(key: tuple, reps: list[int], sets: list[np.ndarray], side: np.ndarray):
        n, across = len(reps), key[1] != key[2]
        if across and (side.all() or not side.any()):  # the other block is empty; pairs within a block are counted at (i, i)
            return
        if n == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            near = np.zeros((2, 2), bool)
            either = len(sets[0]) + len(sets[1]) - both
            near[0, 1] = both * exact.denominator >= either * exact.numerator and (not across or side[0] != side[1])
            likeness = np.full(int(near[0, 1]), both / either)
        else:
            near, likeness = _pair_mask(sets, side, exact, across)
        missed = [float(((1 - p) / p).sum()) for p in (found_share(likeness, d, trees) for d in depths)]
        links = near.sum(axis=0) + near.sum(axis=1)
        root = np.arange(n)
        for i, j in zip(*np.nonzero(near), strict=True) if n < 64 else _tree(near):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            while root[j] != j:
                root[j] = root[root[j]]
                j = root[j]
            root[max(i, j)] = min(i, j)
        for i in range(n):
            top = i
            while root[top] != top:
                top = root[top]
            if links[i]:
                yield reps[i], reps[top], int(links[i]), missed
                missed = None

    def _tree(near):
        """Spanning edges by search, instead of all links."""
        full, left = near | near.T, np.ones(len(near), bool)
        while left.any():
            todo = [int(np.argmax(left))]
            left[todo[0]] = False
            while todo:
                i = todo.pop()
                new = np.flatnonzero(full[i] & left)
                left[new] = False
                for j in new.tolist():
                    todo.append(j)
                    yield i, j

    def batch_of(rows):
        sid, root, links, missed = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(root, pa.int64()), pa.array(links, pa.int64()), pa.array(missed, pa.list_(pa.float64()))], names=["sid", "root", "links", "missed"])

    def run(batches):
        held, reps, sets, side, out = None, [], [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True))
            rep, own, grams = batch.column("sid").to_pylist(), batch.column("own").to_pylist(), batch.column("grams")
            for r, key in enumerate(keys):
                if key != held:
                    if len(reps) > 1:
                        out += one(held, reps, sets, np.array(side))
                    held, reps, sets, side = key, [], [], []
                if reps and reps[-1] == rep[r]:  # a row that repeats a doc_id and its text
                    continue
                reps.append(rep[r])
                sets.append(np.frombuffer(grams[r].as_py(), C.U64))
                side.append(int(own[r] != key[1]))
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        if len(reps) > 1:
            out += one(held, reps, sets, np.array(side))
        if out:
            yield batch_of(out)

    return run


def _compared(docs: DataFrame, sets: DataFrame, cluster: DataFrame, threshold: float, words: int, depths: list[int], trees: int) -> DataFrame:
    """sid, root, links, missed of the members of clusters (node, cluster), by exact comparison of all members of a cluster."""
    cluster = cluster.join(sets.select(F.col("sid").alias("node"), "n", "rep", "th"), "node")
    large = cluster.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = C.stored(cluster.join(large, "cluster").select(F.col("node").alias("sid"), "cluster", "blocks", _key("rep").alias("_id"), F.col("th").alias("_th")), "members")
    texts = docs.join(members.hint("merge"), (_key("id") == F.col("_id")) & (F.col("th") == F.col("_th")))
    grams = texts.select("sid", "cluster", "blocks", "text").mapInArrow(C.thrifty(_sets(words)), "sid long, cluster long, blocks int, grams binary")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    dealt = (
        grams.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sid", "cluster", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "grams")
    )
    n = C.partitions(docs.sparkSession)
    checked = dealt.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "sid")
    out = C.stored(checked.mapInArrow(C.thrifty(_verify(threshold, depths, trees)), "sid long, root long, links long, missed array<double>"), "linked")
    C.dropped(members)
    return out


def _key(name: str):
    return F.coalesce(F.col(name), F.lit(-(2**63)))


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Per document: doc_id, class_id (least doc_id among all documents linked to it, directly or through others), n_links
    (other distinct shingle sets at the threshold or above), n_copies (documents with the same set), n_shingles."""
    last = forest_depth(threshold, trees, DEPTH, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("th"))
    signed = C.stored(docs.mapInArrow(C.thrifty(_sign(words, trees, DEPTH, last)), "id long, th long, h1 long, h2 long, n int, keys array<long>"), "signed")
    of_set = F.min_by(F.struct("th", "keys"), F.struct(F.col("id").isNull(), "id", "th"))
    sets = signed.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"), of_set.alias("one"))
    sets = C.stored(sets.select(F.monotonically_increasing_id().alias("sid"), "h1", "h2", "n", "rep", "n_copies", "one.th", "one.keys"), "sets")
    linked = before = None
    depths = list(range(DEPTH, last - 1, -1))
    for level in range(len(depths)):
        nodes = sets.where("n > 0").select("sid", F.explode(F.slice("keys", level * trees + 1, trees)).alias("key"))
        met = nodes.groupBy("key").agg(F.min("sid").alias("top"), F.max("sid").alias("far")).where("top < far").select("key", "top")
        cluster = components(nodes.join(met, "key").select(F.col("sid").alias("a"), F.col("top").alias("b"))).withColumnRenamed("root", "cluster")
        size = C.stored(cluster.groupBy("cluster").agg(F.count("*").alias("size")), "size")
        grown = size if before is None else size.join(before, ["cluster", "size"], "left_anti")
        if not grown.isEmpty():  # clusters that are as they were have been compared
            todo = cluster.join(grown.select("cluster"), "cluster", "left_semi").select("node", "cluster")
            new = _compared(docs, sets, todo, threshold, words, depths, trees)
            linked = new if linked is None else C.stored(linked.join(todo.select(F.col("node").alias("sid")), "sid", "left_anti").unionByName(new), "linked")
        before = size
        if linked is None:
            continue
        links, missed = linked.agg(F.sum("links") / 2, F.sum(F.col("missed")[level])).first()
        if links and links / (links + missed) >= recall:
            break
    if linked is None:
        linked = docs.sparkSession.createDataFrame([], "sid long, root long, links long, missed array<double>")
    roots = components(linked.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("sid").agg(F.sum("links").alias("n_links"))
    joined = sets.join(links, "sid", "left").join(roots, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid"))
    joined = C.stored(joined.select("h1", "h2", "n", "rep", "root", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "joined")
    least = joined.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = C.stored(joined.join(least, "root").select("h1", "h2", "n", "class_id", "n_links", "n_copies"), "classes")
    return signed.select("id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select(
        F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies", F.col("n").alias("n_shingles")
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document with the least doc_id of each class, with all its columns; rows that repeat its doc_id go too. Rows without
    a doc_id have a hash of their text for one, above 2**62: one stays of a class that has no doc_id. Any further column is kept, whatever its name."""
    stand_in = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    key, keep = C.free(docs, "key"), C.free(docs, "keep")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), stand_in))
    kept = similarity_classes(keyed.select(F.col(key).alias("doc_id"), "text"), threshold).where("doc_id = class_id").select(F.col("doc_id").alias(keep)).distinct()
    return keyed.join(kept.hint("merge"), F.col(key) == F.col(keep)).dropDuplicates([key]).drop(key, keep)
