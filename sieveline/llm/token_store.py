"""Token ids in Parquet: a list column with dictionary or delta encoding, bounded row groups and pages, and page indexes.

Texts are dealt by ranges of (doc_id, hash of the text) to one file each, sorted, and encoded where they land. Spark's writer stores ids under format v2: a
dictionary, or delta packing where it falls back, row groups of ``ROW_GROUP`` bytes and pages of ``PAGE`` bytes with column and offset indexes.
``read_lengths`` touches only the columns of metadata and ``read_some`` only the row groups and pages that may hold the asked documents.

The library encodes each distinct piece of a block of texts once: the byte-level pre-tokeniser cuts at each single space or line break between other characters and
between a letter and a mark after it, and BPE works on each piece alone. Equal pieces are found by Arrow's dictionary encoding. Texts with other white space at a cut, or with a special token's string, are
encoded whole by the library. Pieces are kept for later blocks in two generations of ``CACHE`` at most.

Defined results: null text is empty and has only the end id; ids are stored as int, whatever the vocabulary; files in the order of their names, and rows in the
order of each file, ascend by doc_id, null first, and equal doc_ids by a hash of their text; an empty table gives an empty store.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sieveline.llm import common as C

END = 2
ROW_GROUP, PAGE = 16 << 20, 128 << 10
CACHE = 500_000
#: Characters of the texts that are encoded at a time; a text of twice as many is cut between pieces.
BLOCK = 1 << 21
# White space other than a single space or line break between other characters, and the cutting sign itself.
_ODD = ["\0", "  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
_MARKS = ".,;:!?#$%&*"
# The byte-level alphabet: printable Latin-1 stands for itself, the other bytes in turn for the signs from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SIGNS = np.arange(256, dtype="<u4")
_SIGNS[[b for b in range(256) if b not in _PLAIN]] = 256 + np.arange(256 - len(_PLAIN))
_SIGNS[10] = 10  # parts pieces here
_BETWEEN = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")
_held: dict[str, Encoder] = {}


def _one_piece(piece: bytes) -> bool:
    """Whether a piece is letters alone (up to Latin Extended-B) or ASCII digits alone, with a space before them or not: the pre-tokeniser leaves it whole."""
    inner = piece[1:] if piece[:1] == b" " else piece
    if inner.isalpha() or inner.isdigit():
        return True
    if inner.isascii():
        return False
    text = inner.decode()
    return text.isalpha() and max(text) < "\u0250"


_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(_MARKS.encode())] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Encoder:
    """Whole texts to ids through their distinct pieces."""

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = Tokenizer.from_file(path).model
        self.merges._resize_cache(0)  # it is asked for each piece once
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.end = end
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # the shortcut holds for byte-level BPE with the usual pattern and no normaliser
        self.cuts = type(self.library.pre_tokenizer).__name__ == "ByteLevel" and self.library.normalizer is None and not self.library.pre_tokenizer.add_prefix_space

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, pieces: list[bytes]) -> None:
        """Adds the ids of pieces that neither generation has."""
        plain = list(filter(_one_piece, pieces))
        if len(plain) < len(pieces):
            self.known.update((p, self.whole(p.decode()).tobytes()) for p in set(pieces).difference(plain))
        if not plain:
            return
        signs = _SIGNS[np.frombuffer(b"\n".join(plain), np.uint8)].tobytes().decode("utf-32-le").split("\n")
        ids, upto = [], [0]
        for found in map(self.merges.tokenize, signs):
            for t in found:
                ids.append(t.id)
            upto.append(4 * len(ids))
        flat = np.array(ids, "<u4").tobytes()
        self.known.update((p, flat[a:b]) for p, a, b in zip(plain, upto[:-1], upto[1:], strict=True))

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) + len(pieces) > CACHE:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, pieces))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            missing = [pieces[i] for i in gaps]
            if self.older:
                met = list(map(self.older.get, missing))
                self.known.update((p, x) for p, x in zip(missing, met, strict=True) if x is not None)
                missing = [p for p, x in zip(missing, met, strict=True) if x is None]
            self.learn(missing)
            for i in gaps:
                found[i] = self.known[pieces[i]]
            for p in missing:
                if len(p) > 64:  # such pieces are hardly met again
                    del self.known[p]
        return found

    def fits(self, text: str) -> bool:
        """Whether a text may be cut; it may begin with one space."""
        inner = text[1:] if text[:1] == " " else text
        return self.cuts and not (not inner or inner[0].isspace() or inner[-1].isspace() or any(s in inner for s in self.special) or any(s in inner for s in _ODD))

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are cut, one after another, and how many each has."""
        data, offsets = C.text_bytes(pa.array(texts, pa.large_string()))
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        new = (data == 32) | (data == 10) | (_MARK[data] & np.append(False, _LETTER[data[:-1]]))
        new[1:] |= data[:-1] == 10
        new[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(new)
        if len(data) < 1 << 31:
            kind, at = pa.binary(), np.append(starts, len(data)).astype(np.int32)
        else:
            kind, at = pa.large_binary(), np.append(starts, len(data))
        coded = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        which = coded.indices.to_numpy()
        _, cut, kept = coded.dictionary.buffers()
        raw, cut = kept.to_pybytes(), np.frombuffer(cut, at.dtype)[: len(coded.dictionary) + 1].tolist()
        ids = self.ids_of([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        n = size[which]
        upto = np.cumsum(n)
        place = np.repeat((np.cumsum(size) - size)[which] - (upto - n), n)
        place += np.arange(len(place))
        reach = np.append(0, upto)[np.searchsorted(starts, offsets)]
        return flat[place], np.diff(reach)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with the end id after each, and how many each has with it."""
        plain = [len(t) <= 2 * BLOCK and self.fits(t) for t in texts]
        flat, count = self.joined([t if ok else "" for t, ok in zip(texts, plain, strict=True)])
        other = {}
        for i, (t, ok) in enumerate(zip(texts, plain, strict=True)):
            if not ok and t:
                other[i] = np.concatenate([self.joined([p])[0] if self.fits(p) else self.whole(p) for p in self.spans(t)])
        if not other:  # each id moves by the end ids before it
            out = np.full(len(flat) + len(texts), self.end, "<u4")
            out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), count)] = flat
            return out, count + 1
        at, end, parts = np.append(0, np.cumsum(count)), np.array([self.end], "<u4"), []
        for i in range(len(texts)):
            parts += [other.get(i, flat[at[i] : at[i + 1]]), end]
        return np.concatenate(parts), np.array([len(x) + 1 for x in parts[::2]], np.int64)

    def spans(self, text: str) -> Iterator[str]:
        """Parts of a long text, cut before single spaces between letters, where a piece ends whatever stands elsewhere."""
        at = 0
        while self.cuts and len(text) - at > 2 * BLOCK and (place := _BETWEEN.search(text, at + BLOCK)):
            yield text[at : place.start()]
            at = place.start()
        yield text[at:]


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def blocks_of(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where each block of texts of about BLOCK characters begins, and its texts; null is empty."""
    at = 0
    while at < len(texts):
        block, end, size = [], at, 0
        while end < len(texts) and size < BLOCK:
            block.append(texts[end].as_py() or "")
            size += len(block[-1])
            end += 1
        yield at, block
        at = end


def _encode(path: str):
    def run(batches):
        tool = encoder(path)
        for batch in batches:
            for at, block in blocks_of(batch.column("text")):
                flat, lengths = tool.encode_all(block)
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(flat.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(block)), ids, pa.array(lengths)], names=["doc_id", "ids", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, files: int | None = None, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Encode every text and write the store, files in ascending ranges of doc_id. A doc_id that many rows have is dealt over several files."""
    files = files or C.ranges(docs)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text"))
    named = named.repartitionByRange(files, F.asc_nulls_first("doc_id"), "hash").sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash", "text")
    rows = named.select("doc_id", "text").mapInArrow(_encode(tokenizer), "doc_id long, ids array<int>, n_tokens long")
    (
        rows.write.option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("compression", "zstd")
        .parquet(folder)
    )


def _counted(path: str):
    def run(batches):
        tool = encoder(path)
        for batch in batches:
            for at, block in blocks_of(batch.column("text")):
                _, lengths = tool.encode_all(block)
                lengths[[not t for t in block]] = 0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(block)), pa.array(lengths)], names=["doc_id", "n"])

    return run


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n: ids of each text with the end id, 0 for empty and null texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(C.thrifty(_counted(tokenizer)), "doc_id long, n long")


def read_tokens(spark, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, ids array<int>, n_tokens long").parquet(folder)


def read_lengths(spark, folder: str) -> DataFrame:
    """doc_id and n_tokens: the ids' column isn't read."""
    return read_tokens(spark, folder).select("doc_id", "n_tokens")


def read_some(spark, folder: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; row groups and pages whose bounds exclude them are skipped."""
    return read_tokens(spark, folder).where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def _crc(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "file", "row")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "row", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document, from the files read back: doc_id, start, n_tokens, ids_crc32.

    The running total is taken in each file's own order, and over the files' totals, of which there is one row a file.
    """
    spark = docs.sparkSession
    folder = C.scratch_path(spark, "tokens")
    write_tokens(docs, folder, tokenizer)
    rows = read_tokens(spark, folder).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = C.stored(rows.mapInArrow(_crc, "doc_id long, file string, row long, n_tokens long, ids_crc32 long"), "crc")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", within).join(before, "file").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
