"""Ogg (RFC 3533): page checksums, lacing values, logical streams and granule positions, written and read with numpy and zlib.

A text's payload is its UTF-8 bytes filled up with bytes 255 to a positive multiple of ``FRAME``; each FRAME of 8-bit samples is a
packet. Even packets go to one logical stream and odd ones to another, as pages that alternate; each stream starts with a header
packet of its own. The reader checks every page's CRC and sequence number, joins packets from lacing values (also across
pages), separates the streams by serial number, takes each packet's time from granule positions, and puts packets back by time.

Defined results: null text is empty and gives one packet of bytes 255; equal texts give equal bytes (serial numbers are fixed); broken pages, streams without an end, and pages after it raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.llm import common as C

FRAME = 576
RATE = 8000
SERIALS = (0x51E7E11E, 0x51E7E11F)
_MAGIC = b"SVL8"
_PAGE = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def crc(data: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, bits not reflected, no inversion), as zlib's over mirrored bytes."""
    x = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(bytes(_MIRROR[b] for b in x.to_bytes(4, "little")), "big")


def page(serial: int, sequence: int, granule: int, lacing: bytes, body: bytes, flags: int) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    whole = head + body
    return b"".join((head[:22], struct.pack("<I", crc(whole)), head[26:], body))


def lace(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def pages(serial: int, packets: list[bytes], times: list[int], start: int = 0) -> list[bytes]:
    """Pages of at most 255 lacing values; a packet that doesn't fit goes on in the next page."""
    out: list[bytes] = []
    lacing, body, granule, carried = bytearray(), [], -1, False
    for n, (packet, time) in enumerate(zip(packets, times, strict=True)):
        values, at = lace(len(packet)), 0
        while at < len(values):
            room = 255 - len(lacing)
            take = values[at : at + room]
            body.append(packet[255 * at : 255 * (at + len(take))])
            lacing += take
            at += len(take)
            if at == len(values):
                granule = time
            if len(lacing) == 255 or (at == len(values) and n == len(packets) - 1):
                last = n == len(packets) - 1 and at == len(values)
                flags = carried | (2 if start + len(out) == 0 else 0) | (4 if last else 0)
                out.append(page(serial, start + len(out), granule, bytes(lacing), b"".join(body), flags))
                carried = at < len(values)
                lacing, body, granule = bytearray(), [], -1
    return out


def encode(payload: bytes) -> bytes:
    """Two logical streams of FRAME-byte packets; a packet's granule position is the number of samples up to its end."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    heads, bodies = [], []
    for track, serial in enumerate(SERIALS):
        own = frames[track::2]
        header = _MAGIC + struct.pack("<BIH", track, RATE, FRAME)
        heads.append(page(serial, 0, 0, lace(len(header)), header, 2 if own else 6))
        times = [(2 * i + track + 1) * FRAME for i in range(len(own))]
        bodies.append(pages(serial, own, times, 1))
    turns = [b[i] for i in range(max(map(len, bodies))) for b in bodies if i < len(b)]
    return b"".join([*heads, *turns])


def demultiplex(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream with the granule position of the page on which they end."""
    at, open_, streams, sequence, ended = 0, {}, {}, {}, set()
    while at < len(data):
        if len(data) < at + 27:
            raise ValueError("page header is cut short")
        mark, version, flags, granule, serial, number, check, n = _PAGE.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        whole = data[at : at + size]
        if mark != b"OggS" or version or len(whole) < size:
            raise ValueError(f"no whole page at byte {at}")
        if crc(b"".join((whole[:22], b"\0\0\0\0", whole[26:]))) != check:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        if serial in ended:
            raise ValueError(f"stream {serial:#x} goes on after its end")
        if number != sequence.get(serial, 0) or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(open_.get(serial)):
            raise ValueError(f"page {number} of stream {serial:#x} is out of order")
        sequence[serial] = number + 1
        if flags & 4:
            ended.add(serial)
        packets, rest = streams.setdefault(serial, []), open_.pop(serial, [])
        pos = 27 + n
        for value in lacing:
            rest.append(whole[pos : pos + value])
            pos += value
            if value < 255:
                packets.append((b"".join(rest), granule))
                rest = []
        if rest:
            open_[serial] = rest
        at += size
    if open_:
        raise ValueError("a packet doesn't end")
    if missing := streams.keys() - ended:
        raise ValueError(f"no end of stream {', '.join(f'{s:#x}' for s in sorted(missing))}")
    return streams


def decode(data: bytes) -> tuple[bytes, dict]:
    """The payload, and what the container tells: streams, pages' times, rate."""
    timed, rate, last = [], RATE, 0
    streams = demultiplex(data)
    for packets in streams.values():
        header, own, shown = packets[0][0], packets[1:], None
        if header[:4] != _MAGIC:
            raise ValueError("unknown stream")
        track, rate, frame = struct.unpack("<BIH", header[4:])
        # the last packet of a page ends at its granule position; those before it end two frames earlier each
        time = None
        for packet, granule in reversed(own):
            time = granule if time is None or granule != shown else time - 2 * frame
            shown = granule
            timed.append((time, packet))
        last = max([last, *(g for _, g in own)])
    timed.sort(key=lambda x: x[0])
    if [t for t, _ in timed] != [(i + 1) * FRAME for i in range(len(timed))]:
        raise ValueError("granule positions leave a gap")
    return b"".join(p for _, p in timed), {"streams": len(streams), "packets": len(timed), "seconds": last / rate}


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // FRAME)) * FRAME
    return len(raw), raw + b"\xff" * (size - len(raw))


def feature(payload: bytes, told: dict) -> str:
    """Duration, streams, mean, root mean square and mid-crossings of the samples about 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    cross = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"t={told['seconds']:.3f};s={told['streams']};p={told['packets']};m={x.mean():.4f};r={np.sqrt((x * x).mean()):.4f};z={cross}"


def _write(batches):
    for batch in batches:
        texts, at = batch.column("text"), 0
        while at < len(batch):
            media, n, end, size = [], [], at, 0
            while end < len(batch) and size < 8 << 20:
                raw, payload = payload_of(texts[end].as_py())
                n.append(raw)
                media.append(encode(payload))
                size += len(payload)
                end += 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
            at = end


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (its Ogg bytes)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_write, "doc_id long, n_bytes long, media binary")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches):
    for batch in batches:
        rows = []
        for i, n, media in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            data = media.as_py()
            payload, told = decode(data)
            rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, told)))
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _DIGEST.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def media_digest(docs: DataFrame) -> DataFrame:
    """Per document, from the stored media column read back: sizes, hashes and a feature string."""
    return C.stored(media_table(docs), "media").mapInArrow(_read, _DIGEST)
