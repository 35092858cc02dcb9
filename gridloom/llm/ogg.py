"""Media columns in Ogg: writing payloads as 8-bit samples, reading pages and packets back.

A stream of pages: header (capture pattern, flags, granule position, serial number, sequence number, checksum, lacing
values) and body. Packets are cut into lacing values of 255 bytes with a last one below 255; a packet may run over
pages. Two logical streams are multiplexed: the samples, whose granule position is the number of samples up to the end
of the last packet that a page ends, and the notes, one packet of text with granule position 0.

Defined results: null or empty texts become one block of zeros; equal texts give equal files (serial numbers come from
the payload); damaged pages raise ``OggError``; repeated rows stay rows; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches, texts_of

RATE = 8000
PACKET = 4096
UNIT = 64
_HEADER = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_NO_GRANULE = -1

#: Each byte with its bits in reverse: Ogg's checksum has the same polynomial as zlib's, bits the other way round.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A page or packet that breaks the format."""


def checksum(page: bytes) -> int:
    """Polynomial 0x04C11DB7 from the high bit down, starting at 0, not inverted."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = lambda crc: _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, crc, len(lacing)) + lacing
    return head(checksum(head(0) + body)) + body


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Packets, each with the granule position at its end, as the pages of one logical stream; the first packet has a page of its own."""
    out: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), _NO_GRANULE, _FIRST

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal lacing, body, granule, flags
        out.append(page(serial, len(out), flags | (_LAST if last else 0), granule, bytes(lacing), bytes(body)))
        lacing, body, granule, flags = bytearray(), bytearray(), _NO_GRANULE, _CONTINUED if goes_on else 0

    for i, (packet, at) in enumerate(packets):
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        start = 0
        for k, size in enumerate(sizes):
            if len(lacing) == 255:
                flush(False, k > 0)
            lacing.append(size)
            body += packet[start : start + size]
            start += size
        granule = at
        if i == 0 and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return out


@dataclass
class Logical:
    """One logical stream as read: packets, and the granule position known at the end of each (or None)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    open: bytearray | None = None
    sequence: int = 0
    ended: bool = False

    def seconds(self, rate: int) -> list[float | None]:
        """Timestamps at the ends of packets."""
        return [None if g is None else g / rate for g in self.granules]


def read(data: bytes) -> dict[int, Logical]:
    """Verify every page and reassemble the packets of each logical stream, by serial number."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _HEADER.size:
            raise OggError("a page header is cut off")
        magic, version, flags, granule, serial, sequence, crc, n = _HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = data[at + _HEADER.size : at + _HEADER.size + n]
        start = at + _HEADER.size + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("a page is cut off")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum in the page at {at}")
        if flags & _FIRST:
            if serial in streams:
                raise OggError("a stream begins twice")
            streams[serial] = Logical()
        if serial not in streams:
            raise OggError("a stream has no first page")
        s = streams[serial]
        if s.ended or sequence != s.sequence:
            raise OggError("pages are missing or out of order")
        if bool(flags & _CONTINUED) != (s.open is not None):
            raise OggError("a packet goes on without its beginning or end")
        s.sequence += 1
        last: int | None = None
        for size in lacing:
            part = data[start : start + size]
            start += size
            if s.open is None:
                s.open = bytearray()
            s.open += part  # in place: a packet of any length costs its length
            if size < 255:
                s.packets.append(bytes(s.open))
                s.granules.append(None)
                s.open, last = None, len(s.packets) - 1
        if last is not None and granule != _NO_GRANULE:
            s.granules[last] = granule
        s.ended = bool(flags & _LAST)
        at = end
    if any(not s.ended or s.open is not None for s in streams.values()):
        raise OggError("a stream has no last page")
    return streams


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """Zeros up to a positive multiple of ``unit``."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def write(payload: bytes, n_bytes: int) -> bytes:
    """The payload as 8-bit samples in one logical stream, a note about it in another."""
    serial = zlib.crc32(payload) & 0x7FFFFFFF
    packets = [(b"PCM8" + struct.pack("<II", RATE, len(payload)), 0)]
    packets += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    note = f"n_bytes={n_bytes}\nsha256={hashlib.sha256(payload).hexdigest()}".encode()
    samples, notes = pages(serial, packets), pages(serial ^ 0x80000000, [(b"NOTE", 0), (note, 0)])
    # First pages of all streams come before any other page.
    return b"".join([samples[0], notes[0], *notes[1:], *samples[1:]])


@dataclass
class Sound:
    payload: bytes
    note: dict[str, str]
    rate: int
    seconds: float
    n_packets: int


def decode(media: bytes) -> Sound:
    streams = list(read(media).values())
    samples = next((s for s in streams if s.packets and s.packets[0].startswith(b"PCM8")), None)
    notes = next((s for s in streams if s.packets and s.packets[0] == b"NOTE"), None)
    if samples is None or notes is None:
        raise OggError("a logical stream is missing")
    rate, n = struct.unpack("<II", samples.packets[0][4:])
    payload = b"".join(samples.packets[1:])
    end = samples.seconds(rate)[-1]
    note = dict(line.split("=", 1) for line in notes.packets[1].decode().split("\n"))
    if len(payload) != n or end is None or round(end * rate) != n or hashlib.sha256(payload).hexdigest() != note["sha256"]:
        raise OggError("samples, granule positions and note disagree")
    return Sound(payload, note, rate, end, len(samples.packets) - 1)


def features(sound: Sound) -> str:
    """Whole numbers of the signal, samples as unsigned bytes: length in ms, mean and power in thousandths, sign changes about 128, packets."""
    x = np.frombuffer(sound.payload, np.uint8).astype(np.int64)
    total, square = int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"ms={round(sound.seconds * 1000)};mean={1000 * total // len(x)};power={1000 * square // len(x)};crossings={crossings};packets={sound.n_packets}"


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode_column(docs: DataFrame) -> DataFrame:
    """doc_id, media (the Ogg file): the media column itself."""

    def media(batch) -> list:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts_of(batch)]
        return [[write(pad(x), len(x)) for x in raw]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, ["doc_id"], "media binary", media)


def describe_column(media: DataFrame) -> DataFrame:
    """doc_id, media to what reading the stored bytes gives."""

    def described(batch) -> list:
        rows = []
        for stored in texts_of(batch, "media"):
            sound = decode(stored)
            p = sound.payload
            rows.append((int(sound.note["n_bytes"]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(sound)))
        return list(zip(*rows, strict=True)) or [[] for _ in COLUMNS.split(", ")]

    return map_batches(media, ["doc_id"], COLUMNS, described)
