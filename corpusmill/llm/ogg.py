"""Media columns in Ogg: bytes are stored as 8-bit samples in packets of logical streams.

Writing: a stream of samples and a stream of notes are multiplexed into pages; each page carries a checksum, a
sequence number, a granule position (samples so far) and lacing values. Reading: page checksums and sequence numbers
are verified, logical streams are told apart by serial number, packets are reassembled from lacing values across
pages, and timestamps follow from granule positions.

Defined results: a null text is empty; every payload is padded with bytes 0 to a positive multiple of BLOCK, so even an
empty text has samples; equal texts give equal media; repeated rows and null ids keep their rows; media that is null,
damaged or cut raises an error in `demux`, and gives a null payload with the reason in `decode`. Columns other than id
and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, texts_of, tune

BLOCK = 64
RATE = 8000
PACKET = 4000
#: Fixed values of the container's format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_SEGMENTS = 255
HEADER = struct.Struct("<4sBBqIIIB")
NO_PACKET_ENDS = -1
#: Identification packets of the two streams.
SAMPLES_ID = struct.Struct("<8sBBIQ")  # magic, version, bits of a sample, rate, bytes without padding
NOTES_ID = struct.Struct("<8sB")
SAMPLES_MAGIC, NOTES_MAGIC = b"PCM8raw\0", b"NOTEtxt\0"
SAMPLES_SERIAL, NOTES_SERIAL = 1, 2

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """The format's CRC: polynomial 04C11DB7, high bit first, from 0. Mirrored bits turn it into the CRC of zlib."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(size: int) -> bytes:
    """255 for each full segment, then the rest, which may be 0."""
    return b"\xff" * (size // 255) + bytes([size % 255])


@dataclass
class Writer:
    """One logical stream's packets, cut into pages."""

    serial: int
    pages: list[bytes] = field(default_factory=list)

    def page(self, flags: int, granule: int, laces: bytes, body: bytes) -> None:
        head = HEADER.pack(CAPTURE, 0, flags, granule, self.serial, len(self.pages), 0, len(laces)) + laces
        page = head + body
        self.pages.append(page[:22] + struct.pack("<I", page_checksum(page)) + page[26:])

    def write(self, packets: list[tuple[bytes, int]]) -> list[bytes]:
        """packets: (bytes, granule position after it); the first has a page to itself."""
        self.page(FIRST | (LAST if len(packets) == 1 else 0), packets[0][1], lacing(len(packets[0][0])), packets[0][0])
        laces, body, ends, granule, open_ = b"", b"", [], NO_PACKET_ENDS, False
        for k, (packet, after) in enumerate(packets[1:], 2):
            rest, at = lacing(len(packet)), 0
            while rest:
                take = rest[: MAX_SEGMENTS - len(laces)]
                size = sum(take)
                laces, body, rest, at = laces + take, body + packet[at : at + size], rest[len(take) :], at + size
                granule = granule if rest else after
                final = k == len(packets) and not rest
                if len(laces) == MAX_SEGMENTS or final:
                    self.page((CONTINUED if open_ else 0) | (LAST if final else 0), granule, laces, body)
                    laces, body, granule, open_ = b"", b"", NO_PACKET_ENDS, bool(rest)
        return self.pages


def encode(data: bytes) -> bytes:
    """data as 8-bit samples, padded to a positive multiple of BLOCK, beside a stream of notes about it."""
    payload = data + bytes(-len(data) % BLOCK if data else BLOCK)
    head = SAMPLES_ID.pack(SAMPLES_MAGIC, 1, 8, RATE, len(data))
    packets = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    samples = Writer(SAMPLES_SERIAL).write([(head, 0), *packets])
    note = f"ENCODING=utf-8\nBYTES={len(data)}\nSAMPLES={len(payload)}".encode()
    notes = Writer(NOTES_SERIAL).write([(NOTES_ID.pack(NOTES_MAGIC, 1), 0), (note, len(payload))])
    return b"".join([samples[0], notes[0], *(p for pair in zip(samples[1:], notes[1:], strict=False) for p in pair), *samples[len(notes) :], *notes[len(samples) :]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of each page on which a packet ends
    pages: int = 0
    partial: list[bytes] | None = None
    ended: bool = False


def demux(media: bytes) -> dict[int, Stream]:
    """Serial number -> stream. Raises ValueError on a wrong checksum, a gap, a cut packet or a missing end."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise ValueError("cut page header")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise ValueError("no page starts here")
        laces = media[at + HEADER.size : at + HEADER.size + n]
        body = at + HEADER.size + n
        end = body + sum(laces)
        if end > len(media) or len(laces) < n:
            raise ValueError("cut page")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError("wrong page checksum")
        if bool(flags & FIRST) != (serial not in streams):
            raise ValueError("stream without a start, or with two")
        s = streams.setdefault(serial, Stream())
        if number != s.pages or s.ended:
            raise ValueError("missing page")
        if bool(flags & CONTINUED) != (s.partial is not None):
            raise ValueError("missing part of a packet")
        s.pages += 1
        parts = s.partial or []
        begin, ended = body, False
        cut = body
        for lace in laces:
            cut += lace
            if lace < 255:
                parts.append(media[begin:cut])
                s.packets.append(b"".join(parts))
                parts, begin, ended = [], cut, True
        s.partial = [*parts, media[begin:cut]] if laces and laces[-1] == 255 else None
        if ended:
            s.granules.append(granule)
        s.ended = bool(flags & LAST)
        at = end
    if any(s.partial is not None or not s.ended for s in streams.values()):
        raise ValueError("stream without an end")
    return streams


def decode(media: bytes) -> tuple[bytes, int, dict[int, Stream]]:
    """The samples as stored, how many of them are data, and the streams."""
    streams = demux(media)
    for s in streams.values():
        if s.packets[0][:8] == SAMPLES_MAGIC:
            *_, size = SAMPLES_ID.unpack(s.packets[0])
            payload = b"".join(s.packets[1:])
            if s.granules[-1] != len(payload):
                raise ValueError("granule position and samples differ")
            return payload, size, streams
    raise ValueError("no stream of samples")


def features(payload: bytes, streams: dict[int, Stream]) -> str:
    """Duration from the last granule position, page and packet counts, mean and spread of the samples, zero crossings."""
    x = np.frombuffer(payload, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    mean = total / len(x)
    high = x > mean
    main = max(streams.values(), key=lambda s: s.granules[-1] if s.packets[0][:8] == SAMPLES_MAGIC else -1)
    return (
        f"ms={main.granules[-1] * 1000 // RATE};streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};"
        f"mean={mean:.4f};var={max(0.0, square / len(x) - mean * mean):.4f};crossings={int((high[1:] != high[:-1]).sum())}"
    )


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: the text's UTF-8 bytes in Ogg."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([encode(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "media"])

    return texts_of(docs).mapInArrow(run, "doc_id long, media binary")


_COLUMNS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}


def _read_back(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 7 + ("no media",)
    stored = (len(media), hashlib.sha256(media).hexdigest())
    try:
        payload, size, streams = decode(media)
    except ValueError as e:
        return (None, None, None, None, *stored, None, str(e))
    return (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), *stored, features(payload, streams), None)


def from_media(media: DataFrame) -> DataFrame:
    """Digests and features of each media value, from its stored bytes alone; `error` says why one could not be read."""
    tune(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_read_back(m) for m in b.column("media").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _COLUMNS.values(), strict=True))], ["doc_id", *_COLUMNS])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = from_media(to_media(read(spark, sf_dir, "documents")))
    return out.select("doc_id", *[c for c in _COLUMNS if c != "error"])
