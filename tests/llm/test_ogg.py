import hashlib
import zlib

import pytest

from corpusmill.llm import ogg as O


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"a", bytes(range(256)), b"OggS" * 33):
        assert O.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 254, 255, 256, 3999, 4000, 4001, 65_025, 65_026, 70_000, 300_000])
def test_round_trip(size):
    data = bytes((i * 7 + i // 251) % 256 for i in range(size))
    media = O.encode(data)
    payload, n, streams = O.decode(media)
    assert n == size and payload[:size] == data and not any(payload[size:])
    assert len(payload) % 64 == 0 and 0 <= len(payload) - size <= 64 and payload
    assert len(streams) == 2 and streams[O.SAMPLES_SERIAL].granules[-1] == len(payload)
    assert b"".join(streams[O.NOTES_SERIAL].packets[1:]).startswith(b"ENCODING=utf-8")


def test_packets_across_pages():
    for sizes in ([255 * 255], [255 * 255 - 1, 10], [255 * 300, 0, 5], [0, 0, 255], [100_000, 200_000]):
        packets = [(b"head", 0), *((bytes([k % 250 + 1]) * n, k + 1) for k, n in enumerate(sizes))]
        media = b"".join(O.Writer(7).write(packets))
        assert O.demux(media)[7].packets == [p for p, _ in packets]


def test_damage_is_found():
    media = O.encode(b"some text" * 2000)
    for at in range(0, len(media), 997):
        broken = media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :]
        with pytest.raises(ValueError):
            O.decode(broken)
    for cut in (1, 20, len(media) // 2, len(media) - 1):
        with pytest.raises(ValueError):
            O.decode(media[:cut])


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100), (4, "é" * 100), (4, "é" * 100), (None, "x" * 500_000)]
    out = O.from_media(O.to_media(spark.createDataFrame([(d, t, b"z") for d, t in rows], "doc_id long, text string, media binary"))).collect()
    assert len(out) == 6
    for r in out:
        data = (dict(rows)[r.doc_id] or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert len({(r.media_sha256, r.feature) for r in out if r.doc_id in (3, 4)}) == 1
    bad = spark.createDataFrame([(1, None), (2, b"junk"), (3, O.encode(b"ok")[:-1])], "doc_id long, media binary")
    assert all(r.payload_bytes is None and r.error for r in O.from_media(bad).collect())
    assert O.from_media(O.to_media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_features_by_a_second_way(spark):
    """Every part of the feature from the stored bytes by plain loops: pages are looked for by their capture pattern."""
    rows = [(1, "Hello, wörld! " * 700), (2, ""), (3, "ab" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    media = {r.doc_id: bytes(r.media) for r in O.to_media(docs).collect()}
    got = {r.doc_id: r.feature for r in O.from_media(O.to_media(docs)).collect()}
    for i, text in rows:
        data = text.encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        pages, ends, serials, at = 0, 0, set(), 0
        while at < len(media[i]):
            assert media[i][at : at + 4] == b"OggS"
            n = media[i][at + 26]
            laces = media[i][at + 27 : at + 27 + n]
            serials.add(media[i][at + 14 : at + 18])
            pages, ends, at = pages + 1, ends + sum(x < 255 for x in laces), at + 27 + n + sum(laces)
        mean = sum(payload) / len(payload)
        spread = sum((b - mean) ** 2 for b in payload) / len(payload)
        crossings = sum((a > mean) != (b > mean) for a, b in zip(payload, payload[1:]))
        told = dict(p.split("=") for p in got[i].split(";"))
        assert (int(told["ms"]), int(told["streams"]), int(told["pages"]), int(told["packets"]), int(told["crossings"])) == (len(payload) // 8, len(serials), pages, ends, crossings)
        assert abs(float(told["mean"]) - mean) < 1e-3 and abs(float(told["var"]) - spread) < 1e-2
