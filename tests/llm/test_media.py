import hashlib
import zlib

import pytest

from braidlake.llm import media, ogg


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF
    return c


def test_checksum():
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("size", [0, 1, 254, 255, 256, 510, 255 * 255, 255 * 255 + 1, 255 * 600 + 7])
def test_packets_round_trip(size):
    packets = [(b"head", 0), (b"x" * size, 10), (b"", 10), (b"yz", 12)]
    pages = ogg.paginate(packets, 7)
    s = ogg.demultiplex(ogg.multiplex([pages, ogg.paginate([(b"other", 0)], 9)]))
    assert s[7].packets == [p for p, _ in packets] and s[9].packets == [b"other"]
    assert s[7].granules[-1] == 12


def test_damage_is_found():
    data = media.encode(media.payload(b"some text" * 200))
    for at in (0, 5, 30, len(data) // 2, len(data) - 1):
        with pytest.raises((ogg.OggError, ValueError)):
            media.decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ogg.OggError):
        media.decode(data[:-3])


def test_timestamps():
    _, about = media.decode(media.encode(b"\1" * 576 * 5))
    assert about["seconds"] == [3 * 576 / 8000, 2 * 576 / 8000]


def test_table(spark):
    texts = [None, "", "x", "é" * 288, "a" * 577, "long " * 40000, "x"]
    df = spark.createDataFrame([(i if i != 2 else None, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = media.media_table(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = (texts[r.doc_id] if r.doc_id is not None else "x") or ""
        p = text.encode()
        want = p + b"\xff" * (max(576, -(-len(p) // 576) * 576) - len(p))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and media.decode(bytes(r.media))[0] == want
    same = [tuple(r)[1:] for r in rows if r.doc_id in (None, 6)]
    assert same[0] == same[1]
    assert media.media_table(df.limit(0)).collect() == []
