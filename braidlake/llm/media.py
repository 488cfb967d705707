"""Media columns: texts as 8-bit mono sound in Ogg files, and what is read from the stored bytes.

A payload is the text's UTF-8 with bytes 255 up to a positive multiple of 576. Packets of 576 samples alternate
between two logical streams; each stream begins with a header packet (marker, stream number, rate). The granule
position counts a stream's samples at 8000 a second.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import text_blocks
from .frame_tables import batch
from .ogg import demultiplex, multiplex, paginate

UNIT, RATE, STREAMS = 576, 8000, 2
_HEADER = struct.Struct("<8sBBI")
FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def encode(data: bytes) -> bytes:
    """An Ogg file of 8-bit samples; the length of data is a multiple of UNIT."""
    parts = [[(_HEADER.pack(b"PCM8mono", k, STREAMS, RATE), 0)] for k in range(STREAMS)]
    for i in range(0, len(data), UNIT):
        own = parts[i // UNIT % STREAMS]
        own.append((data[i : i + UNIT], len(own) * UNIT))
    return multiplex([paginate(p, serial=k + 1) for k, p in enumerate(parts)])


def decode(media: bytes) -> tuple[bytes, dict]:
    """(samples, what the container says). Streams are known by their headers, not by their order in the file."""
    found = demultiplex(media)
    streams = {}
    for s in found.values():
        marker, number, of, rate = _HEADER.unpack(s.packets[0])
        if marker != b"PCM8mono" or of != len(found):
            raise ValueError("not a file of this kind")
        streams[number] = (s, rate)
    out = []
    for i in range(max(len(s.packets) for s, _ in streams.values()) - 1):
        out += [streams[k][0].packets[i + 1] for k in range(len(streams)) if i + 1 < len(streams[k][0].packets)]
    seconds = []
    for k in range(len(streams)):
        s, rate = streams[k]
        times = s.times(rate, lambda p: 0 if p[:8] == b"PCM8mono" and len(p) == _HEADER.size else len(p))
        seconds.append(times[-1][1])
    return b"".join(out), {"pages": sum(s.pages for s, _ in streams.values()), "packets": sum(len(s.packets) for s, _ in streams.values()), "seconds": seconds}


def feature(samples: bytes, about: dict) -> str:
    """Streams' durations, page and packet numbers, mean, root mean square and zero crossings of the samples about 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    sign = x >= 0
    return f"{'/'.join(f'{s:.4f}' for s in about['seconds'])};{about['pages']};{about['packets']};{x.sum()};{int((x * x).sum())};{int((sign[1:] != sign[:-1]).sum())}"


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text stored as an Ogg file, read back, and described.

    Returns a row for each row of docs: doc_id, n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32
    (of the payload read back; CRC-32 of its last 32 bytes), media_bytes, media_sha256, feature, media (the file).
    A null text is an empty one: 576 bytes 255. Equal texts give equal values. Ids may be null or repeat; other
    columns are ignored. Documents are independent: no shuffle, and memory for one file at a time.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(1), 1 << 20):
                rows = []
                for i in range(last - first):
                    text = flat[offsets[i] : offsets[i + 1]].tobytes()
                    media = encode(payload(text))
                    back, about = decode(media)
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, about), media))
                yield batch(FIELDS, [x.column(0).slice(first, last - first), *(list(c) for c in zip(*rows, strict=True))])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(make, FIELDS)
