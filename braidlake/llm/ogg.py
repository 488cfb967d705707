"""Ogg: pages with checksums, packets over lacing values, interleaved logical streams, granule positions.

Only bytes objects are handled, one file in memory at a time; a page is at most 65,307 bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not reflected, start and final xor 0: zlib's on mirrored bits."""
    c = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes


def write_page(page: Page) -> bytes:
    head = _HEAD.pack(b"OggS", 0, page.flags, page.granule, page.serial, page.sequence, 0, len(page.lacing)) + page.lacing
    raw = head + page.body
    return raw[:22] + checksum(raw).to_bytes(4, "little") + raw[26:]


def paginate(packets: list[tuple[bytes, int]], serial: int, page_segments: int = 255) -> list[Page]:
    """Pages of one logical stream. packets: (bytes, granule position at the packet's end).

    A packet is laced in segments of 255 bytes and a shorter last one (empty if its size is a multiple of 255); it
    may go on over pages. A page on which no packet ends has granule position -1.
    """
    pages, lacing, body, granule, continued = [], bytearray(), bytearray(), -1, False

    def close(last: bool) -> None:
        nonlocal lacing, body, granule, continued
        flags = CONTINUED * continued | FIRST * (not pages) | LAST * last
        pages.append(Page(flags, granule, serial, len(pages), bytes(lacing), bytes(body)))
        continued = bool(lacing) and lacing[-1] == 255
        lacing, body, granule = bytearray(), bytearray(), -1

    for n, (data, at) in enumerate(packets):
        sizes = [255] * (len(data) // 255) + [len(data) % 255]
        place = 0
        for k, size in enumerate(sizes):
            if len(lacing) == page_segments:
                close(False)
            lacing.append(size)
            body += data[place : place + size]
            place += size
            if k == len(sizes) - 1:
                granule = at
        if n == 0 and len(packets) > 1:
            close(False)  # a stream's header stands alone on its first page
    close(True)
    return pages


def multiplex(streams: list[list[Page]]) -> bytes:
    """One physical stream: all first pages, then the others in turn."""
    out = [write_page(s[0]) for s in streams]
    for k in range(1, max(map(len, streams), default=0)):
        out += [write_page(s[k]) for s in streams if k < len(s)]
    return b"".join(out)


class OggError(ValueError):
    pass


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages in order. A wrong capture pattern, a wrong checksum or a cut page raises OggError."""
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("cut page header")
        magic, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one should start")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("cut page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum on page {sequence} of stream {serial}")
        yield Page(flags, granule, serial, sequence, lacing, data[at + 27 + n : end])
        at = end


@dataclass
class Stream:
    """A logical stream: packets, and for each the granule position known for it (-1 but for the last of a page)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)

    def add(self, page: Page) -> None:
        if page.sequence != self.pages or self.ended or bool(page.flags & FIRST) != (self.pages == 0):
            raise OggError(f"page {page.sequence} of stream {self.serial} is out of order")
        if bool(page.flags & CONTINUED) != bool(self._open):
            raise OggError("a packet's continuation is missing")
        at = 0
        for size in page.lacing:
            self._open.append(page.body[at : at + size])
            at += size
            if size < 255:
                self.packets.append(b"".join(self._open))
                self.granules.append(-1)
                self._open = []
        if page.granule >= 0 and self.granules:
            self.granules[-1] = page.granule
        self.pages += 1
        self.ended = bool(page.flags & LAST)
        if self.ended and self._open:
            raise OggError("the last packet is cut")

    def times(self, rate: float, length) -> list[tuple[float, float]]:
        """(start, end) in seconds of each packet: packets' lengths in granules, counted back from each page's position."""
        out, end = [(0.0, 0.0)] * len(self.packets), None
        known = [g for g in self.granules]
        for i in range(len(known) - 1, -1, -1):
            end = known[i] if known[i] >= 0 else end
            start = (end or 0) - length(self.packets[i])
            out[i] = (max(0, start) / rate, (end or 0) / rate)
            end = start
        return out


def demultiplex(data: bytes) -> dict[int, Stream]:
    streams: dict[int, Stream] = {}
    for page in read_pages(data):
        if page.serial not in streams:
            streams[page.serial] = Stream(page.serial)
        streams[page.serial].add(page)
    for s in streams.values():
        if not s.ended:
            raise OggError(f"stream {s.serial} has no end")
    return streams
