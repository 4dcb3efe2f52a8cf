"""Byte-level joining of small files: newline-delimited text and zstandard frames.

Nothing here parses a record. Text files are joined after checking their boundary (a
missing last newline is added, a byte-order mark is dropped, a repeated header line is
kept once); zstandard files are joined frame by frame after walking the block sizes, so
that a torn frame is found without decompressing it. RFC 8878 gives the frame layout.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterable

import zstandard

ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
BOM = b"\xef\xbb\xbf"


class BrokenPart(ValueError):
    """A part whose length, checksum or frame structure is not what it should be."""


def check_part(data: bytes, size: int | None, crc: int | None, name: str = "") -> None:
    """Compare a part with its catalogued length and CRC-32; null entries are not checked."""
    if size is not None and len(data) != size:
        raise BrokenPart(f"{name}: {len(data)} bytes, the catalogue has {size}")
    if crc is not None and zlib.crc32(data) != crc:
        raise BrokenPart(f"{name}: checksum differs from the catalogue")


def frame_ends(data: bytes) -> list[int]:
    """End offsets of the complete zstandard frames that make up ``data``; raises where one is torn."""
    ends, at, n = [], 0, len(data)

    def need(upto: int) -> None:
        if upto > n:
            raise BrokenPart(f"a zstandard frame breaks off at byte {n}")

    while at < n:
        need(at + 4)
        magic = int.from_bytes(data[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:  # skippable frame
            need(at + 8)
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            need(at)
            ends.append(at)
            continue
        if data[at : at + 4] != ZSTD_MAGIC:
            raise BrokenPart(f"no zstandard frame at byte {at}")
        need(at + 5)
        descriptor = data[at + 4]
        single = descriptor >> 5 & 1
        at += 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + ((1 if single else 0), 2, 4, 8)[descriptor >> 6]
        last = False
        while not last:
            need(at + 3)
            head = int.from_bytes(data[at : at + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            if kind == 3:
                raise BrokenPart("reserved block type")
            at += 3 + (1 if kind == 1 else size)
            need(at)
        at += 4 * (descriptor >> 2 & 1)
        need(at)
        ends.append(at)
    return ends


class TextJoin:
    """Joins newline-delimited parts into ``out``; counts bytes, lines and the CRC-32 of what was written."""

    def __init__(self, out: io.RawIOBase, header: bool = False):
        self.out, self.header, self.first = out, header, None
        self.size = self.lines = self.crc = 0

    def _write(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)
            self.lines += data.count(b"\n")
            self.crc = zlib.crc32(data, self.crc)

    def add(self, data: bytes, name: str = "") -> None:
        """Append one file: empty files add nothing, a file with another header than the first is refused."""
        if data.startswith(BOM):
            data = data[len(BOM) :]
        if not data:
            return
        if self.header:
            line, _, rest = data.partition(b"\n")
            line = line.rstrip(b"\r")
            if self.first is None:
                self.first = line
                self._write(line + b"\n")
            elif line != self.first:
                raise BrokenPart(f"{name}: its header differs from the first one")
            data = rest
        self._write(data if not data or data.endswith(b"\n") else data + b"\n")


class FrameJoin:
    """Joins files of complete zstandard frames; the joined file is a valid zstandard file again."""

    def __init__(self, out: io.RawIOBase):
        self.out = out
        self.size = self.frames = self.crc = 0

    def add(self, data: bytes, name: str = "") -> None:
        try:
            ends = frame_ends(data)
        except BrokenPart as e:
            raise BrokenPart(f"{name}: {e}") from None
        self.out.write(data)
        self.size += len(data)
        self.frames += len(ends)
        self.crc = zlib.crc32(data, self.crc)


def read_back(stream: Iterable[bytes] | io.RawIOBase) -> tuple[int, int, int]:
    """(bytes, lines, CRC-32) of the text in a file of zstandard frames, streamed."""
    size = lines = crc = 0
    with zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True) as reader:
        while chunk := reader.read(1 << 20):
            size += len(chunk)
            lines += chunk.count(b"\n")
            crc = zlib.crc32(chunk, crc)
    return size, lines, crc
