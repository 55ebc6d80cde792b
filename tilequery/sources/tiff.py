"""Directories of a TIFF or BigTIFF file from ranged reads.

`read(offset, length)` returns exactly so many bytes or raises EOFError. Only headers,
directories and the values asked for are read, never tiles.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..functions.dimensions import FIELD_TYPES

MAX_IFDS, DESCRIPTION_BYTES = 100, 1024
#: Bytes per value of the types that hold unsigned numbers.
NUMBERS = {1: "B", 3: "H", 4: "I", 16: "Q"}
Read = Callable[[int, int], bytes]


class TiffError(ValueError):
    """code is one of the error names of the format, detail its text."""

    def __init__(self, code: str, detail: str) -> None:
        super().__init__(detail)
        self.code = code


@dataclass(frozen=True)
class Header:
    order: str  # "<" or ">"
    big: bool
    first_ifd: int


@dataclass(frozen=True)
class Entry:
    tag_id: int
    type_raw: int
    count: int
    raw: bytes  # the value or its offset, as it stands in the directory
    inline: bool

    def offset(self, header: Header) -> int:
        return struct.unpack(header.order + ("Q" if header.big else "I"), self.raw)[0]

    def size(self) -> int | None:
        kind = FIELD_TYPES.get(self.type_raw)
        return kind[1] * self.count if kind else None

    def bytes(self, header: Header, read: Read, most: int | None = None) -> bytes:
        size = self.size()
        if size is None:
            raise TiffError("unknown_field_type", f"Unknown field type: {self.type_raw}")
        size = size if most is None else min(size, most)
        if size == 0:
            return b""
        return self.raw[:size] if self.inline else read(self.offset(header), size)

    def numbers(self, header: Header, read: Read) -> list[int]:
        if self.type_raw not in NUMBERS:
            raise TiffError("invalid_tag_value", f"tag {self.tag_id} holds no numbers")
        raw = self.bytes(header, read)
        return list(struct.unpack(f"{header.order}{self.count}{NUMBERS[self.type_raw]}", raw))

    def inline_number(self, header: Header) -> int | None:
        """A single number that stands in the directory itself, of 16, 32 or 64 bits."""
        if not self.inline or self.count < 1 or self.type_raw not in (3, 4, 16):
            return None
        kind = NUMBERS[self.type_raw]
        return struct.unpack_from(header.order + kind, self.raw)[0]


def read_header(read: Read, size: int) -> Header:
    if size < 8:
        raise TiffError("file_too_small", f"File too small: need at least 8 bytes, got {size}")
    raw = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None:
        raise TiffError("invalid_magic", f"Invalid TIFF magic bytes: expected 0x4949 (II) or 0x4D4D (MM), got 0x{raw[:2].hex().upper()}")
    version = struct.unpack(order + "H", raw[2:4])[0]
    if version == 42:
        first = struct.unpack(order + "I", raw[4:8])[0]
    elif version == 43:
        if size < 16:
            raise TiffError("file_too_small", f"File too small: need at least 16 bytes, got {size}")
        width = struct.unpack(order + "H", raw[4:6])[0]
        if width != 8:
            raise TiffError("invalid_bigtiff_offset_size", f"Invalid BigTIFF offset byte size: expected 8, got {width}")
        first = struct.unpack(order + "Q", read(8, 8))[0]
    else:
        raise TiffError("invalid_version", f"Invalid TIFF version: expected 42 (TIFF) or 43 (BigTIFF), got {version}")
    if first >= size:
        raise TiffError("invalid_ifd_offset", f"Invalid IFD offset: {first}")
    return Header(order, version == 43, first)


def directories(read: Read, header: Header) -> Iterator[list[Entry]]:
    """The chain of directories, at most MAX_IFDS: two reads each."""
    at, n = header.first_ifd, 0
    count_kind, width, slot = ("Q", 20, 8) if header.big else ("H", 12, 4)
    while at and n < MAX_IFDS:
        head = struct.calcsize("<" + count_kind)
        count = struct.unpack(header.order + count_kind, read(at, head))[0]
        raw = read(at + head, count * width + slot)
        entries = []
        for k in range(count):
            own = raw[k * width : (k + 1) * width]
            tag, kind = struct.unpack(header.order + "HH", own[:4])
            values = struct.unpack(header.order + ("Q" if header.big else "I"), own[4 : width - slot])[0]
            size = FIELD_TYPES[kind][1] * values if kind in FIELD_TYPES else None
            entries.append(Entry(tag, kind, values, own[width - slot :], size is not None and size <= slot))
        yield entries
        at = struct.unpack(header.order + ("Q" if header.big else "I"), raw[-slot:])[0]
        n += 1


def by_tag(entries: list[Entry]) -> dict[int, Entry]:
    """Of a repeated tag the last entry counts."""
    return {e.tag_id: e for e in entries}


def text(raw: bytes) -> str:
    """Up to the first NUL; malformed UTF-8 is replaced."""
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")
