"""Directories of containers that stand in a BINARY column, decoded a batch at a time.

All files of an Arrow batch advance together: a step gathers the k-th directory of every file
that has one, and all entries of these directories at once, from one byte buffer with an
offset for each file. Byte order and width are masks. The values of arrays are one gather for
each width of their type, put into Arrow lists by cumulative offsets. No step loops over files, entries or values.

Columns: slide_id and data (the whole file, or as much of its beginning as holds what is asked
for). A null data is an empty file. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import FIELD_TYPES
from .pyramid_tiff import SCHEMAS
from .tiff import MAX_IFDS, NUMBERS

HEADERS = "slide_id string, size long, byte_order string, is_bigtiff boolean, first_ifd_offset long, directories int, error string"
ARRAYS = "slide_id string, ifd_index int, tag_id int, field_type_raw int, count long, values array<long>, error string"
#: Bytes of files, and values, that are decoded at a time.
MOST_BYTES, MOST_VALUES = 32 << 20, 1 << 20
_SIZES = np.zeros(1 << 16, np.int64)
_SIZES[list(FIELD_TYPES)] = [n for _, n in FIELD_TYPES.values()]
_NUMERIC = np.zeros(1 << 16, bool)
_NUMERIC[[t for t in NUMBERS if t != 1]] = True


class Files:
    """The bytes of many files, and numbers read from all of them at once."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.start, self.size = offsets[:-1], np.diff(offsets)

    def numbers(self, at: np.ndarray, width: int, big_endian: np.ndarray) -> np.ndarray:
        """Unsigned numbers of `width` bytes at places of the buffer, as int64 (of 8 bytes the upper half comes out negative)."""
        each = self.raw[at[:, None] + np.arange(width)].astype(np.uint64)
        shift = np.arange(width, dtype=np.uint64) * np.uint64(8)
        little, big = (each << shift).sum(1, dtype=np.uint64), (each << shift[::-1]).sum(1, dtype=np.uint64)
        return np.where(big_endian, big, little).view(np.int64)

    def either(self, at: np.ndarray, narrow: int, wide: int, is_wide: np.ndarray, big_endian: np.ndarray) -> np.ndarray:
        """Numbers of `wide` bytes where is_wide, else of `narrow`."""
        out = np.zeros(len(at), np.int64)
        for width, own in ((narrow, ~is_wide), (wide, is_wide)):
            if own.any():
                out[own] = self.numbers(at[own], width, big_endian[own])
        return out


class Headers:
    """Byte order, width and first directory of every file, and the code of what is wrong with it."""

    def __init__(self, files: Files) -> None:
        n = len(files.size)
        self.files, self.error = files, np.full(n, None, object)
        self.big_endian, self.wide, self.first = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
        self.known = np.zeros(n, bool)  # of the byte order
        has = self._refuse(np.arange(n), files.size < 8, "file_too_small")
        magic = files.numbers(files.start[has], 2, np.zeros(len(has), bool))
        self.big_endian[has] = magic == 0x4D4D
        has = self._refuse(has, (magic != 0x4D4D) & (magic != 0x4949), "invalid_magic")
        self.known[has] = True
        version = files.numbers(files.start[has] + 2, 2, self.big_endian[has])
        self.wide[has] = version == 43
        has = self._refuse(has, (version != 42) & (version != 43), "invalid_version")
        has = self._refuse(has, self.wide[has] & (files.size[has] < 16), "file_too_small")
        slot = files.numbers(files.start[has] + 4, 2, self.big_endian[has])
        has = self._refuse(has, self.wide[has] & (slot != 8), "invalid_bigtiff_offset_size")
        self.first[has] = files.either(files.start[has] + np.where(self.wide[has], 8, 4), 4, 8, self.wide[has], self.big_endian[has])
        self._refuse(has, (self.first[has] < 0) | (self.first[has] >= files.size[has]), "invalid_ifd_offset")

    def _refuse(self, has: np.ndarray, bad: np.ndarray, code: str) -> np.ndarray:
        self.error[has[bad]] = code
        return has[~bad]


class Entries:
    """All entries of the directories of all files, in order of (step, file, entry)."""

    def __init__(self, headers: Headers) -> None:
        files = headers.files
        self.headers, self.directories = headers, np.zeros(len(files.size), np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        has = np.flatnonzero(headers.error == None)  # noqa: E711
        at = headers.first[has]
        for step in range(MAX_IFDS):
            more = at != 0
            has, at = has[more], at[more]
            if not len(has):
                break
            wide, big = headers.wide[has], headers.big_endian[has]
            head, width, slot = np.where(wide, 8, 2), np.where(wide, 20, 12), np.where(wide, 8, 4)
            fits = (at > 0) & (at <= files.size[has] - head)
            count = np.zeros(len(has), np.int64)
            count[fits] = files.either(files.start[has[fits]] + at[fits], 2, 8, wide[fits], big[fits])
            # by division, as a count of 64 bits overflows in a product
            fits &= (count >= 0) & (count <= (files.size[has] - at - head - slot) // width)
            headers.error[has[~fits]] = "range_out_of_bounds"
            has, at, wide, big, head, width, slot, count = (x[fits] for x in (has, at, wide, big, head, width, slot, count))
            self.directories[has] += 1
            base = files.start[has] + at + head
            index = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            own = np.repeat(np.arange(len(has)), count)
            parts.append((has[own], np.full(len(own), step), index, base[own] + index * width[own]))
            at = files.either(base + count * width, 4, 8, wide, big)
        joined = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
        self.file, self.ifd, self.index, place = (joined(k) for k in range(4))
        self.wide, self.big = headers.wide[self.file], headers.big_endian[self.file]
        self.tag, self.kind = files.numbers(place, 2, self.big), files.numbers(place + 2, 2, self.big)
        self.count = files.either(place + 4, 4, 8, self.wide, self.big)
        self.slot = place + np.where(self.wide, 12, 8)  # where the value or its offset stands
        self.width = np.where(self.wide, 8, 4)
        self.bytes = _SIZES[self.kind]
        self.inline = (self.bytes > 0) & (self.count >= 0) & (self.count <= self.width // np.maximum(self.bytes, 1))

    def slots(self) -> pa.Array:
        """The value, or offset, of every entry as it stands in its directory."""
        ends = np.append(0, np.cumsum(self.width))
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.slot, self.width)
        return pa.Array.from_buffers(pa.binary(), len(self.width), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.headers.files.raw[at])])

    def inline_numbers(self) -> pa.Array:
        """Single numbers of 16, 32 or 64 bits that stand in the directory itself, else null."""
        out, ok = np.zeros(len(self.tag), np.int64), self.inline & (self.count > 0) & _NUMERIC[self.kind]
        for width in (2, 4, 8):
            if len(at := np.flatnonzero(ok & (self.bytes == width))):
                out[at] = self.headers.files.numbers(self.slot[at], width, self.big[at])
        return pa.array(out, mask=~ok | (out < 0))


def values_of(files: Files, place: np.ndarray, available: np.ndarray, count: np.ndarray, width: np.ndarray, big_endian: np.ndarray) -> pa.ListArray:
    """Arrays of numbers of 2, 4 or 8 bytes, one for each place; of a short input as many as it holds. Those beyond 63 bits are null."""
    count = np.minimum(count, np.maximum(available, 0) // width)
    ends = np.append(0, np.cumsum(count))
    out, good = np.zeros(ends[-1], np.int64), np.ones(ends[-1], bool)
    for size in (2, 4, 8):
        own = np.flatnonzero(width == size)
        n = count[own]
        index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        to = np.repeat(ends[:-1][own], n) + index
        got = files.numbers(np.repeat(place[own], n) + index * size, size, np.repeat(big_endian[own], n))
        out[to], good[to] = got, got >= 0
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out, mask=~good))


def _decoded(files: DataFrame, schema: str, rows: Callable[[pa.Array, Files], Iterator[list]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:  # some megabytes of files at a time
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + MOST_BYTES, "right")))
                part = batch.slice(lo, hi - lo)
                for columns in rows(part.column(0), Files(part.column(1))):
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                lo = hi

    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")
    return files.select(F.col("slide_id").cast("string"), "data", size.alias("n")).mapInArrow(run, schema)


def headers(files: DataFrame) -> DataFrame:
    """A row per file: size, byte_order (II or MM), is_bigtiff, first_ifd_offset, number of directories, and error (null: none).

    error: file_too_small, invalid_magic, invalid_version, invalid_bigtiff_offset_size or
    invalid_ifd_offset of the header (what isn't known is null), or range_out_of_bounds of a directory; those before it are counted. A chain is
    followed for 100 directories at most."""

    def rows(slide_id: pa.Array, files: Files) -> Iterator[list]:
        h = Headers(files)
        good = h.error == None  # noqa: E711
        entries = Entries(h)
        yield [
            slide_id, pa.array(files.size), pa.array(np.where(h.big_endian, "MM", "II"), pa.string(), mask=~h.known), pa.array(h.wide, mask=~good),
            pa.array(h.first, mask=~good), pa.array(entries.directories.astype(np.int32)), pa.array(h.error, pa.string()),
        ]

    return _decoded(files, HEADERS, rows)


def entries(files: DataFrame) -> DataFrame:
    """The entries of all directories, as the entries table of the pyramidtiff source has them; none of a file without a good header."""

    def rows(slide_id: pa.Array, files: Files) -> Iterator[list]:
        e = Entries(Headers(files))
        small = lambda x: pa.array(x.astype(np.int32))
        yield [slide_id.take(pa.array(e.file)), small(e.ifd), small(e.index), small(e.tag), small(e.kind), pa.array(e.count, mask=e.count < 0), pa.array(e.inline), e.slots(), e.inline_numbers()]

    return _decoded(files, SCHEMAS["entries"], rows)


def value_arrays(files: DataFrame, tags: list[int]) -> DataFrame:
    """The numbers of the asked tags, a row for each of their entries (of a repeated tag of a directory the last).

    Values of 16, 32 and 64 bits. error: unknown_field_type, invalid_tag_value (a type that holds no
    such numbers) or range_out_of_bounds (values is then what the file still holds); values is null for the first two."""
    wanted = np.zeros(1 << 16, bool)
    wanted[tags] = True

    def rows(slide_id: pa.Array, files: Files) -> Iterator[list]:
        e = Entries(Headers(files))
        own = np.flatnonzero(wanted[e.tag])
        # the last of a directory's entries of one tag
        own = own[np.lexsort((e.index[own], e.tag[own], e.ifd[own], e.file[own]))]
        key = np.stack([e.file[own], e.ifd[own], e.tag[own]])
        own = own[np.append((key[:, 1:] != key[:, :-1]).any(0), True)] if len(own) else own
        numeric, known = _NUMERIC[e.kind[own]], e.bytes[own] > 0
        count = np.where(numeric, np.where(e.count[own] < 0, 1 << 60, e.count[own]), 0)
        start, size = files.start[e.file[own]], files.size[e.file[own]]
        offset = np.where(e.inline[own], e.slot[own] - start, 0)
        far = np.flatnonzero(~e.inline[own] & numeric)
        offset[far] = files.either(e.slot[own[far]], 4, 8, e.wide[own[far]], e.big[own[far]])
        offset = np.where((offset < 0) | (offset > size), size, offset)
        available = np.where(e.inline[own], e.width[own], size - offset)
        width = np.where(numeric, e.bytes[own], 2)
        short = numeric & (count > available // width)
        error = np.where(~known, "unknown_field_type", np.where(~numeric, "invalid_tag_value", np.where(short, "range_out_of_bounds", ""))).astype(object)
        held = np.cumsum(np.minimum(count, available // width))
        lo = 0
        while lo < len(own):  # some values at a time
            hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + MOST_VALUES, "right")))
            at, s = own[lo:hi], slice(lo, hi)
            values = values_of(files, start[s] + offset[s], available[s], count[s], width[s], e.big[at])
            values = pa.ListArray.from_arrays(values.offsets, values.values, mask=pa.array(~numeric[s]))
            yield [
                slide_id.take(pa.array(e.file[at])), pa.array(e.ifd[at].astype(np.int32)), pa.array(e.tag[at].astype(np.int32)), pa.array(e.kind[at].astype(np.int32)),
                pa.array(e.count[at], mask=e.count[at] < 0), values, pa.array([x or None for x in error[s]], pa.string()),
            ]
            lo = hi

    return _decoded(files, ARRAYS, rows)
