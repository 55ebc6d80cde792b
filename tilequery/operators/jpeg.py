"""Byte-level operators on JPEG tiles: repair of abbreviated streams, format and size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOI, EOI = b"\xff\xd8", b"\xff\xd9"


# Markers that stand alone: stuffing, TEM, restarts, start and end.
_ALONE = [0x00, 0x01, *range(0xD0, 0xDA), 0xFF]
_SEGMENT = np.ones(256, bool)
_SEGMENT[_ALONE] = False
_FRAME = np.zeros(256, bool)
_FRAME[0xC0:0xD0] = True
_FRAME[[0xC4, 0xC8, 0xCC]] = False


class Walk:
    """The segments of all streams of a batch: every step goes to the next segment of each stream that is still walked."""

    def __init__(self, data: pa.Array) -> None:
        column = data.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.start, self.end = offsets[:-1], offsets[1:]
        own = np.flatnonzero(self.end - self.start >= 2)
        own = own[(self.raw[self.start[own]] == 0xFF) & (self.raw[self.start[own] + 1] == 0xD8)]
        self.streams, self.at = own, self.start[own] + 2
        # bytes that are no marker, fill and markers that stand alone lead on to the next of these
        self.markers = np.flatnonzero((self.raw[:-1] == 0xFF) & _SEGMENT[self.raw[1:]])

    def step(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stream, marker, place of its payload) of the next segment of each stream; streams without one are left."""
        k = np.searchsorted(self.markers, self.at)
        has = k < len(self.markers)
        at = np.where(has, self.markers[np.minimum(k, max(len(self.markers) - 1, 0))] if len(self.markers) else 0, 0)
        has &= at + 1 < self.end[self.streams]
        self.streams, at = self.streams[has], at[has]
        self.place = at + 2
        return self.streams, self.raw[at + 1] if len(at) else np.zeros(0, np.uint8), self.place

    def go_on(self, where: np.ndarray) -> None:
        """Jump over the segments of those streams that are walked on."""
        self.streams, place = self.streams[where], self.place[where]
        has = place + 1 < self.end[self.streams]
        self.streams, place = self.streams[has], place[has]
        self.at = place + self.raw[place].astype(np.int64) * 256 + self.raw[place + 1]


def abbreviated_of(data: pa.Array) -> np.ndarray:
    """Whether the scan of each stream begins before any table."""
    walk, out = Walk(data), np.zeros(len(data), bool)
    while len(walk.streams):
        stream, marker, _ = walk.step()
        out[stream[marker == 0xDA]] = True
        walk.go_on((marker != 0xDA) & (marker != 0xDB) & (marker != 0xC4))
    return out


def sizes(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(width, height) from the frame header, without decoding; -1 where there is none."""
    walk = Walk(data)
    width, height = np.full(len(data), -1), np.full(len(data), -1)
    while len(walk.streams):
        stream, marker, place = walk.step()
        found = _FRAME[marker] & (place + 7 <= walk.end[stream])
        at = place[found]
        pair = lambda k, at=at: walk.raw[at + k].astype(np.int64) * 256 + walk.raw[at + k + 1]
        height[stream[found]], width[stream[found]] = pair(3), pair(5)
        walk.go_on(~found)
    return width, height


def abbreviated(data: bytes | None) -> bool:
    """The same of one stream."""
    return bool(abbreviated_of(pa.array([data], pa.binary()))[0])


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """The same of one stream."""
    width, height = sizes(pa.array([data], pa.binary()))
    return None if width[0] < 0 else (int(width[0]), int(height[0]))


@F.arrow_udf(T.BooleanType())
def is_abbreviated(data: pa.Array) -> pa.Array:
    return pa.array(abbreviated_of(data))


@F.arrow_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def jpeg_size(data: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x, mask=x < 0) for x in sizes(data)], names=["width", "height"])


def is_complete(data: Column) -> Column:
    """A table marker anywhere after the start."""
    return F.coalesce((F.substring(data, 1, 2) == F.lit(SOI)) & F.contains(F.substring(data, 3, 2_147_483_647), F.lit(b"\xff\xdb")), F.lit(False))


def merged(tables: Column, tile: Column) -> Column:
    """Tables without their end marker, then the tile without its start marker."""
    n, m = F.octet_length(tables), F.octet_length(tile)
    head = F.when(F.substring(tables, -2, 2) == F.lit(EOI), F.substr(tables, F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(tables)
    body = F.when(F.substring(tile, 1, 2) == F.lit(SOI), F.substring(tile, 3, 2_147_483_647)).otherwise(tile)
    return F.when(m == 0, tile).when(n == 0, tile).otherwise(F.concat(head, body))


def prepared(tables: Column, tile: Column) -> Column:
    """A stream that decodes by itself."""
    return F.when(is_complete(tile), tile).when(tables.isNotNull() & is_abbreviated(tile), merged(tables, tile)).otherwise(tile)


def tile_format(data: Column) -> Column:
    """jpeg, j2k (codestream), jp2 (container) or null."""
    at = lambda a, n, v: F.substring(data, a, n) == F.lit(v)
    return F.when(at(1, 2, SOI), "jpeg").when(at(1, 4, b"\xff\x4f\xff\x51"), "j2k").when((F.octet_length(data) >= 12) & at(5, 4, b"jP  "), "jp2")


def repair(tiles: DataFrame) -> DataFrame:
    """tiles (..., jpeg_tables, data): data made complete, with its format and size."""
    out = tiles.withColumn("data", prepared(F.col("jpeg_tables"), F.col("data")))
    return out.withColumn("format", tile_format(F.col("data"))).withColumn("size", jpeg_size(F.col("data")))
