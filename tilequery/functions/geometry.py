"""Pyramid, tile and deep-zoom arithmetic as Column expressions. All sizes are longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LEVEL_SIDE, LABEL_SIDE = 256, 1000
DEFAULT_QUALITY = 80


def ceil_div(a: Column, b: Column) -> Column:
    """Null where b is not positive."""
    return F.when(b > 0, F.expr("bigint(0)") + F.floor((a + b - 1) / b).cast("long"))


def shift(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def grid(size: Column, tile: Column) -> Column:
    return ceil_div(size, tile)


def is_candidate(width: Column, height: Column, has_tiles: Column) -> Column:
    """Large enough, tiled, and not a small near-square image (a label)."""
    ratio = width / F.when(height > 0, height)
    label = (width <= LABEL_SIDE) & (height <= LABEL_SIDE) & (ratio > 0.5) & (ratio < 2.0)
    return F.coalesce((width >= MIN_LEVEL_SIDE) & (height >= MIN_LEVEL_SIDE) & has_tiles & ~label, F.lit(False))


def is_valid_downsample(downsample: Column, rank: Column) -> Column:
    """Rank 0 is the base; any other must be near a power of two."""
    power = F.round(F.log2(downsample))
    ratio = downsample / F.pow(F.lit(2.0), power)
    return F.when(rank == 0, F.abs(downsample - 1) < 0.1).otherwise((power >= 1) & (ratio > 0.8) & (ratio < 1.2))


def tile_index(x: Column, y: Column, tiles_x: Column, tiles_y: Column) -> Column:
    return F.when((x >= 0) & (y >= 0) & (x < tiles_x) & (y < tiles_y), y * tiles_x + x)


def tile_side(position: Column, tile: Column, size: Column) -> Column:
    """Width or height of a tile: the remainder at the edge; null outside."""
    return F.when((position >= 0) & (position < ceil_div(size, tile)), F.least(tile, size - position * tile))


def max_dzi_level(width: Column, height: Column) -> Column:
    """ceil(log2(longer side)) without rounding errors: the bits of side - 1."""
    side = F.greatest(width, height)
    return F.when(side <= 1, 0).otherwise(F.length(F.bin(F.greatest(side - 1, F.lit(1))))).cast("int")


def dzi_side(size: Column, level: Column, max_level: Column) -> Column:
    return F.when(level > max_level, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), ceil_div(size, shift(F.greatest(max_level - level, F.lit(0))))))


def dzi_downsample(level: Column, max_level: Column) -> Column:
    return F.when(level > max_level, F.lit(0.0)).otherwise(shift(F.greatest(max_level - level, F.lit(0))).cast("double"))


def dzi_tiles(size: Column, tile: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), ceil_div(size, tile))


def is_valid_quality(quality: Column) -> Column:
    return quality.between(1, 100)


def clamp_quality(quality: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(100), quality))


def clamp_thumbnail(max_size: Column) -> Column:
    return F.greatest(F.lit(64), F.least(F.lit(2048), max_size))


def resized(side: Column, longer: Column, max_size: Column) -> Column:
    """A side of an image scaled so that the longer one is max_size; may enlarge."""
    return F.round(side * (max_size / longer)).cast("long")
