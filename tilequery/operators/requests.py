"""Batches of tile and thumbnail requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.dimensions import status_of
from .ordered import carried, in_parts


def resolve(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Status, error and tile index of each request.

    requests: request_id, slide_id, level, tile_x, tile_y, quality (null: 80). Errors in the
    order of the checks: quality, slide, level, coordinates. One aggregation of levels
    to a row per slide (its levels as a small map), one left join by slide. It is a merge join: Spark
    estimates the slide side by the files it comes from, far too low where levels are
    made of a row, and would hand it out through the driver.
    """
    of = levels.groupBy("slide_id").agg(
        F.count("*").alias("max_levels"), F.map_from_entries(F.collect_list(F.struct("level", F.struct("tiles_x", "tiles_y")))).alias("grids")
    )
    r = requests.withColumn("quality", F.coalesce("quality", F.lit(g.DEFAULT_QUALITY))).join(of.hint("merge"), "slide_id", "left")
    grid = F.try_element_at("grids", F.col("level").cast("int"))
    r = r.withColumn("tiles_x", grid["tiles_x"]).withColumn("tiles_y", grid["tiles_y"])
    index = g.tile_index(F.col("tile_x"), F.col("tile_y"), F.col("tiles_x"), F.col("tiles_y"))
    error = (
        F.when(~g.is_valid_quality(F.col("quality")), "invalid_quality").when(F.col("max_levels").isNull(), "not_found")
        .when((F.col("level") < 0) | (F.col("level") >= F.col("max_levels")), "invalid_level").when(index.isNull(), "tile_out_of_bounds")
    )
    r = r.withColumn("error", error)
    return r.select(
        "request_id", "slide_id", "level", "tile_x", "tile_y", "quality", status_of(F.col("error")).alias("status"), "error",
        F.when(F.col("error").isNull(), index).alias("tile_index"), _message().alias("message"),
    )


def _message() -> Column:
    return (
        F.when(F.col("error") == "invalid_quality", F.format_string("Invalid quality: %s (must be 1-100)", F.col("quality").cast("string")))
        .when(F.col("error") == "not_found", F.concat(F.lit("Slide not found: "), F.col("slide_id").cast("string")))
        .when(F.col("error") == "invalid_level", F.format_string(
            "Invalid level: %s (slide has %s levels, valid range: 0-%s)", F.col("level").cast("string"), F.col("max_levels").cast("string"), (F.col("max_levels") - 1).cast("string")))
        .when(F.col("error") == "tile_out_of_bounds", F.format_string(
            "Tile coordinates (%s, %s) at level %s are out of bounds (max: %s, %s)", F.col("tile_x").cast("string"), F.col("tile_y").cast("string"),
            F.col("level").cast("string"), (F.col("tiles_x") - 1).cast("string"), (F.col("tiles_y") - 1).cast("string")))
    )


def locate(resolved: DataFrame, tiles: DataFrame) -> DataFrame:
    """Byte extents of the requests that passed; tiles (slide_id, level, tile_x, tile_y, offset, length)."""
    return resolved.join(tiles.hint("merge"), ["slide_id", "level", "tile_x", "tile_y"], "left")


def accepted(resolved: DataFrame) -> DataFrame:
    """(slide_id, level, wanted): the distinct tile indexes of the requests that passed, a row per level asked for."""
    return resolved.filter("error IS NULL").groupBy("slide_id", "level").agg(F.collect_set("tile_index").alias("wanted"))


def picked(arrays: DataFrame) -> DataFrame:
    """arrays (slide_id, level, wanted, offsets, byte_counts) to (slide_id, level, tile_index, offset, length) of the wanted tiles only."""
    tile = lambda i: F.struct(i.alias("tile_index"), F.get("offsets", i.cast("int")).alias("offset"), F.get("byte_counts", i.cast("int")).alias("length"))
    return arrays.select("slide_id", "level", F.explode(F.transform("wanted", tile)).alias("t")).select("slide_id", "level", "t.*")


def extents(resolved: DataFrame, levels: DataFrame, arrays: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """resolved with offset and length, null where no level of `levels` has the tile.

    arrays adds offsets and byte_counts to levels. It is given the levels with accepted requests only, and of a
    level's tiles only the wanted ones become rows. No table goes through the driver."""
    asked = levels.join(accepted(resolved).hint("merge"), ["slide_id", "level"])
    return resolved.join(picked(arrays(asked)).hint("merge"), ["slide_id", "level", "tile_index"], "left")


def with_tables(located: DataFrame, tables: DataFrame) -> DataFrame:
    """Add a level's shared decoding tables (slide_id, level, jpeg_tables)."""
    return located.join(tables, ["slide_id", "level"], "left")


def found(requests: DataFrame, slides: DataFrame) -> DataFrame:
    return requests.join(slides.select("slide_id"), "slide_id", "left_semi")


def missing(requests: DataFrame, slides: DataFrame) -> DataFrame:
    return requests.join(slides.select("slide_id"), "slide_id", "left_anti")


def coalesced_reads(extents: DataFrame, block: int) -> DataFrame:
    """Distinct aligned blocks that the byte ranges (slide_id, offset, length) touch; an empty range touches none."""
    each = extents.filter("length > 0").select("slide_id", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("length") - 1) / block))).alias("block"))
    return each.distinct()


def read_plan(extents: DataFrame, gap: int = 0, most: int | None = None) -> DataFrame:
    """Byte ranges (slide_id, offset, length) as few reads: (slide_id, island, start, end, ranges).

    Ranges that overlap, touch or lie at most `gap` bytes apart are one island, told by its
    first byte. An island of more than `most` bytes is cut into reads of `most` (the last is shorter); ranges
    counts the ranges that begin in a read. Empty ranges and those with a null are not read; repeated
    ranges count each. Ranges are dealt by (slide, offset) over tasks, and each task is told the
    greatest end and the last beginning of an island before it, so a hot slide is many tasks.
    """
    own = extents.filter("length > 0 AND offset IS NOT NULL AND slide_id IS NOT NULL").select("slide_id", "offset", (F.col("offset") + F.col("length")).alias("end"))
    own = in_parts(own.withColumn("tie", F.monotonically_increasing_id()), "slide_id", "offset", "end", "tie").drop("tie")
    here = Window.partitionBy("part", "slide_id").orderBy("pos")
    own = carried(own, ["slide_id"], F.col("end"), "end_before")
    reached = F.greatest("end_before", F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    own = own.withColumn("begins", F.when(F.coalesce(F.col("offset") > reached + gap, F.lit(True)), F.col("offset")))
    own = carried(own, ["slide_id"], F.col("begins"), "begun_before")
    own = own.withColumn("island", F.greatest("begun_before", F.max("begins").over(here)))
    if most is None:
        return own.groupBy("slide_id", "island").agg(F.col("island").alias("start"), F.max("end").alias("end"), F.count("*").alias("ranges")).select("slide_id", "island", "start", "end", "ranges")
    # counted by read, so that a long island isn't one group
    piece = F.floor((F.col("offset") - F.col("island")) / most)
    per = own.groupBy("slide_id", "island", piece.alias("piece")).agg(F.max("end").alias("end"), F.count("*").alias("ranges"))
    ends = per.groupBy("slide_id", "island").agg(F.max("end").alias("whole"))
    every = ends.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("whole") - F.col("island") - 1) / most))))
    out = every.join(per.drop("end"), ["slide_id", "island", "piece"], "left")
    start = F.col("island") + F.col("piece") * most
    return out.select("slide_id", "island", start.alias("start"), F.least(start + most, "whole").alias("end"), F.coalesce("ranges", F.lit(0)).alias("ranges"))


def thumbnail_plan(wanted: DataFrame, levels: DataFrame) -> DataFrame:
    """wanted (slide_id, max_size): clamp, level, whether one tile is enough, and the size of the result."""
    from .pyramid import best_level

    base = levels.filter("level = 0").select("slide_id", F.greatest("width", "height").alias("longer"))
    w = wanted.withColumn("size", g.clamp_thumbnail(F.col("max_size"))).withColumn("clamped", F.col("size") != F.col("max_size"))
    w = w.join(base, "slide_id").withColumn("d", F.col("longer") / F.col("size"))
    chosen = best_level(levels, w.select("slide_id", "d").distinct())
    out = w.join(chosen, ["slide_id", "d"]).join(levels.select("slide_id", "level", "width", "height", "tiles_x", "tiles_y"), ["slide_id", "level"])
    longer = F.greatest("width", "height")
    return out.select(
        "slide_id", "max_size", "size", "clamped", "level", ((F.col("tiles_x") == 1) & (F.col("tiles_y") == 1)).alias("single_tile"),
        g.resized(F.col("width"), longer, F.col("size")).alias("out_width"), g.resized(F.col("height"), longer, F.col("size")).alias("out_height"),
    )
