"""Whole answers: slides opened with their validation, and batches of tile requests answered with bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dimensions import status_of
from ..functions.text import vendor_metadata
from ..sources import pyramid_tiff
from . import jpeg, pyramid, requests, tiles, validation


def open_slides(spark: SparkSession, path: str) -> DataFrame:
    """A row per slide file below path: format, base size, levels, vendor metadata, and the findings of validation.

    error: of the file (see the slides table), or unsupported_format where it has no valid
    pyramid; null: the slide can be served. A file that can't be read has empty levels.
    """
    slides = pyramid_tiff.read(spark, path, "slides")
    levels = pyramid.build(pyramid_tiff.read(spark, path))
    return opened(slides, levels)


def opened(slides: DataFrame, levels: DataFrame) -> DataFrame:
    """The same of tables that were read before: slides, levels."""
    checked = validation.check_pyramids(slides, levels)
    out = slides.join(checked, "slide_id", "left").join(pyramid.metadata(levels), "slide_id", "left")
    error = F.coalesce("error", F.when(~F.coalesce("is_valid", F.lit(False)), "unsupported_format"))
    return out.select(
        "slide_id", "size", "format", "byte_order", "is_bigtiff", "width", "height", F.coalesce("level_count", F.lit(0)).alias("level_count"), "levels",
        vendor_metadata(F.col("description")).alias("vendor"), "is_valid", "errors", "warnings", error.alias("error"), "message",
    )


def get_tiles(wanted: DataFrame, slides: DataFrame, levels: DataFrame, arrays: DataFrame, encode: bool = True) -> DataFrame:
    """Answer tile requests: status, error, message, and the bytes of the tile.

    wanted: request_id, slide_id, level, tile_x, tile_y, quality; slides: as opened();
    levels; arrays (slide_id, ifd_index, offsets, byte_counts, jpeg_tables). Checks come in
    the order quality, slide (404 not_found; 415 unsupported_format), level, coordinates; then
    the extent is looked up, each distinct range is read once, abbreviated streams get
    their tables and, with encode, all are encoded anew at the asked quality. A range that
    can't be read, or whose extent can't, is a row with not_found or io_error.

    Returns request_id, slide_id, level, tile_x, tile_y, quality, status, error, message,
    offset, length, cache_hit (an equal request with a lesser request_id is in the batch) and
    data. Arrays are read for levels with accepted requests only, and only
    wanted indexes leave them.
    """
    served = levels.join(slides.filter("error IS NULL").select("slide_id"), "slide_id", "left_semi")
    known = slides.filter("error IS NOT NULL").select("slide_id", F.coalesce("message", F.element_at("errors.code", 1)).alias("why"))
    resolved = requests.resolve(wanted, served).join(known, "slide_id", "left")
    refused = (F.col("error") == "not_found") & F.col("why").isNotNull()
    resolved = resolved.withColumn("message", F.when(refused, F.concat(F.lit("Unsupported format: "), "why")).otherwise(F.col("message"))).withColumn("error", F.when(refused, "unsupported_format").otherwise(F.col("error"))).drop("why")

    own = arrays.join(served.select("slide_id", "ifd_index", "level"), ["slide_id", "ifd_index"])
    asked = requests.accepted(resolved)
    extents = requests.picked(own.join(asked, ["slide_id", "level"]))
    tables = own.select("slide_id", "level", "jpeg_tables")
    read = tiles.fetch(extents).withColumnRenamed("error", "read_error").join(tables, ["slide_id", "level"], "left")
    read = read.withColumn("data", jpeg.prepared(F.col("jpeg_tables"), F.col("data"))).drop("jpeg_tables")

    key = ["slide_id", "level", "tile_index", "quality"]
    first = resolved.filter("error IS NULL").groupBy(*key).agg(F.min("request_id").alias("first"))
    out = resolved.join(read, ["slide_id", "level", "tile_index"], "left")
    if encode:
        # one encoding for each tile and quality, however often it is asked for
        made = first.join(read.filter("read_error IS NULL"), ["slide_id", "level", "tile_index"]).select(*key, "data")
        made = tiles.transcode(made).withColumnRenamed("error", "codec_error")
        out = out.drop("data").join(made, key, "left")
    else:
        out = out.withColumn("codec_error", F.lit(None).cast("string"))
    out = out.join(first, key, "left").withColumn("error", F.coalesce("error", "read_error", F.when(F.col("offset").isNull(), "io_error"), "codec_error"))
    return out.select(
        "request_id", "slide_id", "level", "tile_x", "tile_y", "quality", status_of(F.col("error")).alias("status"), "error", "message", "offset", "length",
        (F.col("error").isNull() & (F.col("request_id") > F.col("first"))).alias("cache_hit"), F.when(F.col("error").isNull(), F.col("data")).alias("data"),
    )


def thumbnail_tiles(plan: DataFrame, levels: DataFrame, arrays: DataFrame) -> DataFrame:
    """The tiles with their bytes that the thumbnails of a plan (requests.thumbnail_plan) are made of; input of tiles.thumbnails."""
    chosen = plan.join(levels.select("slide_id", "level", "ifd_index", "width", "height", "tile_width", "tile_height", "tiles_x", "tiles_y"), ["slide_id", "level"])
    own = chosen.join(arrays.select("slide_id", "ifd_index", "offsets", "byte_counts", "jpeg_tables"), ["slide_id", "ifd_index"])
    at = F.posexplode(F.arrays_zip("offsets", "byte_counts")).alias("i", "t")
    each = own.select("slide_id", "level", "width", "height", "tile_width", "tile_height", "tiles_x", "tiles_y", "out_width", "out_height", "jpeg_tables", at).filter("i < tiles_x * tiles_y")
    each = each.select("*", (F.col("i") % F.col("tiles_x")).alias("tile_x"), F.floor(F.col("i") / F.col("tiles_x")).cast("long").alias("tile_y"), F.col("t.offsets").alias("offset"), F.col("t.byte_counts").alias("length"))
    return tiles.fetch(each.drop("i", "t")).withColumn("data", jpeg.prepared(F.col("jpeg_tables"), F.col("data"))).drop("jpeg_tables")
