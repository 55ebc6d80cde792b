"""Validation of directories and pyramids as arrays of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import COMPRESSIONS, lookup

LARGE_TILE, TILE_STEP = 4096, 16


def _finding(code: str, when: Column, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.col("ifd_index").cast("int").alias("ifd_index"), detail.cast("string").alias("detail")))


def _some(*findings: Column) -> Column:
    return F.filter(F.array(*findings), lambda x: x.isNotNull())


def _unsupported() -> Column:
    return F.coalesce(~lookup(F.col("compression"), {k: s for k, (_, s) in COMPRESSIONS.items()}, False), F.lit(False)) & F.col("compression").isNotNull()


def _name() -> Column:
    return F.coalesce(lookup(F.col("compression"), {k: n for k, (n, _) in COMPRESSIONS.items()}), F.lit("Unknown"))


def _tile_findings(tiled: Column) -> list[Column]:
    """What is wrong with a tiled directory or level."""
    gone = F.array_join(_some(F.when(~F.col("has_offsets"), "TileOffsets"), F.when(~F.col("has_counts"), "TileByteCounts")), ",")
    return [
        _finding("missing_tag", tiled & F.col("compression").isNull(), F.lit("Compression")),
        _finding("unsupported_compression", tiled & _unsupported(), _name()),
        _finding("missing_tile_tags", tiled & (~F.col("has_offsets") | ~F.col("has_counts")), gone),
        _finding("invalid_tile_dimensions", tiled & ((F.col("tile_width") == 0) | (F.col("tile_height") == 0)), F.lit("Tile dimensions cannot be zero")),
    ]


def check_levels(levels: DataFrame) -> DataFrame:
    """Add errors array<struct<code,ifd_index,detail>> and warnings array<string> to levels.

    levels: level, ifd_index, compression, tile_width, tile_height, has_offsets, has_counts, has_jpeg_tables."""
    warn = F.when((F.col("compression") == 7) & ~F.col("has_jpeg_tables"), F.format_string("Level %s: No JPEGTables tag found (tiles may have inline tables)", F.col("level").cast("string")))
    return levels.withColumn("errors", _some(*_tile_findings(F.lit(True)))).withColumn("warnings", _some(warn))


def check_ifds(ifds: DataFrame) -> DataFrame:
    """The same for directories: strips only is an error and ends the check, not tiled is no finding."""
    tiled = F.col("is_tiled")
    sides = F.greatest("tile_width", "tile_height")
    errors = _some(_finding("strip_organization", F.col("is_stripped") & ~tiled, F.lit(None)), *_tile_findings(tiled))
    size = F.format_string("IFD %s: tile size %sx%s", F.col("ifd_index").cast("string"), F.col("tile_width").cast("string"), F.col("tile_height").cast("string"))
    uneven = (F.col("tile_width") % TILE_STEP != 0) | (F.col("tile_height") % TILE_STEP != 0)
    warnings = _some(F.when(tiled & (sides > LARGE_TILE), F.concat(size, F.lit(" is unusually large"))), F.when(tiled & uneven, F.concat(size, F.lit(" is not a multiple of 16"))))
    return ifds.withColumn("errors", errors).withColumn("warnings", warnings)


def strict(checked: DataFrame) -> DataFrame:
    """The first error of each row only; null where there is none."""
    return checked.withColumn("error", F.get("errors", F.lit(0)))


# The reading error that a finding is told as.
READ_ERRORS = {
    "missing_tag": "missing_tag", "strip_organization": "strip_organization", "unsupported_compression": "unsupported_compression",
    "missing_tile_tags": "missing_tag", "no_pyramid_levels": "missing_tag", "invalid_tile_dimensions": "invalid_tag_value",
}


def as_read_error(finding: Column) -> Column:
    """struct(code, message) of a finding, as reading the slide tells it; null of null. Of several missing tags the first is told."""
    code, detail = finding["code"], finding["detail"]
    first = F.coalesce(F.nullif(F.split_part(detail, F.lit(","), F.lit(1)), F.lit("")), F.lit("TileOffsets"))
    tag = F.when(code == "no_pyramid_levels", "No valid pyramid levels found").when(code == "missing_tile_tags", first).otherwise(detail)
    told = lookup(code, READ_ERRORS)
    message = (
        F.when(told == "missing_tag", F.concat(F.lit("Missing required tag: "), tag))
        .when(told == "strip_organization", "Unsupported organization: file uses strips instead of tiles")
        .when(told == "unsupported_compression", F.concat(F.lit("Unsupported compression: "), detail, F.lit(" (only JPEG and JPEG 2000 are supported)")))
        .when(told == "invalid_tag_value", F.concat(F.lit("Invalid tag value for TileWidth/TileLength: "), detail))
    )
    return F.when(told.isNotNull(), F.struct(told.alias("code"), message.alias("message")))


def check_pyramids(slides: DataFrame, levels: DataFrame) -> DataFrame:
    """(slide_id, is_valid, errors, warnings); a slide without levels has one error."""
    each = check_levels(levels).groupBy("slide_id").agg(
        F.sort_array(F.collect_list(F.struct("level", "errors", "warnings"))).alias("l")
    ).select("slide_id", F.flatten(F.transform("l", lambda x: x["errors"])).alias("errors"), F.flatten(F.transform("l", lambda x: x["warnings"])).alias("warnings"))
    none = F.array(F.struct(F.lit("no_pyramid_levels").alias("code"), F.lit(None).cast("int").alias("ifd_index"), F.lit(None).cast("string").alias("detail")))
    out = slides.select("slide_id").join(each, "slide_id", "left")
    errors = F.coalesce("errors", none)
    return out.select("slide_id", (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
