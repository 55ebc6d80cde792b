"""Image pyramids: from directories to levels, and the choice of a level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g


def pivot_tags(entries: DataFrame) -> DataFrame:
    """ifd_entries (slide_id, ifd_index, tag_id, value long) to one row per directory.

    Of a repeated tag the last entry counts (entry_index, if given). A directory's entries
    are its own group, so the aggregation has no skewed key beyond a slide's directories."""
    order = F.col("entry_index") if "entry_index" in entries.columns else F.lit(0)
    last = lambda tag: F.max_by(F.when(F.col("tag_id") == tag, F.col("value")), F.when(F.col("tag_id") == tag, order))
    has = lambda tag: F.max(F.col("tag_id") == tag)
    return entries.groupBy("slide_id", "ifd_index").agg(
        last(256).alias("width"), last(257).alias("height"), last(322).alias("tile_width"), last(323).alias("tile_height"), last(259).cast("int").alias("compression"),
        (has(324) & has(325)).alias("has_tiles"), (has(322) & has(323)).alias("is_tiled"), has(273).alias("is_stripped"), has(347).alias("has_jpeg_tables"),
    )


def with_grid(ifds: DataFrame) -> DataFrame:
    """Add tiles_x, tiles_y and tile_count; null where a tile side is missing or zero."""
    out = ifds.withColumn("tiles_x", g.grid(F.col("width"), F.col("tile_width"))).withColumn("tiles_y", g.grid(F.col("height"), F.col("tile_height")))
    return out.withColumn("tile_count", F.col("tiles_x") * F.col("tiles_y"))


def classify(ifds: DataFrame) -> DataFrame:
    """Add kind (level, rejected or other), rank among candidates, downsample and level.

    Candidates are ranked by area, the largest first, ties by directory order. The
    downsample is the mean of both sides' ratios to rank 0, tested with the candidate's
    rank; survivors are numbered densely. One shuffle by slide serves both windows.
    """
    own = with_grid(ifds).withColumn("candidate", g.is_candidate(F.col("width"), F.col("height"), F.col("has_tiles")) & F.col("tile_count").isNotNull())
    by = Window.partitionBy("slide_id", "candidate").orderBy((F.col("width") * F.col("height")).desc(), "ifd_index")
    ranked = own.withColumn("rank", F.when(F.col("candidate"), F.row_number().over(by) - 1))
    first = lambda c: F.first(c).over(by)
    ranked = ranked.withColumn("downsample", F.when(F.col("candidate"), (first("width") / F.col("width") + first("height") / F.col("height")) / 2))
    kind = F.when(~F.col("candidate"), "other").when(g.is_valid_downsample(F.col("downsample"), F.col("rank")), "level").otherwise("rejected")
    ranked = ranked.withColumn("kind", kind)
    number = F.row_number().over(Window.partitionBy("slide_id", "kind").orderBy("rank")) - 1
    return ranked.withColumn("level", F.when(F.col("kind") == "level", number)).drop("candidate")


def build(ifds: DataFrame) -> DataFrame:
    """levels(slide_id, level, ifd_index, width, height, tile_width, ..., downsample, compression)."""
    return classify(ifds).filter("kind = 'level'").drop("kind", "rank")


def best_level(levels: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each slide and wanted downsample d: the least downsample that is at least 0.99 d, else the last level.

    wanted: slide_id, d. An equi-join by slide and one aggregation."""
    both = wanted.join(levels.select("slide_id", "level", "downsample"), "slide_id")
    fits = F.col("downsample") >= 0.99 * F.col("d")
    return both.groupBy("slide_id", "d").agg(F.coalesce(F.min_by("level", F.when(fits, F.struct("downsample", "level"))), F.max("level")).alias("level"))


def wsi_level(levels: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each slide and d: the greatest downsample that is at most d (ties: the later level), else level 0; and d / it."""
    both = wanted.join(levels.select("slide_id", "level", "downsample"), "slide_id")
    fits = F.col("downsample") <= F.col("d")
    best = F.max(F.when(fits, F.struct("downsample", "level")))
    out = both.groupBy("slide_id", "d").agg(best.alias("b"), F.max(F.when(F.col("level") == 0, F.col("downsample"))).alias("base"))
    return out.select("slide_id", "d", F.coalesce("b.level", F.lit(0)).alias("level"), (F.col("d") / F.coalesce("b.downsample", "base")).alias("scale"))


def metadata(levels: DataFrame) -> DataFrame:
    """A document per slide: its levels in order, their number and the base size."""
    level = F.struct("level", "width", "height", "tile_width", "tile_height", "tiles_x", "tiles_y", "downsample")
    out = levels.groupBy("slide_id").agg(F.sort_array(F.collect_list(level)).alias("levels"))
    base = F.get("levels", F.lit(0))
    return out.select("slide_id", F.size("levels").alias("level_count"), base["width"].alias("width"), base["height"].alias("height"), "levels")


def level_info(levels: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a slide and its wanted level are, a row for each of wanted (slide_id, level).

    level_count, base_width and base_height (null: the slide has no levels; then level_count is 0), and the level's width, height, tile_width,
    tile_height, tiles_x, tiles_y and downsample, null where the level is out of range. One row per slide
    carries its levels to the wanted ones, by a merge join: Spark takes the levels for as small as the files they come from,
    and would hand them out through the driver."""
    of = metadata(levels).select("slide_id", F.col("level_count").alias("n"), F.col("width").alias("base_width"), F.col("height").alias("base_height"), F.col("levels").alias("of_slide"))
    own = F.when(F.col("level") >= 0, F.get("of_slide", F.col("level").cast("int")))
    out = wanted.select("slide_id", "level").join(of.hint("merge"), "slide_id", "left").withColumn("l", own)
    each = ["width", "height", "tile_width", "tile_height", "tiles_x", "tiles_y", "downsample"]
    return out.select("slide_id", "level", F.coalesce("n", F.lit(0)).alias("level_count"), "base_width", "base_height", *[F.col(f"l.{c}").alias(c) for c in each])


def tile_extents(arrays: DataFrame) -> DataFrame:
    """arrays (slide_id, level, tiles_x, offsets, byte_counts) to tiles (slide_id, level, tile_x, tile_y, offset, length)."""
    each = arrays.select("slide_id", "level", "tiles_x", F.posexplode(F.arrays_zip("offsets", "byte_counts")).alias("i", "t"))
    return each.select(
        "slide_id", "level", (F.col("i") % F.col("tiles_x")).alias("tile_x"), F.floor(F.col("i") / F.col("tiles_x")).cast("long").alias("tile_y"),
        F.col("t.offsets").alias("offset"), F.col("t.byte_counts").alias("length"),
    )


