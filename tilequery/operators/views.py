"""Responses as columns: metadata documents, errors, viewer pages, signed addresses."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signing
from ..functions.text import dzi_xml, html_escape
from . import pyramid

CACHE_SECONDS = 3600
# The viewer page; names in braces are filled in.
PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<script src="https://cdn.jsdelivr.net/npm/openseadragon@4.1/build/openseadragon/openseadragon.min.js"></script>
<style>html, body, #viewer {{ height: 100%; margin: 0 }}</style></head>
<body><h1>{title}</h1><p>{format}</p><div id="viewer"></div>
<script>
const levels = [{levels}], last = {last};
OpenSeadragon({{ id: "viewer", tileSources: {{
  width: {width}, height: {height}, tileSize: {tile}, minLevel: 0, maxLevel: last,
  getLevelScale: k => levels[last - k].width / {width},
  getTileUrl: (k, x, y) => "{base}/tiles/{id}/" + levels[last - k].level + "/" + x + "/" + y + ".jpg{auth}"
}} }});
</script></body></html>
"""


def health(spark: SparkSession, version: str = "0.1.0") -> DataFrame:
    return spark.range(1).select(F.lit("healthy").alias("status"), F.lit(version).alias("version"))


def metadata_json(levels: DataFrame) -> DataFrame:
    m = pyramid.metadata(levels)
    return m.select("slide_id", F.to_json(F.struct("slide_id", "level_count", F.struct("width", "height").alias("dimensions"), "levels")).alias("body"))


def dzi_descriptors(levels: DataFrame) -> DataFrame:
    base = levels.filter("level = 0")
    return base.select("slide_id", dzi_xml(F.col("width"), F.col("height"), F.col("tile_width")).alias("body"))


def error_json(resolved: DataFrame) -> DataFrame:
    """resolve()'s errors as bodies; null where there is none."""
    body = F.to_json(F.struct("error", "message", "status"))
    return resolved.withColumn("body", F.when(F.col("error").isNotNull(), body))


def response_headers(tiles: DataFrame, cache_seconds: int = CACHE_SECONDS) -> DataFrame:
    """cache_control, cache_hit and quality columns for tiles that are sent."""
    return tiles.withColumn("cache_control", F.lit(f"public, max-age={cache_seconds}"))


def viewer_pages(levels: DataFrame, secret: str | None = None, expiry: int | None = None, base: str = "", formats: DataFrame | None = None) -> DataFrame:
    """A page per slide that shows its tiles: (slide_id, body).

    The page has the level table (number and size of each level), the tile size of level 0,
    and addresses of tiles below base with the encoded id and, with a secret, a viewer token. What comes from a
    slide is escaped. formats: (slide_id, format); without it, or for a slide it lacks, the format is empty."""
    m = pyramid.metadata(levels).withColumn("id", F.col("slide_id").cast("string"))
    m = m.withColumn("format", F.lit("")) if formats is None else m.join(formats.select("slide_id", "format"), "slide_id", "left")
    auth = F.lit("") if secret is None else F.concat(F.lit(f"?exp={expiry}&vt="), signing.viewer_token(secret, F.col("id"), F.lit(expiry)))
    entry = lambda x: F.concat(F.lit("{level: "), x["level"].cast("string"), F.lit(", width: "), x["width"].cast("string"), F.lit(", height: "), x["height"].cast("string"), F.lit("}"))
    first = F.get("levels", F.lit(0))
    filled = {
        "title": html_escape(F.col("id")), "format": html_escape(F.coalesce("format", F.lit(""))), "levels": F.array_join(F.transform("levels", entry), ", "),
        "last": (F.col("level_count") - 1).cast("string"), "width": F.col("width").cast("string"), "height": F.col("height").cast("string"),
        "tile": first["tile_width"].cast("string"), "base": F.lit(base.rstrip("/")), "id": F.replace(F.url_encode("id"), F.lit("+"), F.lit("%20")), "auth": auth,
    }
    pieces = []
    for text, name, _, _ in Formatter().parse(PAGE):
        pieces += [F.lit(text)] + ([filled[name]] if name else [])
    return m.select("slide_id", F.concat(*pieces).alias("body"))


def sign_urls(rows: DataFrame, secret: str, now: int, ttl: int = CACHE_SECONDS, base: str = "") -> DataFrame:
    """rows (path, params array<struct<k,v>>): exp, sig and the signed address."""
    exp = F.lit(now + ttl).cast("long")
    return rows.select(
        "*", exp.alias("exp"), signing.sign(secret, F.col("path"), F.col("params"), exp).alias("sig"),
        signing.signed_url(base, secret, F.col("path"), F.col("params"), exp).alias("url"),
    )


def plain_urls(rows: DataFrame, secret: str, now: int, ttl: int = CACHE_SECONDS, base: str = "") -> DataFrame:
    """The same for reading by people: parameters as they are, not encoded."""
    exp = F.lit(now + ttl).cast("long")
    pairs = F.transform("params", lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    tail = F.array(F.concat(F.lit("exp="), exp.cast("string")), F.concat(F.lit("sig="), signing.sign(secret, F.col("path"), F.col("params"), exp)))
    return rows.select("*", F.concat(F.lit(base.rstrip("/")), F.col("path"), F.lit("?"), F.array_join(F.concat(pairs, tail), "&")).alias("url"))


def thumbnail_headers(plan: DataFrame) -> DataFrame:
    """What a response says of a thumbnail whose size was brought into range."""
    return plan.withColumn("requested_size", F.when(F.col("clamped"), F.col("max_size"))).withColumn("actual_size", F.when(F.col("clamped"), F.col("size")))


def check(slides: DataFrame, pyramids: DataFrame) -> DataFrame:
    """A report of a collection: slides (slide_id, format, error) and validation results, counted by outcome."""
    both = slides.join(pyramids.select("slide_id", "is_valid"), "slide_id", "left")
    outcome = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("is_valid"), "ok").otherwise("unsupported_format")
    return both.groupBy(F.coalesce("format", F.lit("unknown")).alias("format"), outcome.alias("outcome")).agg(F.count("*").alias("slides"))
