"""Text functions: file names, vendor descriptions, deep-zoom descriptors, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4_294_967_295
MARKER = "Aperio"
# The deep-zoom descriptor.
DZI = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<Image xmlns="http://schemas.microsoft.com/deepzoom/2008"\n       TileSize="%d"\n'
    '       Overlap="0"\n       Format="jpg">\n  <Size Width="%d" Height="%d" />\n</Image>'
)


def is_slide_file(path: Column) -> Column:
    """Suffix .svs, .tif or .tiff in any case; the id may hold line breaks."""
    return F.lower(path).rlike(r"(?s)\.(svs|tif|tiff)\z")


def is_tiff_header(data: Column) -> Column:
    """Whether bytes begin as a TIFF or BigTIFF file of either byte order: eight bytes or more, mark and version."""
    start = F.hex(F.substring(data, 1, 4))
    return (F.octet_length(data) >= 8) & start.isin("49492A00", "49492B00", "4D4D002A", "4D4D002B")


def dzi_xml(width: Column, height: Column, tile: Column) -> Column:
    return F.format_string(DZI, tile.cast("long"), width.cast("long"), height.cast("long"))


def u32(digits: Column) -> Column:
    """An unsigned 32-bit number, with a leading plus allowed; else null."""
    n = F.when(digits.rlike(r"^\+?[0-9]+\z"), F.regexp_replace(digits, r"^\+?0*(?=[0-9])", ""))
    n = F.when(F.length(n) <= 10, n).try_cast("long")
    return F.when(n <= U32, n)


def dzi_tile_coords(name: Column) -> Column:
    """struct(x, y) of x_y, x_y.jpg or x_y.jpeg; null if malformed."""
    stem = F.regexp_replace(name, r"\.jpe?g\z", "")
    parts = F.split(stem, "_")
    x, y = u32(F.get(parts, F.lit(0))), u32(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def tile_file_y(name: Column) -> Column:
    return u32(F.regexp_replace(name, r"\.jpg\z", ""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number(c: Column) -> Column:
    """A decimal number, without the type letters that casts would allow."""
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c).try_cast("double")


def description_pairs(description: Column) -> Column:
    """array<struct<k,v>> of the parts with an equals sign, in order."""
    parts = F.filter(F.transform(F.split(description, r"\|"), trimmed), lambda p: F.instr(p, "=") > 0)
    return F.transform(parts, lambda p: F.struct(
        trimmed(F.substring_index(p, "=", 1)).alias("k"), trimmed(F.substr(p, F.instr(p, "=") + F.lit(1))).alias("v")
    ))


def description_map(description: Column) -> Column:
    """Properties; of a repeated key the last value counts."""
    pairs = description_pairs(description)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def vendor_metadata(description: Column) -> Column:
    """struct(mpp, magnification, vendor, image_description, properties); all null or empty without a description."""
    p = description_map(F.coalesce(description, F.lit("")))
    return F.struct(
        number(F.try_element_at(p, F.lit("MPP"))).alias("mpp"), number(F.try_element_at(p, F.lit("AppMag"))).alias("magnification"),
        F.when(F.contains(description, F.lit(MARKER)), MARKER).alias("vendor"), description.alias("image_description"), p.alias("properties"),
    )


def html_escape(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c
