"""Small dimension tables: tags, field types, compressions, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the container format: tag number and name.
TAGS = {
    254: "NewSubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation",
    270: "ImageDescription", 273: "StripOffsets", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution",
    283: "YResolution", 284: "PlanarConfiguration", 305: "Software", 322: "TileWidth", 323: "TileLength", 324: "TileOffsets",
    325: "TileByteCounts", 347: "JPEGTables",
}
# Field type code, name, bytes per value.
FIELD_TYPES = {1: ("Byte", 1), 2: ("Ascii", 1), 3: ("Short", 2), 4: ("Long", 4), 7: ("Undefined", 1), 16: ("Long8", 8)}
# Compression code, name, supported.
COMPRESSIONS = {
    1: ("None", False), 5: ("LZW", False), 6: ("Old JPEG", False), 7: ("JPEG", True), 8: ("Deflate", False),
    32946: ("Deflate (Adobe)", False), 33003: ("JPEG 2000", True),
}
# Error code and HTTP status of requests.
ERRORS = {
    "not_found": 404, "invalid_level": 400, "tile_out_of_bounds": 400, "invalid_quality": 400, "unsupported_format": 415,
    "io_error": 500, "decode_error": 500, "encode_error": 500, "storage_error": 502,
    "missing_signature": 401, "missing_expiry": 401, "signature_expired": 401, "invalid_signature": 401,
    "invalid_signature_format": 400, "invalid_expiry_format": 400,
}


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAGS.items()), "tag_id int, tag string")


def field_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, b) for k, (n, b) in FIELD_TYPES.items()], "field_type_raw int, field_type string, bytes int")


def compressions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, s) for k, (n, s) in COMPRESSIONS.items()], "compression int, compression_name string, supported boolean")


def errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ERRORS.items()), "error string, status int")


def lookup(column: Column, table: dict, default=None) -> Column:
    """A CASE over a small table."""
    out = None
    for k, v in table.items():
        out = F.when(column == F.lit(k), F.lit(v)) if out is None else out.when(column == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def status_of(error: Column, default: int = 200) -> Column:
    return lookup(error, ERRORS, default)


def value_bytes(field_type_raw: Column, count: Column) -> Column:
    """Bytes that a value takes; null for unknown field types."""
    return lookup(field_type_raw, {k: b for k, (_, b) in FIELD_TYPES.items()}).cast("long") * count


def fits_inline(field_type_raw: Column, count: Column, is_bigtiff: Column) -> Column:
    """An unknown field type is never inline."""
    return F.coalesce(value_bytes(field_type_raw, count) <= F.when(is_bigtiff, 8).otherwise(4), F.lit(False))
