"""Bucket addresses and signing parameters as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(address: Column) -> Column:
    """struct(bucket, error): of s3://bucket/anything the bucket; a text without a scheme is a bucket as it is; other schemes are refused."""
    text = F.trim(address)
    s3, own = text.startswith("s3://"), F.split_part(F.substr(text, F.lit(6)), F.lit("/"), F.lit(1))
    error = (
        F.when(text.isNull() | (text == ""), F.lit("Bucket name cannot be empty"))
        .when(s3 & (own == ""), F.format_string("Invalid S3 URI '%s'. Expected format: s3://bucket-name", text))
        .when(~s3 & F.contains(text, F.lit("://")), F.format_string("Invalid URI scheme in '%s'. Expected s3:// or plain bucket name", text))
    )
    return F.struct(F.when(error.isNull(), F.when(s3, own).otherwise(text)).alias("bucket"), error.alias("error"))


def parameters(given: Column) -> Column:
    """struct(params array<struct<k,v>>, error) of an array of key=value texts; the value goes on behind further equal signs.

    error is that of the first text without one; no array gives no parameters."""
    given = F.coalesce(given, F.array().cast("array<string>"))
    wrong = F.get(F.filter(given, lambda p: ~F.contains(p, F.lit("="))), F.lit(0))
    error = F.when(wrong.isNotNull(), F.format_string("Invalid parameter format '%s'. Expected key=value", wrong))
    pair = lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v"))
    return F.struct(F.when(error.isNull(), F.transform(given, pair)).alias("params"), error.alias("error"))
