"""Where slides lie and how requests are signed, as plain settings."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlsplit


def parse_bucket(address: str) -> tuple[str, str]:
    """(bucket, prefix) of s3://bucket/prefix or bucket/prefix; other schemes are refused."""
    parts = urlsplit(address)
    if parts.scheme and parts.scheme != "s3":
        raise ValueError(f"not an s3 address: {address}")
    bucket, _, prefix = address.removeprefix("s3://").partition("/")
    if not bucket:
        raise ValueError("no bucket given")
    return bucket, prefix


@dataclass(frozen=True)
class Settings:
    bucket: str
    prefix: str = ""
    endpoint: str | None = None
    region: str = "us-east-1"
    secret: str | None = None
    quality: int = 80
    block_bytes: int = 262_144
    cache_seconds: int = 3600

    def __post_init__(self) -> None:
        if not 1 <= self.quality <= 100:
            raise ValueError("quality must be 1 to 100")
        if not 1024 <= self.block_bytes <= 16 << 20:
            raise ValueError("block_bytes must be 1 KiB to 16 MiB")

    def spark_options(self) -> dict[str, str]:
        """File system settings; path-style addresses with an endpoint of one's own."""
        out = {"spark.hadoop.fs.s3a.endpoint.region": self.region}
        if self.endpoint:
            out |= {"spark.hadoop.fs.s3a.endpoint": self.endpoint, "spark.hadoop.fs.s3a.path.style.access": "true"}
        return out
