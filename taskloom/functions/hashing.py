"""Seeded, engine-portable hashes used for every deterministic order and sample."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def md5_int(digest: Column) -> Column:
    """The first 15 hex digits (60 bits) as a non-negative bigint."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def md5_bucket(digest: Column, digits: int) -> Column:
    """Bucket 0..16**digits-1, monotone in the digest's own order."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def bucket_digits(width: int) -> int:
    """Hex digits for a few buckets per shuffle partition: 4096 buckets, more on wide clusters."""
    digits = 3
    while 16**digits < 4 * width:
        digits += 1
    return digits


def sha_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
