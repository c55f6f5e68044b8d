"""Order, splits and shards from content hashes: the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "|"
HEX_DIGITS = 8


def seeded_hash(seed: int, *keys: Column) -> Column:
    """md5 of ``seed:key|key``; nulls are skipped."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(SEP, *[k.cast("string") for k in keys])))


def hex_threshold(share: float) -> str:
    """The hash prefix below which ``share`` of all keys fall."""
    if not 0.0 < share < 1.0:
        raise ValueError("share must lie between 0 and 1")
    return format(int(share * 16**HEX_DIGITS), f"0{HEX_DIGITS}x")


def below_share(hashed: Column, share: float) -> Column:
    return F.substring(hashed, 1, HEX_DIGITS) < F.lit(hex_threshold(share))


def hash_number(hashed: Column) -> Column:
    """The first hex digits as a number."""
    return F.conv(F.substring(hashed, 1, HEX_DIGITS), 16, 10).cast("long")
