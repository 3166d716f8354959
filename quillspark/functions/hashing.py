"""Seeded, engine-independent hashes: orders, buckets and ids that any system with SHA-256 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str, sep: str = ":") -> Column:
    """Hex SHA-256 of the parts joined by ``sep``; strings that are no columns are literals."""
    return F.sha2(F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def group_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(value, 256), 1, 20))


def unsigned64(hexes: Column) -> Column:
    """The first 16 hex digits as an unsigned number: a decimal, since longs are signed."""
    return F.conv(F.substring(hexes, 1, 16), 16, 10).cast("decimal(20,0)")


def uniform(hexes: Column) -> Column:
    """A number from 0 up to 1 of a digest."""
    return unsigned64(hexes).cast("double") / F.lit(float(2**64))


def choice(hexes: Column, n: int) -> Column:
    return (unsigned64(hexes) % F.lit(n).cast("decimal(20,0)")).cast("long")


def seed31(hexes: Column) -> Column:
    return (unsigned64(hexes) % F.lit(2**31 - 1).cast("decimal(20,0)")).cast("long")
