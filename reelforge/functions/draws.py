"""Reproducible draws: md5 of seed, stable id and purpose.

A draw depends on nothing but its own row, so samples, splits and shuffles do
not depend on partitioning, and any engine with md5 gives the same ones.
Membership differs from that of a sequential random generator; determinism,
disjointness, caps and exact counts are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, identity: str | Column, purpose: str) -> Column:
    """Hex string to order by."""
    identity = F.col(identity) if isinstance(identity, str) else identity
    return F.md5(F.concat(F.lit(f"{seed}:"), identity.cast("string"), F.lit(f":{purpose}")))


def coin(seed: int | str, identity: str | Column, purpose: str) -> Column:
    """True for half of all rows."""
    return F.substring(draw(seed, identity, purpose), 1, 1) < "8"


def between(seed: int | str, identity: str | Column, purpose: str, low: int, high: int) -> Column:
    """A whole number from low to high, both included."""
    number = F.conv(F.substring(draw(seed, identity, purpose), 1, 8), 16, 10).cast("long")
    return (F.lit(low) + number % F.lit(high - low + 1)).cast("int")
