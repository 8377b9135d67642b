"""Deterministic pseudo-random order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(id_col: str = "pairID", seed: int = 42) -> Column:
    """Hex digest that orders rows at random, yet the same on every run and engine."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def digest_number(text: Column) -> Column:
    """First 32 bits of the md5 of text as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def digest_bucket(hex_key: Column, digits: int) -> Column:
    """Leading hex digits as a number: grows with the key."""
    return F.conv(F.substring(hex_key, 1, digits), 16, 10).cast("int")
