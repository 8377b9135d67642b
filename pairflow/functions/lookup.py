"""Dictionary lookups as column expressions (no join needed for driver-supplied constants)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column | str, mapping: dict, default=None, dtype: str | None = None) -> Column:
    """mapping[key], or default where the key is absent or null."""
    key = F.col(key) if isinstance(key, str) else key
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    if default is not None:
        found = F.coalesce(found, F.lit(default))
    return found.cast(dtype) if dtype else found


def any_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
