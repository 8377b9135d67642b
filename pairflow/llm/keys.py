"""Joins against a set of keys that is sent to every task only if it is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.workspace import materialize

# Keys of 8 bytes: some 50 MB as a hash table. Larger sets meet the rows in a shuffle join.
BROADCAST_KEYS = 1_000_000


def sized(df: DataFrame, name: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """df written once, with a broadcast hint if it has at most limit rows."""
    stored = materialize(df, name)
    return F.broadcast(stored) if stored.count() <= limit else stored


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose id is not among ids (one long column); a null id counts as a value."""
    dropped = sized(ids.toDF("_dropped_id").distinct(), "dropped")
    return docs.join(dropped, docs[id_col].cast("long").eqNullSafe(dropped["_dropped_id"]), "left_anti")
