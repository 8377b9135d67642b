"""Sinks. Every write names its mode and layout; nothing passes through the driver."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {
    "header": "true", "escape": '"', "quote": '"', "emptyValue": '""', "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Full, train and test rows as one table partitioned by split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


# Characters a line of CSV can't hold, and the letters that stand for them behind a backslash.
_ESCAPES = {"\n": "n", "\r": "r", "\x00": "0"}


def one_line(df: DataFrame) -> DataFrame:
    """Line breaks and NUL in strings as \\n, \\r and \\0, backslashes doubled, so that a CSV file can be split anywhere."""
    def escaped(c: str) -> Column:
        text = F.replace(F.col(f"`{c}`"), F.lit("\\"), F.lit("\\\\"))
        for char, letter in _ESCAPES.items():
            text = F.replace(text, F.lit(char), F.lit("\\" + letter))
        return text.alias(c)
    return df.select(*[escaped(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def many_lines(df: DataFrame) -> DataFrame:
    """The reverse of one_line, for every string."""
    def part(text: Column) -> Column:
        for char, letter in _ESCAPES.items():
            text = F.replace(text, F.lit("\\" + letter), F.lit(char))
        return text

    def plain(c: str) -> Column:
        # Between doubled backslashes, taken from the left, any other backslash belongs to the letter behind it. Most texts have none.
        text = F.col(f"`{c}`")
        whole = F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")
        return F.when(text.contains("\\"), whole).otherwise(text).alias(c)
    return df.select(*[plain(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


# JSON files are compressed, which no two tasks can share; so they end after this many rows.
FILE_ROWS = 1_000_000
TEXT_OPTIONS = {"compression": "gzip", "maxRecordsPerFile": str(FILE_ROWS)}
# As FILE_ROWS, for CSV, whose rows hold whole texts.
CSV_FILE_ROWS = 250_000
# A task keeps a file open for each of so many partition values; Spark sorts only the rows of any beyond.
_OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "16", "spark.sql.optimizer.plannedWrite.enabled": "false"}


@contextlib.contextmanager
def unsorted_partitions(spark: SparkSession) -> Iterator[None]:
    """Writes inside do not sort whole rows by their partition value first, which spills them once more."""
    before = {k: spark.conf.get(k, None) for k in _OPEN_FILES}
    try:
        for k, v in _OPEN_FILES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_csv(df: DataFrame, path: str, *partition_by: str, compressed: bool = False) -> None:
    """CSV with one line per row (see one_line). Tasks can share a file; a compressed one they can't, so that it ends
    after CSV_FILE_ROWS rows."""
    writer = one_line(df).write.mode("overwrite").options(**CSV_OPTIONS)
    if compressed:
        writer = writer.options(compression="gzip", maxRecordsPerFile=str(CSV_FILE_ROWS))
    with unsorted_partitions(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_json(df: DataFrame, path: str, *partition_by: str) -> None:
    """Compressed JSON lines."""
    writer = df.write.mode("overwrite").options(**TEXT_OPTIONS)
    with unsorted_partitions(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Scoring is the costly step, so its result is stored once and read back by the evaluation."""
    df.write.mode("overwrite").partitionBy("strategy").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "pairID") -> None:
    """Bucketed table at path: later joins and groupings on the key need no shuffle."""
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).format("parquet").saveAsTable(table))


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row report as a single JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def append_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("strategy").parquet(path)


def in_display_order(df: DataFrame, key: str = "pairID") -> DataFrame:
    """Total order by key, for sinks that are read by people."""
    return df.orderBy(F.col(key))
