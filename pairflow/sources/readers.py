"""Readers for pair tables and stored predictions. All take explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairflow.sources.writers import many_lines
from pairflow.functions.text import decode_label

RAW_PAIR_SCHEMA = T.StructType([
    T.StructField("pairID", T.StringType()),
    T.StructField("premise", T.StringType()),
    T.StructField("hypothesis", T.StringType()),
    T.StructField("genre", T.StringType()),
    T.StructField("label_id", T.IntegerType()),
])
PAIR_SCHEMA = T.StructType([
    T.StructField("pairID", T.StringType()),
    T.StructField("premise", T.StringType()),
    T.StructField("hypothesis", T.StringType()),
    T.StructField("genre", T.StringType()),
    T.StructField("label", T.StringType()),
])
RESULT_FIELDS = [
    T.StructField("raw_response", T.StringType()),
    T.StructField("predicted_label", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("response_tokens", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
]
PREDICTION_SCHEMA = T.StructType(PAIR_SCHEMA.fields + RESULT_FIELDS)

CSV_OPTIONS = {
    "header": "true", "escape": '"', "quote": '"', "emptyValue": "", "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_split(spark: SparkSession, path: str, schema: T.StructType = RAW_PAIR_SCHEMA) -> DataFrame:
    """One stored split; a raw split gets its label decoded."""
    df = spark.read.schema(schema).parquet(path)
    return with_label(df) if "label_id" in df.columns else df


def with_label(df: DataFrame, id_col: str = "label_id") -> DataFrame:
    return df.withColumn("label", decode_label(id_col))


def content_id(*cols: str) -> Column:
    """Key made of the row's own content: the same wherever and whenever the row is read."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.md5(F.concat_ws("\u001f", *parts))


def with_content_id(df: DataFrame, *cols: str, output: str = "pairID") -> DataFrame:
    return df.withColumn(output, content_id(*(cols or ("premise", "hypothesis", "genre"))))


def with_position_id(df: DataFrame, output: str = "pairID") -> DataFrame:
    """Key made of file and row position: unique even for exact copies (Parquet sources only)."""
    return df.withColumn(output, F.concat_ws(
        "-", F.md5(F.col("_metadata.file_path")), F.col("_metadata.row_index").cast("string")))


def read_validation(spark: SparkSession, matched: str, mismatched: str,
                    schema: T.StructType = RAW_PAIR_SCHEMA) -> DataFrame:
    """Both validation splits in one table, with the split named in `source`."""
    return combine_validation(read_split(spark, matched, schema), read_split(spark, mismatched, schema))


def combine_validation(matched: DataFrame, mismatched: DataFrame) -> DataFrame:
    return matched.withColumn("source", F.lit("matched")).unionByName(
        mismatched.withColumn("source", F.lit("mismatched")))


def read_pairs_csv(spark: SparkSession, path: str, schema: T.StructType = PAIR_SCHEMA, foreign: bool = False) -> DataFrame:
    """Pairs of write_csv, whose files any number of tasks can share if they aren't compressed. foreign: files with line
    breaks inside values, which are one task each."""
    rows = spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=foreign).csv(path)
    return rows if foreign else many_lines(rows)


def read_predictions_csv(spark: SparkSession, root: str, strategies: list[str] | None = None,
                         schema: T.StructType = PREDICTION_SCHEMA, foreign: bool = False) -> DataFrame:
    """Predictions stored as <root>/strategy=<name>/*.csv or *.csv.gz; a strategy without files yields no rows.

    The strategy comes from the folder, so choosing strategies prunes files before any is opened.
    """
    full = T.StructType(schema.fields + [T.StructField("strategy", T.StringType())])
    df = spark.read.schema(full).options(**CSV_OPTIONS, multiLine=foreign).csv(root)
    df = df if foreign else many_lines(df)
    return df.where(F.col("strategy").isin(strategies)) if strategies else df


def read_predictions(spark: SparkSession, root: str, strategies: list[str] | None = None) -> DataFrame:
    """As read_predictions_csv for the Parquet layout."""
    df = spark.read.parquet(root)
    return df.where(F.col("strategy").isin(strategies)) if strategies else df


def harmonise(df: DataFrame) -> DataFrame:
    """Bring prediction tables with other column names to `label` and `predicted_label`."""
    if "label" not in df.columns and "true_label" in df.columns:
        df = df.withColumnRenamed("true_label", "label")
    if "predicted_label" not in df.columns and "bert_prediction" in df.columns:
        df = df.withColumnRenamed("bert_prediction", "predicted_label")
    return df


def union_sources(sources: dict[str, DataFrame], name_col: str = "strategy") -> DataFrame:
    """One long table from differently shaped prediction tables."""
    out = None
    for name, df in sources.items():
        part = harmonise(df).withColumn(name_col, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
