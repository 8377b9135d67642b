"""Findings of the fourth review on stored files."""

import os

from pyspark.sql import functions as F

from pairflow import domain
from pairflow.catalog import QUERIES
from pairflow.sources import fixtures as FX
from pairflow.sources import readers, writers
from pairflow.workspace import scratch_path


def test_prediction_files_are_a_few_times_the_documents(spark, sf):
    """Three strategies repeat both texts of every pair; as plain CSV that is some 15 times the documents."""
    rows = QUERIES["src5_read_predictions_csv"](spark, sf)
    stored = sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in rows.inputFiles())
    assert 0 < stored < 4 * os.path.getsize(f"{sf}/documents.parquet")
    expected = FX.predictions(spark, sf, ["zero-shot", "few-shot", "cot"]).select(rows.columns)
    assert rows.exceptAll(expected).count() == 0 and rows.count() == expected.count()


def test_compressed_csv_is_read_by_several_tasks(spark, monkeypatch):
    """No two tasks share a compressed file, so that a single writer's rows must lie in several."""
    rows = [(f"p{i}", 'a\nb "c", \\n \r\\ \x00', "" if i % 2 else None, "g", "neutral") for i in range(1000)]
    df = spark.createDataFrame(rows, readers.PAIR_SCHEMA).withColumn("strategy", F.lit(domain.STRATEGIES[0]))
    path = scratch_path(spark, "csv-compressed")
    monkeypatch.setattr(writers, "CSV_FILE_ROWS", 100)
    writers.write_csv(df.coalesce(1), path, "strategy", compressed=True)
    back = readers.read_predictions_csv(spark, path, schema=readers.PAIR_SCHEMA)
    files = back.inputFiles()
    assert len(files) == 10 and all(f.endswith(".csv.gz") for f in files)
    assert back.exceptAll(df).count() == 0 and back.count() == 1000
