"""The registered queries against SQL, and the pipeline on small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import connect, differences
from pairflow.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_one_query_per_operator():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    for sql in ORACLE.values():
        assert duckdb.extract_statements(sql)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLE[name]) == []


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        ids, kept = {r[0] for r in before.select("doc_id").collect()}, {r[0] for r in docs.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.7 * len(ids), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "benchmark leaks", "secrets", "encoding"]
    # Nothing is left of what the stages remove.
    from pairflow.llm import decontaminate, parity_join
    assert decontaminate.search(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert parity_join.join(docs).filter("doc_id <> component_id").count() == 0
