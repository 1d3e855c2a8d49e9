"""The query over the stream of cases: slices of time in order, state of two of them, the same rows."""

import pathlib

import pytest
from harness import compare, connect
from pyspark.sql import functions as F

import __spark_entry__
from docuvet.plans import stream_queries
from docuvet.plans.derive import Inputs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(stream_queries, "SLICE_ROWS", 500)


def test_files_are_in_the_order_of_time(spark, tmp_path, small_slices):
    rows = Inputs(spark, FOLDER).case_face_results
    bounds = stream_queries.slice_bounds(Inputs(spark, FOLDER).case_documents, "screened_at")
    assert len(bounds) == 2
    # A slice without rows is a file too.
    stream_queries.as_stream(rows, str(tmp_path / "rows"), "compared_at", -1, [*bounds, 4e9])
    files = sorted((tmp_path / "rows").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == 5
    spans = [spark.read.parquet(str(f)).agg(F.min("compared_at"), F.max("compared_at"), F.count("*")).first() for f in files]
    assert spans[3][2] == 0 and spans[4][2] == 1 and sum(s[2] for s in spans) == rows.count() + 1
    assert spans[0][1] < spans[1][0] and spans[1][1] < spans[2][0] < spans[2][1] < spans[4][0]


def test_slices_give_the_same_rows(spark, small_slices, monkeypatch):
    batches = []
    real = stream_queries.to_the_end

    def counted(stream, path):
        out = real(stream, path)
        batches.extend(pathlib.Path(path, "state", "commits").glob("[0-9]*"))
        return out

    monkeypatch.setattr(stream_queries, "to_the_end", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    difference, _ = compare(spark, connect(FOLDER), __spark_entry__.queries()["case_stream"], __spark_entry__.oracle_sql()["case_stream"], FOLDER)
    assert difference == "" and len(batches) >= 4
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
