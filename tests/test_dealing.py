"""Costly rows of a file of one row group are worked on in many tasks, also without the local session's setting."""

import pytest
from pyspark.sql import functions as F

from docuvet.plans.derive import Inputs
from docuvet.sources.tables import REDEAL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def as_on_a_cluster(spark):
    before = spark.conf.get(REDEAL, "false")
    spark.conf.set(REDEAL, "false")
    yield spark
    spark.conf.set(REDEAL, before)


@pytest.mark.parametrize("name", ["id_docs", "mrz_parts", "document_metrics", "person_records"])
def test_costly_rows_are_spread(as_on_a_cluster, name):
    rows = getattr(Inputs(as_on_a_cluster, FOLDER), name)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == as_on_a_cluster.read.parquet(f"{FOLDER}/customer.parquet").count()
    assert max(sizes) < sum(sizes) / 4
