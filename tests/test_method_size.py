"""Generated methods stay within 8,000 bytes under Spark's own settings: the JVM interprets larger ones and never compiles them."""

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from docuvet.operators import quality

FOLDER = "/root/testdata/sf0.001"
LIMIT = 8000


def largest_method(df):
    """Bytes of the largest method that Spark generates for a query."""
    debug = df.sparkSession._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


@pytest.fixture
def as_given(spark):
    """Spark's default for huge methods, and plans that are whole before they run."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.codegen.hugeMethodLimit", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for key, value in kept.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("name", ["evidence_signals", "number_verdicts", "ocr_quality", "structure_checks"])
def test_methods_can_be_compiled(as_given, name):
    assert 0 < largest_method(__spark_entry__.queries()[name](as_given, FOLDER)) < LIMIT


def test_sources_of_odd_images(spark):
    rows = [(None, None, None, None, None, None), ("A.PDF", "", None, 100, 200, False), ("x.png", "My Screen", True, 9, 9, True),
            ("x.png", "HP scan", False, 5, 5, None), ("x.png", None, "", 175, 100, False), ("x.png", None, "", 157, 100, False), ("x.png", "", "", 0, 0, True)]
    columns = "filename string, software string, mime_type string, width int, height int, has_camera_exif boolean"
    images = spark.createDataFrame([(r[0], r[1], "" if r[2] is None else str(r[2]), *r[3:]) for r in rows], columns).withColumns(
        {"white_ratio": F.lit("0.31").cast("decimal(9,2)"), "white_std": F.lit("1.1").cast("decimal(9,1)"),
         "color_sparsity": F.lit("0.5").cast("decimal(9,2)"), "p99_gradient": F.lit("1").cast("decimal(9,1)")})
    found = quality.with_source(images)
    assert not [c for c in found.columns if c.startswith("_")]
    assert [r["source_type"] for r in found.collect()] == [
        "PHYSICAL_CAPTURE", "DIGITAL_PDF", "SCREENSHOT", "SCANNED_DOCUMENT", "SCREENSHOT", "PHYSICAL_CAPTURE", "PHYSICAL_CAPTURE"]
