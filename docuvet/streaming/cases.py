"""Cases decided when their last part arrives: document, face and liveness results as three streams."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet.operators import risk

#: How long after the document result a case waits for the others (and how much earlier they may be), and how late rows may come.
WAIT, LATE = "10 minutes", "1 minute"


def _side(results: DataFrame, at: str, late: str, once: bool, name: str) -> DataFrame:
    """One stream of results with its watermark, each case's first result only, and its key under a name of its own."""
    timed = results.withWatermark(at, late)
    first = timed.dropDuplicatesWithinWatermark(["case_id"]) if once else timed
    return first.withColumnRenamed("case_id", name)


def _together(case: str, at: str, wait: str) -> Column:
    return F.expr(f"case_id = {case} AND {at} >= screened_at - INTERVAL {wait} AND {at} <= screened_at + INTERVAL {wait}")


def join_case_stream(
    documents: DataFrame, faces: DataFrame, liveness: DataFrame, wait: str = WAIT, late: str = LATE, once: bool = True
) -> DataFrame:
    """Document results with the face and liveness results of their case, where those arrive in time.

    ``documents`` has case_id and screened_at, ``faces`` case_id and compared_at, ``liveness`` case_id and checked_at (timestamps).
    Two left outer joins on the case and the interval of ``wait`` around the document result: a case goes out as soon as both
    others are there, and without them once the watermarks show that they cannot come in time any more. Until then, and no
    longer, each side's rows are state. ``once`` drops results that a source delivers again within ``late``. A row without
    case or time joins nothing; a document result without a time is dropped with the late ones.
    """
    left = documents.withWatermark("screened_at", late)
    left = left.dropDuplicatesWithinWatermark(["case_id"]) if once else left
    with_face = left.join(_side(faces, "compared_at", late, once, "_face_case"), _together("_face_case", "compared_at", wait), "leftOuter")
    # One event time goes on; two would leave the next join without a watermark of its own.
    with_face = with_face.drop("_face_case", "compared_at")
    both = with_face.join(_side(liveness, "checked_at", late, once, "_live_case"), _together("_live_case", "checked_at", wait), "leftOuter")
    return both.drop("_live_case", "checked_at")


def decide_case_stream(documents: DataFrame, faces: DataFrame, liveness: DataFrame, wait: str = WAIT, late: str = LATE, once: bool = True) -> DataFrame:
    """Decisions of a stream of cases, as ``decide_cases`` gives them for a batch: a missing side takes its default."""
    cases = join_case_stream(documents, faces, liveness, wait, late, once)
    if "document_score" in cases.columns:
        cases = cases.withColumn("composite_risk_score", F.col("document_score"))
    return risk.with_risk(cases)
