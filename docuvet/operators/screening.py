"""The whole screening of a batch: from lines, barcodes and metrics to decisions and dossiers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuvet.functions.stages import compute_once
from docuvet.operators import barcodes, dossier, mrz, quality, risk, validation, verdict
from docuvet.operators.fields import extract_fields


def screen_documents(docs: DataFrame, codes: DataFrame, metrics: DataFrame, statistics: DataFrame, compat: bool = False) -> DataFrame:
    """Document stage: fields, number rules, zone, barcode, gate and verdict by ``doc_id``.

    ``docs`` has ``doc_id`` and ``lines``; ``codes`` the decoded barcodes; ``metrics`` one row of
    image metrics per document; ``statistics`` its reading statistics. All joins share the key.
    """
    read = validation.validate_numbers(extract_fields(docs, compat))
    read = validation.with_reading_quality(mrz.with_mrz(read, compat), statistics)
    coded = barcodes.with_barcodes(read, codes)
    joined = dossier.join_document(coded, metrics)
    gate = quality.quality_gate(quality.refine_source(quality.with_source(joined)))
    judged = verdict.with_verdict(
        gate.withColumns({"ocr_confidence": F.col("confidence"), "has_ocr_warning": F.col("ocr_warning").isNotNull()})
    )
    return compute_once(judged.withColumn("reasons", verdict.document_reasons()))


def decide_cases(documents: DataFrame, faces: DataFrame, liveness: DataFrame) -> DataFrame:
    """Case stage: join face and liveness results and fuse everything into a decision."""
    cases = dossier.join_case(documents, faces, liveness)
    return risk.with_risk(cases.withColumn("composite_risk_score", F.col("document_score")))
