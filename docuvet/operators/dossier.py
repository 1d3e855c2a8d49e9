"""One nested case document per screened case, and its joins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.text import mask_sensitive_id
from docuvet.operators.mrz import mrz_applicable


def join_case(documents: DataFrame, faces: DataFrame, liveness: DataFrame) -> DataFrame:
    """Document results with face and liveness results where a case has them."""
    return documents.join(faces, "case_id", "left").join(liveness, "case_id", "left")


def join_document(fields: DataFrame, *results: DataFrame) -> DataFrame:
    """Results of several modules by document. All joins share one key, so one exchange per side serves them."""
    joined = fields
    for result in results:
        joined = joined.join(result, "doc_id", "left")
    return joined


def escalation_action(level: Column) -> Column:
    return F.when(level == "HIGH", fixed.ESCALATE).otherwise(fixed.MANUAL_REVIEW_REQUIRED)


def _default(name: str, value) -> Column:
    return F.coalesce(F.col(name), F.lit(value))


#: Texts of a dossier that nothing computes with; pass others to ``case_dossier``.
TEXTS = {
    "title": "Screening dossier", "notes": "Referred for review.", "engine": "docuvet",
    "portal_name": "", "portal_url": "", "portal_notice": "Prepared for review by authorised staff; nothing was submitted.",
}


def case_dossier(cases: DataFrame, texts: dict[str, str] = TEXTS) -> DataFrame:
    """Assemble the nested dossier from flat result columns; identifiers are masked. Columns that a case lacks are NULL."""
    words = TEXTS | texts
    types = dict(cases.dtypes)
    have = lambda name, kind: F.col(name) if name in types else F.lit(None).cast(kind)
    level = _default("risk_level", "SUSPICIOUS")
    regions = F.coalesce(F.col("suspicious_regions"), F.array().cast(types["suspicious_regions"]))
    mrz = _default("mrz_status", "NOT_APPLICABLE")
    barcode = _default("barcode_status", "NOT_FOUND")
    return cases.select(
        F.col("case_id").cast("string").alias("case_id"),
        F.lit(words["title"]).alias("report_title"),
        F.col("generated_timestamp"),
        F.struct(
            F.lit(words["portal_name"]).alias("name"), F.lit(words["portal_url"]).alias("official_url"),
            F.lit(fixed.SUBMISSION_STATUS).alias("submission_status"), F.lit(words["portal_notice"]).alias("submission_notice"),
        ).alias("submission_portal"),
        F.struct(
            _default("filename", "uploaded_document.jpg").alias("filename"), "size_bytes",
            F.col("evidence_sha256").alias("sha256_digest"),
            F.when(F.col("filename").rlike(r"(?i)\.jpe?g$"), "image/jpeg").otherwise("image/png").alias("mime_type"),
        ).alias("evidence_file"),
        F.struct(
            _default("final_decision", "SUSPICIOUS").alias("final_decision"), level.alias("risk_level"),
            F.coalesce("risk_score", "tampering_score").alias("composite_risk_score"), "tampering_score",
            escalation_action(level).alias("recommended_action"),
        ).alias("screening_verdict"),
        F.struct(F.col("gate_status").alias("status"), F.col("gate_issues").alias("issues"), F.col("gate_warnings").alias("warnings")).alias("quality_gate"),
        F.struct(
            F.lit(words["engine"]).alias("analysis_engine"), F.size(regions).alias("anomaly_zones_detected"),
            regions.alias("suspicious_regions"), F.col("reasons").alias("forensic_flags"),
        ).alias("forensic_tampering_findings"),
        F.struct(
            _default("is_readable", False).alias("is_readable"), F.coalesce(have("ocr_confidence", "double"), F.lit(0)).cast("double").alias("confidence_score"),
            _default("document_type", fixed.UNKNOWN).alias("document_type"),
            "name", "dob", mask_sensitive_id(F.col("doc_number")).alias("doc_number_masked"), "expiry_date", "address", "gender",
        ).alias("extracted_ocr_data"),
        F.struct(
            F.col("aadhaar_status").alias("status"), "masked_aadhaar", F.col("verhoeff_ok").alias("is_verhoeff_valid"),
            have("structure_checks", CHECKS).alias("checks"),
        ).alias("aadhaar_validation"),
        F.struct(
            (F.col("mrz_format") != "NONE").alias("mrz_detected"), mrz_applicable(_default("document_type", fixed.UNKNOWN)).alias("is_applicable"),
            mrz.alias("status"), _default("mrz_format", "NONE").alias("format"), (mrz != "FAILED").alias("checksums_passed"),
            F.col("mrz_checks").alias("checksum_details"),
        ).alias("mrz_validation_findings"),
        F.struct(
            (barcode != "NOT_FOUND").alias("detected"), barcode.alias("status"), _default("barcode_format", "NONE").alias("format"),
            barcode.alias("cross_match_verdict"), "comparisons",
        ).alias("barcode_qr_findings"),
        _default("analyst_notes", words["notes"]).alias("analyst_notes"),
    )


CHECKS = "array<struct<name:string,passed:boolean,details:string,severity:string>>"


def printed_reasons(reasons: Column, count: int = 5) -> Column:
    """The reasons that fit on the printed report."""
    return F.slice(reasons, 1, count)


def text_snippet(text: Column, length: int = 300) -> Column:
    return F.substring(text, 1, length)
