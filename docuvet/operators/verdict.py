"""Tampering score, hard failures, document verdict, reasons and audit signals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.numbers import clamp, dec, round1
from docuvet.params import TamperParams


def _share(metric: str, full: int, cap: int) -> Column:
    return F.least(dec(cap), dec(F.col(metric).cast("double") * cap / full))


def tampering_score(params: TamperParams = TamperParams()) -> Column:
    p = params
    total = _share("ela_std", p.ela_full, p.ela_cap) + _share("texture_std", p.texture_full, p.texture_cap) + _share(
        "edge_p95", p.edge_full, p.edge_cap
    )
    return clamp(F.round(total, 1), 0, 100).cast("decimal(9,1)")


def _failures() -> dict[str, Column]:
    false = F.lit(False)
    return {
        "VERHOEFF_CHECKSUM_FAILED": F.coalesce(~F.col("verhoeff_ok"), false),
        "PAN_FORMAT_INVALID": F.coalesce(F.col("document_type").contains("PAN"), false) & F.col("pan_number").isNull(),
        "MRZ_CHECKSUM_FAILED": F.coalesce(F.col("mrz_status") == "FAILED", false),
        "BARCODE_MISMATCH": F.coalesce(F.col("barcode_status") == "MISMATCH", false),
    }


def _successes() -> dict[str, Column]:
    false = F.lit(False)
    return {
        "VERHOEFF_CHECKSUM_VALID": F.coalesce(F.col("verhoeff_ok"), false),
        "PAN_FORMAT_VALID": F.col("pan_number").isNotNull(),
        "MRZ_CHECKSUMS_PASSED": F.coalesce(F.col("mrz_status") == "VERIFIED", false),
        "BARCODE_MATCHES": F.coalesce(F.col("barcode_status") == "MATCH", false),
    }


def _codes(signals: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, code) for code, hit in signals.items()]))


REGION_TYPE = (
    "array<struct<id:string,title:string,reason:string,severity:string,type:string,"
    "bounding_box:struct<x:double,y:double,width:double,height:double>>>"
)


def failed_region() -> Column:
    """The one region that a failed check marks, with the first failure as its reason."""
    box = F.struct(*[F.lit(float(v)).alias(k) for k, v in fixed.FAILED_REGION_BOX.items()])
    texts = {k: F.lit(v) for k, v in fixed.FAILED_REGION.items()}
    return F.struct(
        texts["id"].alias("id"), texts["title"].alias("title"), F.get("fail_signals", 0).alias("reason"), texts["severity"].alias("severity"),
        texts["type"].alias("type"), box.alias("bounding_box"),
    )


def with_verdict(docs: DataFrame, params: TamperParams = TamperParams()) -> DataFrame:
    """Add the document verdict to a table of gate, number, zone and barcode results.

    Image signals alone never make a document high risk; that takes a failed check.
    """
    df = docs.withColumns(
        {
            "raw_tampering": tampering_score(params), "fail_signals": _codes(_failures()),
            "success_signals": _codes(_successes()), "recapture": F.col("gate_status") == "RECAPTURE_REQUIRED",
        }
    )
    t, hard, again = F.col("raw_tampering"), F.size("fail_signals") > 0, F.col("recapture")
    conf = F.coalesce("ocr_confidence", dec(85, 9, 1))
    unclear = (conf < 45) | (F.coalesce("has_ocr_warning", F.lit(False)) & (conf < 60))
    tenth = lambda share: dec(t * dec(share, 3, 2))
    return df.withColumns(
        {
            "suspicion_count": F.when(again, 0).otherwise(F.size("fail_signals") * 2),
            "document_decision": F.when(again, "RECAPTURE REQUIRED").when(hard, "HIGH RISK")
            .when(unclear, "REVIEW REQUIRED").otherwise("VERIFIED"),
            "document_level": F.when(again, "NEUTRAL").when(hard, "HIGH").when(unclear, "MEDIUM").otherwise("LOW"),
            "document_score": F.when(again, dec(15, 9, 1))
            .when(hard, round1(clamp(tenth("0.2") + dec(75), 75, 98)))
            .when(unclear, round1(clamp(tenth("0.5") + dec(20), 25, 48)))
            .otherwise(round1(clamp(tenth("0.1"), 1, 8))),
            "tampering_score": F.when(again, dec(0, 9, 1)).when(hard, t).otherwise(round1(tenth("0.3"))),
            "suspicious_regions": F.when(hard & ~again, F.array(failed_region())).otherwise(F.array().cast(REGION_TYPE)),
        }
    )


def document_reasons() -> Column:
    """Ordered reasons: quality alerts, or the source followed by failures or successes."""
    alerts = F.concat(
        F.transform("gate_issues", lambda i: F.concat(F.lit("QUALITY ALERT: "), i)),
        F.transform("gate_warnings", lambda w: F.concat(F.lit("QUALITY NOTE: "), w)),
    )
    way = F.when(F.col("is_digital"), "digital").otherwise("optical")
    source = F.array(F.concat(F.lit("SOURCE: "), F.col("source_display"), F.lit(" ("), way, F.lit(")")))
    number = F.when(F.col("doc_number").isNotNull(), "NUMBER_EXTRACTED").when(F.col("name").isNotNull(), "NAME_EXTRACTED")
    good = F.concat("success_signals", F.array_compact(F.array(number)), F.array(F.lit("CONSISTENT_COMPRESSION")))
    findings = F.when(F.size("fail_signals") > 0, F.col("fail_signals")).otherwise(good)
    return F.when(F.col("recapture"), alerts).otherwise(F.concat(source, findings))


def evidence_signals() -> Column:
    """Nine audit values as text."""
    na = F.lit("N/A")
    values = {
        "document_source": F.col("source_display"),
        "quality_gate": F.col("gate_status"),
        "camera_glare": F.when(F.col("is_digital"), "NOT_APPLICABLE").otherwise(
            F.concat(F.round(F.col("glare_ratio") * 100, 1).cast("decimal(9,1)").cast("string"), F.lit("%"))
        ),
        "tampering_variance": F.concat(F.round("ela_std", 1).cast("decimal(9,1)").cast("string"), F.lit(" std dev")),
        "checksum_verhoeff": F.when(F.col("verhoeff_ok").isNull(), na).when(F.col("verhoeff_ok"), "VALID").otherwise("FAILED"),
        "pan_status": F.when(F.col("pan_number").isNotNull(), "VALID").otherwise(na),
        "mrz_status": F.coalesce("mrz_status", na),
        "barcode_status": F.coalesce("barcode_status", na),
        "ocr_confidence": F.concat(F.coalesce("ocr_confidence", dec(85, 9, 1)).cast("decimal(9,1)").cast("string"), F.lit("%")),
    }
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def with_verdict_v1(docs: DataFrame, params: TamperParams) -> DataFrame:
    """Earlier verdict: weighted tampering, consistency, reading and blur shares."""
    barcode = F.col("barcode_status")
    consistency = F.when(F.col("mrz_status") == "FAILED", 55).otherwise(0) + F.when(barcode == "MISMATCH", 50).when(
        barcode == "INVALID", 25
    ).otherwise(0)
    df = docs.withColumns({"tampering_v1": tampering_score(params), "consistency_v1": consistency})
    t, c = F.col("tampering_v1"), F.col("consistency_v1")
    unread = F.greatest(dec(0, 9, 1), dec(100, 9, 1) - F.coalesce("ocr_confidence", dec(80, 9, 1)))
    blurry = F.when(F.col("is_blurry"), dec(3)).otherwise(dec(0))
    total = dec(t * dec("0.40", 3, 2)) + dec(F.least(F.lit(100), c) * dec("0.35", 3, 2)) + dec(unread * dec("0.15", 3, 2)) + blurry
    df = df.withColumn("score_v1", round1(clamp(F.round(total, 1), 0, 100)))
    s = F.col("score_v1")
    high, medium = (s >= 65) | (t >= 70) | (c >= 50), (s >= 30) | (t >= 35)
    return df.withColumns(
        {
            "decision_v1": F.when(high, "HIGH RISK").when(medium, "SUSPICIOUS").otherwise("VERIFIED"),
            "level_v1": F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"),
        }
    )


def analysis_methods() -> Column:
    """Five pass or fail rows per document."""
    checksum = F.coalesce(F.col("verhoeff_ok"), F.col("mrz_status") != "FAILED", F.lit(True))
    rows = (
        ("Document Quality Gate", F.coalesce(F.col("gate_status") == "PASSED", F.lit(True))),
        ("Document Authenticity (ELA)", F.col("tampering_score") < 50),
        ("Text & Identity Parser", F.coalesce("is_readable", F.lit(False))),
        ("Number / MRZ Checksums", checksum),
        ("2D Barcode & QR Scanner", F.coalesce(F.col("barcode_status") != "MISMATCH", F.lit(True))),
    )
    return F.array(*[F.struct(F.lit(name).alias("method"), ok.alias("passed")) for name, ok in rows])
