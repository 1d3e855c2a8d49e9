"""Weighted risk fusion, decisions, numbered reasons and the five-part breakdown."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.numbers import clamp, dec, round1
from docuvet.params import RiskParams


def _verhoeff_failed() -> Column:
    """``verhoeff_ok`` is NULL for documents that carry no Verhoeff number."""
    return F.coalesce(~F.col("verhoeff_ok"), F.lit(False))


def _is(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


def _column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def consistency_risk() -> Column:
    unreadable = ~F.coalesce(F.col("is_readable"), F.lit(True))
    return F.greatest(
        dec(2),
        F.when(_verhoeff_failed(), dec(90)),
        F.when(_is("mrz_status", "FAILED"), dec(85)).when(_is("barcode_status", "MISMATCH"), dec(80)),
        F.when(unreadable, dec(40)),
    )


def face_failed() -> Column:
    return F.coalesce((F.col("face_status") == "FAILED") | (F.col("similarity") < 70), F.lit(False))


def face_risk() -> Column:
    gap = dec(100) - F.col("similarity")
    scored = F.when(face_failed(), F.greatest(dec(75), dec(gap))).otherwise(F.greatest(dec(2), dec(gap * dec("0.8", 2, 1))))
    return F.when(F.col("has_face"), clamp(scored, 0, 100)).otherwise(dec(5))


def liveness_failed(compat: bool = False) -> Column:
    """``compat`` lets an unset ``all_passed`` override a failed ``passed``."""
    passed, every = F.col("liveness_passed"), F.col("liveness_all_passed")
    if compat:
        ok = F.coalesce(passed, F.lit(True)) | F.coalesce(every, F.lit(True))
    else:
        ok = F.coalesce(passed, every, F.lit(True))
    return F.col("has_liveness") & ~ok


def with_signals(df: DataFrame) -> DataFrame:
    """Complete a signal table with the defaults used where a module gave no result."""
    face_status = _column_or_null(df, "face_status", "string")
    similarity = _column_or_null(df, "similarity", "decimal(9,1)")
    passed = _column_or_null(df, "liveness_passed", "boolean")
    every = _column_or_null(df, "liveness_all_passed", "boolean")
    tamper = F.coalesce(dec(F.col("tampering_score"), 9, 1), dec(10, 9, 1))
    return df.withColumns(
        {
            "has_face": face_status.isNotNull() | similarity.isNotNull(),
            "has_liveness": passed.isNotNull() | every.isNotNull(),
            "face_status": F.coalesce(face_status, F.lit("PASSED")),
            "similarity": F.coalesce(similarity, dec(95, 9, 1)),
            "liveness_passed": passed,
            "liveness_all_passed": every,
            "tampering_score": tamper,
            "composite_risk_score": F.coalesce(_column_or_null(df, "composite_risk_score", "decimal(9,1)"), tamper),
        }
    )


def with_risk(signals: DataFrame, params: RiskParams = RiskParams(), compat: bool = False) -> DataFrame:
    """Add sub-scores, composite score, level, action and decision to a signal table."""
    scored = with_signals(signals).withColumns(
        {
            "consistency_risk": consistency_risk(),
            "checksum_failed": _verhoeff_failed() | _is("mrz_status", "FAILED") | _is("barcode_status", "MISMATCH"),
            "face_risk": face_risk(),
            "face_failed": F.col("has_face") & face_failed(),
            "liveness_failed": liveness_failed(compat),
        }
    )
    any_failed = F.col("checksum_failed") | F.col("face_failed") | F.col("liveness_failed")
    scored = scored.withColumns(
        {
            "liveness_risk": F.when(~F.col("has_liveness"), dec(3)).when(F.col("liveness_failed"), dec(88)).otherwise(dec("2.5")),
            "any_failed": any_failed,
            "document_risk": F.when(
                ~any_failed & (F.col("tampering_score") < 65), dec(F.col("tampering_score") * dec("0.5", 2, 1))
            ).otherwise(dec(F.col("composite_risk_score"))),
        }
    )
    total = (
        F.col("document_risk") * dec(params.document_weight, 3, 2)
        + F.col("consistency_risk") * dec(params.consistency_weight, 3, 2)
        + F.col("face_risk") * dec(params.face_weight, 3, 2)
        + F.col("liveness_risk") * dec(params.liveness_weight, 3, 2)
    )
    recapture = F.coalesce(F.col("recapture"), F.lit(False))
    scored = scored.withColumns(
        {
            "recapture": recapture,
            "risk_score": F.when(recapture, dec(15, 9, 1)).otherwise(round1(clamp(total, 2, "99.5"))),
        }
    )
    return scored.withColumn(
        "risk_level",
        F.when(F.col("recapture"), "LOW")
        .when(F.col("any_failed") | (F.col("risk_score") > params.suspicious_max), "HIGH")
        .when(F.col("risk_score") > params.verified_max, "MEDIUM")
        .otherwise("LOW"),
    ).withColumns(
        {
            "final_decision": F.when(F.col("recapture"), "RECAPTURE REQUIRED").otherwise(decision_of(F.col("risk_level"))),
            "recommended_action": F.when(F.col("recapture"), "MANUAL_REVIEW").otherwise(action_of(F.col("risk_level"))),
        }
    )


def decision_of(level: Column) -> Column:
    return F.when(level == "HIGH", "HIGH RISK").when(level == "MEDIUM", "SUSPICIOUS").otherwise("VERIFIED")


def action_of(level: Column) -> Column:
    return F.when(level == "HIGH", "REJECT").when(level == "MEDIUM", "MANUAL_REVIEW").otherwise("PASS")


def _reason(condition: Column, key: str, category: str, severity, impact, weight: int, module: str) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(
        condition,
        F.struct(
            F.lit(fixed.RISK_REASON_TITLES[key]).alias("title"),
            F.lit(category).alias("category"),
            severity.alias("severity"),
            round1(impact).alias("impact_score"),
            F.lit(weight).alias("weight"),
            F.lit(module).alias("source_module"),
        ),
    )


def risk_reasons() -> Column:
    """Reasons in fixed order, numbered R-1 onwards; needs the columns of ``with_risk``."""
    surface_severity = F.when(F.col("checksum_failed"), "HIGH").otherwise("MEDIUM")
    found = F.array_compact(
        F.array(
            _reason(_verhoeff_failed(), "verhoeff", "DOCUMENT", "HIGH", dec(90), 35, "CHECKSUM"),
            _reason(_is("mrz_status", "FAILED"), "mrz", "MRZ", "HIGH", dec(85), 30, "MRZ"),
            _reason(_is("barcode_status", "MISMATCH"), "barcode", "BARCODE", "HIGH", dec(80), 25, "BARCODE"),
            _reason(F.col("tampering_score") > 55, "surface", "DOCUMENT", surface_severity, F.col("tampering_score"), 35, "ELA"),
            _reason(F.col("face_risk") > 35, "face", "FACE", "HIGH", F.col("face_risk"), 30, "FACE"),
            _reason(F.col("liveness_risk") > 50, "liveness", "LIVENESS", "HIGH", dec(88), 20, "LIVENESS"),
        )
    )
    always = F.lit(True)
    passed = F.array(_reason(always, "passed", "DOCUMENT", "LOW", dec(-85), 100, "RISK"))
    recapture = F.array(_reason(always, "recapture", "QUALITY", "HIGH", dec(50), 100, "QUALITY"))
    chosen = F.when(F.col("recapture"), recapture).when(F.size(found) == 0, passed).otherwise(found)
    number = F.when(F.col("recapture"), "R-QG")
    return F.transform(
        chosen,
        lambda reason, i: F.struct(
            F.coalesce(number, F.concat(F.lit("R-"), (i + 1).cast("string"))).alias("id"),
            *[reason[f].alias(f) for f in ("title", "category", "severity", "impact_score", "weight", "source_module")],
        ),
    )


def _level(score: Column, medium: bool = True) -> Column:
    level = F.when(score > 50, "HIGH")
    return (level.when(score > 25, "MEDIUM") if medium else level).otherwise("LOW")


def risk_breakdown() -> Column:
    """Array of the five sub-scores; needs the columns of ``with_risk``."""

    def part(key, score, weight, medium=True, when_recaptured=0, recaptured_level="LOW"):
        value = F.when(F.col("recapture"), dec(when_recaptured)).otherwise(dec(score))
        level = F.when(F.col("recapture"), recaptured_level).otherwise(_level(score, medium))
        return F.struct(
            F.lit(key).alias("part"), F.lit(fixed.BREAKDOWN_NAMES[key]).alias("name"),
            round1(value).alias("score"), level.alias("level"), F.lit(weight).alias("weight"),
        )

    return F.array(
        part("tamper", F.col("document_risk"), 35),
        part("consistency", F.col("consistency_risk"), 25),
        part("face", F.col("face_risk"), 25),
        part("liveness", F.col("liveness_risk"), 15, medium=False),
        part("quality", dec(5), 0, when_recaptured=85, recaptured_level="HIGH"),
    )


def with_fallback_risk(signals: DataFrame) -> DataFrame:
    """Three-part score used where the full engine is out of reach; cut-offs 28 and 55."""
    df = with_signals(signals)
    tamper = F.when(F.col("tampering_score") == 0, dec(10)).otherwise(dec(F.col("tampering_score")))
    similarity = F.when(F.col("similarity") == 0, dec(95)).otherwise(dec(F.col("similarity")))
    face = F.when(F.col("has_face") & (F.col("face_status") == "FAILED"), dec(85)).otherwise(
        F.greatest(dec(0), dec(dec(100) - similarity))
    )
    live = F.when(F.coalesce(F.col("liveness_passed"), F.lit(False)), dec(0)).otherwise(dec(85))
    total = tamper * dec("0.35", 3, 2) + face * dec("0.25", 3, 2) + live * dec("0.15", 3, 2)
    return (
        df.withColumn("fallback_total", dec(total))
        .withColumn(
            "fallback_level",
            F.when(F.col("fallback_total") > 55, "HIGH").when(F.col("fallback_total") > 28, "MEDIUM").otherwise("LOW"),
        )
        .withColumns(
            {
                "fallback_score": round1(F.col("fallback_total")),
                "fallback_decision": decision_of(F.col("fallback_level")),
                "fallback_action": action_of(F.col("fallback_level")),
            }
        )
    )


def with_workflow_verdict(stages: DataFrame) -> DataFrame:
    """Overall verdict and next action from the states of the three screening stages."""
    doc, live, face = F.col("document_state"), F.col("liveness_state"), F.col("face_state")
    done = (doc == "PASSED") & (live == "PASSED") & (face == "PASSED")
    return stages.withColumns(
        {
            "workflow_decision": F.when(doc == "RECAPTURE_REQUIRED", "RECAPTURE REQUIRED")
            .when((doc == "FAILED") | (face == "FAILED"), "HIGH RISK")
            .when(live == "FAILED", "SUSPICIOUS")
            .when(done, "VERIFIED")
            .otherwise("SUSPICIOUS"),
            "workflow_action": F.when(doc == "RECAPTURE_REQUIRED", "RECAPTURE_DOCUMENT")
            .when((doc == "FAILED") | (face == "FAILED"), "REJECT_AND_REPORT")
            .when(live == "FAILED", "MANUAL_REVIEW")
            .when(done, "APPROVE")
            .otherwise("CONTINUE_VERIFICATION"),
        }
    )


def with_stage_access(stages: DataFrame) -> DataFrame:
    """Which of the five stages an operator may open, from the stage states."""
    settled = {c: F.coalesce(F.col(c).isin("PASSED", "FAILED"), F.lit(False)) for c in
               ("document_state", "liveness_state", "face_state")}
    return stages.withColumns(
        {
            "can_open_document": F.lit(True),
            "can_open_liveness": settled["document_state"],
            "can_open_face": settled["document_state"] & settled["liveness_state"],
            "can_open_risk": settled["document_state"] & settled["face_state"],
            "can_open_decision": F.coalesce(F.col("decision_state").isin("COMPLETED", "READY"), F.lit(False))
            | F.coalesce(F.col("risk_state").isin("COMPLETED", "PASSED"), F.lit(False)),
        }
    )
