"""Rules for national identity numbers, and the reading quality of a document."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.checksums import digits_only, verhoeff_valid_digits
from docuvet.functions.stages import compute_once, let
from docuvet.functions.text import contains_any, match
from docuvet.operators.fields import detected_field_count

CHECK_TYPE = "array<struct<name:string,passed:boolean,details:string,severity:string>>"


def aadhaar_candidates(text: Column) -> Column:
    """Twelve-digit candidates in order: grouped digits, whole words, runs in the digit stream."""
    stream = digits_only(text)
    found = [
        F.regexp_extract_all(text, F.lit(fixed.AADHAAR_GROUPED), 1),
        F.regexp_extract_all(text, F.lit(fixed.AADHAAR_WORD), 1),
        F.regexp_extract_all(stream, F.lit(fixed.AADHAAR_RUN), 1),
    ]
    return F.array_distinct(F.transform(F.concat(*found), digits_only))


def pick_aadhaar(candidates: Column) -> Column:
    """First candidate that satisfies the Verhoeff check, else the first one."""
    return let(candidates, lambda c: F.coalesce(F.get(F.filter(c, verhoeff_valid_digits), 0), F.get(c, 0)))


def _check(name, passed: Column, good: Column | str, bad: Column | str, severity: str) -> Column:
    def text(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        F.lit(name).alias("name"),
        passed.alias("passed"),
        F.when(passed, text(good)).otherwise(text(bad)).alias("details"),
        F.when(passed, "LOW").otherwise(severity).alias("severity"),
    )


def _or_na(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("N/A"))


def check_flags() -> dict[str, Column]:
    """What the structure checks ask of texts and fields.

    They are columns before the checks read them: a check reads its flag three times, and written out each time the checks grow beyond
    the method size that the JVM compiles.
    """
    upper = F.col("upper_text")
    government, authority = contains_any(upper, fixed.GOVERNMENT_HEADERS), contains_any(upper, fixed.AUTHORITY_HEADERS)
    return {
        "_header_found": government | authority,
        "_authority_found": authority | contains_any(upper, fixed.AADHAAR_TAGLINES),
        "_demographic_found": F.col("name").isNotNull() & (F.col("dob").isNotNull() | F.col("gender").isNotNull()),
        "_pan_header_found": contains_any(upper, fixed.PAN_HEADERS),
    }


def aadhaar_checks() -> Column:
    """Structure checks; needs ``aadhaar_digits``, ``verhoeff_ok``, the fields and ``check_flags``."""
    digits = F.col("aadhaar_digits")
    shown = F.concat(F.substring(digits, 1, 4), F.lit(" XXXX "), F.substring(digits, 9, 4))
    listed = F.concat(
        F.lit("Name: "), _or_na("name"), F.lit(", DOB: "), _or_na("dob"), F.lit(", Gender: "), _or_na("gender")
    )
    names = fixed.AADHAAR_CHECK_NAMES
    number = F.array(
        _check(names["format"], F.lit(True), F.concat(F.lit("Detected number "), shown), "", "HIGH"),
        _check(names["checksum"], F.col("verhoeff_ok"), "Check digit is valid", "Check digit does not fit", "HIGH"),
    )
    missing = F.array(_check(names["missing"], F.lit(False), "", "No 12-digit number starting with 2-9", "HIGH"))
    rest = F.array(
        _check(names["government"], F.col("_header_found"), "Header found", "Header missing", "MEDIUM"),
        _check(names["authority"], F.col("_authority_found"), "Authority text found", "Authority text missing", "MEDIUM"),
        _check(names["demographic"], F.col("_demographic_found"), listed, listed, "MEDIUM"),
        _check(names["pin"], F.col("pin_code").isNotNull(), F.concat(F.lit("PIN "), F.col("pin_code")),
               "No PIN code", "MEDIUM"),
    )
    return F.concat(F.when(digits.isNotNull(), number).otherwise(missing), rest)


def pan_checks() -> Column:
    pan, entity = F.col("pan_number"), F.col("pan_entity")
    names = fixed.PAN_CHECK_NAMES
    shown = F.concat(F.substring(pan, 1, 5), F.lit("XXXX"), F.substring(pan, 10, 1))
    known = F.coalesce(entity != fixed.PAN_OTHER_ENTITY, F.lit(False))
    number = F.array(
        _check(names["syntax"], F.lit(True), F.concat(F.lit("Number "), shown), "", "HIGH"),
        F.struct(
            F.lit(names["entity"]).alias("name"), known.alias("passed"),
            F.concat(F.substring(pan, 4, 1), F.lit(" -> "), entity).alias("details"), F.lit("LOW").alias("severity"),
        ),
    )
    missing = F.array(_check(names["syntax"], F.lit(False), "", "No 10-character number", "HIGH"))
    header = _check(names["header"], F.col("_pan_header_found"), "Header found",
                    "Header missing", "MEDIUM")
    return F.concat(F.when(pan.isNotNull(), number).otherwise(missing), F.array(header))


def high_checks_passed(checks: Column) -> Column:
    return F.forall(checks, lambda c: (c["severity"] != "HIGH") | c["passed"])


def pan_entity(pan: Column) -> Column:
    kind = None
    for letter, name in fixed.PAN_ENTITY_TYPES.items():
        hit = F.substring(pan, 4, 1) == letter
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return F.when(pan.isNotNull(), kind.otherwise(fixed.PAN_OTHER_ENTITY))


def validate_numbers(fields: DataFrame) -> DataFrame:
    """Route each document to the rules for its kind of number and apply them.

    Rules overwrite type and number where they find one. The two branches never both run.
    """
    is_type = F.col("document_type")
    aadhaar = is_type.contains("AADHAAR") | contains_any(F.col("upper_text"), fixed.AADHAAR_ROUTE_KEYWORDS)
    pan = is_type.contains("PAN") | contains_any(F.col("upper_text"), fixed.PAN_ROUTE_KEYWORDS)
    df = fields.withColumn("route", F.when(aadhaar, "AADHAAR").when(pan, "PAN"))
    df = df.withColumns(
        {
            "aadhaar_digits": F.when(F.col("route") == "AADHAAR", pick_aadhaar(aadhaar_candidates(F.col("raw_text")))),
            "pan_number": F.when(F.col("route") == "PAN", match(F.col("upper_text"), fixed.PAN_NUMBER)),
        }
    )
    df = df.withColumns(
        {
            "verhoeff_ok": F.when(
                F.col("route") == "AADHAAR", F.coalesce(verhoeff_valid_digits(F.col("aadhaar_digits")), F.lit(False))
            ),
            "pan_entity": pan_entity(F.col("pan_number")),
        }
    )
    flags = check_flags()
    df = compute_once(df.withColumns(flags)).withColumn(
        "structure_checks",
        F.when(F.col("route") == "AADHAAR", aadhaar_checks()).when(F.col("route") == "PAN", pan_checks()),
    ).drop(*flags)
    digits = F.col("aadhaar_digits")
    passed = high_checks_passed(F.col("structure_checks"))
    checked = df.withColumns(
        {
            "aadhaar_status": F.when(
                F.col("route") == "AADHAAR",
                F.when(passed & F.col("verhoeff_ok"), "VERIFIED").when(digits.isNotNull(), "SUSPICIOUS").otherwise("INVALID"),
            ),
            "pan_status": F.when(
                F.col("route") == "PAN",
                F.when(passed & F.col("pan_number").isNotNull(), "VERIFIED").otherwise("INVALID"),
            ),
            "masked_aadhaar": F.concat(F.lit("XXXX-XXXX-"), F.substring(digits, 9, 4)),
            "doc_number": F.coalesce(
                F.concat(F.substring(digits, 1, 4), F.lit(" "), F.substring(digits, 5, 4), F.lit(" "), F.substring(digits, 9, 4)),
                F.col("pan_number"),
                F.col("doc_number"),
            ),
            "document_type": F.when(F.col("route") == "AADHAAR", fixed.AADHAAR)
            .when(F.col("pan_number").isNotNull(), fixed.PAN)
            .otherwise(F.col("document_type")),
        }
    ).withColumn("detected_field_count", detected_field_count())
    return compute_once(checked)


def reading_quality(line_count: Column, confidence: Column, field_count: Column) -> dict[str, Column]:
    """Readable flag, recapture flag and warning from the mean confidence of a document."""
    none = line_count == 0
    poor = (confidence < 35) & (field_count == 0)
    return {
        "is_readable": ~none,
        "ocr_recapture": none | poor,
        "ocr_warning": F.when(none, "No readable text lines")
        .when(poor, "Low character confidence")
        .when(confidence < 60, "Moderate character confidence"),
    }


def line_statistics(lines: DataFrame) -> DataFrame:
    """Mean confidence and number of lines per document, combined on the map side."""
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("line_count"),
        F.round(F.avg(F.col("confidence").cast("decimal(9,2)")), 1).cast("decimal(9,1)").alias("confidence"),
    )


def with_reading_quality(documents: DataFrame, statistics: DataFrame) -> DataFrame:
    """Every document gets a row; one without lines counts as unreadable."""
    joined = documents.join(statistics, "doc_id", "left").withColumns(
        {
            "line_count": F.coalesce("line_count", F.lit(0)),
            "confidence": F.coalesce("confidence", F.lit(0)).cast("decimal(9,1)"),
        }
    )
    return joined.withColumns(
        reading_quality(F.col("line_count"), F.col("confidence"), F.col("detected_field_count"))
    )
