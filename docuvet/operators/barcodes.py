"""Decoded barcodes: payload attributes and their agreement with the printed fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.checksums import digits_only
from docuvet.functions.stages import compute_once, let
from docuvet.functions.text import contains_any, first_non_empty, match, non_empty, payload_summary, strip

COMPARISON_TYPE = (
    "array<struct<field:string,ocr_value:string,barcode_value:string,is_match:boolean,severity:string>>"
)


def has_qr_marker(payload: Column) -> Column:
    return contains_any(payload, fixed.QR_MARKERS)


def _last_wins(pairs: Column) -> Column:
    """Map of keys from an array of (k, v); of repeated keys the last value counts. One sort, then a look at the next pair."""

    def build(ordered: Column) -> Column:
        last = F.filter(ordered, lambda p, i: F.coalesce(F.get(ordered, i + 1)["k"] != p["k"], F.lit(True)))
        return F.map_from_arrays(F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"]))

    return let(F.sort_array(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))), build)


def _pairs(text: Column, pattern: str, value) -> Column:
    """Key and value of every match; the text is searched once and only the matches are cut."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.transform(
        whole,
        lambda m: F.struct(F.lower(F.regexp_extract(m, pattern, 1)).alias("k"), value(F.regexp_extract(m, pattern, 2)).alias("v")),
    )


def quoted_attributes(payload: Column) -> Column:
    """All key="value" pairs of a text."""
    return _last_wins(_pairs(payload, fixed.QR_ATTRIBUTE, lambda v: v))


def _decoded(reference: Column) -> Column:
    """Character of a numeric reference such as &#39; or &#x27;. The ampersand stays a named one, to be decoded last."""
    digits = F.regexp_extract(reference, "[0-9A-Fa-f]+", 0)
    code = F.when(reference.rlike("^&#[xX]"), F.upper(digits)).otherwise(F.hex(digits.try_cast("long")))
    character = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    return F.when(character == "&", "&amp;").otherwise(character)


def _element_attributes(payload: Column) -> Column:
    def unescape(value: Column) -> Column:
        plain = F.substring(value, F.lit(2), F.length(value) - 2)
        references = F.array_distinct(F.regexp_extract_all(plain, F.lit(fixed.XML_REFERENCE), 0))
        plain = F.aggregate(references, plain, lambda text, r: F.replace(text, r, F.coalesce(_decoded(r), r)))
        for entity, char in fixed.XML_ENTITIES:
            plain = F.replace(plain, F.lit(entity), F.lit(char))
        return plain

    return _last_wins(_pairs(F.regexp_extract(payload, fixed.XML_ELEMENT, 2), fixed.XML_ATTRIBUTE, unescape))


def qr_attributes(payload: Column) -> Column:
    """Attributes of an identity payload: of its element when it is one, else all pairs in the text.

    NULL for payloads without any of the identity markers.
    """
    xml = payload.rlike(fixed.XML_ELEMENT)
    return F.when(
        has_qr_marker(payload), F.when(xml, _element_attributes(payload)).otherwise(quoted_attributes(payload))
    )


def qr_identity(attributes: Column) -> dict[str, Column]:
    def value(key: str) -> Column:
        return non_empty(F.try_element_at(attributes, F.lit(key)))

    gender, yob, uid = value("gender"), value("yob"), value("uid")
    return {
        "qr_name": value("name"),
        "qr_gender": F.when(gender == "M", "MALE").when(gender == "F", "FEMALE").otherwise(gender),
        "qr_dob": F.coalesce(value("dob"), F.concat(yob, F.lit("-01-01"))),
        "qr_yob": yob,
        "qr_uid_masked": F.when(F.length(uid) >= 4, F.concat(F.lit("XXXX-XXXX-"), F.right(uid, F.lit(4)))),
        "qr_care_of": value("co"),
        "qr_district": value("dist"),
        "qr_state": value("state"),
        "qr_pin": value("pc"),
    }


def _compared(key: str, condition: Column, printed: Column, decoded, is_match: Column, severity: str) -> Column:
    decoded = decoded if isinstance(decoded, Column) else F.lit(decoded)
    same = F.coalesce(is_match, F.lit(False))
    return F.when(
        condition,
        F.struct(
            F.lit(fixed.COMPARED[key]).alias("field"), printed.alias("ocr_value"), decoded.alias("barcode_value"),
            same.alias("is_match"), F.when(same, "LOW").otherwise(severity).alias("severity"),
        ),
    )


def _either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def cross_match_qr() -> Column:
    """Comparisons of an identity QR code with the printed fields."""
    letters = lambda c: F.regexp_replace(F.upper(c), "[^A-Z]", "")
    name, gender, dob, address = (first_non_empty(F.col(c)) for c in ("name", "gender", "dob", "address"))
    qr_name, qr_gender, qr_dob, qr_pin = (F.col(c) for c in ("qr_name", "qr_gender", "qr_dob", "qr_pin"))
    same_birth = _either_contains(digits_only(qr_dob), digits_only(dob)) | F.coalesce(
        F.contains(dob, F.col("qr_yob")), F.lit(False)
    )
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    return F.array_compact(
        F.array(
            _compared("name", both(qr_name, name), name, qr_name, _either_contains(letters(qr_name), letters(name)), "HIGH"),
            _compared("gender", both(qr_gender, gender), gender, qr_gender, F.upper(qr_gender) == F.upper(gender), "MEDIUM"),
            _compared("dob", both(qr_dob, dob), dob, qr_dob, same_birth, "HIGH"),
            _compared("pin", both(qr_pin, address), address, qr_pin, F.contains(address, qr_pin), "LOW"),
        )
    )


def cross_match_payload() -> Column:
    """Comparisons of any other payload with the printed fields."""
    payload, upper = F.col("payload"), F.upper("payload")
    number, name, dob = (first_non_empty(F.col(c)) for c in ("doc_number", "name", "dob"))
    clean = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    long_number = F.length(clean(number)) >= 5
    number_in = F.contains(clean(payload), clean(number))
    other_id = match(payload, fixed.PAYLOAD_ID)
    parts = F.filter(F.split(name, rf"[{fixed.WS},]+"), lambda p: F.length(p) > 2)
    hits = F.size(F.filter(parts, lambda p: F.contains(upper, F.upper(p))))
    name_in = (hits >= F.greatest(F.lit(1), F.size(parts) - 1)) & (F.size(parts) > 0)
    other_name = match(payload, fixed.PAYLOAD_NAME)
    birth = digits_only(dob)
    birth_in = (F.length(birth) >= 6) & F.contains(digits_only(payload), birth)
    yes, no = F.lit(True), F.lit(False)
    return F.array_compact(
        F.array(
            F.coalesce(
                _compared("id", long_number & number_in, number, fixed.MATCH_NOTES["id"], yes, "HIGH"),
                _compared("id", long_number & (F.upper(other_id) != clean(number)), number, other_id, no, "HIGH"),
            ),
            F.coalesce(
                _compared("name", name.isNotNull() & name_in, name, fixed.MATCH_NOTES["name"], yes, "HIGH"),
                _compared("name", (F.size(parts) >= 2) & other_name.isNotNull(), name, strip(other_name), no, "HIGH"),
            ),
            _compared("birth", birth_in, dob, fixed.MATCH_NOTES["birth"], yes, "LOW"),
        )
    )


def primary_barcode(barcodes: DataFrame) -> DataFrame:
    """First non-blank barcode of each document, with the number of distinct texts.

    Both are aggregates that combine before the shuffle; no document is gathered in one task.
    """
    texts = barcodes.withColumn("raw_text", strip(F.col("raw_text"))).filter(F.col("raw_text") != "")
    first = F.min_by(F.struct("format", "raw_text", "is_valid"), "seq")
    # One row per text first: repeated reads of one code collapse on the map side.
    per_text = texts.groupBy("doc_id", "raw_text").agg(
        F.min_by(F.struct("seq", "format", "is_valid"), "seq").alias("b")
    ).select("doc_id", "raw_text", "b.seq", "b.format", "b.is_valid")
    return per_text.groupBy("doc_id").agg(F.count("*").alias("barcode_count"), first.alias("b")).select(
        "doc_id", "barcode_count", F.col("b.format").alias("barcode_format"), F.col("b.raw_text").alias("payload"),
        F.coalesce("b.is_valid", F.lit(True)).alias("payload_valid"),
    )


def with_barcodes(fields: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Join each document with its primary barcode and compare the two; absent codes are NOT_FOUND."""
    joined = fields.join(primary_barcode(barcodes), "doc_id", "left")
    df = joined.withColumn("qr", F.when(F.col("payload_valid"), qr_attributes(F.col("payload"))))
    df = df.withColumn("qr", F.when(F.size("qr") > 0, F.col("qr")))
    df = compute_once(df.withColumns(qr_identity(F.col("qr"))))
    compared = (
        F.when(F.col("qr").isNotNull(), cross_match_qr())
        .when(F.col("payload_valid"), cross_match_payload())
        .otherwise(F.array().cast(COMPARISON_TYPE))
    )
    df = compute_once(df.withColumn("comparisons", compared))
    # Gender and PIN differences are reported with a lower severity and never count as a mismatch.
    conflict = F.exists("comparisons", lambda c: ~c["is_match"] & (c["severity"] == "HIGH"))
    return df.withColumns(
        {
            "barcode_count": F.coalesce("barcode_count", F.lit(0)),
            "barcode_status": F.when(F.col("payload").isNull(), "NOT_FOUND")
            .when(~F.col("payload_valid"), "INVALID")
            .when(conflict, "MISMATCH")
            .otherwise("MATCH"),
            "payload_summary": F.when(F.col("payload_valid"), payload_summary(F.col("payload"), 120)).otherwise(
                payload_summary(F.col("payload"), 100)
            ),
        }
    )
