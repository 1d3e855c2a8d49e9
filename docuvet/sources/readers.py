"""Readers for verification history, users, dossiers, evidence files, text lines and frame streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docuvet.functions.checksums import evidence_digest
from docuvet.functions.text import strip
from docuvet.operators.barcodes import COMPARISON_TYPE
from docuvet.operators.dossier import CHECKS
from docuvet.operators.verdict import REGION_TYPE
from docuvet.streaming.liveness import FRAME_SCHEMA

OCR_FIELDS = "name string, docNumber string, dob string, gender string, address string"
VERIFICATION_SCHEMA = (
    "case_id string, owner_id string, owner_email string, owner_role string, org_name string, timestamp string, "
    "applicant_name string, document_type string, source_display string, final_decision string, "
    "overall_risk_score double, overall_status string, evidence_sha256 string, reasons array<string>, "
    f"liveness_passed boolean, face_similarity double, ocr_fields struct<{OCR_FIELDS.replace(' string', ':string')}>"
)
# Secrets are not part of the layout and are never loaded.
USER_SCHEMA = (
    "id string, email string, username string, role string, created_at string, full_name string, org_name string, "
    "org_id string, org_type string, authorized_person string"
)
# Both generations of the dossier: the earlier one has no quality gate and number validation,
# the later one no text snippet and zone fields.
DOSSIER_SCHEMA = (
    "case_id string, report_title string, generated_timestamp string, "
    "submission_portal struct<name:string,official_url:string,submission_status:string,submission_notice:string>, "
    "evidence_file struct<filename:string,size_bytes:long,sha256_digest:string,mime_type:string>, "
    "screening_verdict struct<final_decision:string,risk_level:string,composite_risk_score:double,tampering_score:double,recommended_action:string>, "
    "quality_gate struct<status:string,issues:array<string>,warnings:array<string>>, "
    f"forensic_tampering_findings struct<analysis_engine:string,anomaly_zones_detected:int,suspicious_regions:{REGION_TYPE},forensic_flags:array<string>>, "
    "extracted_ocr_data struct<is_readable:boolean,confidence_score:double,document_type:string,name:string,dob:string,doc_number_masked:string,"
    "expiry_date:string,address:string,gender:string,raw_text_snippet:string>, "
    f"aadhaar_validation struct<status:string,masked_aadhaar:string,is_verhoeff_valid:boolean,checks:{CHECKS}>, "
    "mrz_validation_findings struct<mrz_detected:boolean,is_applicable:boolean,status:string,format:string,checksums_passed:boolean,"
    "checksum_details:array<struct<name:string,field:string,data:string,expected:string,calculated:int,valid:boolean,description:string>>,mrz_parsed_fields:map<string,string>>, "
    f"barcode_qr_findings struct<detected:boolean,status:string,format:string,cross_match_verdict:string,comparisons:{COMPARISON_TYPE}>, analyst_notes string"
)
OCR_RESULT_SCHEMA = "doc_id long, lines array<struct<text:string,confidence:double,box:array<array<double>>>>"


def parse_timestamp(text):
    """'yyyy-MM-dd HH:mm:ss UTC' as a timestamp; NULL where it does not parse."""
    return F.try_to_timestamp(F.regexp_replace(text, " UTC$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))


def read_verifications(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """History records. A JSON array per file, or (``multiline=False``) one record per line, which splits."""
    df = spark.read.schema(VERIFICATION_SCHEMA).option("multiLine", multiline).json(path)
    return df.withColumn("recorded_at", parse_timestamp(F.col("timestamp")))


def read_users(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Users, one row each: from JSON objects keyed by e-mail address, or (``lines``) one user per line.

    An object has to be parsed whole, so such a file is one row of one task; user bases that outgrow a task's memory come as
    lines, which split.
    """
    if lines:
        return spark.read.schema(USER_SCHEMA).json(path)
    layout = f"map<string,struct<{USER_SCHEMA.replace(' string', ':string')}>>"
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", layout)).alias("key", "user"))
        .select("user.*")
    )


def read_dossiers(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Case dossiers of either generation, one per file or (``multiline=False``) one per line.

    Keys that a generation lacks are NULL.
    """
    return spark.read.schema(DOSSIER_SCHEMA).option("multiLine", multiline).json(path)


def read_dossiers_whole(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Case dossiers of any generation: ``case_id``, the known keys, and ``dossier``, the whole document as a VARIANT.

    Keys that no known generation has are kept there, with their own types, and are asked for by path (``dossier_value``).
    A text that is no JSON document gives a row of nulls.
    """
    texts = spark.read.text(path, wholetext=multiline).filter(F.trim("value") != "")
    whole = texts.select(F.try_parse_json("value").alias("dossier"), "value")
    known = whole.select("dossier", F.from_json("value", DOSSIER_SCHEMA).alias("known"))
    return known.select("known.*", "dossier")


def dossier_value(path: str, kind: str = "string"):
    """Value at a JSON path of ``dossier``; NULL where there is none or where it is of another kind."""
    return F.try_variant_get("dossier", path, kind)


def unknown_keys(dossiers: DataFrame) -> DataFrame:
    """Keys beyond the known layout, nested ones with their path: case_id, key, kind (schema of the value), one row each."""
    known = StructType.fromDDL(DOSSIER_SCHEMA)
    entries = lambda c: F.explode(F.col(c).try_cast("map<string,variant>")).alias("key", "value")
    top = dossiers.select("case_id", F.lit("").alias("inside"), entries("dossier"))
    structs = {f.name: f.dataType for f in known if isinstance(f.dataType, StructType)}
    nested = top.filter(F.col("key").isin(*structs)).select("case_id", F.col("key").alias("inside"), F.col("value").alias("part"))
    below = nested.select("case_id", "inside", entries("part"))
    expected = [("", f.name) for f in known] + [(n, f.name) for n, t in structs.items() for f in t]
    names = F.array(*[F.lit(f"{a}.{b}") for a, b in expected])
    found = top.union(below).filter(~F.array_contains(names, F.concat_ws(".", "inside", "key")))
    path = F.when(F.col("inside") == "", F.col("key")).otherwise(F.concat_ws(".", "inside", "key"))
    return found.select("case_id", path.alias("key"), F.schema_of_variant("value").alias("kind"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and digest of evidence files; the content is dropped after hashing."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"),
        evidence_digest(F.col("content")).alias("sha256"),
    )


def ocr_lines(results: DataFrame) -> DataFrame:
    """Non-blank recognised lines with their running number in the document."""
    lines = results.select("doc_id", F.posexplode("lines").alias("line_no", "l")).select(
        "doc_id", "line_no", strip(F.col("l.text")).alias("text"), F.col("l.confidence").alias("confidence"), F.col("l.box").alias("box")
    )
    return lines.filter(F.col("text") != "")


def read_ocr_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per document with its recognised lines (JSON lines)."""
    return spark.read.schema(OCR_RESULT_SCHEMA).json(path)


def read_ocr_lines(spark: SparkSession, path: str) -> DataFrame:
    return ocr_lines(read_ocr_results(spark, path))


def read_frames_stream(spark: SparkSession, path: str, file_format: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """Stream of camera-frame measurements; the rate limit bounds each micro-batch."""
    return (
        spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).format(file_format).load(path)
    )
