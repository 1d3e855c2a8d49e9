"""Whole screenings, dossiers, and evaluation queries."""

from pyspark.sql import functions as F

from docuvet.operators import anomaly, dossier, evaluation, history, mrz, risk, screening, validation
from docuvet.operators.quality import exact_percentiles
from docuvet.plans.derive import _MODULE_RESULTS
from docuvet.plans.document_queries import SPACES, id_docs, ocr_lines, strip_sql
from docuvet.plans.image_queries import _REASONS, VERDICT, judged
from docuvet.plans.mrz_queries import _COMPARED, _PARTS, compared, mrz_docs
from docuvet.plans.registry import query
from docuvet.plans.risk_queries import RISK


@query("ocr_lines", f"""
SELECT doc_id, line_no, {strip_sql('text')} AS text, CAST(30 + (doc_id * 7 + line_no * 11) % 70 AS BIGINT) AS confidence FROM (
SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS text, CAST(generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS INT) AS line_no FROM <id_docs>) WHERE {strip_sql('text')} <> ''""")
def recognised_lines(t):
    return ocr_lines(t)


def screened(t):
    metrics = t.document_metrics.drop(*_MODULE_RESULTS)
    documents = screening.screen_documents(id_docs(t), t.barcodes, metrics, validation.line_statistics(ocr_lines(t)))
    return screening.decide_cases(documents.withColumn("case_id", F.col("doc_id")), t.case_faces, t.case_liveness)


_METRICS = ("width, height, blur, luminance, contrast, glare_ratio, skew_deg, top_std, bottom_std, left_std, right_std, ela_std, texture_std, "
            "edge_p95, white_ratio, white_std, color_sparsity, p99_gradient, filename, mime_type, software, has_camera_exif")
_NUMBER_SEEN = "CASE WHEN doc_number IS NOT NULL THEN ['NUMBER_EXTRACTED'] WHEN name IS NOT NULL THEN ['NAME_EXTRACTED'] ELSE [] END"
_CASE_REASONS = _REASONS.replace("CASE WHEN pan_number IS NOT NULL THEN ['NUMBER_EXTRACTED'] ELSE [] END", _NUMBER_SEEN)
_CASE_RISK = (
    RISK.replace("<signals>", "sig")
    .replace("  similarity < 70 AS face_failed", "  (face_status = 'FAILED' OR similarity < 70) AS face_failed")
    .replace("CASE WHEN similarity < 70 THEN greatest(75", "CASE WHEN face_status = 'FAILED' OR similarity < 70 THEN greatest(75")
    .replace("ELSE CAST(tampering_score AS decimal(18,6)) END AS document_risk", "ELSE CAST(composite_risk_score AS decimal(18,6)) END AS document_risk")
)


_SCREEN = f"""{_COMPARED},
raw AS (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS text, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS line_no FROM <id_docs>),
st AS (SELECT doc_id, count(*) AS n, sum(30 + (doc_id * 7 + line_no * 11) % 70) AS s FROM raw WHERE {strip_sql('text')} <> '' GROUP BY 1),
q AS (SELECT v.doc_id, coalesce(n, 0) AS n, CAST(coalesce(floor(CAST(20 * s + n AS DOUBLE) / (2 * n)) / 10, 0) AS decimal(9,1)) AS conf, detected_field_count AS found FROM validated v LEFT JOIN st USING (doc_id)),
m AS (SELECT doc_id, count(*) FILTER (NOT is_match AND severity = 'HIGH') AS conflicts FROM cmp GROUP BY 1),
jm AS MATERIALIZED (SELECT v.doc_id AS image_id, {_METRICS}, v.document_type, v.doc_number, v.name, conf AS ocr_confidence, n = 0 OR (conf < 35 AND found = 0) OR conf < 60 AS has_ocr_warning, n > 0 AS is_readable,
  v.verhoeff_ok, v.pan_number, 'NOT_APPLICABLE' AS mrz_status, CASE WHEN payload IS NULL THEN 'NOT_FOUND' WHEN NOT payload_valid THEN 'INVALID' WHEN coalesce(conflicts, 0) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS barcode_status
  FROM validated v JOIN b USING (doc_id) JOIN q USING (doc_id) LEFT JOIN m USING (doc_id) JOIN (SELECT doc_id, {_METRICS} FROM <document_metrics>) USING (doc_id)),
verd AS MATERIALIZED (SELECT *, array_to_string({_CASE_REASONS}, ' | ') AS reasons FROM {VERDICT.replace('<image_metrics>', 'jm')}),
sig AS MATERIALIZED (SELECT image_id AS case_id, CAST(tampering_score AS decimal(9,1)) AS tampering_score, CAST(document_score AS decimal(9,1)) AS composite_risk_score, verhoeff_ok, mrz_status, barcode_status, is_readable,
  recapture, face_status, similarity, liveness_passed FROM verd JOIN <case_faces> f ON image_id = f.case_id JOIN <case_liveness> l ON image_id = l.case_id)"""


@query("screening", f"""{_SCREEN}
SELECT r.case_id, d.document_type, d.doc_number, d.name, d.barcode_status, d.gate_status, d.document_decision, r.risk_level, CAST(r.risk_score AS DOUBLE) AS risk_score, r.final_decision, r.recommended_action, d.reasons
FROM {_CASE_RISK} r JOIN verd d ON r.case_id = d.image_id""")
def screen(t):
    return screened(t).select(
        "case_id", "document_type", "doc_number", "name", "barcode_status", "gate_status", "document_decision", "risk_level",
        F.col("risk_score").cast("double").alias("risk_score"), "final_decision", "recommended_action", F.array_join("reasons", " | ").alias("reasons"))


_PLAIN_NUMBER = f"regexp_replace(doc_number, {SPACES}, '', 'g')"


@query("dossiers", f"""{_SCREEN}
SELECT CAST(r.case_id AS VARCHAR) AS case_id, r.final_decision, CASE WHEN r.risk_level = 'HIGH' THEN 'REJECT / ESCALATE TO CYBER CELL' ELSE 'MANUAL REVIEW REQUIRED' END AS recommended_action,
  CASE WHEN doc_number IS NULL THEN 'N/A' WHEN regexp_full_match({_PLAIN_NUMBER}, '\\p{{Nd}}{{12}}') THEN 'XXXX-XXXX-' || right({_PLAIN_NUMBER}, 4)
    WHEN length({_PLAIN_NUMBER}) > 6 THEN substr({_PLAIN_NUMBER}, 1, 2) || '***' || right({_PLAIN_NUMBER}, 4) ELSE doc_number END AS doc_number_masked,
  CASE WHEN len(d.fails) > 0 AND NOT d.recapture THEN 1 ELSE 0 END AS anomaly_zones_detected, CASE WHEN len(d.fails) > 0 AND NOT d.recapture THEN d.fails[1] END AS region_reason, CASE WHEN regexp_matches(d.filename, '(?i)\\.jpe?g$') THEN 'image/jpeg' ELSE 'image/png' END AS mime_type, d.barcode_status <> 'NOT_FOUND' AS detected
FROM {_CASE_RISK} r JOIN verd d ON r.case_id = d.image_id""")
def dossiers(t):
    cases = screened(t).withColumns({
        "generated_timestamp": F.lit("2026-01-01T00:00:00"), "size_bytes": F.length("raw_text").cast("long"),
        "evidence_sha256": F.sha2(F.col("raw_text").cast("binary"), 256),
        "analyst_notes": F.lit(None).cast("string"),
    })
    built = dossier.case_dossier(cases)
    return built.select(
        "case_id", "screening_verdict.final_decision", "screening_verdict.recommended_action", "extracted_ocr_data.doc_number_masked",
        "forensic_tampering_findings.anomaly_zones_detected", F.get("forensic_tampering_findings.suspicious_regions", 0)["reason"].alias("region_reason"), "evidence_file.mime_type", "barcode_qr_findings.detected")


@query("escalation_actions", f"""
SELECT case_id, CASE WHEN document_level = 'HIGH' THEN 'REJECT / ESCALATE TO CYBER CELL' ELSE 'MANUAL REVIEW REQUIRED' END AS action FROM (SELECT image_id AS case_id, document_level FROM {VERDICT})""")
def escalation_actions(t):
    return judged(t).select(F.col("image_id").alias("case_id"), dossier.escalation_action(F.col("document_level")).alias("action"))


# --- Evaluation and review ---------------------------------------------------------------------------
@query("pad_metrics", """
WITH c AS (SELECT score AS threshold, count(*) FILTER (is_attack = 1) AS a, count(*) FILTER (is_attack <> 1) AS g FROM <scored> GROUP BY 1)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(coalesce(sum(a) OVER b, 0)::DOUBLE / sum(a) OVER ()::DOUBLE, 9) AS apcer, round((sum(g) OVER () - coalesce(sum(g) OVER b, 0))::DOUBLE / sum(g) OVER ()::DOUBLE, 9) AS bpcer
FROM c WINDOW b AS (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""".replace("OVER ()::DOUBLE", "OVER ()"))
def pad_metrics(t):
    rates = evaluation.error_rates(t.scored, "is_attack", "score")
    return rates.select(F.col("threshold").cast("double").alias("threshold"), F.round("apcer", 9).alias("apcer"), F.round("bpcer", 9).alias("bpcer"))


@query("equal_error_rate", """
WITH c AS (SELECT score AS threshold, count(*) FILTER (is_attack = 1) AS a, count(*) FILTER (is_attack <> 1) AS g FROM <scored> GROUP BY 1),
r AS (SELECT threshold, coalesce(sum(a) OVER b, 0)::DOUBLE / sum(a) OVER () AS apcer, (sum(g) OVER () - coalesce(sum(g) OVER b, 0))::DOUBLE / sum(g) OVER () AS bpcer FROM c WINDOW b AS (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(threshold AS DOUBLE) AS threshold, round((apcer + bpcer) / 2, 9) AS eer FROM r ORDER BY abs(apcer - bpcer), threshold LIMIT 1""")
def equal_error_rate(t):
    found = evaluation.equal_error_rate(evaluation.error_rates(t.scored, "is_attack", "score"))
    return found.select(F.col("threshold").cast("double").alias("threshold"), F.round("eer", 9).alias("eer"))


@query("roc_auc", """
SELECT round(sum(CASE WHEN a.score > g.score THEN 2 WHEN a.score = g.score THEN 1 ELSE 0 END)::DOUBLE / (2 * count(*)), 9) AS auc FROM <scored> a JOIN <scored> g ON a.is_attack = 1 AND g.is_attack <> 1""")
def roc_auc(t):
    return evaluation.roc_auc(t.scored, "is_attack", "score").select(F.round("auc", 9).alias("auc"))


_TRUTH = f"(SELECT r.*, is_fraud FROM {RISK} r JOIN <case_truth> USING (case_id))"


def judged_cases(t):
    return risk.with_risk(t.signals).join(t.case_truth, "case_id")


@query("confusion", f"""
SELECT is_fraud, count(*) FILTER (final_decision = 'VERIFIED') AS "VERIFIED", count(*) FILTER (final_decision = 'SUSPICIOUS') AS "SUSPICIOUS",
  count(*) FILTER (final_decision = 'RECAPTURE REQUIRED') AS "RECAPTURE REQUIRED", count(*) FILTER (final_decision = 'HIGH RISK') AS "HIGH RISK" FROM {_TRUTH} GROUP BY 1""")
def confusion(t):
    return evaluation.confusion(judged_cases(t), "is_fraud", "final_decision", ["VERIFIED", "SUSPICIOUS", "RECAPTURE REQUIRED", "HIGH RISK"])


@query("decision_rates", f"""
SELECT round(count(*) FILTER (is_fraud AND c)::DOUBLE / count(*) FILTER (is_fraud), 9) AS false_clear, round(count(*) FILTER (NOT is_fraud AND NOT c)::DOUBLE / count(*) FILTER (NOT is_fraud), 9) AS false_escalation,
  round(count(*) FILTER (is_fraud AND x)::DOUBLE / count(*) FILTER (x), 9) AS precision, round(count(*) FILTER (is_fraud AND x)::DOUBLE / count(*) FILTER (is_fraud), 9) AS recall,
  round(2 * count(*) FILTER (is_fraud AND x)::DOUBLE / (count(*) FILTER (x) + count(*) FILTER (is_fraud)), 9) AS f1
FROM (SELECT is_fraud, final_decision = 'VERIFIED' AS c, final_decision = 'HIGH RISK' AS x FROM {_TRUTH})""")
def decision_rates(t):
    rates = evaluation.decision_rates(
        judged_cases(t), F.col("is_fraud"), F.col("final_decision") == "VERIFIED", F.col("final_decision") == "HIGH RISK")
    return rates.select(*[F.round(c, 9).alias(c) for c in rates.columns])


@query("escalation", f"""
SELECT risk_level, escalated, count(*) AS cases FROM (SELECT risk_level, CASE WHEN risk_level = 'LOW' AND ((NOT recapture AND (document_risk > 50 OR consistency_risk > 50 OR face_risk > 50 OR liveness_risk > 50)) OR recapture OR case_id % 100 < 60) THEN 'MEDIUM' ELSE risk_level END AS escalated FROM {RISK}) GROUP BY 1, 2""")
def escalation(t):
    parts = F.transform(risk.risk_breakdown(), lambda p: p["level"])
    level = evaluation.escalate(F.col("risk_level"), parts, F.col("case_id") % 100)
    return risk.with_risk(t.signals).select("risk_level", level.alias("escalated")).groupBy("risk_level", "escalated").agg(F.count("*").alias("cases"))


@query("average_fusion", f"""
SELECT case_id, CAST(round(CAST(tampering_score + similarity + coalesce(CASE WHEN liveness_passed THEN 2.5 END, 0) AS decimal(18,6)) / (2 + CASE WHEN liveness_passed THEN 1 ELSE 0 END), 1) AS DOUBLE) AS average_score FROM <signals>""")
def average_fusion(t):
    df = t.signals.withColumn("live", F.when(F.col("liveness_passed"), F.lit(2.5)))
    return df.select("case_id", evaluation.average_fusion("tampering_score", "similarity", "live").cast("double").alias("average_score"))


@query("overrides", f"""
WITH o AS (SELECT case_id, count(*) AS n, arg_max(action, (acted_at, override_id, partkey, suppkey)) AS action FROM <overrides> GROUP BY 1)
SELECT r.case_id, final_decision, coalesce(action, final_decision) AS effective_decision, coalesce(n, 0) AS override_count FROM {RISK} r LEFT JOIN o USING (case_id)""")
def overrides(t):
    # Lines of one order may repeat a number; their keys make the log position unique.
    log = t.overrides.withColumn("override_id", F.struct("override_id", "partkey", "suppkey"))
    return evaluation.with_overrides(risk.with_risk(t.signals), log).select("case_id", "final_decision", "effective_decision", "override_count")


@query("review_queue", f"""
SELECT case_id, CAST(risk_score AS DOUBLE) AS risk_score FROM {RISK} WHERE risk_level = 'MEDIUM' AND case_id NOT IN (SELECT case_id FROM <overrides>)""")
def review_queue(t):
    return evaluation.review_queue(risk.with_risk(t.signals), t.overrides).select("case_id", F.col("risk_score").cast("double").alias("risk_score"))


@query("retention", "SELECT owner_id, count(*) AS kept FROM <history> WHERE timestamp >= TIMESTAMP '2001-01-01' - INTERVAL 365 DAY GROUP BY 1")
def retention(t):
    kept = evaluation.within_retention(t.history, F.lit("2001-01-01").cast("timestamp_ntz"), 365)
    return kept.groupBy("owner_id").agg(F.count("*").alias("kept"))


@query("type_thresholds", f"""
WITH th AS (SELECT document_type, CAST(median(CAST(edge_p95 AS DOUBLE)) AS DOUBLE) AS threshold FROM <image_metrics> WHERE document_type <> 'UNKNOWN' GROUP BY 1)
SELECT document_type, count(*) AS images, count(*) FILTER (CAST(edge_p95 AS DOUBLE) > coalesce(threshold, 200)) AS exceeding FROM <image_metrics> LEFT JOIN th USING (document_type) GROUP BY 1""")
def type_thresholds(t):
    images = t.image_metrics.select("document_type", "edge_p95")
    known = images.filter(F.col("document_type") != "UNKNOWN")
    limits = exact_percentiles(known, ["document_type"], "edge_p95", {"threshold": 0.5}).drop("n")
    judged = evaluation.above_type_threshold(images.withColumn("edge_p95", F.col("edge_p95").cast("double")), limits, "edge_p95", 200.0)
    return judged.groupBy("document_type").agg(F.count("*").alias("images"), F.count_if("exceeds").alias("exceeding"))


def merged_sources(t):
    """Printed fields, zone and barcode of the same customer's documents."""
    zones = mrz.with_mrz(mrz_docs(t)).select("doc_id", *[c for c in mrz.MRZ_FIELDS if c != "mrz_checks"])
    return dossier.join_document(compared(t), zones)


_ZONE_DOB = "CASE WHEN CAST(substr(p2.dob, 1, 2) AS INT) > 30 THEN '19' ELSE '20' END || substr(p2.dob, 1, 2) || '-' || substr(p2.dob, 3, 2) || '-' || substr(p2.dob, 5, 2)"
_DATE = lambda c: f"TRY_CAST({c} AS DATE)"
_CODES = ", ".join(f"CASE WHEN {hit} THEN '{code}' END" for code, hit in (
    ("NAME_MRZ", "NOT skipped AND name IS NOT NULL AND levenshtein(n, given || 'APPLICANT') > 2 AND levenshtein(n, 'APPLICANT' || given) > 2 AND NOT contains(given || 'APPLICANT', n)"),
    ("DOB_MRZ", "NOT skipped AND dob <> zone_dob"),
    ("NUMBER_MRZ", "NOT skipped AND regexp_replace(upper(doc_number), '[^A-Z0-9]', '', 'g') <> num"),
    ("GENDER_MRZ", "NOT skipped AND sex IN ('M', 'F') AND substr(gender, 1, 1) <> sex"),
    ("BARCODE", "conflicts > 0"),
    ("ISSUE_AFTER_EXPIRY", f"{_DATE('issue_date')} > {_DATE('expiry_date')}"),
    ("ISSUED_BEFORE_BIRTH", f"{_DATE('issue_date')} < {_DATE('dob')}"),
    ("EXPIRED", f"{_DATE('expiry_date')} < DATE '2026-01-01'"),
    ("BIRTH_IN_FUTURE", f"{_DATE('dob')} > DATE '2026-01-01'"),
    ("NUMBER_FORMAT", "CASE document_type WHEN 'NATIONAL_ID (AADHAAR)' THEN length(regexp_replace(doc_number, '[^0-9]', '', 'g')) <> 12 "
                      "WHEN 'NATIONAL_ID (PAN)' THEN NOT regexp_full_match(doc_number, '[A-Z]{5}[0-9]{4}[A-Z]') END"),
))


@query("cross_field", f"""{_COMPARED}, {_PARTS},
m AS (SELECT doc_id, count(*) FILTER (NOT is_match AND severity = 'HIGH') AS conflicts FROM cmp GROUP BY 1),
j AS MATERIALIZED (SELECT v.doc_id, v.name, v.dob, v.gender, v.doc_number, issue_date, expiry_date, document_type, skipped, num, sex, {_ZONE_DOB} AS zone_dob, substr(holder, 12) AS given,
  regexp_replace(upper(v.name), '[^A-Z]', '', 'g') AS n, CASE WHEN payload_valid THEN conflicts END AS conflicts FROM validated v JOIN p2 USING (doc_id) JOIN b USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT doc_id, array_to_string(list_filter([{_CODES}], lambda c: c IS NOT NULL), ',') AS findings FROM j""")
def cross_field(t):
    findings = evaluation.cross_field_findings(F.lit("2026-01-01").cast("date"))
    return merged_sources(t).select("doc_id", F.array_join(findings, ",").alias("findings"))


_LONG = "\nUNION ALL ".join(
    f"SELECT doc_id, '{field}' AS field_name, '{source}' AS source, {value} AS value FROM {table} AND {value} IS NOT NULL"
    for source, table, values in (
        ("OCR", "validated WHERE true", {"name": "name", "dob": "dob", "gender": "gender", "number": "doc_number"}),
        ("QR", "b WHERE payload_valid AND is_qr", {
            "name": "q_name", "dob": "q_yob || '-01-01'", "gender": "q_gender",
            "number": "'XXXX-XXXX-' || right(regexp_extract(payload, 'uid=\"([^\"]*)\"', 1), 4)"}),
        ("MRZ", "p2 WHERE NOT skipped", {
            "name": "'APPLICANT'", "number": "num", "gender": "CASE sex WHEN 'M' THEN 'MALE' WHEN 'F' THEN 'FEMALE' ELSE 'UNSPECIFIED' END",
            "dob": "CASE WHEN CAST(substr(dob, 1, 2) AS INT) > 30 THEN '19' ELSE '20' END || substr(dob, 1, 2) || '-' || substr(dob, 3, 2) || '-' || substr(dob, 5, 2)"}),
    )
    for field, value in values.items()
)


@query("evidence_long", f"{_COMPARED}, {_PARTS}\n{_LONG}")
def evidence_long(t):
    return evaluation.evidence_long(merged_sources(t))


@query("fields_by_source", f"""{_COMPARED}, {_PARTS}
SELECT doc_id, field_name, min(value) FILTER (source = 'OCR') AS "OCR", min(value) FILTER (source = 'MRZ') AS "MRZ", min(value) FILTER (source = 'QR') AS "QR" FROM ({_LONG}) GROUP BY 1, 2""")
def fields_by_source(t):
    return evaluation.fields_side_by_side(merged_sources(t))


# --- Shared evidence, splits, training rows, printed reports --------------------------------------------
_EVIDENCE = """(SELECT o_orderkey AS case_id, o_custkey AS owner_id, o_orderdate AS timestamp, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE sha256(CAST(o_custkey % 2 AS VARCHAR) || ':' || CAST(o_orderdate AS VARCHAR)) END AS evidence_sha256 FROM orders)"""


def evidence_of(t):
    """Each day's cases of customers with the same last bit share a file."""
    text = F.concat((F.col("o_custkey") % 2).cast("string"), F.lit(":"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.orders.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").alias("timestamp"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.sha2(text.cast("binary"), 256)).alias("evidence_sha256"),
    )


@query("shared_evidence", f"""
WITH c AS (SELECT evidence_sha256, owner_id, case_id, min(timestamp) AS first_at FROM {_EVIDENCE} WHERE evidence_sha256 <> '' GROUP BY 1, 2, 3)
SELECT evidence_sha256, count(DISTINCT owner_id) AS owners, count(*) AS cases, arg_min(owner_id, struct_pack(a := first_at, b := owner_id)) AS first_owner
FROM c GROUP BY 1 HAVING count(DISTINCT owner_id) > 1""")
def shared_evidence(t):
    return evaluation.shared_evidence(evidence_of(t))


@query("split_documents", """
WITH p AS (SELECT toxic, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS place FROM documents JOIN labels USING (doc_id))
SELECT CASE WHEN place < 70 THEN 'TRAIN' WHEN place < 85 THEN 'VALIDATION' ELSE 'TEST' END AS split, toxic, count(*) AS documents FROM p GROUP BY 1, 2""")
def split_documents(t):
    rows = evaluation.split_documents(t.documents.join(t.labels, "doc_id"), "doc_id")
    return rows.groupBy("split", "toxic").agg(F.count("*").alias("documents"))


@query("split_leaks", f"""
SELECT evidence_sha256, min(split) AS first, max(split) AS last, count(*) AS rows
FROM (SELECT *, CASE WHEN owner_id % 10 < 7 THEN 'TRAIN' WHEN owner_id % 10 < 9 THEN 'VALIDATION' ELSE 'TEST' END AS split FROM {_EVIDENCE}) GROUP BY 1 HAVING min(split) <> max(split)""")
def split_leaks(t):
    place = F.col("owner_id") % 10
    split = F.when(place < 7, "TRAIN").when(place < 9, "VALIDATION").otherwise("TEST")
    return evaluation.split_leaks(evidence_of(t).withColumn("split", split), "evidence_sha256")


@query("training_rows", """
WITH latest AS (SELECT case_id, arg_max(action, struct_pack(a := acted_at, b := override_id, c := action)) AS label FROM <overrides> GROUP BY 1)
SELECT label, count(*) AS rows FROM <case_truth> JOIN latest USING (case_id) GROUP BY 1""")
def training_rows(t):
    rows = evaluation.training_rows(t.case_truth, t.overrides)
    return rows.groupBy("label").agg(F.count("*").alias("rows"))


@query("printed_reasons", f"""
SELECT case_id, len(r[1:5]) AS printed, array_to_string(r[1:5], ' | ') AS reasons FROM (SELECT image_id AS case_id, string_split(reasons, ' | ') AS r FROM ({_SCREEN} SELECT * FROM verd))""")
def printed_reasons(t):
    reasons = dossier.printed_reasons(F.col("reasons"))
    return screened(t).select("case_id", F.size(reasons).cast("long").alias("printed"), F.array_join(reasons, " | ").alias("reasons"))


@query("top_contributions", """
SELECT case_id, array_to_string(list_transform(list_reverse(list_sort([struct_pack(v := CAST(tampering_score AS DOUBLE), n := 'tampering'), struct_pack(v := CAST(100 - similarity AS DOUBLE), n := 'face'),
  struct_pack(v := CASE WHEN liveness_passed THEN 0.0 ELSE 50.0 END::DOUBLE, n := 'liveness')]))[1:2], lambda x: x.n), ',') AS top FROM <signals>""")
def top_contributions(t):
    values = F.array(
        F.col("tampering_score").cast("double"), (F.lit(100) - F.col("similarity")).cast("double"),
        F.when(F.col("liveness_passed"), 0.0).otherwise(50.0),
    )
    return t.signals.select("case_id", F.array_join(evaluation.top_contributions(["tampering", "face", "liveness"], values, 2), ",").alias("top"))


@query("display_fields", """
SELECT doc_id, 'Applicant Name' AS field, CASE WHEN doc_id % 3 = 0 THEN 'Not confidently detected' ELSE 'N' || CAST(doc_id AS VARCHAR) END AS value, doc_id % 3 <> 0 AS is_consistent FROM <mrz_parts>
UNION ALL SELECT doc_id, f, 'Not confidently detected', false FROM <mrz_parts>, (SELECT unnest(['Document ID', 'Date of Birth', 'Address', 'Gender']) AS f)""")
def display_fields(t):
    empty = {c: F.lit("") for c in ("doc_number", "dob", "address", "gender")}
    named = t.mrz_parts.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("N"), F.col("doc_id").cast("string"))).alias("name"))
    return named.withColumns(empty).select("doc_id", F.inline(history.display_fields()))


# --- One-class anomaly score and learned fusion ----------------------------------------------------------
_X = "CAST(ela_std AS DOUBLE) AS x, CAST(texture_std AS DOUBLE) AS y"
_DISTANCE = f"""(WITH m AS (SELECT image_id, {_X}, barcode_status <> 'MISMATCH' AS genuine FROM <image_metrics>),
g AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM m WHERE genuine)
SELECT image_id, x, y, genuine, sqrt(greatest(0, ((x - mx) * (x - mx) * vy - 2 * (x - mx) * (y - my) * vxy + (y - my) * (y - my) * vx) / (vx * vy - vxy * vxy))) AS distance FROM m, g)"""


def distances(t):
    rows = t.image_metrics.select("image_id", "ela_std", "texture_std", (F.col("barcode_status") != "MISMATCH").alias("genuine"))
    model = anomaly.fit_genuine(rows.filter("genuine"), ("ela_std", "texture_std"))
    return rows.withColumn("distance", anomaly.anomaly_distance(model))


@query("anomaly_scores", f"SELECT image_id, x AS ela, y AS texture, round(distance, 6) AS distance FROM {_DISTANCE}")
def anomaly_scores(t):
    return distances(t).select(
        "image_id", F.col("ela_std").cast("double").alias("ela"), F.col("texture_std").cast("double").alias("texture"), F.round("distance", 6).alias("distance"))


@query("anomaly_threshold", f"SELECT round(quantile_cont(distance, 0.95), 6) AS threshold FROM {_DISTANCE} WHERE genuine")
def anomaly_threshold(t):
    found = anomaly.learned_threshold(distances(t).filter("genuine"), "distance")
    return found.select(F.round("threshold", 6).alias("threshold"))


@query("learned_fusion")
def learned_fusion(t):
    cases = t.signals.withColumns({"mrz_failed": (F.col("mrz_status") == "FAILED").cast("int"), "mismatch": (F.col("barcode_status") == "MISMATCH").cast("int"),
                                   "number_failed": F.coalesce(~F.col("verhoeff_ok"), F.lit(False)).cast("int")})
    labelled = cases.join(t.case_truth, "case_id")
    scored = anomaly.learned_fusion(cases, labelled, ("tampering_score", "mrz_failed", "mismatch", "number_failed"), "is_fraud")
    return scored.select("case_id", F.round("fraud_probability", 6).alias("fraud_probability"))
