"""Upload, source, quality-gate, verdict and face queries."""

from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.stages import compute_once
from docuvet.operators import faces, quality, verdict
from docuvet.params import TAMPER_V1, TamperParams
from docuvet.plans.registry import query


def _any(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _ratio(low, high):
    return f"(greatest(width, height) >= least(width, height) * CAST({low} AS decimal(5,2)) AND greatest(width, height) <= least(width, height) * CAST({high} AS decimal(5,2)))"


_SCREEN = f"({_ratio(1.75, 2.25)} OR {_ratio(1.58, 1.80)} OR {_ratio(1.30, 1.36)})"
SOURCE = f"""(SELECT *, source_type IN ('DIGITAL_PDF', 'SCREENSHOT', 'DIGITAL_IMAGE') AS is_digital, source_type = 'PHYSICAL_CAPTURE' AS glare_applicable,
  source_type IN ('SCANNED_DOCUMENT', 'PHYSICAL_CAPTURE') AS blur_applicable,
  CASE source_type WHEN 'DIGITAL_PDF' THEN 1.0 WHEN 'SCREENSHOT' THEN 0.95 WHEN 'DIGITAL_IMAGE' THEN 0.92 WHEN 'SCANNED_DOCUMENT' THEN 0.88 ELSE CASE WHEN has_camera_exif THEN 0.9 ELSE 0.75 END END AS source_confidence
FROM (SELECT *, CASE WHEN ends_with(lower(filename), '.pdf') OR contains(lower(mime_type), 'pdf') THEN 'DIGITAL_PDF'
  WHEN {_any('lower(filename)', fixed.SCREENSHOT_NAMES)} OR {_any('lower(software)', fixed.SCREENSHOT_SOFTWARE)} OR ({_SCREEN} AND white_ratio > 0.30 AND white_std < 1.2 AND NOT has_camera_exif) THEN 'SCREENSHOT'
  WHEN (white_ratio > 0.35 AND white_std < 1.5 AND NOT has_camera_exif) OR (color_sparsity < 0.08 AND p99_gradient > 1200) THEN 'DIGITAL_IMAGE'
  WHEN {_any('lower(software)', fixed.SCANNER_SOFTWARE)} OR (white_ratio > 0.40 AND white_std < 3.5 AND NOT has_camera_exif AND NOT {_SCREEN}) THEN 'SCANNED_DOCUMENT' ELSE 'PHYSICAL_CAPTURE' END AS source_type
FROM <image_metrics>))"""
REFINED = f"""(SELECT *, CASE source_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SOURCE_NAMES.items())} END AS source_display FROM (SELECT * REPLACE (
  CASE WHEN is_digital AND contains(document_type, 'AADHAAR') THEN 'E_AADHAAR' WHEN is_digital AND contains(document_type, 'PAN') THEN 'E_PAN'
  WHEN source_type = 'SCANNED_DOCUMENT' AND document_type = 'PASSPORT' THEN 'PASSPORT_SCAN' ELSE source_type END AS source_type) FROM {SOURCE}))"""
_one = lambda c: f"CAST(CAST(round({c}, 1) AS decimal(9,1)) AS VARCHAR)"
_nn = lambda items: f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
_SIZE = "CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR)"
_LOW = "(width < 380 OR height < 380)"
_ISSUES = _nn([
    f"CASE WHEN {_LOW} THEN 'LOW_RESOLUTION ' || {_SIZE} END",
    f"CASE WHEN blur_applicable AND NOT is_digital AND blur < 45 THEN 'SEVERE_BLUR ' || {_one('blur')} END",
    f"CASE WHEN luminance < 35 THEN 'TOO_DARK ' || {_one('luminance')} END",
    f"CASE WHEN NOT is_digital AND luminance > 248 AND contrast < 20 THEN 'WASHED_OUT ' || {_one('luminance')} END",
    f"CASE WHEN glare_applicable AND NOT is_digital AND glare_ratio > 0.20 THEN 'GLARE ' || {_one('glare_ratio * 100')} END",
])
_EDGES = "CASE WHEN is_digital THEN [] ELSE " + _nn([f"CASE WHEN {s}_std > 40 THEN '{s}' END" for s in ("top", "bottom", "left", "right")]) + " END"
_WARNINGS = _nn([
    f"CASE WHEN NOT {_LOW} AND (width < 800 OR height < 600) THEN 'SMALL_RESOLUTION ' || {_SIZE} END",
    f"CASE WHEN blur_applicable AND NOT is_digital AND blur >= 45 AND blur < 75 THEN 'MODERATE_BLUR ' || {_one('blur')} END",
    f"CASE WHEN NOT is_digital AND abs(skew_deg) > 18 THEN 'SKEWED ' || {_one('skew_deg')} END",
    f"CASE WHEN len({_EDGES}) >= 2 THEN 'CROPPED ' || array_to_string({_EDGES}, ', ') END",
])
GATE = f"(SELECT *, CASE WHEN len(issues) > 0 THEN 'RECAPTURE_REQUIRED' ELSE 'PASSED' END AS gate_status FROM (SELECT *, {_ISSUES} AS issues, {_WARNINGS} AS warnings FROM {REFINED}))"


def tampering_sql(p: TamperParams):
    part = lambda c, full, cap: f"least(CAST({cap} AS decimal(18,6)), CAST(CAST({c} AS DOUBLE) * {cap} / {full} AS decimal(18,6)))"
    return f"CAST(least(100, greatest(0, round({part('ela_std', p.ela_full, p.ela_cap)} + {part('texture_std', p.texture_full, p.texture_cap)} + {part('edge_p95', p.edge_full, p.edge_cap)}, 1))) AS decimal(9,1))"


_D = lambda x: f"CAST({x} AS decimal(18,6))"
_FAILS = _nn([
    "CASE WHEN NOT verhoeff_ok THEN 'VERHOEFF_CHECKSUM_FAILED' END",
    "CASE WHEN contains(document_type, 'PAN') AND pan_number IS NULL THEN 'PAN_FORMAT_INVALID' END",
    "CASE WHEN mrz_status = 'FAILED' THEN 'MRZ_CHECKSUM_FAILED' END", "CASE WHEN barcode_status = 'MISMATCH' THEN 'BARCODE_MISMATCH' END",
])
_GOOD = _nn([
    "CASE WHEN verhoeff_ok THEN 'VERHOEFF_CHECKSUM_VALID' END", "CASE WHEN pan_number IS NOT NULL THEN 'PAN_FORMAT_VALID' END",
    "CASE WHEN mrz_status = 'VERIFIED' THEN 'MRZ_CHECKSUMS_PASSED' END", "CASE WHEN barcode_status = 'MATCH' THEN 'BARCODE_MATCHES' END",
])
VERDICT = f"""(SELECT *, CASE WHEN recapture THEN 'RECAPTURE REQUIRED' WHEN hard THEN 'HIGH RISK' WHEN unclear THEN 'REVIEW REQUIRED' ELSE 'VERIFIED' END AS document_decision,
  CASE WHEN recapture THEN 'NEUTRAL' WHEN hard THEN 'HIGH' WHEN unclear THEN 'MEDIUM' ELSE 'LOW' END AS document_level, CASE WHEN recapture THEN 0 ELSE CAST(len(fails) * 2 AS INT) END AS suspicion_count,
  CASE WHEN recapture THEN 15 WHEN hard THEN round(least(98, greatest(75, {_D('t * CAST(0.20 AS decimal(3,2))')} + 75)), 1)
    WHEN unclear THEN round(least(48, greatest(25, {_D('t * CAST(0.50 AS decimal(3,2))')} + 20)), 1) ELSE round(least(8, greatest(1, {_D('t * CAST(0.10 AS decimal(3,2))')})), 1) END AS document_score,
  CASE WHEN recapture THEN 0 WHEN hard THEN t ELSE round({_D('t * CAST(0.30 AS decimal(3,2))')}, 1) END AS tampering_score
FROM (SELECT *, {tampering_sql(TamperParams())} AS t, {_FAILS} AS fails, {_GOOD} AS good, len({_FAILS}) > 0 AS hard, gate_status = 'RECAPTURE_REQUIRED' AS recapture,
  ocr_confidence < 45 OR (has_ocr_warning AND ocr_confidence < 60) AS unclear FROM {GATE}))"""


@query("admit_uploads", """
SELECT coalesce(reject_reason, 'ACCEPTED') AS outcome, mime, count(*) AS uploads, sum(size_bytes) AS bytes FROM (SELECT size_bytes,
  CASE WHEN regexp_matches(filename, '(?i)\\.jpe?g$') THEN 'image/jpeg' ELSE 'image/png' END AS mime,
  CASE WHEN nullif(filename, '') IS NOT NULL AND lower(regexp_extract(filename, '\\.([^.]*)$', 1)) NOT IN ('jpg', 'jpeg', 'png', 'webp', 'pdf') THEN 'UNSUPPORTED_TYPE'
    WHEN size_bytes = 0 THEN 'EMPTY_FILE' WHEN size_bytes > 30 * 1024 * 1024 THEN 'TOO_LARGE' END AS reject_reason FROM <uploads>) GROUP BY 1, 2""".replace("\\\\", "\\"))
def admit_uploads(t):
    checked = quality.admit_uploads(t.uploads)
    outcome, mime = F.coalesce("reject_reason", F.lit("ACCEPTED")), quality.mime_from_name(F.col("filename"))
    return checked.groupBy(outcome.alias("outcome"), mime.alias("mime")).agg(F.count("*").alias("uploads"), F.sum("size_bytes").alias("bytes"))


@query("source_class", f"""
SELECT image_id, source_type, is_digital, glare_applicable, blur_applicable, CAST(source_confidence AS DOUBLE) AS source_confidence FROM {SOURCE}""")
def source_class(t):
    return quality.with_source(t.image_metrics).select(
        "image_id", "source_type", "is_digital", "glare_applicable", "blur_applicable", F.col("source_confidence").cast("double").alias("source_confidence"))


@query("refined_sources", f"SELECT source_type, source_display, count(*) AS images FROM {REFINED} GROUP BY 1, 2")
def refined_sources(t):
    df = quality.refine_source(quality.with_source(t.image_metrics))
    return df.groupBy("source_type", "source_display").agg(F.count("*").alias("images"))


def gated(t):
    return quality.quality_gate(quality.refine_source(quality.with_source(t.image_metrics)))


@query("quality_gate", f"""
SELECT image_id, gate_status, array_to_string(issues, '; ') AS issues, array_to_string(warnings, '; ') AS warnings FROM {GATE}""")
def quality_gate(t):
    return gated(t).select(
        "image_id", "gate_status", F.array_join("gate_issues", "; ").alias("issues"), F.array_join("gate_warnings", "; ").alias("warnings"))


@query("glare_ratio", """
SELECT image_id, CAST(sum(CASE WHEN area > 100 AND w * 10 < img_w * 7 AND h * 10 < img_h * 7 THEN area ELSE 0 END) AS DOUBLE) / CAST(max(img_w * img_h) AS DOUBLE) AS glare_ratio
FROM (SELECT *, CAST(w * h AS BIGINT) AS area FROM <regions>) GROUP BY 1""")
def glare_ratio(t):
    blobs = t.regions.withColumn("area", (F.col("w") * F.col("h")).cast("long"))
    return quality.glare_ratio(blobs).select("image_id", "glare_ratio")


_ORDER = ["seq", "x", "y", "w", "h", "angle"]


@query("skew_median", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq, x, y, w, h, angle) AS rn FROM <regions>)
SELECT image_id, coalesce(median(CAST(CASE WHEN abs(angle) < 45 THEN angle WHEN angle > 45 THEN angle - 90 WHEN angle < -45 THEN angle + 90 END AS DOUBLE)), 0) AS skew_deg FROM f WHERE rn <= 15 GROUP BY 1""")
def skew_median(t):
    return quality.skew_angle(t.regions, _ORDER)


@query("top_regions", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq, x, y, w, h, angle) AS rn FROM <regions> WHERE w * h * 200 > img_w * img_h)
SELECT image_id, 'sr_' || CAST(rn AS VARCHAR) AS id, round(x * 100.0 / img_w, 1) AS x_pct, round(y * 100.0 / img_h, 1) AS y_pct, round(w * 100.0 / img_w, 1) AS w_pct, round(h * 100.0 / img_h, 1) AS h_pct
FROM f WHERE rn <= 4""")
def top_regions(t):
    df = quality.top_regions(t.regions, _ORDER)
    return df.select("image_id", "id", *[F.col(c).cast("double").alias(c) for c in ("x_pct", "y_pct", "w_pct", "h_pct")])


@query("metric_percentiles", """
SELECT document_type, count(*) AS n, round(quantile_cont(CAST(edge_p95 AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST(edge_p95 AS DOUBLE), 0.99), 6) AS p99, round(quantile_cont(CAST(edge_p95 AS DOUBLE), 0.5), 6) AS median
FROM <image_metrics> GROUP BY 1""")
def metric_percentiles(t):
    df = quality.exact_percentiles(t.image_metrics, ["document_type"], "edge_p95", {"p95": 0.95, "p99": 0.99, "median": 0.5})
    return df.select("document_type", "n", *[F.round(c, 6).alias(c) for c in ("p95", "p99", "median")])


@query("tampering_score", f"""
SELECT image_id, CAST({tampering_sql(TamperParams())} AS DOUBLE) AS current_score, CAST({tampering_sql(TAMPER_V1)} AS DOUBLE) AS earlier_score FROM <image_metrics>""")
def tampering_score(t):
    return t.image_metrics.select(
        "image_id", verdict.tampering_score().cast("double").alias("current_score"),
        verdict.tampering_score(TAMPER_V1).cast("double").alias("earlier_score"))


@query("document_verdict", f"""
SELECT image_id, document_decision, document_level, suspicion_count, CAST(document_score AS DOUBLE) AS document_score, CAST(tampering_score AS DOUBLE) AS tampering_score, array_to_string(fails, ',') AS fails FROM {VERDICT}""")
def document_verdict(t):
    return verdict.with_verdict(gated(t)).select(
        "image_id", "document_decision", "document_level", "suspicion_count", F.col("document_score").cast("double").alias("document_score"),
        F.col("tampering_score").cast("double").alias("tampering_score"), F.array_join("fail_signals", ",").alias("fails"))


_REASONS = f"""CASE WHEN recapture THEN list_concat(list_transform(issues, lambda i: 'QUALITY ALERT: ' || i), list_transform(warnings, lambda w: 'QUALITY NOTE: ' || w))
  ELSE list_concat(['SOURCE: ' || source_display || ' (' || CASE WHEN is_digital THEN 'digital' ELSE 'optical' END || ')'], CASE WHEN hard THEN fails ELSE list_concat(good, CASE WHEN pan_number IS NOT NULL THEN ['NUMBER_EXTRACTED'] ELSE [] END, ['CONSISTENT_COMPRESSION']) END) END"""


def judged(t):
    named = gated(t).withColumns({"doc_number": F.col("pan_number"), "name": F.lit(None).cast("string")})
    return verdict.with_verdict(named)


@query("document_reasons", f"SELECT image_id, array_to_string({_REASONS}, ' | ') AS reasons FROM {VERDICT}")
def document_reasons(t):
    return judged(t).select("image_id", F.array_join(verdict.document_reasons(), " | ").alias("reasons"))


@query("evidence_signals", f"""
SELECT image_id, source_display AS document_source, gate_status AS quality_gate, CASE WHEN is_digital THEN 'NOT_APPLICABLE' ELSE {_one('glare_ratio * 100')} || '%' END AS camera_glare,
  {_one('ela_std')} || ' std dev' AS tampering_variance, CASE WHEN verhoeff_ok IS NULL THEN 'N/A' WHEN verhoeff_ok THEN 'VALID' ELSE 'FAILED' END AS checksum_verhoeff,
  CASE WHEN pan_number IS NULL THEN 'N/A' ELSE 'VALID' END AS pan_status, mrz_status, barcode_status, {_one('ocr_confidence')} || '%' AS ocr_confidence FROM {GATE}""")
def evidence_signals(t):
    keys = ("document_source", "quality_gate", "camera_glare", "tampering_variance", "checksum_verhoeff", "pan_status", "mrz_status",
            "barcode_status", "ocr_confidence")
    # Without the boundary, source, gate and texts become one method, larger than the JVM compiles.
    read = ("width", "height", "blur", "luminance", "contrast", "glare_ratio", "skew_deg", "top_std", "bottom_std", "left_std", "right_std", "ela_std",
            "verhoeff_ok", "pan_number", "mrz_status", "barcode_status", "ocr_confidence", "document_type", "source_type", "is_digital", "glare_applicable", "blur_applicable")
    sourced = compute_once(quality.with_source(t.image_metrics).select("image_id", *read))
    signals = verdict.evidence_signals()
    return quality.quality_gate(quality.refine_source(sourced)).select("image_id", *[signals[k].alias(k) for k in keys])


@query("document_verdict_v1", f"""
SELECT image_id, CAST(s AS DOUBLE) AS score_v1, CASE WHEN s >= 65 OR t >= 70 OR c >= 50 THEN 'HIGH RISK' WHEN s >= 30 OR t >= 35 THEN 'SUSPICIOUS' ELSE 'VERIFIED' END AS decision_v1
FROM (SELECT *, round(least(100, greatest(0, t * CAST(0.40 AS decimal(3,2)) + least(100, c) * CAST(0.35 AS decimal(3,2)) + greatest(0, 100 - ocr_confidence) * CAST(0.15 AS decimal(3,2)) + CASE WHEN blur < 45 THEN 3 ELSE 0 END)), 1) AS s
FROM (SELECT *, {tampering_sql(TAMPER_V1)} AS t, CASE WHEN mrz_status = 'FAILED' THEN 55 ELSE 0 END + CASE barcode_status WHEN 'MISMATCH' THEN 50 WHEN 'INVALID' THEN 25 ELSE 0 END AS c FROM <image_metrics>))""")
def document_verdict_v1(t):
    df = verdict.with_verdict_v1(t.image_metrics.withColumn("is_blurry", F.col("blur") < 45), TAMPER_V1)
    return df.select("image_id", F.col("score_v1").cast("double").alias("score_v1"), "decision_v1")


@query("analysis_methods", f"""
WITH v AS (SELECT * FROM {VERDICT})
SELECT method, count(*) AS documents, count(*) FILTER (passed) AS passed FROM (
SELECT 'Document Quality Gate' AS method, gate_status = 'PASSED' AS passed FROM v UNION ALL SELECT 'Document Authenticity (ELA)', tampering_score < 50 FROM v
UNION ALL SELECT 'Text & Identity Parser', is_readable FROM v UNION ALL SELECT 'Number / MRZ Checksums', coalesce(verhoeff_ok, mrz_status <> 'FAILED') FROM v
UNION ALL SELECT '2D Barcode & QR Scanner', barcode_status <> 'MISMATCH' FROM v) GROUP BY 1""")
def analysis_methods(t):
    rows = judged(t).select(F.explode(verdict.analysis_methods()).alias("m")).select("m.method", "m.passed")
    return rows.groupBy("method").agg(F.count("*").alias("documents"), F.count_if("passed").alias("passed"))


# --- Faces ------------------------------------------------------------------------------------------
_PAIRS = """(SELECT d.case_id, d.vec_id, d.embedding::DOUBLE[] AS a, list_transform(list_zip(d.embedding::DOUBLE[], s.embedding::DOUBLE[]), lambda p: (d.vec_id % 11) * CAST(0.1 AS DOUBLE) * p[1] + (1 - (d.vec_id % 11) * CAST(0.1 AS DOUBLE)) * p[2]) AS b,
  CASE WHEN d.vec_id % 20 = 0 THEN 0 ELSE 1 END AS doc_face_count, CASE d.vec_id % 14 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS selfie_face_count
  FROM <face_sides> d JOIN <face_sides> s ON d.case_id = s.case_id AND d.side = 0 AND s.side = 1)"""


def pairs(t):
    sides = t.face_sides
    docs = sides.filter("side = 0").select("case_id", "vec_id", F.col("embedding").alias("doc_embedding"))
    other = sides.filter("side = 1").select("case_id", F.col("embedding").alias("other"))
    share = (F.col("vec_id") % 11) * F.lit(0.1)
    blend = F.zip_with("doc_embedding", "other", lambda x, y: share * x.cast("double") + (F.lit(1) - share) * y.cast("double"))
    both = docs.join(other, "case_id").withColumns({
        "selfie_embedding": blend,
        "doc_face_count": F.when(F.col("vec_id") % 20 == 0, 0).otherwise(1),
        "selfie_face_count": F.when(F.col("vec_id") % 14 == 0, 0).when(F.col("vec_id") % 14 == 2, 2).otherwise(1),
    })
    keys = ("case_id", "vec_id", "doc_face_count", "selfie_face_count", "doc_embedding")
    # A second selfie of every case comes later and is not the one that is compared.
    selfies = both.select("case_id", F.lit(1).alias("seq"), "selfie_embedding").unionByName(
        both.select("case_id", F.lit(2).alias("seq"), F.transform("doc_embedding", lambda x: x.cast("double")).alias("selfie_embedding"))
    )
    return faces.face_pairs(both.select(*keys, F.lit(1).alias("seq")), selfies, ("seq",))


_COS = "list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))"
_CAL = "round(CAST(CASE WHEN cosine >= 0.363 THEN least(99.5, 70.0 + (cosine - 0.363) / (0.80 - 0.363) * 29.5) ELSE greatest(10.0, cosine / 0.363 * 69.9) END AS decimal(18,6)), 1)"


@query("face_pairs", f"""
SELECT case_id, CAST(round(CAST(cosine AS decimal(18,8)), 4) AS DOUBLE) AS cosine, CAST(round(CAST(sqrt(greatest(0, 2 - 2 * cosine)) AS decimal(18,8)), 4) AS DOUBLE) AS l2, CAST({_CAL} AS DOUBLE) AS similarity
FROM (SELECT *, {_COS} AS cosine FROM {_PAIRS})""")
def face_pairs(t):
    df = pairs(t)
    four = lambda c: F.round(c.cast("decimal(18,8)"), 4).cast("double")
    return df.select(
        "case_id", four(F.col("cosine")).alias("cosine"), four(faces.normalized_l2(F.col("doc_embedding"), F.col("selfie_embedding"))).alias("l2"),
        F.col("similarity").cast("double").alias("similarity"))


@query("histogram_similarity", f"""
SELECT case_id, CAST(round(least(95, greatest(30, CAST(50 + 45 * r AS decimal(18,6)))), 1) AS DOUBLE) AS similarity FROM (SELECT case_id,
  (list_dot_product(a, b) - len(a) * list_avg(a) * list_avg(b)) / sqrt((list_dot_product(a, a) - len(a) * list_avg(a) * list_avg(a)) * (list_dot_product(b, b) - len(b) * list_avg(b) * list_avg(b))) AS r FROM {_PAIRS})""")
def histogram_similarity(t):
    return pairs(t).select(
        "case_id", faces.histogram_similarity(F.col("doc_embedding"), F.col("selfie_embedding")).cast("double").alias("similarity"))


_FACE = f"""(SELECT *, coalesce(input_error, CASE WHEN s < 70 THEN 'FACE_MISMATCH' END) AS error_code, input_error IS NULL AND s >= 70 AS passed FROM (SELECT case_id, {_CAL} AS s,
  CASE WHEN doc_face_count = 0 THEN 'NO_DOC_FACE' WHEN selfie_face_count = 0 THEN 'NO_SELFIE_FACE' WHEN selfie_face_count > 1 THEN 'MULTIPLE_SELFIE_FACES' END AS input_error
  FROM (SELECT *, {_COS} AS cosine FROM {_PAIRS})))"""


@query("face_verdict", f"""
SELECT case_id, error_code, CASE WHEN passed THEN 'PASSED' ELSE 'FAILED' END AS face_status, CAST(CASE WHEN input_error IS NULL THEN s ELSE 0 END AS DOUBLE) AS similarity,
  CAST(CASE WHEN input_error IS NOT NULL THEN 0 ELSE round(least(CAST(99.8 AS decimal(18,6)), greatest(CAST(70 AS decimal(18,6)), CASE WHEN passed THEN CAST((s - 70) * CAST(0.8 AS decimal(2,1)) + 75 AS decimal(18,6)) ELSE CAST(s * CAST(0.9 AS decimal(2,1)) AS decimal(18,6)) END)), 1) END AS DOUBLE) AS match_confidence,
  CASE WHEN input_error = 'NO_DOC_FACE' THEN 1 WHEN input_error IS NOT NULL THEN 2 ELSE 3 END AS details FROM {_FACE}""")
def face_verdict(t):
    return faces.with_face_verdict(pairs(t)).select(
        "case_id", "error_code", "face_status", F.col("similarity").cast("double").alias("similarity"),
        F.col("match_confidence").cast("double").alias("match_confidence"), F.size("face_details").alias("details"))


@query("primary_faces", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN width >= 40 AND height >= 40 THEN 0 ELSE 1 END, seq, width, height) AS rn, width >= 40 AND height >= 40 AS ok FROM <face_boxes>)
SELECT image_id, count(*) FILTER (ok) AS face_count, max(CASE WHEN rn = 1 AND ok THEN seq END) AS seq, max(CASE WHEN rn = 1 AND ok THEN width END) AS width FROM f GROUP BY 1""")
def primary_faces(t):
    return faces.primary_faces(t.face_boxes).select("image_id", "face_count", "face.seq", "face.width")


@query("crop_quality", """
SELECT blur >= 20 AND luminance BETWEEN 25 AND 245 AS crop_passed, blur < 20 AS is_blurry, luminance < 25 AS is_dark, luminance > 245 AS is_overexposed, count(*) AS crops FROM <face_boxes> GROUP BY 1, 2, 3, 4""")
def crop_quality(t):
    flags = faces.crop_quality()
    return t.face_boxes.select(*[c.alias(n) for n, c in flags.items()]).groupBy(*flags).agg(F.count("*").alias("crops"))
