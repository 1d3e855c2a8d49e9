"""Screening inputs derived from the given tables.

The given tables hold no identity numbers, barcodes or camera frames, so these inputs are
computed from keys and values of every row. One SQL text per input serves Spark and DuckDB.
Nothing is filtered: each input is as large as the table behind it.
"""

from pyspark.sql import DataFrame, SparkSession

from docuvet.sources.tables import read_dealt, read_table

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

# Tables from whose rows whole documents are read: some 0.4 ms of search a row, where a file of one row group is one task.
COSTLY = {"customer": "c_custkey"}

# Frames of the test data lie minutes apart, so their time chunks are days.
CHUNK_DAY = 86400

_KEYS = """
  SELECT c_custkey AS k, c_mktsegment AS seg, c_custkey % 8 AS kind, c_custkey % 24 AS third,
    CAST(234567890124 + c_custkey AS STRING) AS n,
    lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS dd,
    lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') AS mm,
    CAST(1950 + c_custkey % 56 AS STRING) AS yyyy,
    substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', CAST(1 + 3 * (c_custkey % 12) AS INT), 3) AS mon,
    CASE WHEN c_custkey % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END AS sex,
    CAST(110001 + c_custkey % 800000 AS STRING) AS pin,
    lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0') AS seven,
    chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + c_custkey % 25 AS INT)) || 'X'
      || substr('PCZHP', CAST(1 + c_custkey % 5 AS INT), 1) || 'Q'
      || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || 'K' AS pan
  FROM {customer}
"""

SQL = {
    # One text per customer: eight kinds of document, some unreadable.
    "id_docs": f"""
SELECT k AS doc_id, CASE kind
  WHEN 0 THEN 'GOVERNMENT OF INDIA' || chr(10) || 'NAME: APPLICANT ' || seg || chr(10) || 'DOB: ' || dd || '/' || mm || '/' || yyyy
    || chr(10) || 'GENDER: ' || sex || chr(10) || 'AADHAAR NO: ' || substr(n, 1, 4) || ' ' || substr(n, 5, 4) || ' ' || substr(n, 9, 4)
  WHEN 1 THEN 'UNIQUE IDENTIFICATION AUTHORITY OF INDIA' || chr(10) || 'Ravi ' || seg || chr(10) || 'Meraaadhaarmeripehchaan' || chr(10) || 'D0B: ' || dd || '-' || mm || '-' || yyyy
    || chr(10) || 'SEX: ' || substr(sex, 1, 1) || chr(10) || substr(n, 1, 4) || '-' || substr(n, 5, 4) || '-' || substr(n, 9, 4)
    || chr(10) || 'ADDRESS: H NO ' || CAST(k AS STRING) || ', MG ROAD,' || chr(10) || 'PUNE ' || pin || chr(10) || 'help@uidai.gov.in 1947'
  WHEN 2 THEN 'INCOME TAX DEPARTMENT' || chr(10) || 'GOVT OF INDIA' || chr(10) || 'Name: David ' || seg || chr(10)
    || 'Date of Birth: ' || dd || ' ' || mon || ' ' || yyyy || chr(10) || 'Permanent Account Number' || chr(10) || pan
  WHEN 3 THEN 'REPUBLIC OF UTOPIA' || chr(10) || 'PASSPORT' || chr(10) || 'PASSPORT NUMBER' || chr(10) || 'CY' || seven || chr(10)
    || 'SURNAME: ' || seg || chr(10) || 'GIVEN NAMES: ANNA MARIA' || chr(10) || 'NATIONALITY: UTOPIAN' || chr(10) || 'SEX: ' || substr(sex, 1, 1)
    || chr(10) || 'DATE OF BIRTH: ' || dd || '/' || mm || '/' || yyyy || chr(10) || 'DATE OF ISSUE: ' || dd || '/' || mm || '/2019'
    || chr(10) || 'EXPIRY: ' || dd || ' ' || mon || ' 2029'
  WHEN 4 THEN 'DRIVING LICENCE' || chr(10) || 'Priya ' || seg || chr(10) || 'DOB: ' || dd || '.' || mm || '.' || yyyy || chr(10)
    || 'MH-12 2011' || seven || chr(10) || 'VALID TILL: ' || dd || '/' || mm || '/2027' || chr(10) || 'S/O RAM KUMAR, 12 STATION ROAD, NASHIK ' || pin
  WHEN 5 THEN 'ELECTION COMMISSION' || chr(10) || 'ELECTOR PHOTO IDENTITY CARD' || chr(10) || 'Meena ' || seg || chr(10)
    || 'YEAR OF BIRTH: ' || yyyy || chr(10) || 'FLAT 4, LAKE VIEW, BHOPAL ' || pin
  WHEN 6 THEN '  ' || seg || '   desk ' || chr(10) || chr(10) || dd || '/' || mm || '/' || yyyy || chr(10) || CASE
      WHEN third < 8 THEN substr(n, 1, 4) || ' ' || substr(n, 5, 4) || ' ' || substr(n, 9, 4)
      WHEN third < 16 THEN pan ELSE 'MH12 2011' || seven END
  ELSE CASE WHEN third < 8 THEN ' ' || chr(10) || ' ' WHEN third < 16 THEN 'reception desk' ELSE 'ID NO: AB/' || seven || ' ' || 'UIDAI' END
  END AS raw_text
FROM ({_KEYS})""",
    # Three machine readable zones per customer, one in each format. Line 1 and the check digits are
    # written by the query under test from these parts.
    "mrz_parts": """
SELECT c_custkey AS doc_id, CAST(c_custkey % 3 AS INT) AS kind,
  'CY' || lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0') AS num,
  lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0')
    || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS dob,
  CAST(26 + c_custkey % 10 AS STRING) || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0')
    || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS expiry,
  CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE '<' END AS sex,
  'APPLICANT<<' || c_mktsegment AS holder,
  CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS shift_number,
  CASE WHEN c_custkey % 14 = 0 THEN 1 ELSE 0 END AS shift_composite
FROM {customer}""",
    # Decoded barcodes: none, one or two per document, with conflicting and damaged ones.
    "barcodes": f"""
SELECT k AS doc_id, seq, CASE WHEN seq = 1 THEN 'QRCode' ELSE 'PDF417' END AS format,
  CASE WHEN k % 11 = 0 AND seq = 1 THEN false ELSE true END AS is_valid,
  CASE
    WHEN seq = 1 AND k % 5 = 0 THEN ''
    WHEN seq = 2 AND k % 7 <> 0 THEN '  '
    WHEN seq = 2 THEN 'NAME: ' || seg || ' DOB ' || yyyy || mm || dd
    WHEN kind IN (0, 1, 7) THEN CASE WHEN k % 3 = 0 THEN '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) ELSE '' END || '<PrintLetterBarcodeData uid="' || n || '" name="' || CASE WHEN k % 6 = 0 THEN 'SOMEONE ELSE'
        WHEN kind = 0 THEN 'APPLICANT ' || seg WHEN k % 9 = 0 THEN 'RAVI&#32;' || seg WHEN k % 9 = 3 THEN 'RAVI&#x20;' || seg ELSE 'RAVI ' || seg END
      || '" Gender="' || substr(sex, 1, 1) || '" yob="' || CASE WHEN k % 16 = 8 THEN '1949' ELSE yyyy END
      || '" dist="PUNE" pc="' || CASE WHEN k % 10 = 1 THEN '999999' ELSE pin END || '"/>'
    WHEN kind = 2 THEN 'NAME: ' || CASE WHEN k % 6 = 2 THEN 'OTHER PERSON' ELSE 'DAVID ' || seg END || ' ID: ' || pan || ' ' || yyyy || mm || dd
    WHEN kind = 4 THEN 'DL: ' || CASE WHEN k % 6 = 4 THEN 'KA01ZZ9999' ELSE 'MH122011' || seven END || ' NAM: PRIYA ' || seg
    ELSE 'TICKET ' || seven || ' ' || yyyy || '-' || mm || '-' || dd END AS raw_text
FROM (SELECT *, 1 AS seq FROM ({_KEYS}) UNION ALL SELECT *, 2 AS seq FROM ({_KEYS}))""",
    # Module results per case.
    "signals": """
SELECT o_orderkey AS case_id, o_custkey AS owner_id, o_orderdate AS screened_at,
  CAST(o_orderkey * 37 % 1000 AS decimal(9,0)) * 0.1 AS tampering_score,
  CAST(100 - (o_orderkey % 45) AS decimal(9,1)) AS similarity,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 11 <> 0 END AS verhoeff_ok,
  CASE WHEN o_orderkey % 13 = 0 THEN 'FAILED' ELSE 'VERIFIED' END AS mrz_status,
  CASE WHEN o_orderkey % 17 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS barcode_status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 19 <> 0 END AS liveness_passed,
  o_orderkey % 23 <> 0 AS is_readable, o_orderkey % 29 = 0 AS recapture
FROM {orders}""",
    # States of the screening stages per case.
    "stages": """
SELECT o_orderkey AS case_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RECAPTURE_REQUIRED' WHEN 2 THEN 'READY' ELSE 'PASSED' END AS document_state,
  CASE o_orderkey % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'LOCKED' ELSE 'PASSED' END AS liveness_state,
  CASE o_orderkey % 11 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'LOCKED' ELSE 'PASSED' END AS face_state,
  CASE o_orderkey % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'READY' ELSE 'LOCKED' END AS risk_state,
  CASE o_orderkey % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'READY' ELSE 'LOCKED' END AS decision_state
FROM {orders}""",
    # Capture metrics per image; one image per order line.
    "image_metrics": """
SELECT l_orderkey * 8 + l_linenumber AS image_id, l_partkey AS part_id,
  CAST(300 + (l_orderkey * 13 + l_linenumber * 7) % 1300 AS INT) AS width,
  CAST(300 + (l_orderkey * 17 + l_linenumber * 5) % 900 AS INT) AS height,
  CAST((l_orderkey * 31 + l_linenumber) % 2000 AS decimal(9,1)) * 0.1 AS blur,
  CAST((l_orderkey * 7 + l_linenumber * 3) % 2560 AS decimal(9,1)) * 0.1 AS luminance,
  CAST((l_orderkey * 11 + l_linenumber) % 800 AS decimal(9,1)) * 0.1 AS contrast,
  CAST((l_orderkey * 19) % 300 AS decimal(9,3)) * 0.001 AS glare_ratio,
  CAST((l_orderkey * 23 + l_linenumber) % 500 - 250 AS decimal(9,1)) * 0.1 AS skew_deg,
  CAST(l_orderkey % 80 AS decimal(9,1)) AS top_std, CAST(l_orderkey * 3 % 80 AS decimal(9,1)) AS bottom_std,
  CAST(l_orderkey * 7 % 80 AS decimal(9,1)) AS left_std, CAST(l_linenumber * 11 % 80 AS decimal(9,1)) AS right_std,
  CAST((l_orderkey * 29 + l_linenumber) % 700 AS decimal(9,1)) * 0.1 AS ela_std,
  CAST((l_orderkey * 5 + l_linenumber * 13) % 500 AS decimal(9,1)) * 0.1 AS texture_std,
  CAST((l_orderkey * 3 + l_linenumber * 17) % 2400 AS decimal(9,1)) * 0.1 AS edge_p95,
  CAST(l_orderkey * 3 % 100 AS decimal(9,2)) * 0.01 AS white_ratio,
  CAST(l_orderkey * 7 % 60 AS decimal(9,1)) * 0.1 AS white_std,
  CAST(l_orderkey * 13 % 50 AS decimal(9,2)) * 0.01 AS color_sparsity,
  CAST(l_orderkey * 17 % 2000 AS decimal(9,1)) AS p99_gradient,
  CASE WHEN l_orderkey % 13 = 0 THEN 'Screenshot_' || CAST(l_orderkey AS STRING) || '.png'
    WHEN l_orderkey % 17 = 0 THEN 'copy.' || CAST(l_orderkey AS STRING) || '.PDF' ELSE 'photo.jpg' END AS filename,
  CASE WHEN l_orderkey % 19 = 0 THEN 'application/pdf' ELSE 'image/jpeg' END AS mime_type,
  CASE WHEN l_orderkey % 23 = 0 THEN 'EPSON Scan' WHEN l_orderkey % 29 = 0 THEN 'Screen Grab' ELSE '' END AS software,
  l_orderkey % 4 = 0 AS has_camera_exif,
  CASE l_orderkey % 5 WHEN 0 THEN 'NATIONAL_ID (AADHAAR)' WHEN 1 THEN 'NATIONAL_ID (PAN)' WHEN 2 THEN 'PASSPORT' ELSE 'UNKNOWN' END AS document_type,
  CAST(l_orderkey * 41 % 100 AS decimal(9,1)) AS ocr_confidence, l_orderkey % 3 = 0 AS has_ocr_warning, l_orderkey % 31 <> 0 AS is_readable,
  CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey % 10 <> 0 END AS verhoeff_ok,
  CASE WHEN l_orderkey % 5 = 1 AND l_orderkey % 4 <> 0 THEN 'ABCPX1234K' END AS pan_number,
  CASE WHEN l_orderkey % 5 <> 2 THEN 'NOT_APPLICABLE' WHEN l_orderkey % 3 = 0 THEN 'FAILED' ELSE 'VERIFIED' END AS mrz_status,
  CASE l_orderkey % 9 WHEN 0 THEN 'MISMATCH' WHEN 1 THEN 'MATCH' WHEN 2 THEN 'INVALID' ELSE 'NOT_FOUND' END AS barcode_status
FROM {lineitem}""",
    # Anomaly boxes and straight line segments found in the images of an order.
    "regions": """
SELECT l_orderkey AS image_id, l_linenumber AS seq, 1000 AS img_w, 800 AS img_h,
  CAST(l_partkey % 700 AS INT) AS x, CAST(l_suppkey % 500 AS INT) AS y,
  CAST(10 + l_partkey * 7 % 290 AS INT) AS w, CAST(10 + l_suppkey * 3 % 200 AS INT) AS h,
  CAST(l_partkey % 360 - 180 AS INT) AS angle
FROM {lineitem}""",
    # Portrait and selfie embeddings per case: neighbouring vectors, blended so that some match.
    "face_sides": """
SELECT CAST(floor(vec_id / 2) AS BIGINT) AS case_id, vec_id, CAST(vec_id % 2 AS INT) AS side, embedding FROM {embeddings}""",
    # Detected face boxes per portrait and selfie image.
    "face_boxes": """
SELECT l_orderkey AS image_id, l_linenumber AS seq, CAST(20 + l_partkey % 60 AS INT) AS width, CAST(20 + l_suppkey % 60 AS INT) AS height,
  CAST(l_partkey * 3 % 500 AS decimal(9,1)) * 0.1 AS blur, CAST(l_suppkey * 7 % 256 AS decimal(9,1)) AS luminance
FROM {lineitem}""",
    # Camera frames per user.
    "frames": """
SELECT user_id AS session_id, CAST(ts AS timestamp) AS ts, event_id,
  CASE event_type WHEN 'click' THEN 'TURN_LEFT' WHEN 'purchase' THEN 'TURN_RIGHT' ELSE 'BLINK_TWICE' END AS challenge,
  CAST(CASE WHEN event_type = 'error' AND event_id % 16 = 0 THEN 0 WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS INT) AS face_count,
  CAST(5 + event_id * 7 % 36 AS decimal(9,2)) * 0.01 AS ear_l, CAST(5 + event_id * 11 % 36 AS decimal(9,2)) * 0.01 AS ear_r,
  CAST(event_id * 5 % 61 - 30 AS decimal(9,1)) AS yaw
FROM {events}""",
    # Submitted results: several versions of a case, each shared by two owners.
    "history": """
SELECT o_custkey AS owner_id, CAST(floor(o_custkey / 2) AS BIGINT) * 4 + o_orderkey % 4 AS case_id, o_orderdate AS timestamp, o_orderkey AS version,
  'Applicant ' || CAST(o_custkey % 97 AS STRING) AS applicant_name,
  CASE o_orderkey % 4 WHEN 0 THEN 'PASSPORT' WHEN 1 THEN 'NATIONAL_ID (PAN)' WHEN 2 THEN 'VOTER_ID' ELSE 'NATIONAL_ID (AADHAAR)' END AS document_type,
  CASE o_orderkey % 10 WHEN 0 THEN 'HIGH RISK' WHEN 1 THEN 'SUSPICIOUS' WHEN 2 THEN 'RECAPTURE REQUIRED' ELSE 'VERIFIED' END AS final_decision
FROM {orders}""",
    # Registered users, one per customer, and a batch of new registrations from suppliers.
    "users": """
SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@example.org' AS email, lower(c_name) AS username,
  CASE WHEN c_custkey % 10 = 0 THEN 'ADMIN' WHEN c_custkey % 2 = 0 THEN 'ORGANISATION' ELSE 'INDIVIDUAL' END AS role,
  CASE WHEN c_custkey % 2 = 0 THEN 'Desk ' || c_mktsegment ELSE '' END AS org_name
FROM {customer}""",
    "registrations": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_suppkey % 13 = 0 THEN 'no-address' ELSE ' Customer.' || lpad(CAST(l_partkey AS STRING), 9, '0') || '@Example.org ' END AS email,
  CASE l_linenumber % 3 WHEN 0 THEN 'organisation' WHEN 1 THEN 'INDIVIDUAL' ELSE NULL END AS role,
  CASE WHEN l_orderkey % 2 = 0 THEN 'user' || CAST(l_orderkey AS STRING) END AS username,
  CASE WHEN l_orderkey % 3 = 0 THEN 'Person ' || CAST(l_suppkey AS STRING) END AS full_name,
  CASE WHEN l_orderkey % 5 = 0 THEN 'Org ' || CAST(l_suppkey AS STRING) END AS org_name,
  CAST(NULL AS STRING) AS org_id, CAST(NULL AS STRING) AS org_type, CAST(NULL AS STRING) AS authorized_person
FROM {lineitem}""",
    # Uploaded files.
    "uploads": """
SELECT l_orderkey * 8 + l_linenumber AS upload_id,
  CASE l_orderkey % 9 WHEN 0 THEN 'scan' WHEN 1 THEN 'scan.tar.gz' WHEN 2 THEN 'id.PDF' WHEN 3 THEN 'a.b.JPEG' WHEN 4 THEN 'x.webp'
    WHEN 5 THEN 'y.jpg' WHEN 6 THEN 'notes.txt' WHEN 7 THEN '' ELSE 'z.png' END AS filename,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 7 = 0 THEN 0 ELSE CAST(l_partkey * 20011 AS BIGINT) END AS size_bytes
FROM {lineitem}""",
    # Dates as they are printed on documents.
    "date_texts": """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 9
    WHEN 0 THEN lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)
    WHEN 1 THEN CAST(year(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) || '-' || CAST(day(o_orderdate) AS STRING)
    WHEN 2 THEN 'born ' || CAST(day(o_orderdate) AS STRING) || ' ' || substr('JanuaryFebruarMarchxxAprilxxMayxxxxJunexxxJulyxxxAugustxSeptembOctoberNovembeDecembe', CAST(1 + 7 * (month(o_orderdate) - 1) AS INT), 3) || '  ' || CAST(year(o_orderdate) AS STRING)
    WHEN 3 THEN CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
    WHEN 4 THEN 'YEAR ' || CAST(year(o_orderdate) AS STRING)
    WHEN 5 THEN 'n/a'
    WHEN 6 THEN ' ' || CAST(day(o_orderdate) AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) || '.' || CAST(year(o_orderdate) + 30 AS STRING)
    WHEN 7 THEN '' ELSE '31 feb ' || CAST(year(o_orderdate) AS STRING) END AS printed
FROM {orders}""",
    # Labelled scores of an attack detector.
    "scored": """
SELECT doc_id, toxic AS is_attack, quality, CAST(n_chars % 1000 AS decimal(9,3)) * 0.001 AS score, lang
FROM {documents} JOIN {labels} USING (doc_id)""",
}


# Capture metrics, face and liveness results per customer document, for whole-screening queries.
_MODULE_RESULTS = ("document_type", "ocr_confidence", "has_ocr_warning", "is_readable", "verhoeff_ok", "pan_number", "mrz_status",
                   "barcode_status")
SQL["document_metrics"] = SQL["image_metrics"].replace("{lineitem}", "{customer}").replace("l_orderkey * 8 + l_linenumber AS image_id", "c_custkey AS doc_id").replace(
    "l_orderkey", "c_custkey").replace("l_linenumber", "(c_custkey % 7)").replace("l_partkey AS part_id", "c_custkey AS part_id")
SQL["case_faces"] = """
SELECT c_custkey AS case_id, CASE WHEN c_custkey % 4 = 0 THEN 'FAILED' ELSE 'PASSED' END AS face_status, CAST(100 - c_custkey % 45 AS decimal(9,1)) AS similarity
FROM {customer}"""
SQL["case_liveness"] = """
SELECT c_custkey AS case_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 7 <> 0 END AS liveness_passed FROM {customer}"""
# Records of persons, written up to three times: in another order, with a letter or a digit missing, with another date.
SQL["person_records"] = """
SELECT c_custkey AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'Anna ' || last WHEN 1 THEN upper(last) || ', ANNA' ELSE 'Ana  ' || last END AS name,
  CASE WHEN c_custkey % 21 = 20 THEN NULL WHEN c_custkey % 12 = 11 THEN '1999-12-31' WHEN b % 50 = 0 THEN '1990-01-01' ELSE CAST(1950 + b % 50 AS STRING) || '-01-' || lpad(CAST(1 + b % 28 AS STRING), 2, '0') END AS dob,
  CASE WHEN c_custkey % 15 = 14 THEN '' WHEN b % 40 = 7 THEN 'N0000-0000' WHEN c_custkey % 3 = 1 THEN substr(number, 1, 4) || substr(number, 6) ELSE number END AS doc_number
FROM (SELECT c_custkey, b, 'K' || CAST(100000 + b * 7919 % 900001 AS STRING) AS last, 'P' || CAST(10000000 + b * 104729 % 90000001 AS STRING) AS number
  FROM (SELECT c_custkey, CAST(floor(c_custkey / 3) AS BIGINT) AS b FROM {customer}))"""
# Results of a case as three streams: face results come within minutes, some liveness results too late or never.
SQL["case_documents"] = SQL["signals"].replace("CAST(100 - (o_orderkey % 45) AS decimal(9,1)) AS similarity,", "").replace(
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 19 <> 0 END AS liveness_passed,", "").replace(
    "o_orderdate AS screened_at", "CAST(o_orderdate AS timestamp) AS screened_at")
SQL["case_face_results"] = """
SELECT o_orderkey AS case_id, CAST(o_orderdate AS timestamp) + INTERVAL 1 SECOND * (o_orderkey % 900 - 300) AS compared_at, CAST(100 - (o_orderkey % 45) AS decimal(9,1)) AS similarity
FROM {orders} WHERE o_orderkey % 6 <> 0"""
SQL["case_liveness_results"] = """
SELECT o_orderkey AS case_id, CAST(o_orderdate AS timestamp) + INTERVAL 1 SECOND * (o_orderkey % 750) AS checked_at, o_orderkey % 19 <> 0 AS liveness_passed
FROM {orders} WHERE o_orderkey % 5 <> 0"""
# Fraud labels and analyst overrides per case.
SQL["case_truth"] = "SELECT o_orderkey AS case_id, o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 37 = 0 AS is_fraud FROM {orders}"
SQL["overrides"] = """
SELECT o_orderkey AS case_id, l_linenumber AS override_id, l_shipdate AS acted_at, 'analyst' || CAST(l_suppkey % 7 AS STRING) AS analyst,
  CASE l_partkey % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'HIGH RISK' ELSE 'SUSPICIOUS' END AS action, l_partkey AS partkey, l_suppkey AS suppkey
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"""


class Inputs:
    """Given and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        return read_dealt(self.spark, path, COSTLY[name]) if name in COSTLY else read_table(self.spark, path)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name not in SQL:
            raise AttributeError(name)
        used = {t: self.base(t) for t in BASE_TABLES if "{" + t + "}" in SQL[name]}
        return self.spark.sql(SQL[name], **used)


def duckdb_sql(name: str) -> str:
    """The same input as a DuckDB subquery."""
    text = SQL[name]
    for table in BASE_TABLES:
        text = text.replace("{" + table + "}", table)
    return f"({text})"
