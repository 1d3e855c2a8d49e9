"""Machine readable zone and barcode queries."""

from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.checksums import icao_check_digit
from docuvet.operators import barcodes, fields, mrz
from docuvet.plans.document_queries import (
    digits_sql, icao_sql, id_docs, rx, strip_sql, validated, validated_sql,
)
from docuvet.plans.registry import query, re2


def mrz_docs(t):
    """Zones written from the parts of each customer: passports, cards and visas in turn."""
    p = t.mrz_parts
    # Fillers weigh nothing, so data of any length within the width has the digit of the filled width.
    digit = lambda s, width, shift="": (icao_check_digit(F.rpad(s, width, "<"), width) + (F.col(shift) if shift else 0)) % 10
    text = lambda c: c.cast("string")
    p = p.withColumns({
        "num": F.concat("num", text(digit(F.col("num"), 9, "shift_number"))),
        "dob": F.concat("dob", text(digit(F.col("dob"), 6))),
        "expiry": F.concat("expiry", text(digit(F.col("expiry"), 6))),
    })
    comp = F.when(F.col("kind") == 0, F.concat("num", "dob", "expiry", F.lit("<" * 15))).otherwise(
        F.concat("num", F.lit("<" * 15), "dob", "expiry", F.lit("<" * 11)))
    p = p.withColumn("comp", text(digit(comp, 51, "shift_composite")))
    fill = lambda n: F.lit("<" * n)
    head = lambda code, width: F.rpad(F.concat(F.lit(code + "<UTO"), "holder"), width, "<")
    lines = (
        F.when(F.col("kind") == 0, F.array(head("P", 44), F.concat("num", F.lit("UTO"), "dob", "sex", "expiry", fill(15), "comp")))
        .when(F.col("kind") == 1, F.array(F.concat(F.lit("I<UTO"), "num", fill(15)),
              F.concat("dob", "sex", "expiry", F.lit("UTO"), fill(11), "comp"), F.rpad("holder", 30, "<")))
        .otherwise(F.array(head("I", 36), F.concat("num", F.lit("UTO"), "dob", "sex", "expiry", fill(8))))
    )
    doc_type = F.when(F.col("doc_id") % 10 == 0, fixed.VOTER_ID).otherwise(fixed.PASSPORT)
    # Documents carry other lines around the zone.
    framed = F.concat(F.array(F.lit("REPUBLIC OF UTOPIA")), lines, F.array(F.lit("<<<")))
    return p.select("doc_id", framed.alias("lines"), doc_type.alias("document_type")).withColumn(
        "raw_text", F.array_join("lines", "\n"))


_PARTS = f"""
p0 AS (SELECT *, num || CAST(({icao_sql('num')} + shift_number) % 10 AS VARCHAR) AS n1, dob || CAST({icao_sql('dob')} AS VARCHAR) AS d1, expiry || CAST({icao_sql('expiry')} AS VARCHAR) AS e1 FROM <mrz_parts>),
p1 AS (SELECT *, CASE WHEN kind = 0 THEN n1 || d1 || e1 || repeat('<', 15) ELSE n1 || repeat('<', 15) || d1 || e1 || repeat('<', 11) END AS comp_data FROM p0),
p2 AS (SELECT *, doc_id % 10 = 0 AS skipped, {icao_sql('num')} AS num_cd, CAST(substr(n1, 10, 1) AS INT) AS num_seen, {icao_sql('comp_data')} AS comp_cd, ({icao_sql('comp_data')} + shift_composite) % 10 AS comp_seen FROM p1)"""


@query("mrz_fields", f"""
WITH {_PARTS}
SELECT doc_id, CASE WHEN skipped THEN 'NOT_APPLICABLE' WHEN shift_number = 0 AND (kind = 2 OR shift_composite = 0) THEN 'VERIFIED' ELSE 'FAILED' END AS mrz_status,
  CASE WHEN skipped THEN 'NONE' ELSE ['TD3', 'TD1', 'TD2'][kind + 1] END AS mrz_format,
  CASE WHEN NOT skipped THEN CASE WHEN kind = 0 THEN 'P' ELSE 'I' END END AS mrz_code, CASE WHEN NOT skipped THEN 'UTO' END AS mrz_country,
  CASE WHEN NOT skipped THEN 'APPLICANT' END AS mrz_surname, CASE WHEN NOT skipped THEN substr(holder, 12) END AS mrz_given_names,
  CASE WHEN NOT skipped THEN num END AS mrz_number, CASE WHEN NOT skipped THEN 'UTO' END AS mrz_nationality,
  CASE WHEN NOT skipped THEN CASE WHEN CAST(substr(dob, 1, 2) AS INT) > 30 THEN '19' ELSE '20' END || substr(dob, 1, 2) || '-' || substr(dob, 3, 2) || '-' || substr(dob, 5, 2) END AS mrz_dob,
  CASE WHEN NOT skipped THEN CASE sex WHEN 'M' THEN 'MALE' WHEN 'F' THEN 'FEMALE' ELSE 'UNSPECIFIED' END END AS mrz_sex,
  CASE WHEN NOT skipped THEN '20' || substr(expiry, 1, 2) || '-' || substr(expiry, 3, 2) || '-' || substr(expiry, 5, 2) END AS mrz_expiry, CAST(NULL AS VARCHAR) AS mrz_optional
FROM p2""")
def mrz_fields(t):
    return mrz.with_mrz(mrz_docs(t)).select("doc_id", *[c for c in mrz.MRZ_FIELDS if c != "mrz_checks"])


@query("mrz_checksums_long", f"""
WITH {_PARTS}
SELECT doc_id, 'document_number' AS field, num AS data, CAST(num_seen AS VARCHAR) AS expected, num_cd AS calculated, num_cd = num_seen AS valid FROM p2 WHERE NOT skipped
UNION ALL SELECT doc_id, 'dob', dob, substr(d1, 7, 1), CAST(substr(d1, 7, 1) AS INT), true FROM p2 WHERE NOT skipped
UNION ALL SELECT doc_id, 'expiry_date', expiry, substr(e1, 7, 1), CAST(substr(e1, 7, 1) AS INT), true FROM p2 WHERE NOT skipped
UNION ALL SELECT doc_id, 'composite', 'Composite String', CAST(comp_seen AS VARCHAR), comp_cd, comp_cd = comp_seen FROM p2 WHERE NOT skipped AND kind <> 2""")
def mrz_checksums_long(t):
    checks = mrz.with_mrz(mrz_docs(t)).select("doc_id", F.explode("mrz_checks").alias("c"))
    return checks.select("doc_id", "c.field", "c.data", "c.expected", "c.calculated", "c.valid")


@query("mrz_strict", f"""
WITH {_PARTS}
SELECT CASE WHEN skipped OR kind = 1 THEN 'NONE' ELSE ['TD3', 'TD1', 'TD2'][kind + 1] END AS mrz_format, count(*) AS documents FROM p2 GROUP BY 1""")
def mrz_strict(t):
    return mrz.with_mrz(mrz_docs(t), compat=True).groupBy("mrz_format").agg(F.count("*").alias("documents"))


# --- Barcodes ------------------------------------------------------------------------------------
@query("qr_attributes", f"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, {re2(fixed.QR_ATTRIBUTE)}, 1)) AS k, unnest(regexp_extract_all(html, {re2(fixed.QR_ATTRIBUTE)}, 2)) AS v,
  generate_subscripts(regexp_extract_all(html, {re2(fixed.QR_ATTRIBUTE)}, 1), 1) AS i FROM pages)
SELECT page_id, lower(k) AS attribute, arg_max(v, i) AS value FROM a GROUP BY 1, 2""")
def qr_attributes(t):
    return t.pages.select("page_id", F.explode_outer(barcodes.quoted_attributes(F.col("html"))).alias("attribute", "value")).filter(
        F.col("attribute").isNotNull())


@query("qr_identity", """
SELECT doc_id, seq, replace(replace(regexp_extract(raw_text, 'name="([^"]*)"', 1), '&#32;', ' '), '&#x20;', ' ') AS qr_name, CASE regexp_extract(raw_text, 'Gender="([^"]*)"', 1) WHEN 'M' THEN 'MALE' ELSE 'FEMALE' END AS qr_gender,
  regexp_extract(raw_text, 'yob="([^"]*)"', 1) || '-01-01' AS qr_dob, 'XXXX-XXXX-' || right(regexp_extract(raw_text, 'uid="([^"]*)"', 1), 4) AS qr_uid_masked,
  regexp_extract(raw_text, 'dist="([^"]*)"', 1) AS qr_district, regexp_extract(raw_text, 'pc="([^"]*)"', 1) AS qr_pin FROM <barcodes> WHERE contains(raw_text, 'uid=')""")
def qr_identity(t):
    codes = t.barcodes.filter(barcodes.has_qr_marker(F.col("raw_text")))
    parts = barcodes.qr_identity(barcodes.qr_attributes(F.col("raw_text")))
    chosen = ("qr_name", "qr_gender", "qr_dob", "qr_uid_masked", "qr_district", "qr_pin")
    return codes.select("doc_id", "seq", *[parts[c].alias(c) for c in chosen])


_STRIPPED = strip_sql("raw_text")
_PRIMARY = f"""(SELECT doc_id, count(DISTINCT t) AS barcode_count, arg_min(format, seq) AS barcode_format, arg_min(t, seq) AS payload, arg_min(is_valid, seq) AS payload_valid
  FROM (SELECT *, {_STRIPPED} AS t FROM <barcodes>) WHERE t <> '' GROUP BY 1)"""


@query("primary_barcodes", f"SELECT * FROM {_PRIMARY}")
def primary_barcodes(t):
    return barcodes.primary_barcode(t.barcodes)


def _row(field, ocr, code, is_match, severity, where):
    return (f"SELECT doc_id, '{field}' AS field, {ocr} AS ocr_value, {code} AS barcode_value, coalesce({is_match}, false) AS is_match, "
            f"CASE WHEN coalesce({is_match}, false) THEN 'LOW' ELSE '{severity}' END AS severity FROM b WHERE payload_valid AND {where}")


_letters = lambda c: f"regexp_replace(upper({c}), '[^A-Z]', '', 'g')"
_clean = lambda c: f"regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"
_C, _N = fixed.COMPARED, fixed.MATCH_NOTES
_NAME_PARTS = f"list_filter(string_split_regex(name, {re2('[' + fixed.WS + ',]+')}), lambda p: length(p) > 2)"
_HITS = f"len(list_filter({_NAME_PARTS}, lambda p: contains(upper(payload), upper(p))))"
_NAME_IN = f"({_HITS} >= greatest(1, len({_NAME_PARTS}) - 1) AND len({_NAME_PARTS}) > 0)"
_ID, _NM = rx("payload", fixed.PAYLOAD_ID), rx("payload", fixed.PAYLOAD_NAME)
_COMPARED = f"""{validated_sql('<id_docs>')},
b AS MATERIALIZED (SELECT v.doc_id, name, gender, dob, address, doc_number, p.* EXCLUDE (doc_id), contains(payload, 'uid=') AS is_qr,
  nullif(replace(replace(regexp_extract(payload, 'name="([^"]*)"', 1), '&#32;', ' '), '&#x20;', ' '), '') AS q_name, CASE regexp_extract(payload, 'Gender="([^"]*)"', 1) WHEN 'M' THEN 'MALE' ELSE 'FEMALE' END AS q_gender,
  regexp_extract(payload, 'yob="([^"]*)"', 1) AS q_yob, regexp_extract(payload, 'pc="([^"]*)"', 1) AS q_pin FROM validated v LEFT JOIN {_PRIMARY} p USING (doc_id)),
cmp AS MATERIALIZED (
{_row(_C['name'], 'name', 'q_name', f"contains({_letters('q_name')}, {_letters('name')}) OR contains({_letters('name')}, {_letters('q_name')})", 'HIGH', 'is_qr AND name IS NOT NULL')}
UNION ALL {_row(_C['gender'], 'gender', 'q_gender', 'q_gender = gender', 'MEDIUM', 'is_qr AND gender IS NOT NULL')}
UNION ALL {_row(_C['dob'], 'dob', "q_yob || '-01-01'", f"contains({digits_sql('dob')}, q_yob || '0101') OR contains(q_yob || '0101', {digits_sql('dob')}) OR contains(dob, q_yob)", 'HIGH', 'is_qr AND dob IS NOT NULL')}
UNION ALL {_row(_C['pin'], 'address', 'q_pin', 'contains(address, q_pin)', 'LOW', 'is_qr AND address IS NOT NULL')}
UNION ALL {_row(_C['id'], 'doc_number', f"CASE WHEN contains({_clean('payload')}, {_clean('doc_number')}) THEN '{_N['id']}' ELSE {_ID} END", f"contains({_clean('payload')}, {_clean('doc_number')})", 'HIGH',
       f"NOT is_qr AND length({_clean('doc_number')}) >= 5 AND (contains({_clean('payload')}, {_clean('doc_number')}) OR upper({_ID}) <> {_clean('doc_number')})")}
UNION ALL {_row(_C['name'], 'name', f"CASE WHEN {_NAME_IN} THEN '{_N['name']}' ELSE {strip_sql(_NM)} END", _NAME_IN, 'HIGH',
       f"NOT is_qr AND name IS NOT NULL AND ({_NAME_IN} OR (len({_NAME_PARTS}) >= 2 AND {_NM} IS NOT NULL))")}
UNION ALL {_row(_C['birth'], 'dob', f"'{_N['birth']}'", 'true', 'LOW', f"NOT is_qr AND length({digits_sql('dob')}) >= 6 AND contains({digits_sql('payload')}, {digits_sql('dob')})")})"""


def compared(t):
    return barcodes.with_barcodes(validated(t), t.barcodes)


@query("cross_match", f"{_COMPARED} SELECT * FROM cmp")
def cross_match(t):
    rows = compared(t).select("doc_id", F.explode("comparisons").alias("c"))
    return rows.select("doc_id", "c.field", "c.ocr_value", "c.barcode_value", "c.is_match", "c.severity")


@query("barcode_status", f"""{_COMPARED},
m AS (SELECT doc_id, count(*) AS comparisons, count(*) FILTER (NOT is_match AND severity = 'HIGH') AS conflicts FROM cmp GROUP BY 1)
SELECT b.doc_id, CASE WHEN payload IS NULL THEN 'NOT_FOUND' WHEN NOT payload_valid THEN 'INVALID' WHEN coalesce(conflicts, 0) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS barcode_status,
  coalesce(barcode_count, 0) AS barcode_count, CAST(coalesce(comparisons, 0) AS INT) AS comparisons,
  CASE WHEN length(payload) > CASE WHEN payload_valid THEN 120 ELSE 100 END THEN substr(payload, 1, CASE WHEN payload_valid THEN 120 ELSE 100 END) || '...' ELSE payload END AS payload_summary
FROM b LEFT JOIN m USING (doc_id)""")
def barcode_status(t):
    return compared(t).select("doc_id", "barcode_status", "barcode_count", F.size("comparisons").alias("comparisons"), "payload_summary")
