"""Check digits, text normalisation, identity fields and document validation queries."""

from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions import checksums, text
from docuvet.operators import fields, validation
from docuvet.plans.registry import query, re2

# --- SQL building blocks ---------------------------------------------------------------------
STRIP = re2(rf"^[{fixed.WS}]+|[{fixed.WS}]+$")
SPACES = re2(rf"[{fixed.WS}]+")
D5 = str(checksums.PRODUCT)
P8 = str([checksums._permuted(d, i) for i in range(8) for d in range(10)])


def strip_sql(x):
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def spaces_sql(x):
    return f"coalesce(trim(regexp_replace({x}, {SPACES}, ' ', 'g')), '')"


def rx(x, pattern, group=1):
    return f"nullif(regexp_extract({x}, {re2(pattern)}, {group}), '')"


def has_any(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def digits_sql(x):
    return f"regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g')"


def verhoeff_state(d, n, shift):
    """State of an n-digit string by one table step per digit."""
    return (
        f"list_reduce(list_prepend(0, list_transform(range(0, {n}), lambda i: ({P8})[((i + {shift}) % 8) * 10 + CAST(substr({d}, CAST({n} - i AS INT), 1) AS INT) + 1])), "
        f"lambda c, p: ({D5})[c * 10 + p + 1])"
    )


def verhoeff_sql(d):
    return f"(regexp_full_match({d}, '[0-9]{{12}}') AND {verhoeff_state(d, 12, 0)} = 0)"


def icao_sql(x):
    value = f"CAST(greatest(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({x}, CAST(i AS INT), 1)) - 1, 0) AS INT)"
    return f"CAST(coalesce(list_sum(list_transform(range(1, length({x}) + 1), lambda i: {value} * ([7, 3, 1])[((i - 1) % 3) + 1])), 0) % 10 AS INT)"


def date_sql(x):
    """ISO form of a printed date held in column ``x``; the text itself where nothing fits."""
    d = f"upper({strip_sql(x)})"

    def ymd(p, y, m, day):
        year, month, dd = rx(d, p, y), rx(d, p, m), rx(d, p, day)
        return (
            f"CASE WHEN CAST({dd} AS INT) BETWEEN 1 AND 31 AND CAST({month} AS INT) BETWEEN 1 AND 12 AND CAST({year} AS INT) BETWEEN 1900 AND 2030 "
            f"THEN {year} || '-' || lpad(CAST(CAST({month} AS INT) AS VARCHAR), 2, '0') || '-' || lpad(CAST(CAST({dd} AS INT) AS VARCHAR), 2, '0') END"
        )

    p = fixed.DATE_D_MON_Y
    mon = f"coalesce(list_position({list(fixed.MONTHS)}, substr({rx(d, p, 2)}, 1, 3)), 0)"
    named = (
        f"CASE WHEN {mon} > 0 AND CAST({rx(d, p, 1)} AS INT) BETWEEN 1 AND 31 AND CAST({rx(d, p, 3)} AS INT) BETWEEN 1900 AND 2030 "
        f"THEN {rx(d, p, 3)} || '-' || lpad(CAST({mon} AS VARCHAR), 2, '0') || '-' || lpad(CAST(CAST({rx(d, p, 1)} AS INT) AS VARCHAR), 2, '0') END"
    )
    exact = f"coalesce({ymd(fixed.DATE_DMY, 3, 2, 1)}, {ymd(fixed.DATE_YMD, 1, 2, 3)}, {named})"
    year = f"CASE WHEN CAST({rx(d, fixed.DATE_YEAR)} AS INT) BETWEEN 1900 AND 2030 THEN {rx(d, fixed.DATE_YEAR)} || '-01-01' END"
    precision = f"CASE WHEN {exact} IS NOT NULL THEN 'DAY' WHEN {year} IS NOT NULL THEN 'YEAR' WHEN nullif({strip_sql(x)}, '') IS NOT NULL THEN 'NONE' END"
    return f"coalesce({exact}, {year}, nullif({x}, ''))", precision


def mask_sql(x):
    d = digits_sql(x)
    return f"CASE WHEN length({d}) = 12 THEN 'XXXX XXXX ' || right({d}, 4) WHEN length({d}) >= 6 THEN 'XXXX ' || right({d}, 4) ELSE {x} END"


def stop_word_sql(x, compat):
    letters = f"upper(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    if compat:
        words = list(fixed.NAME_STOP_WORDS)
        hit = f"len(list_filter({words}, lambda w: contains({letters}, w) OR contains(w, {letters}))) > 0"
    else:
        long = "|".join(w for w in fixed.NAME_STOP_WORDS if len(w) >= fixed.GLUED_STOP_WORD_LENGTH)
        hit = f"regexp_matches({x}, {re2('(?i)' + fixed.B0 + '(?:' + '|'.join(fixed.NAME_STOP_WORDS) + ')' + fixed.B1)})"
        hit = f"({hit} OR regexp_matches(upper(regexp_replace({x}, '[^A-Za-z]', '', 'g')), '{long}'))"
    return f"(length({letters}) < 3 OR {hit})"


def type_sql(upper):
    return "CASE " + " ".join(f"WHEN {has_any(upper, words)} THEN '{kind}'" for kind, words in fixed.DOCUMENT_KEYWORDS) + " ELSE 'UNKNOWN' END"


def fields_sql(source, compat=False, older=False):
    """Common table expressions that end in ``fields``: one row of identity fields per document."""
    dob, dob_precision = date_sql("dob_raw")
    exp, _ = date_sql("expiry_raw")
    iss, _ = date_sql("issue_raw")
    ok = lambda line, p=None: f"NOT {stop_word_sql(line, compat)}" + (f" AND regexp_matches({line}, {re2(p)})" if p else f" AND length({line}) >= 3")
    first_line = strip_sql("string_split(n, chr(10))[1]")
    candidate = strip_sql(f"string_split_regex({first_line}, {re2(fixed.NAME_CUT)})[1]")
    address = "replace(adr, chr(10), ', ')"
    for phrase in fixed.ADDRESS_BANNED_PHRASES:
        address = f"regexp_replace({address}, '(?i){phrase.replace('.', chr(92) + '.')}', '', 'g')"
    address = spaces_sql(f"string_split_regex({address}, {re2(fixed.ADDRESS_CUT)})[1]")
    passport_lines = f"list_filter(list_transform(list_filter(lines, lambda l: regexp_matches(l, {re2(fixed.PASSPORT_LABEL)})), lambda l: regexp_extract(l, {re2(fixed.PASSPORT_LABEL_VALUE)}, 1)), lambda v: v <> '')[1]"
    tail = f"coalesce({rx('raw_text', fixed.LABELLED_NUMBER)}, {rx('raw_text', fixed.COMPACT_NUMBER)})" if older else "num_dl"
    dl_type = "" if older else "WHEN type0 = 'UNKNOWN' AND num_dl IS NOT NULL THEN 'DRIVER_LICENSE'"
    pin_line = (
        f"regexp_matches(l, {re2(fixed.PIN_CODE)}) AND NOT {has_any('upper(l)', fixed.ADDRESS_HEADING_WORDS)} AND NOT {stop_word_sql('l', compat)} AND length({spaces_sql('l')}) >= 10"
    )
    return f"""
WITH src AS (SELECT doc_id, list_filter(list_transform(string_split(raw_text, chr(10)), lambda l: {strip_sql('l')}), lambda l: l <> '') AS lines FROM {source}),
txt AS (SELECT *, array_to_string(lines, chr(10)) AS raw_text, upper(array_to_string(lines, chr(10))) AS upper_text FROM src),
s1 AS (SELECT *, {type_sql('upper_text')} AS type0,
  {strip_sql(f"coalesce({', '.join(rx('raw_text', p) for p in fixed.DOB_PATTERNS)})")} AS dob_raw,
  {strip_sql(f"coalesce({', '.join(rx('raw_text', p) for p in fixed.EXPIRY_PATTERNS)})")} AS expiry_raw,
  {strip_sql(f"coalesce({', '.join(rx('raw_text', p) for p in fixed.ISSUE_PATTERNS)})")} AS issue_raw,
  [{', '.join(rx('raw_text', p) for p in fixed.NAME_PATTERNS)}] AS name_raw,
  upper({rx('raw_text', fixed.GENDER_PATTERN)}) AS sex, upper({rx('raw_text', fixed.NATIONALITY_PATTERN)}) AS nationality,
  {rx('raw_text', fixed.ADDRESS_PATTERN)} AS adr, {rx('raw_text', fixed.PIN_CODE)} AS pin_code,
  {rx('raw_text', fixed.AADHAAR_SPACED)} AS num_a, {rx('upper_text', fixed.PAN_NUMBER)} AS num_p,
  {rx('upper_text', fixed.PASSPORT_NUMBER)} AS num_pp, {rx('upper_text', fixed.LICENSE_NUMBER)} AS num_dl,
  coalesce(list_position(list_transform(lines, lambda l: {has_any('upper(l)', fixed.DOB_LINE_WORDS)}), true), 0) AS anchor FROM txt),
s2 AS (SELECT *, {strip_sql(f"coalesce(num_a, num_p, CASE WHEN type0 = 'PASSPORT' OR contains(upper_text, 'PASSPORT') THEN coalesce({passport_lines}, num_pp) END, {tail})")} AS doc_number,
  CASE WHEN type0 = 'UNKNOWN' AND num_a IS NOT NULL THEN 'NATIONAL_ID (AADHAAR)' WHEN type0 = 'UNKNOWN' AND num_p IS NOT NULL THEN 'NATIONAL_ID (PAN)' {dl_type} ELSE type0 END AS document_type,
  CASE WHEN anchor >= 2 THEN list_reverse(lines[1:anchor - 1]) ELSE [] END AS above,
  list_filter(list_transform(list_filter(name_raw, lambda n: n IS NOT NULL), lambda n: {candidate}), lambda n: {ok('n')})[1] AS name_labelled FROM s1),
fields AS MATERIALIZED (SELECT doc_id, lines, raw_text, upper_text, document_type,
  nullif({spaces_sql(f"coalesce(name_labelled, list_filter(above, lambda l: {ok('l', fixed.NAME_LINE_ABOVE)})[1], list_filter(lines[1:8], lambda l: {ok('l', fixed.NAME_LINE_TOP)})[1])")}, '') AS name,
  {dob} AS dob, {dob_precision} AS dob_precision, doc_number, {exp} AS expiry_date, {iss} AS issue_date,
  CASE WHEN adr IS NOT NULL THEN CASE WHEN length({address}) >= 10 THEN {address} END ELSE nullif({spaces_sql(f"list_filter(lines, lambda l: {pin_line})[1]")}, '') END AS address,
  CASE WHEN sex IN ('M', 'MALE', 'PURUSH') THEN 'MALE' WHEN sex IN ('F', 'FEMALE', 'MAHILA') THEN 'FEMALE' ELSE sex END AS gender,
  nationality, pin_code, {mask_sql('doc_number')} AS masked_doc_number FROM s2)"""


FIELD_COLUMNS = ", ".join(fields.FIELDS) + ", dob_precision"
DOCUMENT_TEXTS = "(SELECT doc_id, text AS raw_text FROM documents)"


def id_docs(t):
    return t.id_docs.select("doc_id", fields.text_lines(F.col("raw_text")).alias("lines"))


def natural_docs(t):
    return t.documents.select("doc_id", fields.text_lines(F.col("text")).alias("lines"))


# --- Check digits and digests -------------------------------------------------------------------
@query("icao_digits", f"""
SELECT p_partkey, {icao_sql("upper(p_name)")} AS name_digit, {icao_sql("lpad(CAST(p_partkey AS VARCHAR), 9, '0')")} AS number_digit FROM part""")
def icao_digits(t):
    number = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    return t.part.select(
        "p_partkey", checksums.icao_check_digit(F.col("p_name")).alias("name_digit"),
        checksums.icao_check_digit(number, 9).alias("number_digit"),
    )


_TWELVE = "CAST(200000000000 + (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31) % 800000000000 AS VARCHAR)"


@query("verhoeff_validate", f"""
SELECT valid, count(*) AS numbers FROM (SELECT {verhoeff_sql('n')} AS valid FROM (SELECT {_TWELVE} AS n FROM lineitem)) GROUP BY 1""")
def verhoeff_validate(t):
    key = F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 31
    number = (F.lit(200000000000) + key % 800000000000).cast("string")
    return t.lineitem.select(checksums.verhoeff_valid(number).alias("valid")).groupBy("valid").agg(F.count("*").alias("numbers"))


@query("verhoeff_generate", f"""
SELECT o_orderkey, ([0, 4, 3, 2, 1, 5, 6, 7, 8, 9])[{verhoeff_state('p', 11, 1)} + 1] AS digit
FROM (SELECT o_orderkey, CAST(20000000000 + o_orderkey * 7919 AS VARCHAR) AS p FROM orders)""")
def verhoeff_generate(t):
    prefix = (F.lit(20000000000) + F.col("o_orderkey") * 7919).cast("string")
    return t.orders.select("o_orderkey", checksums.verhoeff_digit(prefix).alias("digit"))


@query("evidence_digest", """
SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 12) AS image_id,
  CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256(CAST(doc_id AS VARCHAR)) END AS evidence_hash FROM documents""")
def evidence_digest(t):
    content = F.col("text").cast("binary")
    stored = F.when(F.col("doc_id") % 2 == 0, checksums.evidence_digest(content)).otherwise("")
    return t.documents.select(
        "doc_id", checksums.evidence_digest(content).alias("digest"), checksums.short_id(content).alias("image_id"),
        checksums.evidence_hash(stored, F.col("doc_id")).alias("evidence_hash"),
    )


@query("case_ids", """
SELECT o_orderkey, 'CYBER-' || strftime(o_orderdate, '%Y%m%d') || '-' || upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6)) AS case_id FROM orders""")
def case_ids(t):
    return t.orders.select("o_orderkey", checksums.case_id(F.col("o_orderdate"), F.col("o_orderkey")).alias("case_id"))


# --- Normalisation and masking --------------------------------------------------------------------
@query("normalize_texts", f"""
SELECT doc_id, md5({spaces_sql('text')}) AS text_md5, length({spaces_sql('text')}) AS n FROM documents""")
def normalize_texts(t):
    clean = text.normalize_text(F.col("text"))
    return t.documents.select("doc_id", F.md5(clean.cast("binary")).alias("text_md5"), F.length(clean).alias("n"))


_DATE, _PRECISION = date_sql("printed")


@query("normalize_dates", f"SELECT doc_id, {_DATE} AS iso, {_PRECISION} AS precision FROM <date_texts>")
def normalize_dates(t):
    parsed = t.date_texts.select("doc_id", "printed", text.parse_date(F.col("printed")).alias("p"))
    return parsed.select("doc_id", F.coalesce("p.iso", F.nullif("printed", F.lit(""))).alias("iso"), F.col("p.precision").alias("precision"))


@query("fix_ocr_digits", """
SELECT doc_id, md5(translate(text, 'OoDIl|!SsBZz', '000111155822')) AS fixed_md5 FROM documents""")
def fix_ocr_digits(t):
    return t.documents.select("doc_id", F.md5(text.fix_ocr_digits(F.col("text")).cast("binary")).alias("fixed_md5"))


@query("payload_summaries", """
SELECT page_id, CASE WHEN length(html) > 120 THEN substr(html, 1, 120) || '...' ELSE html END AS summary,
  CASE WHEN length(url) > 20 THEN substr(url, 1, 20) || '...' ELSE url END AS short_url FROM pages""")
def payload_summaries(t):
    return t.pages.select(
        "page_id", text.payload_summary(F.col("html")).alias("summary"), text.payload_summary(F.col("url"), 20).alias("short_url")
    )


_CLEAN = f"regexp_replace(s, {SPACES}, '', 'g')"


@query("mask_ids", f"""
SELECT k, {mask_sql('s')} AS masked, CASE WHEN nullif(s, '') IS NULL THEN 'N/A' WHEN regexp_full_match({_CLEAN}, '\\p{{Nd}}{{12}}') THEN 'XXXX-XXXX-' || right({_CLEAN}, 4)
  WHEN length({_CLEAN}) > 6 THEN substr({_CLEAN}, 1, 2) || '***' || right({_CLEAN}, 4) ELSE s END AS dossier_masked
FROM (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN substr(CAST(234567890124 + c_custkey AS VARCHAR), 1, 4) || ' ' || substr(CAST(234567890124 + c_custkey AS VARCHAR), 5)
  WHEN 1 THEN c_name WHEN 2 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS s FROM customer)""")
def mask_ids(t):
    number = (F.col("c_custkey") + 234567890124).cast("string")
    kind = F.col("c_custkey") % 4
    s = (
        F.when(kind == 0, F.concat(F.substring(number, 1, 4), F.lit(" "), F.substring(number, 5, 8)))
        .when(kind == 1, F.col("c_name")).when(kind == 2, F.col("c_custkey").cast("string")).otherwise("")
    )
    return t.customer.select(F.col("c_custkey").alias("k"), s.alias("s")).select(
        "k", text.mask_doc_number(F.col("s")).alias("masked"), text.mask_sensitive_id(F.col("s")).alias("dossier_masked")
    )


# --- Identity fields -----------------------------------------------------------------------------
@query("extract_fields", f"{fields_sql('<id_docs>')} SELECT doc_id, {FIELD_COLUMNS} FROM fields")
def extract_fields(t):
    return fields.extract_fields(id_docs(t)).select("doc_id", *fields.FIELDS, "dob_precision")


@query("extract_fields_documents", f"{fields_sql(DOCUMENT_TEXTS)} SELECT doc_id, {FIELD_COLUMNS} FROM fields")
def extract_fields_documents(t):
    return fields.extract_fields(natural_docs(t)).select("doc_id", *fields.FIELDS, "dob_precision")


@query("extract_fields_compat", f"{fields_sql('<id_docs>', compat=True)} SELECT doc_id, {FIELD_COLUMNS} FROM fields")
def extract_fields_compat(t):
    return fields.extract_fields(id_docs(t), compat=True).select("doc_id", *fields.FIELDS, "dob_precision")


@query("doc_numbers_v1", f"{fields_sql('<id_docs>', older=True)} SELECT doc_id, document_type, doc_number, masked_doc_number FROM fields")
def doc_numbers_v1(t):
    return fields.extract_fields(id_docs(t), older_numbers=True).select("doc_id", "document_type", "doc_number", "masked_doc_number")


_ALL_TEXTS = "(SELECT raw_text FROM <id_docs> UNION ALL SELECT text FROM documents UNION ALL SELECT text FROM conversations)"


@query("classify_documents", f"""
SELECT document_type, count(*) AS documents FROM (SELECT {type_sql('upper(raw_text)')} AS document_type FROM {_ALL_TEXTS}) GROUP BY 1""")
def classify_documents(t):
    texts = t.id_docs.select("raw_text").union(t.documents.select("text")).union(t.conversations.select("text"))
    kind = fields.classify_document(F.upper("raw_text"))
    return texts.select(kind.alias("document_type")).groupBy("document_type").agg(F.count("*").alias("documents"))


# --- Number rules ----------------------------------------------------------------------------------
def candidates_sql(t):
    # Without look-around, adjacent words share no separator once every separator is doubled.
    doubled = f"regexp_replace({t}, '([^{fixed.WORD}])', '\\1\\1', 'g')"
    return (
        f"list_transform(list_concat(regexp_extract_all({t}, {re2(fixed.AADHAAR_GROUPED)}, 1), regexp_extract_all({doubled}, {re2(fixed.AADHAAR_WORD)}, 1), "
        f"regexp_extract_all({digits_sql(t)}, {re2(fixed.AADHAAR_RUN)}, 1)), lambda c: {digits_sql('c')})"
    )


def pick_sql(c):
    return f"coalesce(list_filter({c}, lambda d: {verhoeff_sql('d')})[1], {c}[1])"


@query("aadhaar_candidates", f"""
SELECT doc_id, CAST(len(list_distinct(c)) AS INT) AS candidates, {pick_sql('c')} AS picked, coalesce({verhoeff_sql(pick_sql('c'))}, false) AS valid
FROM (SELECT doc_id, {candidates_sql('text')} AS c FROM documents)""")
def aadhaar_candidates(t):
    found = t.documents.select("doc_id", validation.aadhaar_candidates(F.col("text")).alias("c"))
    picked = found.select("doc_id", F.size("c").alias("candidates"), validation.pick_aadhaar(F.col("c")).alias("picked"))
    return picked.select("doc_id", "candidates", "picked", checksums.verhoeff_valid(F.col("picked")).alias("valid"))


def validated_sql(source):
    entity = "CASE substr(pan_number, 4, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.PAN_ENTITY_TYPES.items()) + f" ELSE '{fixed.PAN_OTHER_ENTITY}' END"
    return f"""{fields_sql(source)},
routed AS (SELECT *, CASE WHEN contains(document_type, 'AADHAAR') OR {has_any('upper_text', fixed.AADHAAR_ROUTE_KEYWORDS)} THEN 'AADHAAR'
  WHEN contains(document_type, 'PAN') OR contains(upper_text, 'PERMANENT ACCOUNT NUMBER') THEN 'PAN' END AS route FROM fields),
cand AS (SELECT *, CASE WHEN route = 'AADHAAR' THEN {candidates_sql('raw_text')} ELSE [] END AS c, CASE WHEN route = 'PAN' THEN {rx('upper_text', fixed.PAN_NUMBER)} END AS pan_number FROM routed),
picked AS (SELECT *, {pick_sql('c')} AS ad FROM cand),
v AS MATERIALIZED (SELECT * EXCLUDE (document_type, doc_number), CASE WHEN route = 'AADHAAR' THEN coalesce({verhoeff_sql('ad')}, false) END AS verhoeff_ok,
  CASE WHEN pan_number IS NOT NULL THEN {entity} END AS pan_entity, CASE WHEN route = 'AADHAAR' THEN 'NATIONAL_ID (AADHAAR)' WHEN pan_number IS NOT NULL THEN 'NATIONAL_ID (PAN)' ELSE document_type END AS document_type,
  coalesce(substr(ad, 1, 4) || ' ' || substr(ad, 5, 4) || ' ' || substr(ad, 9, 4), pan_number, doc_number) AS doc_number FROM picked),
validated AS MATERIALIZED (SELECT *, CASE WHEN route = 'AADHAAR' THEN CASE WHEN verhoeff_ok THEN 'VERIFIED' WHEN ad IS NOT NULL THEN 'SUSPICIOUS' ELSE 'INVALID' END END AS aadhaar_status,
  CASE WHEN route = 'PAN' THEN CASE WHEN pan_number IS NOT NULL THEN 'VERIFIED' ELSE 'INVALID' END END AS pan_status,
  'XXXX-XXXX-' || right(ad, 4) AS masked_aadhaar,
  CAST(name IS NOT NULL AS INT) + CAST(dob IS NOT NULL AS INT) + CAST(doc_number IS NOT NULL AS INT) + CAST(expiry_date IS NOT NULL AS INT) + CAST(address IS NOT NULL AS INT) + CAST(gender IS NOT NULL AS INT) AS detected_field_count FROM v)"""


def validated(t):
    return validation.validate_numbers(fields.extract_fields(id_docs(t)))


@query("number_verdicts", f"""{validated_sql('<id_docs>')}
SELECT doc_id, route, document_type, doc_number, aadhaar_status, masked_aadhaar, verhoeff_ok, pan_status, pan_entity, detected_field_count FROM validated""")
def number_verdicts(t):
    return validated(t).select(
        "doc_id", "route", "document_type", "doc_number", "aadhaar_status", "masked_aadhaar", "verhoeff_ok", "pan_status",
        "pan_entity", "detected_field_count",
    )


@query("aadhaar_verdicts", f"""{validated_sql(DOCUMENT_TEXTS)}
SELECT aadhaar_status, pan_status, document_type, count(*) AS documents, count(DISTINCT doc_number) AS numbers FROM validated GROUP BY 1, 2, 3""")
def aadhaar_verdicts(t):
    df = validation.validate_numbers(fields.extract_fields(natural_docs(t)))
    return df.groupBy("aadhaar_status", "pan_status", "document_type").agg(
        F.count("*").alias("documents"), F.count_distinct("doc_number").alias("numbers")
    )


def _check_sql(name, passed, severity, where):
    return f"SELECT doc_id, '{name}' AS name, {passed} AS passed, CASE WHEN {passed} THEN 'LOW' ELSE '{severity}' END AS severity FROM validated WHERE {where}"


_A, _P, _GOV, _AUTH, _TAG = (
    fixed.AADHAAR_CHECK_NAMES, fixed.PAN_CHECK_NAMES, has_any("upper_text", fixed.GOVERNMENT_HEADERS),
    has_any("upper_text", fixed.AUTHORITY_HEADERS), has_any("upper_text", fixed.AADHAAR_TAGLINES),
)
_CHECKS = "\nUNION ALL ".join([
    _check_sql(_A["format"], "true", "HIGH", "route = 'AADHAAR' AND ad IS NOT NULL"),
    _check_sql(_A["checksum"], "verhoeff_ok", "HIGH", "route = 'AADHAAR' AND ad IS NOT NULL"),
    _check_sql(_A["missing"], "false", "HIGH", "route = 'AADHAAR' AND ad IS NULL"),
    _check_sql(_A["government"], f"({_GOV} OR {_AUTH})", "MEDIUM", "route = 'AADHAAR'"),
    _check_sql(_A["authority"], f"({_AUTH} OR {_TAG})", "MEDIUM", "route = 'AADHAAR'"),
    _check_sql(_A["demographic"], "(name IS NOT NULL AND (dob IS NOT NULL OR gender IS NOT NULL))", "MEDIUM", "route = 'AADHAAR'"),
    _check_sql(_A["pin"], "pin_code IS NOT NULL", "MEDIUM", "route = 'AADHAAR'"),
    _check_sql(_P["syntax"], "pan_number IS NOT NULL", "HIGH", "route = 'PAN'"),
    f"SELECT doc_id, '{_P['entity']}', pan_entity <> '{fixed.PAN_OTHER_ENTITY}', 'LOW' FROM validated WHERE pan_number IS NOT NULL",
    _check_sql(_P["header"], has_any("upper_text", fixed.PAN_HEADERS), "MEDIUM", "route = 'PAN'"),
])


@query("structure_checks", f"{validated_sql('<id_docs>')} {_CHECKS}")
def structure_checks(t):
    return validated(t).select("doc_id", F.explode("structure_checks").alias("c")).select("doc_id", "c.name", "c.passed", "c.severity")


def ocr_lines(t):
    """Line rows of the derived documents with a confidence per line."""
    lines = t.id_docs.select("doc_id", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "text"))
    confidence = F.lit(30) + (F.col("doc_id") * 7 + F.col("line_no") * 11) % 70
    return lines.withColumns({"text": text.strip(F.col("text")), "confidence": confidence}).filter(F.col("text") != "")


@query("ocr_quality", f"""{validated_sql('<id_docs>')},
raw AS (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS text, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS line_no FROM <id_docs>),
st AS (SELECT doc_id, count(*) AS n, sum(30 + (doc_id * 7 + line_no * 11) % 70) AS s FROM raw WHERE {strip_sql('text')} <> '' GROUP BY 1),
q AS (SELECT v.doc_id, coalesce(n, 0) AS line_count, CAST(coalesce(floor(CAST(20 * s + n AS DOUBLE) / (2 * n)) / 10, 0) AS DOUBLE) AS confidence, detected_field_count FROM validated v LEFT JOIN st USING (doc_id))
SELECT doc_id, line_count, confidence, line_count > 0 AS is_readable, line_count = 0 OR (confidence < 35 AND detected_field_count = 0) AS ocr_recapture,
  CASE WHEN line_count = 0 THEN 'No readable text lines' WHEN confidence < 35 AND detected_field_count = 0 THEN 'Low character confidence' WHEN confidence < 60 THEN 'Moderate character confidence' END AS ocr_warning FROM q""")
def ocr_quality(t):
    df = validation.with_reading_quality(validated(t), validation.line_statistics(ocr_lines(t)))
    return df.select("doc_id", "line_count", F.col("confidence").cast("double").alias("confidence"), "is_readable", "ocr_recapture", "ocr_warning")
