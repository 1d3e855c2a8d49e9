"""Risk fusion, reasons, breakdown, workflow and history queries."""

from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.operators import history, risk
from docuvet.plans.registry import query

# Sub-scores and decision of every case, in SQL.
RISK = """(
SELECT *, CASE WHEN recapture THEN 'RECAPTURE REQUIRED' WHEN risk_level = 'HIGH' THEN 'HIGH RISK' WHEN risk_level = 'MEDIUM' THEN 'SUSPICIOUS' ELSE 'VERIFIED' END AS final_decision,
  CASE WHEN recapture THEN 'MANUAL_REVIEW' WHEN risk_level = 'HIGH' THEN 'REJECT' WHEN risk_level = 'MEDIUM' THEN 'MANUAL_REVIEW' ELSE 'PASS' END AS recommended_action
FROM (SELECT *, CASE WHEN recapture THEN 'LOW' WHEN any_failed OR risk_score > 58 THEN 'HIGH' WHEN risk_score > 28 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT *, CASE WHEN recapture THEN CAST(15 AS decimal(9,1)) ELSE round(greatest(CAST(2 AS decimal(18,6)), least(CAST(99.5 AS decimal(18,6)),
    CAST(document_risk * CAST(0.35 AS decimal(3,2)) + consistency_risk * CAST(0.25 AS decimal(3,2)) + face_risk * CAST(0.25 AS decimal(3,2)) + liveness_risk * CAST(0.15 AS decimal(3,2)) AS decimal(18,6)))), 1) END AS risk_score
FROM (SELECT *, CASE WHEN NOT any_failed AND tampering_score < 65 THEN CAST(tampering_score * CAST(0.5 AS decimal(2,1)) AS decimal(18,6)) ELSE CAST(tampering_score AS decimal(18,6)) END AS document_risk
FROM (SELECT *, checksum_failed OR face_failed OR liveness_failed AS any_failed
FROM (SELECT *,
  CAST(greatest(2, CASE WHEN NOT verhoeff_ok THEN 90 ELSE 2 END, CASE WHEN mrz_status = 'FAILED' THEN 85 WHEN barcode_status = 'MISMATCH' THEN 80 ELSE 2 END, CASE WHEN NOT is_readable THEN 40 ELSE 2 END) AS decimal(18,6)) AS consistency_risk,
  coalesce(NOT verhoeff_ok, false) OR mrz_status = 'FAILED' OR barcode_status = 'MISMATCH' AS checksum_failed,
  similarity < 70 AS face_failed,
  CAST(CASE WHEN similarity < 70 THEN greatest(75, 100 - similarity) ELSE greatest(2, CAST((100 - similarity) * CAST(0.8 AS decimal(2,1)) AS decimal(18,6))) END AS decimal(18,6)) AS face_risk,
  coalesce(NOT liveness_passed, false) AS liveness_failed,
  CAST(CASE WHEN liveness_passed IS NULL THEN 3 WHEN liveness_passed THEN 2.5 ELSE 88 END AS decimal(18,6)) AS liveness_risk
FROM <signals>))))))"""


def _d(column):
    return F.col(column).cast("double")


@query("risk_by_segment", f"""
SELECT c_mktsegment, final_decision, count(*) AS cases, CAST(sum(risk_score) AS DOUBLE) AS total_score,
  CAST(max(risk_score) AS DOUBLE) AS max_score
FROM {RISK} JOIN customer ON owner_id = c_custkey GROUP BY 1, 2""")
def risk_by_segment(t):
    """Decisions and scores by market segment of the owner."""
    scored = risk.with_risk(t.signals)
    owners = t.customer.select("c_custkey", "c_mktsegment")
    # Aggregate per owner first: the join then moves one row per owner and decision.
    per_owner = scored.groupBy("owner_id", "final_decision").agg(
        F.count("*").alias("n"), F.sum("risk_score").alias("s"), F.max("risk_score").alias("m")
    )
    return (
        per_owner.join(owners, F.col("owner_id") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "final_decision")
        .agg(
            F.sum("n").alias("cases"), F.sum("s").cast("double").alias("total_score"), F.max("m").cast("double").alias("max_score")
        )
    )


@query("composite_risk", f"""
SELECT case_id, CAST(document_risk AS DOUBLE) AS document_risk, CAST(consistency_risk AS DOUBLE) AS consistency_risk,
  CAST(face_risk AS DOUBLE) AS face_risk, CAST(liveness_risk AS DOUBLE) AS liveness_risk,
  CAST(risk_score AS DOUBLE) AS risk_score, risk_level, final_decision, recommended_action FROM {RISK}""")
def composite_risk(t):
    return risk.with_risk(t.signals).select(
        "case_id", *[_d(c).alias(c) for c in ("document_risk", "consistency_risk", "face_risk", "liveness_risk", "risk_score")],
        "risk_level", "final_decision", "recommended_action",
    )


def _reason_rows(rows):
    return "\nUNION ALL ".join(
        f"SELECT case_id, {pos} AS pos, '{fixed.RISK_REASON_TITLES[key].replace(chr(39), chr(39) * 2)}' AS title, '{cat}' AS category, {sev} AS severity, "
        f"CAST({impact} AS DOUBLE) AS impact_score, {weight} AS weight FROM r WHERE NOT recapture AND ({cond})"
        for pos, (key, cat, sev, impact, weight, cond) in enumerate(rows)
    )


@query("risk_reasons", f"""
WITH r AS (SELECT * FROM {RISK}), found AS (
{_reason_rows([
    ("verhoeff", "DOCUMENT", "'HIGH'", "90", 35, "NOT verhoeff_ok"),
    ("mrz", "MRZ", "'HIGH'", "85", 30, "mrz_status = 'FAILED'"),
    ("barcode", "BARCODE", "'HIGH'", "80", 25, "barcode_status = 'MISMATCH'"),
    ("surface", "DOCUMENT", "CASE WHEN checksum_failed THEN 'HIGH' ELSE 'MEDIUM' END", "tampering_score", 35, "tampering_score > 55"),
    ("face", "FACE", "'HIGH'", "round(face_risk, 1)", 30, "face_risk > 35"),
    ("liveness", "LIVENESS", "'HIGH'", "88", 20, "liveness_risk > 50"),
])}),
numbered AS (SELECT *, 'R-' || CAST(row_number() OVER (PARTITION BY case_id ORDER BY pos) AS VARCHAR) AS id FROM found)
SELECT case_id, id, title, category, severity, impact_score, weight FROM numbered
UNION ALL SELECT case_id, 'R-1', '{fixed.RISK_REASON_TITLES["passed"]}', 'DOCUMENT', 'LOW', -85, 100 FROM r
  WHERE NOT recapture AND case_id NOT IN (SELECT case_id FROM found)
UNION ALL SELECT case_id, 'R-QG', '{fixed.RISK_REASON_TITLES["recapture"]}', 'QUALITY', 'HIGH', 50, 100 FROM r WHERE recapture""")
def risk_reasons(t):
    return (
        risk.with_risk(t.signals)
        .select("case_id", F.explode(risk.risk_reasons()).alias("r"))
        .select("case_id", "r.id", "r.title", "r.category", "r.severity", F.col("r.impact_score").cast("double").alias("impact_score"), "r.weight")
    )


def _breakdown_rows(rows):
    return "\nUNION ALL ".join(
        f"SELECT case_id, '{part}' AS part, CAST(CASE WHEN recapture THEN {recap} ELSE round({col}, 1) END AS DOUBLE) AS score, "
        f"CASE WHEN recapture THEN '{recap_level}' WHEN {col} > 50 THEN 'HIGH' {mid} ELSE 'LOW' END AS level, {w} AS weight FROM r"
        for part, col, w, mid, recap, recap_level in rows
    )


@query("risk_breakdown_long", f"""
WITH r AS (SELECT * FROM {RISK})
{_breakdown_rows([
    ("tamper", "document_risk", 35, "WHEN document_risk > 25 THEN 'MEDIUM'", 0, "LOW"),
    ("consistency", "consistency_risk", 25, "WHEN consistency_risk > 25 THEN 'MEDIUM'", 0, "LOW"),
    ("face", "face_risk", 25, "WHEN face_risk > 25 THEN 'MEDIUM'", 0, "LOW"),
    ("liveness", "liveness_risk", 15, "", 0, "LOW"),
    ("quality", "CAST(5 AS decimal(18,6))", 0, "", 85, "HIGH"),
])}""")
def risk_breakdown_long(t):
    return (
        risk.with_risk(t.signals)
        .select("case_id", F.explode(risk.risk_breakdown()).alias("b"))
        .select("case_id", "b.part", F.col("b.score").cast("double").alias("score"), "b.level", "b.weight")
    )


@query("fallback_risk", """
SELECT case_id, CAST(round(total, 1) AS DOUBLE) AS fallback_score,
  CASE WHEN total > 55 THEN 'HIGH RISK' WHEN total > 28 THEN 'SUSPICIOUS' ELSE 'VERIFIED' END AS fallback_decision,
  CASE WHEN total > 55 THEN 'REJECT' WHEN total > 28 THEN 'MANUAL_REVIEW' ELSE 'PASS' END AS fallback_action
FROM (SELECT case_id, CAST(CASE WHEN tampering_score = 0 THEN 10 ELSE tampering_score END * CAST(0.35 AS decimal(3,2))
   + (100 - similarity) * CAST(0.25 AS decimal(3,2)) + CASE WHEN liveness_passed THEN 0 ELSE 85 END * CAST(0.15 AS decimal(3,2)) AS decimal(18,6)) AS total
  FROM <signals>)""")
def fallback_risk(t):
    return risk.with_fallback_risk(t.signals).select(
        "case_id", _d("fallback_score").alias("fallback_score"), "fallback_decision", "fallback_action"
    )


@query("workflow_verdict", """
SELECT case_id, CASE WHEN document_state = 'RECAPTURE_REQUIRED' THEN 'RECAPTURE REQUIRED' WHEN document_state = 'FAILED' OR face_state = 'FAILED' THEN 'HIGH RISK'
    WHEN liveness_state = 'FAILED' THEN 'SUSPICIOUS' WHEN document_state = 'PASSED' AND liveness_state = 'PASSED' AND face_state = 'PASSED' THEN 'VERIFIED' ELSE 'SUSPICIOUS' END AS workflow_decision,
  CASE WHEN document_state = 'RECAPTURE_REQUIRED' THEN 'RECAPTURE_DOCUMENT' WHEN document_state = 'FAILED' OR face_state = 'FAILED' THEN 'REJECT_AND_REPORT'
    WHEN liveness_state = 'FAILED' THEN 'MANUAL_REVIEW' WHEN document_state = 'PASSED' AND liveness_state = 'PASSED' AND face_state = 'PASSED' THEN 'APPROVE' ELSE 'CONTINUE_VERIFICATION' END AS workflow_action
FROM <stages>""")
def workflow_verdict(t):
    return risk.with_workflow_verdict(t.stages).select("case_id", "workflow_decision", "workflow_action")


@query("stage_access", """
SELECT case_id, true AS can_open_document, document_state IN ('PASSED', 'FAILED') AS can_open_liveness,
  document_state IN ('PASSED', 'FAILED') AND liveness_state IN ('PASSED', 'FAILED') AS can_open_face,
  document_state IN ('PASSED', 'FAILED') AND face_state IN ('PASSED', 'FAILED') AS can_open_risk,
  decision_state IN ('COMPLETED', 'READY') OR risk_state IN ('COMPLETED', 'PASSED') AS can_open_decision FROM <stages>""")
def stage_access(t):
    df = risk.with_stage_access(t.stages)
    return df.select("case_id", *[c for c in df.columns if c.startswith("can_open")])


LATEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, case_id ORDER BY timestamp DESC, version DESC) AS rn FROM <history>) WHERE rn = 1)"""


@query("history_latest", f"SELECT owner_id, case_id, version, applicant_name, document_type, final_decision FROM {LATEST}")
def history_latest(t):
    return history.latest_records(t.history).select("owner_id", "case_id", "version", "applicant_name", "document_type", "final_decision")


@query("tenant_kpis", f"""
SELECT owner_id, count(*) AS total, count(*) FILTER (final_decision = 'VERIFIED') AS verified,
  count(*) FILTER (final_decision IN ('SUSPICIOUS', 'RECAPTURE REQUIRED')) AS suspicious, count(*) FILTER (final_decision = 'HIGH RISK') AS high_risk
FROM {LATEST} GROUP BY 1""")
def tenant_kpis(t):
    return history.tenant_kpis(history.latest_records(t.history))


@query("history_positions", f"""
SELECT owner_id, case_id, row_number() OVER (PARTITION BY owner_id ORDER BY timestamp DESC, case_id) AS position FROM {LATEST}""")
def history_positions(t):
    return history.newest_first(history.latest_records(t.history)).select("owner_id", "case_id", "position")


# The batch holds the submissions of the last stored year; everything earlier is already stored.
SPLIT = "DATE '1997-01-01'"


@query("upsert_history", f"""
WITH stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, case_id ORDER BY timestamp DESC, version DESC) AS rn FROM <history> WHERE timestamp < {SPLIT}) WHERE rn = 1),
batch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, case_id ORDER BY timestamp DESC, version DESC) AS rn FROM <history> WHERE timestamp >= {SPLIT}) WHERE rn = 1)
SELECT owner_id, case_id, version, final_decision FROM batch
UNION ALL SELECT owner_id, case_id, version, final_decision FROM stored s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.owner_id = s.owner_id AND b.case_id = s.case_id)""")
def upsert_history(t):
    records = t.history
    split = F.lit("1997-01-01").cast("timestamp_ntz")
    stored = history.latest_records(records.filter(F.col("timestamp") < split))
    batch = records.filter(F.col("timestamp") >= split)
    return history.upsert(stored, batch).select("owner_id", "case_id", "version", "final_decision")


@query("search_history", f"""
SELECT owner_id, case_id, version FROM {LATEST}
WHERE (contains(lower(CAST(case_id AS VARCHAR)), 'voter') OR contains(lower(applicant_name), 'voter') OR contains(lower(document_type), 'voter')) AND final_decision = 'HIGH RISK'""")
def search_history(t):
    return history.search_history(history.latest_records(t.history), "VoTeR", "HIGH RISK").select("owner_id", "case_id", "version")


@query("lookup_cases", f"""
SELECT q.case_id, q.user_id, q.role, r.owner_id, r.version FROM (SELECT CAST(floor(id / 2) AS BIGINT) * 4 + 1 AS case_id, id AS user_id, role FROM <users>) q
JOIN (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY timestamp DESC, version DESC, owner_id DESC) AS nth FROM (SELECT * EXCLUDE (rn) FROM {LATEST})) r
  ON q.case_id = r.case_id AND CASE WHEN q.role = 'ADMIN' THEN r.nth = 1 ELSE r.owner_id = q.user_id END""")
def lookup_cases(t):
    requests = t.users.select((F.floor(F.col("id") / 2).cast("long") * 4 + 1).alias("case_id"), F.col("id").alias("user_id"), "role")
    return history.lookup_cases(history.latest_records(t.history), requests).select("case_id", "user_id", "role", "owner_id", "version")


@query("records_with_owner", f"""
SELECT r.owner_id, count(*) AS records, min(u.email) AS email, min(u.role) AS role FROM {LATEST} r JOIN <users> u ON r.owner_id = u.id GROUP BY 1""")
def records_with_owner(t):
    joined = history.records_with_owner(history.latest_records(t.history), t.users)
    return joined.groupBy("owner_id").agg(F.count("*").alias("records"), F.min("email").alias("email"), F.min("role").alias("role"))


@query("user_sessions", """
SELECT u.id, u.role, count(*) AS events FROM events e JOIN <users> u ON e.user_id = u.id GROUP BY 1, 2""")
def user_sessions(t):
    sessions = t.events.join(t.users.select("id", F.col("email").alias("email")), F.col("user_id") == F.col("id")).select("event_id", "email")
    return history.sessions_with_user(sessions, t.users).groupBy("id", "role").agg(F.count("*").alias("events"))


@query("admit_registrations", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lower(trim(email)) AS email, upper(coalesce(role, 'INDIVIDUAL')) AS role, username, full_name, org_name FROM <registrations>),
f AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, role, username, full_name, org_name) AS rn FROM c WHERE contains(email, '@'))
SELECT email, role, coalesce(username, split_part(email, '@', 1)) AS username,
  CASE WHEN role = 'INDIVIDUAL' THEN coalesce(full_name, 'Applicant Subject') END AS full_name,
  CASE WHEN role <> 'INDIVIDUAL' THEN coalesce(org_name, 'Authorized Institution') END AS org_name,
  CASE WHEN role = 'INDIVIDUAL' THEN 'USR-' ELSE 'ORG-' END || upper(substr(md5(email), 1, 8)) AS id,
  CASE WHEN role <> 'INDIVIDUAL' THEN 'COMPANY' END AS org_type
FROM f WHERE rn = 1 AND email NOT IN (SELECT email FROM <users>)""")
def admit_registrations(t):
    return history.admit_registrations(t.registrations, t.users, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select(
        "email", "role", "username", "full_name", "org_name", "id", "org_type"
    )


@query("users_by_role", """
SELECT role, count(*) AS users, count(full_name) AS with_full_name, count(org_name) AS with_org_name
FROM (SELECT 'INDIVIDUAL' AS role, c_name AS full_name, NULL AS org_name FROM customer UNION ALL SELECT 'ORGANISATION', NULL, s_name FROM supplier) GROUP BY 1""")
def users_by_role(t):
    people = t.customer.select(F.lit("INDIVIDUAL").alias("role"), F.col("c_name").alias("full_name"))
    orgs = t.supplier.select(F.lit("ORGANISATION").alias("role"), F.col("s_name").alias("org_name"))
    return history.union_users(people, orgs).groupBy("role").agg(
        F.count("*").alias("users"), F.count("full_name").alias("with_full_name"), F.count("org_name").alias("with_org_name")
    )


@query("verification_records", f"""
SELECT CAST(s.case_id AS VARCHAR) AS case_id, CASE WHEN u.id IS NULL THEN 'ANONYMOUS' ELSE CAST(u.id AS VARCHAR) END AS owner_id, coalesce(u.role, 'INDIVIDUAL') AS owner_role,
  coalesce(u.org_name, '') AS org_name, CASE WHEN s.case_id % 3 = 0 THEN 'Applicant Subject' ELSE 'Person ' || CAST(s.case_id % 89 AS VARCHAR) END AS applicant_name,
  CASE WHEN s.case_id % 4 = 0 THEN 'NATIONAL_ID' ELSE 'PASSPORT' END AS document_type, s.final_decision, CAST(s.risk_score AS DOUBLE) AS overall_risk_score,
  coalesce(s.liveness_passed, true) AS liveness_passed, CAST(s.similarity AS DOUBLE) AS face_similarity, 'Not confidently detected' AS shown_number
FROM {RISK} s LEFT JOIN <users> u ON s.owner_id * 2 = u.id""")
def verification_records(t):
    scored = risk.with_risk(t.signals)
    case = F.col("case_id")
    submitted = scored.select(
        case.cast("string").alias("caseId"),
        (F.col("owner_id") * 2).cast("string").alias("user_id"),
        case.alias("result_key"),
        F.col("screened_at").alias("timestamp"),
        F.when(case % 3 == 0, "").otherwise(F.concat(F.lit("Person "), (case % 89).cast("string"))).alias("applicant_name"),
        F.when(case % 4 != 0, "PASSPORT").alias("documentType"),
        F.lit("").alias("source_display"),
        F.col("final_decision").alias("finalDecision"),
        F.col("risk_score").alias("overallRiskScore"),
        F.col("risk_level").alias("overallStatus"),
        F.lit("").alias("evidenceSha256"),
        F.lit(None).cast("array<string>").alias("reasons"),
        "liveness_passed", F.col("similarity").alias("similarityScore"),
        *[F.lit("").alias(c) for c in ("name", "docNumber", "dob", "gender", "address")],
    )
    users = t.users.withColumn("id", F.col("id").cast("string"))
    return history.project_verification_record(history.normalize_keys(submitted), users).select(
        "case_id", "owner_id", "owner_role", "org_name", "applicant_name", "document_type", "final_decision",
        _d("overall_risk_score").alias("overall_risk_score"), "liveness_passed", _d("face_similarity").alias("face_similarity"),
        F.col("ocr_fields.doc_number").alias("shown_number"),
    )
