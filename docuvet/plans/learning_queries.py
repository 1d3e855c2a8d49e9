"""SQL functions, percentiles from sketches, splits that keep shared evidence together, and forest fusion."""

from pyspark.sql import functions as F

from docuvet.functions import sql
from docuvet.operators import anomaly, audit, evaluation, forest, groups, persons, risk, sketches
from docuvet.plans.document_queries import icao_sql, mask_sql, verhoeff_sql
from docuvet.plans.registry import query
from docuvet.plans.risk_queries import RISK
from docuvet.plans.screening_queries import _EVIDENCE, evidence_of

_NUMBERS = "SELECT o_orderkey AS k, CAST(200000000000 + o_orderkey * 7919 % 1000 AS STRING) AS n, upper(o_orderpriority) || CAST(o_custkey AS STRING) AS z FROM {orders}"


@query("sql_functions", f"""
SELECT k, {verhoeff_sql('n')} AS valid, {icao_sql('z')} AS zone_digit, {mask_sql('n')} AS masked, {mask_sql('z')} AS zone_masked FROM ({_NUMBERS.replace('{orders}', 'orders')})""")
def sql_functions(t):
    sql.register(t.spark)
    return t.spark.sql(
        f"SELECT k, verhoeff_valid(n) AS valid, icao_check_digit(z) AS zone_digit, mask_id(n) AS masked, mask_id(z) AS zone_masked FROM ({_NUMBERS})", orders=t.orders
    )


# --- Sketches ---------------------------------------------------------------------------------------------
_DAYS = """
SELECT l_shipdate AS taken_at, CASE l_orderkey % 5 WHEN 0 THEN 'NATIONAL_ID (AADHAAR)' WHEN 1 THEN 'NATIONAL_ID (PAN)' WHEN 2 THEN 'PASSPORT' ELSE 'UNKNOWN' END AS document_type,
  CAST((l_orderkey * 3 + l_linenumber * 17) % 2400 AS decimal(9,1)) * 0.1 AS edge_p95 FROM {lineitem}"""
_SHARES = {"median": 0.5, "p95": 0.95, "p99": 0.99}


@query("sketch_percentiles", f"""
SELECT document_type, count(*) AS n, CAST(min(edge_p95) AS DOUBLE) AS low, CAST(max(edge_p95) AS DOUBLE) AS high, true AS median, true AS p95, true AS p99
FROM ({_DAYS.replace('{lineitem}', 'lineitem')}) WHERE CAST(taken_at AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' GROUP BY 1""")
def sketch_percentiles(t):
    """Percentiles of three years from daily sketches; whether the rank of each is within a hundredth of its share, over all rows."""
    metrics = t.spark.sql(_DAYS, lineitem=t.lineitem)
    days = sketches.daily_sketches(metrics, ["document_type"], "taken_at", "edge_p95")
    found = sketches.range_percentiles(days, ["document_type"], _SHARES, "1994-01-01", "1996-12-31")
    within = metrics.filter(F.to_date("taken_at").between("1994-01-01", "1996-12-31"))
    errors = sketches.rank_errors(within, ["document_type"], "edge_p95", found, _SHARES)
    judged = errors.select("document_type", *[(F.col(n) < sketches.RANK_ERROR).alias(n) for n in _SHARES])
    return found.drop(*_SHARES).join(judged, "document_type")


# --- Splits by groups, and the forest fitted on one and judged on another -----------------------------------------
_GROUPED = f"""
labelled AS (SELECT e.case_id, CASE WHEN evidence_sha256 = '' THEN 'c' || e.case_id ELSE evidence_sha256 END AS g, is_fraud::INT AS fraud, e.case_id % 37 = 0 AS held FROM {_EVIDENCE} e JOIN <case_truth> USING (case_id)),
units AS (SELECT g, count(*) AS size, max(fraud) AS stratum, bool_or(held) AS held FROM labelled GROUP BY 1)"""


def split_cases(t):
    """Labelled cases in splits; one kind of attack is seen in none of them."""
    records = evidence_of(t).join(t.case_truth, "case_id").withColumn("fraud", F.col("is_fraud").cast("int"))
    found = groups.connected_groups(records, "case_id", ("evidence_sha256",))
    return groups.split_groups(records, found, "case_id", "fraud", {"UNSEEN_ATTACK": F.col("case_id") % 37 == 0})


@query("group_splits", f"""
WITH {_GROUPED}
SELECT stratum, CAST(sum(size) FILTER (NOT held) AS BIGINT) AS open_rows, CAST(coalesce(sum(size) FILTER (held), 0) AS BIGINT) AS held_rows, true AS exact, CAST(0 AS BIGINT) AS leaks FROM units GROUP BY 1""")
def group_splits(t):
    """Rows by stratum of their group; whether each split has its share to one row; groups and evidence files in two splits."""
    rows = split_cases(t)
    units = rows.groupBy("group_id").agg(F.count("*").alias("size"), F.max("fraud").alias("stratum"), F.min("split").alias("split"), (F.min("split") != F.max("split")).alias("cut"))
    held = F.col("split") == "UNSEEN_ATTACK"
    counted = lambda name: F.coalesce(F.sum(F.when(F.col("split") == name, F.col("size"))), F.lit(0))
    by_stratum = units.groupBy("stratum").agg(
        F.sum(F.when(~held, F.col("size"))).alias("open_rows"), counted("UNSEEN_ATTACK").alias("held_rows"),
        *[counted(n).alias(f"_{n}") for n, _ in groups.SHARES], F.count_if("cut").alias("_cut"),
    )
    exact = F.lit(True)
    for name, share in groups.SHARES:
        exact = exact & (F.abs(F.col(f"_{name}") - F.col("open_rows") * share / 100) <= 1)
    leaks = evaluation.split_leaks(rows.filter(F.length("evidence_sha256") > 0), "evidence_sha256").count()
    return by_stratum.select("stratum", "open_rows", "held_rows", exact.alias("exact"), (F.col("_cut") + F.lit(leaks)).alias("leaks"))


_SCORES = ("tampering_score", "face_gap", "liveness_failed", "mrz_failed", "mismatch", "number_failed", "unreadable")


def module_scores(t):
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return t.signals.select(
        "case_id", "tampering_score", (100 - F.col("similarity")).alias("face_gap"), flag(~F.col("liveness_passed")).alias("liveness_failed"),
        flag(F.col("mrz_status") == "FAILED").alias("mrz_failed"), flag(F.col("barcode_status") == "MISMATCH").alias("mismatch"),
        flag(~F.col("verhoeff_ok")).alias("number_failed"), flag(~F.col("is_readable")).alias("unreadable"),
    )


@query("forest_fusion", f"""
WITH {_GROUPED}, strata AS (SELECT stratum, sum(size) AS n FROM units WHERE NOT held GROUP BY 1)
SELECT CAST(sum(n - round(n * 85 / 100)) AS BIGINT) AS test_cases, true AS beats_average, true AS separates, true AS contributions_add_up FROM strata""")
def forest_fusion(t):
    """A forest fitted on TRAIN and judged on TEST: whether it orders better than the plain average and well, and adds up."""
    # Fitting, both curves and the sums read the same rows: groups are found, and cases scored, once.
    cases = groups._stored(module_scores(t).join(split_cases(t).select("case_id", "split", "is_fraud", "fraud"), "case_id"), "fusion-cases")
    model = forest.fit_forest(cases.filter("split = 'TRAIN'"), _SCORES, "fraud")
    test = forest.score_forest(cases.filter("split = 'TEST'"), model).withColumns({
        "average": evaluation.average_fusion("tampering_score", "face_gap", "liveness_failed", "mrz_failed").cast("double"),
        "sum": F.aggregate("contributions", F.lit(forest.mean_probability(model)), lambda a, x: a + x),
    })
    test = groups._stored(test.select("fraud", "fraud_probability", "average", "sum"), "fusion-test")
    learned, average = (evaluation.roc_auc(test, "fraud", score).first()[0] for score in ("fraud_probability", "average"))
    counted = test.agg(F.count("*").alias("test_cases"), F.max(F.abs(F.col("sum") - F.col("fraud_probability"))).alias("_gap"))
    return counted.select(
        "test_cases", F.lit(learned > average).alias("beats_average"), F.lit(learned > 0.75).alias("separates"),
        (F.col("_gap") < 1e-9).alias("contributions_add_up"),
    )


# --- One-class score: fitted, bounded and judged on different documents ----------------------------------------------
@query("anomaly_validated", """
WITH m AS (SELECT CAST(ela_std AS DOUBLE) AS x, CAST(texture_std AS DOUBLE) AS y, barcode_status <> 'MISMATCH' AS genuine,
  CAST('0x' || substr(md5(CAST(image_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS place FROM <image_metrics>),
g AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM m WHERE genuine AND place < 70),
d AS (SELECT *, sqrt(greatest(0, ((x - mx) * (x - mx) * vy - 2 * (x - mx) * (y - my) * vxy + (y - my) * (y - my) * vx) / (vx * vy - vxy * vxy))) AS distance FROM m, g),
t AS (SELECT quantile_cont(distance, 0.95) AS threshold FROM d WHERE genuine AND place >= 70 AND place < 85)
SELECT genuine, count(*) AS documents, count(*) FILTER (distance > threshold + 1e-7) AS anomalous FROM d, t WHERE place >= 85 GROUP BY 1""")
def anomaly_validated(t):
    """Anomalous documents of TEST, by a model of the genuine ones of TRAIN and the threshold of those of VALIDATION."""
    rows = t.image_metrics.select("image_id", "ela_std", "texture_std", (F.col("barcode_status") != "MISMATCH").alias("genuine"))
    rows = evaluation.split_documents(rows, "image_id")
    model = anomaly.fit_genuine(rows.filter("genuine and split = 'TRAIN'"), ("ela_std", "texture_std"))
    judged = anomaly.with_anomaly(rows.filter("split <> 'TRAIN'"), model)
    threshold = anomaly.learned_threshold(judged.filter("genuine and split = 'VALIDATION'"), "distance").first()[0]
    # Distances are equal to the seventh decimal at least, whatever the order of summation.
    above = F.col("distance") > F.lit(threshold + 1e-7)
    return judged.filter("split = 'TEST'").groupBy("genuine").agg(F.count("*").alias("documents"), F.count_if(above).alias("anomalous"))


# --- The same person, written differently --------------------------------------------------------------------------
@query("same_persons", """
WITH RECURSIVE r AS (SELECT case_id, nullif(array_to_string(list_sort(list_filter(string_split_regex(upper(name), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')), ' '), '') AS name,
  nullif(dob, '') AS dob, nullif(regexp_replace(upper(doc_number), '[^A-Z0-9]', '', 'g'), '') AS number FROM <person_records>),
links AS (SELECT a.case_id AS a, b.case_id AS b FROM r a JOIN r b ON a.case_id <> b.case_id AND levenshtein(a.name, b.name) <= 1
  AND (coalesce(a.dob = b.dob, false) OR coalesce(levenshtein(a.number, b.number) <= 1, false))),
reached(a, b) AS (SELECT case_id, case_id FROM r UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b)
SELECT r.case_id, (SELECT count(*) FROM links WHERE links.a = r.case_id) AS n_links, (SELECT min(b) FROM reached WHERE reached.a = r.case_id) AS person_id FROM r""")
def same_persons(t):
    return persons.same_persons(t.person_records)


# --- Audit rows and minimisation -------------------------------------------------------------------------------------
_MODULES = ", ".join(f"struct_pack(module := '{m}', score := CAST({c} AS decimal(18,6)))" for m, c in (
    ("DOCUMENT", "document_risk"), ("CONSISTENCY", "consistency_risk"), ("FACE", "face_risk"), ("LIVENESS", "liveness_risk"), ("COMPOSITE", "risk_score")))


@query("audit_long", f"""
SELECT kind, subject, count(*) AS rows, count(DISTINCT case_id) AS cases, count(DISTINCT value) AS values FROM (
  SELECT case_id, 'MODULE' AS kind, m.module AS subject, CAST(CAST(m.score AS decimal(9,1)) AS VARCHAR) AS value
  FROM (SELECT case_id, unnest([{_MODULES}]) AS m FROM {RISK})
  UNION ALL SELECT case_id, 'REVIEW', 'final_decision', action FROM <overrides>) GROUP BY 1, 2""")
def audit_long(t):
    cases = risk.with_risk(t.signals).withColumn("screened_at", F.col("screened_at").cast("timestamp"))
    rows = audit.long_rows(audit.module_results(cases, "screened_at"), audit.review_decisions(t.overrides))
    return rows.groupBy("kind", "subject").agg(F.count("*").alias("rows"), F.count_distinct("case_id").alias("cases"), F.count_distinct("value").alias("values"))


POLICIES = (
    audit.Policy("AUDITOR", "applicant_name", 0, audit.MASK), audit.Policy("AUDITOR", "owner_id", 0, audit.HASH),
    audit.Policy("ANALYST", "applicant_name", 730, audit.MASK), audit.Policy("ANALYST", "applicant_name", 1460, audit.DROP),
    audit.Policy("ANALYST", "document_type", 1460, audit.DROP),
)


@query("minimised_history", """
WITH h AS (SELECT *, date_diff('day', CAST(timestamp AS DATE), DATE '1998-08-03') AS age FROM <history>)
SELECT 'AUDITOR' AS role, version, CASE WHEN age > 0 THEN substr(sha256(CAST(owner_id AS VARCHAR)), 1, 12) ELSE CAST(owner_id AS VARCHAR) END AS owner_id,
  CASE WHEN age > 0 THEN left(applicant_name, 1) || '***' ELSE applicant_name END AS applicant_name, document_type FROM h
UNION ALL
SELECT 'ANALYST', version, CAST(owner_id AS VARCHAR), CASE WHEN age > 1460 THEN NULL WHEN age > 730 THEN left(applicant_name, 1) || '***' ELSE applicant_name END, CASE WHEN age <= 1460 THEN document_type END FROM h""")
def minimised_history(t):
    today = F.lit("1998-08-03").cast("date")
    seen = [
        audit.minimised(t.history, list(POLICIES), role, "timestamp", today).select(F.lit(role).alias("role"), "version", F.col("owner_id").cast("string").alias("owner_id"), "applicant_name", "document_type")
        for role in ("AUDITOR", "ANALYST")
    ]
    return seen[0].union(seen[1])
