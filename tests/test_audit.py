"""Audit rows, the append-only table, and minimisation by policy."""

import datetime

import pytest
from pyspark.sql import functions as F

from docuvet.operators import audit

AT = datetime.datetime(2026, 4, 1, 12)
ACTIONS = "case_id string, at timestamp, actor string, action string, detail string, value string"


def test_rows_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "audit")
    actions = lambda *rows: audit.audit_actions(spark.createDataFrame([(*r, "x") for r in rows], ACTIONS))
    first = actions(("C1", AT, "a1", "READ", None), ("C1", AT, "a1", "READ", None), ("C2", AT + datetime.timedelta(days=1), None, "EXPORT", "csv"), (None, None, "a2", "DELETE", ""))
    audit.append_audit(spark, first, path)
    files = set(audit.read_audit(spark, path).inputFiles())
    assert audit.read_audit(spark, path).count() == 3
    audit.append_audit(spark, first, path)
    more = actions(("C1", AT, "a1", "READ", None), ("C1", AT, "a1", "READ", "again"))
    audit.append_audit(spark, more, path)
    found = audit.read_audit(spark, path)
    assert found.count() == 4 and files <= set(found.inputFiles())
    decisions = audit.review_decisions(spark.createDataFrame([("C1", AT, "a1", "VERIFIED")], "case_id string, acted_at timestamp, analyst string, action string"))
    both = audit.long_rows(first, decisions)
    assert both.columns == found.drop("day").columns and both.filter("kind = 'REVIEW' and value = 'VERIFIED'").count() == 1


def test_minimisation_by_role_and_age(spark):
    day = lambda n: AT - datetime.timedelta(days=n)
    rows = [("U1", "Ravi", 7, day(0)), ("U1", "Ravi", 7, day(31)), ("U1", "Ravi", 7, day(400)), ("U1", "Ravi", 7, None), (None, None, None, day(400))]
    df = spark.createDataFrame(rows, "owner_id string, applicant_name string, score int, timestamp timestamp")
    table = spark.createDataFrame(
        [("ANALYST", "applicant_name", 30, "MASK"), ("ANALYST", "applicant_name", 365, "DROP"), ("ANALYST", "score", 365, "DROP"), ("AUDITOR", "owner_id", 0, "HASH")],
        "role string, column string, older_than_days int, action string",
    )
    policies = audit.read_policies(table)
    seen = audit.minimised(df, policies, "ANALYST", "timestamp", F.lit("2026-04-01").cast("date"))
    assert dict(seen.dtypes)["score"] == "int"
    assert [tuple(r)[:3] for r in seen.collect()] == [("U1", "Ravi", 7), ("U1", "R***", 7), ("U1", None, None), ("U1", None, None), (None, None, None)]
    hashed = [r.owner_id for r in audit.minimised(df, policies, "AUDITOR", "timestamp", F.lit("2026-04-01").cast("date")).collect()]
    assert hashed[0] == "U1" and len(hashed[1]) == 12 and hashed[1] == hashed[3] and hashed[4] is None
    assert audit.minimised(df, policies, "OTHER", "timestamp", F.current_date()).collect() == df.collect()
    with pytest.raises(ValueError, match="no such columns"):
        audit.minimised(df.drop("score"), policies, "ANALYST", "timestamp", F.current_date())
