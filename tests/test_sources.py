"""Reading and writing of history, users, dossiers, evidence and text lines."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from docuvet.operators import dossier, history
from docuvet.plans.derive import Inputs
from docuvet.plans.screening_queries import screened
from docuvet.sources import readers, writers


def test_users_without_secrets(spark, tmp_path):
    people = {"a@example.org": {"id": "U1", "email": "a@example.org", "role": "INDIVIDUAL", "full_name": "A", "password_hash": "x", "salt": "y"},
              "b@example.org": {"id": "O1", "email": "b@example.org", "role": "ORGANISATION", "org_name": "B"}}
    (tmp_path / "users.json").write_text(json.dumps(people, indent=1))
    df = readers.read_users(spark, str(tmp_path / "users.json"))
    assert not {"password_hash", "salt"} & set(df.columns)
    assert sorted((r.id, r.full_name, r.org_name) for r in df.collect()) == [("O1", None, "B"), ("U1", "A", None)]
    (tmp_path / "users.jsonl").write_text("\n".join(map(json.dumps, people.values())))
    assert sorted(readers.read_users(spark, str(tmp_path / "users.jsonl"), lines=True).collect()) == sorted(df.collect())


def test_verifications_round_trip(spark, tmp_path):
    record = {"case_id": "C1", "owner_id": "U1", "timestamp": "2026-08-31 10:00:00 UTC", "final_decision": "VERIFIED", "overall_risk_score": 3.6,
              "reasons": ["r"], "liveness_passed": True, "ocr_fields": {"name": "N", "docNumber": "D"}}
    (tmp_path / "v.json").write_text(json.dumps([record, record | {"case_id": "C2", "final_decision": "HIGH RISK"}]))
    df = readers.read_verifications(spark, str(tmp_path / "v.json"))
    assert df.filter("case_id = 'C1'").select(F.date_format("recorded_at", "yyyyMMddHH"), "ocr_fields.docNumber").first()[:] == ("2026083110", "D")


def stored_history(spark, path):
    return sorted((r.owner_id, r.case_id, r.final_decision) for r in spark.read.parquet(path).collect())


def test_history_keeps_every_case_once(spark, tmp_path):
    path = str(tmp_path / "history")
    day = lambda n: datetime.datetime(2026, 8, n)
    frame = lambda *rows: spark.createDataFrame(rows, "owner_id string, case_id string, final_decision string, timestamp timestamp, version int")
    writers.write_verifications(frame(("U1", "C1", "VERIFIED", day(1), 1), ("U1", "C2", "HIGH RISK", day(1), 1), ("U2", "C9", "VERIFIED", day(1), 1)), path)
    writers.merge_verifications(spark, frame(("U1", "C3", "HIGH RISK", day(2), 1)), path)
    assert stored_history(spark, path) == [("U1", "C1", "VERIFIED"), ("U1", "C2", "HIGH RISK"), ("U1", "C3", "HIGH RISK"), ("U2", "C9", "VERIFIED")]
    again = frame(("U1", "C1", "SUSPICIOUS", day(3), 2), ("U1", "C1", "VERIFIED", day(2), 2), ("U2", "C1", "VERIFIED", day(3), 1))
    writers.merge_verifications(spark, again, path)
    want = [("U1", "C1", "SUSPICIOUS"), ("U1", "C2", "HIGH RISK"), ("U1", "C3", "HIGH RISK"), ("U2", "C1", "VERIFIED"), ("U2", "C9", "VERIFIED")]
    assert stored_history(spark, path) == want
    writers.merge_verifications(spark, again.filter("false"), path)
    assert stored_history(spark, path) == want
    one = history.tenant_history(spark.read.parquet(path), "U2")
    assert sorted(r.case_id for r in one.collect()) == ["C1", "C9"]
    assert "PartitionFilters: [isnotnull(owner_bucket" in one._jdf.queryExecution().toString()
    newest = history.lookup_case(spark.read.parquet(path), "C1", role="ADMIN").first()
    assert (newest.owner_id, newest.final_decision) in {("U1", "SUSPICIOUS"), ("U2", "VERIFIED")} and newest.timestamp == day(3)
    assert history.lookup_case(spark.read.parquet(path), "C2", "U2").count() == 0


def test_submissions_as_they_are_posted(spark, tmp_path):
    posted = [
        {"case_id": "N1", "user_id": "U1", "applicant_name": "Given Name", "final_decision": "VERIFIED", "overall_risk_score": 0.0, "liveness_passed": False, "face_similarity": 91.5,
         "doc_data": {"documentType": "PASSPORT", "evidenceSha256": "ab", "suspiciousReasons": ["r"], "ocr": {"fields": {"name": "Read Name", "docNumber": "D7"}}}},
        {"caseId": "N2", "applicant_name": "Given Name", "doc_data": {"document_type": "VOTER_ID", "ocr": {"fields": {"name": ""}}}},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, posted)))
    users = spark.createDataFrame([("U1", "u@example.org", "ORGANISATION")], "id string, email string, role string")
    rows = history.project_verification_record(history.normalize_keys(spark.read.json(str(tmp_path / "p.json"))), users)
    one, two = rows.orderBy("case_id").collect()
    assert (one.case_id, one.owner_id, one.applicant_name, one.document_type, one.evidence_sha256, one.reasons) == ("N1", "U1", "Read Name", "PASSPORT", "ab", ["r"])
    assert (float(one.overall_risk_score), one.liveness_passed, float(one.face_similarity), one.ocr_fields.doc_number) == (0.0, False, 91.5, "D7")
    assert (two.case_id, two.owner_id, two.applicant_name, two.document_type, two.final_decision) == ("N2", "ANONYMOUS", "Given Name", "VOTER_ID", "VERIFIED")
    assert (float(two.overall_risk_score), two.liveness_passed, float(two.face_similarity), two.reasons) == (5.0, True, 95.0, [])
    shown = spark.createDataFrame([("A", None, "", "x", "F")], "name string, doc_number string, dob string, address string, gender string")
    assert [(f.field, f.value, f.is_consistent) for f in shown.select(history.display_fields()).first()[0]][:3] == [
        ("Applicant Name", "A", True), ("Document ID", "Not confidently detected", False), ("Date of Birth", "Not confidently detected", False)]


def test_dossiers_of_both_generations(spark, tmp_path):
    old = {"case_id": "D1", "screening_verdict": {"final_decision": "VERIFIED"}, "extracted_ocr_data": {"raw_text_snippet": "abc"}}
    new = {"case_id": "D2", "screening_verdict": {"final_decision": "HIGH RISK"}, "quality_gate": {"status": "PASSED", "issues": []}}
    for d in (old, new):
        (tmp_path / f"report_{d['case_id']}.json").write_text(json.dumps(d, indent=2))
    df = readers.read_dossiers(spark, str(tmp_path / "report_*.json"))
    assert sorted((r.case_id, r.quality_gate.status if r.quality_gate else None) for r in df.collect()) == [("D1", None), ("D2", "PASSED")]
    writers.write_dossiers(df, str(tmp_path / "lines"))
    back = readers.read_dossiers(spark, str(tmp_path / "lines"), multiline=False)
    assert sorted((r.case_id, r.screening_verdict.final_decision) for r in back.collect()) == [("D1", "VERIFIED"), ("D2", "HIGH RISK")]


def test_written_dossiers_read_back_whole(spark, tmp_path):
    """A full dossier, written and read, gives the same JSON: no key is lost on the way."""
    cases = screened(Inputs(spark, "/root/testdata/sf0.001")).withColumns({
        "generated_timestamp": F.lit("2026-01-01T00:00:00"), "size_bytes": F.lit(1), "evidence_sha256": F.lit("ab"), "analyst_notes": F.lit("n"),
    })
    built = dossier.case_dossier(cases).limit(30).persist()
    writers.write_dossiers(built, str(tmp_path / "d"))
    back = readers.read_dossiers(spark, str(tmp_path / "d"), multiline=False)
    plain = lambda value: {k: plain(v) for k, v in value.items() if v is not None} if isinstance(value, dict) else [plain(v) for v in value] if isinstance(value, list) else value
    read = lambda df: {d["case_id"]: plain(d) for d in (json.loads(r.value) for r in writers.dossier_json(df).collect())}
    ours, theirs = read(built), read(back)
    assert len(ours) == 30 and ours == theirs


def test_evidence(spark, tmp_path):
    (tmp_path / "e.jpg").write_bytes(b"abc")
    row = readers.read_evidence(spark, str(tmp_path / "*.jpg")).first()
    assert (row.filename, row.size_bytes, row.sha256) == ("e.jpg", 3, hashlib.sha256(b"abc").hexdigest())


def test_ocr_lines(spark, tmp_path):
    doc = {"doc_id": 5, "lines": [{"text": " A ", "confidence": 90.0, "box": [[0, 0]]}, {"text": "  ", "confidence": 1.0}, {"text": "B", "confidence": 80.0}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    rows = readers.read_ocr_lines(spark, str(tmp_path / "r.json")).collect()
    assert [(r.line_no, r.text) for r in sorted(rows, key=lambda r: r.line_no)] == [(0, "A"), (2, "B")]


def test_dossiers_keep_unknown_keys(spark, tmp_path):
    """A third generation: new keys at the top and inside known ones are kept, asked for by path, and written back."""
    third = {"case_id": "D3", "screening_verdict": {"final_decision": "HIGH RISK", "model_version": 7}, "device": {"os": "A", "sensors": [1, {"x": 2.5}]}, "note": None, "barcode_qr_findings": {"detected": True}}
    second = {"case_id": "D2", "screening_verdict": {"final_decision": "VERIFIED"}, "quality_gate": {"status": "PASSED", "issues": []}}
    for d in (second, third):
        (tmp_path / f"report_{d['case_id']}.json").write_text(json.dumps(d, indent=2))
    (tmp_path / "report_broken.json").write_text("{not json")
    df = readers.read_dossiers_whole(spark, str(tmp_path / "report_*.json"))
    asked = df.select("case_id", "screening_verdict.final_decision", readers.dossier_value("$.device.os").alias("os"), readers.dossier_value("$.device.sensors[1].x", "double").alias("x"),
                      readers.dossier_value("$.screening_verdict.model_version", "int").alias("v"), readers.dossier_value("$.device.os", "int").alias("wrong"))
    assert sorted(map(tuple, asked.collect()), key=str) == sorted([("D2", "VERIFIED", None, None, None, None), ("D3", "HIGH RISK", "A", 2.5, 7, None), (None,) * 6], key=str)
    beyond = {(r.case_id, r.key): r.kind for r in readers.unknown_keys(df).collect()}
    assert set(beyond) == {("D3", "device"), ("D3", "note"), ("D3", "screening_verdict.model_version")} and beyond["D3", "screening_verdict.model_version"] == "BIGINT"
    writers.write_dossiers_whole(df.filter("case_id is not null"), str(tmp_path / "lines"))
    back = readers.read_dossiers_whole(spark, str(tmp_path / "lines"), multiline=False)
    assert {r.case_id: json.loads(r.j) for r in back.select("case_id", F.to_json("dossier").alias("j")).collect()} == {"D2": second, "D3": third}
