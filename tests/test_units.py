"""Hand-computed values and properties of single operators."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions import checksums, landmarks, text
from docuvet.operators import anomaly, barcodes, evaluation, faces, fields, history, mrz, quality, risk, validation, verdict

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def icao(s):
    return sum(max(ALPHABET.find(c), 0) * (7, 3, 1)[i % 3] for i, c in enumerate(s.upper())) % 10


def verhoeff(s):
    c = 0
    for i, d in enumerate(reversed(s)):
        p = int(d)
        for _ in range(i % 8):
            p = fixed.VERHOEFF_PERMUTATION[p]
        c = checksums._dihedral(c, p)
    return c == 0


def test_icao_golden(spark):
    golden = {"CY9842011": 9, "880414": 5, "311022": 3, "L898902C3": 6, "740812": 2, "120415": 9, "": 0}
    df = spark.createDataFrame([(s,) for s in golden], "s string")
    assert {r[0]: r[1] for r in df.select("s", checksums.icao_check_digit(F.col("s"))).collect()} == golden


def test_icao_fixed_and_free_length_agree(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice(ALPHABET + "<") for _ in range(39)) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    for s, free, wide in df.select("s", checksums.icao_check_digit(F.col("s")), checksums.icao_check_digit(F.col("s"), 39)).collect():
        assert free == wide == icao(s)


def test_verify_check_digit(one):
    valid, calculated, expected = one({"d": "880414", "e": "5"}, checksums.verify_check_digit(F.col("d"), F.col("e")))[0]
    assert (valid, calculated, expected) == (True, 5, "5")
    assert tuple(one({"d": "<<<", "e": "<"}, checksums.verify_check_digit(F.col("d"), F.col("e")))[0]) == (True, 0, "0")
    assert tuple(one({"d": "880414", "e": "X"}, checksums.verify_check_digit(F.col("d"), F.col("e")))[0]) == (False, 5, "X")


def test_verhoeff_properties(spark):
    rng = random.Random(3)
    prefixes = [str(rng.randrange(10**10, 10**11)) for _ in range(60)]
    df = spark.createDataFrame([(p,) for p in prefixes], "p string")
    digits = {p: d for p, d in df.select("p", checksums.verhoeff_digit(F.col("p"))).collect()}
    full = [p + str(d) for p, d in digits.items()]
    changed = [n[:i] + str((int(n[i]) + 1) % 10) + n[i + 1:] for n in full for i in range(12)]
    numbers = spark.createDataFrame([(n,) for n in full + changed + ["23", "2345 6789 0124"]], "n string")
    got = {n: v for n, v in numbers.select("n", checksums.verhoeff_valid(F.col("n"))).collect()}
    assert all(got[n] and verhoeff(n) for n in full)
    assert not any(got[n] or verhoeff(n) for n in changed)
    assert got["2345 6789 0124"] and not got["23"]


def test_dates_and_masks(one):
    col = F.col("s")
    for printed, iso in {"15/08/1998": "1998-08-15", "14 APR 1988": "1988-04-14", "12/31/2028": "2028-01-01", "n/a": "n/a",
                         "31.02.2001": "2001-02-31", "1998-8-5": "1998-08-05", "40 XYZ 1999": "1999-01-01"}.items():
        assert one({"s": printed}, text.normalize_date(col)) == (iso,)
    assert one({"s": "2345 6789 0124"}, text.mask_sensitive_id(col), text.mask_doc_number(col)) == ("XXXX-XXXX-0124", "XXXX XXXX 0124")
    assert one({"s": "CY9842011"}, text.mask_sensitive_id(col)) == ("CY***2011",)
    assert one({"s": "DAVID KIM"}, text.stop_word_line(col), text.stop_word_line(col, compat=True)) == (False, True)


def test_mrz_golden(spark):
    good = ["P<CYBAPPLICANT<<ANNA<<<<<<<<<<<<<<<<<<<<<<<<", "CY98420119CYB8804145M3110223<<<<<<<<<<<<<<06"]
    bad = [good[0], "CY98420110CYB8804148M3110222<<<<<<<<<<<<<<06"]
    df = spark.createDataFrame([(1, good, fixed.PASSPORT), (2, bad, fixed.PASSPORT), (3, good, fixed.PAN)],
                               "doc_id int, lines array<string>, document_type string")
    df = df.withColumn("raw_text", F.array_join("lines", "\n"))
    rows = {r.doc_id: r for r in mrz.with_mrz(df).collect()}
    assert rows[1].mrz_status == "VERIFIED" and rows[1].mrz_surname == "APPLICANT" and rows[1].mrz_dob == "1988-04-14"
    assert rows[2].mrz_status == "FAILED" and [c.valid for c in rows[2].mrz_checks][:3] == [False, False, False]
    assert rows[3].mrz_status == "NOT_APPLICABLE"


def test_mrz_dates(one):
    raw = F.col("r")
    assert one({"r": "300101"}, mrz.mrz_date(raw, True)) == ("2030-01-01",)
    assert one({"r": "311022"}, mrz.mrz_date(raw, False)) == ("2031-10-22",)
    assert one({"r": "X10101"}, mrz.mrz_date(raw, True)) == ("X1-01-01",)
    assert one({"r": "12"}, mrz.mrz_date(raw, True)) == ("12",)


def test_risk_golden(spark):
    rows = [("a", None, False, "PASSED", None, True), ("b", None, True, "PASSED", 95, True), ("c", Decimal(90), True, "FAILED", 20, False)]
    df = spark.createDataFrame(rows, "case_id string, tampering_score decimal(9,1), verhoeff_ok boolean, face_status string, similarity int, liveness_passed boolean")
    df = df.withColumns({"mrz_status": F.lit("NOT_APPLICABLE"), "barcode_status": F.lit("NOT_FOUND"), "is_readable": F.lit(True), "recapture": F.lit(False)})
    df = df.withColumn("face_status", F.when(F.col("case_id") == "a", "FAILED").otherwise(F.col("face_status")))
    got = {r.case_id: (r.risk_score, r.final_decision) for r in risk.with_risk(df).collect()}
    # 45.125 and 3.625, rounded half up
    assert got["a"] == (Decimal("45.1"), "HIGH RISK") and got["b"] == (Decimal("3.6"), "VERIFIED")
    assert Decimal(2) <= got["c"][0] <= Decimal("99.5") and got["c"][1] == "HIGH RISK"
    compat = {r.case_id: r.liveness_failed for r in risk.with_risk(df, compat=True).collect()}
    assert not compat["c"]


def test_faces_and_yaw(spark):
    df = spark.createDataFrame([(0.363,), (0.80,), (0.0,)], "c double")
    assert [r[0] for r in df.select(faces.calibrate_similarity(F.col("c"))).collect()] == [Decimal("70.0"), Decimal("99.5"), Decimal("10.0")]
    eyes = spark.createDataFrame([(100.0, 140.0, 132.0)], "r double, l double, n double")
    assert eyes.select(landmarks.eye_line_yaw(F.col("r"), F.col("l"), F.col("n"))).first()[0] == 18.0
    # 10 + 7.5 + 7.5
    metrics = spark.createDataFrame([(21.0, 16.0, 40.0)], "ela_std double, texture_std double, edge_p95 double")
    assert metrics.select(verdict.tampering_score()).first()[0] == Decimal("25.0")


def test_missing_landmarks(spark):
    df = spark.createDataFrame([([],)], "p array<struct<x:double,y:double,z:double>>")
    assert tuple(df.select(landmarks.eye_aspect_ratio(F.col("p")), landmarks.mesh_yaw(F.col("p"))).first()) == (0.28, 0.0)


def test_qr_payloads(spark):
    payloads = [
        '<PrintLetterBarcodeData uid="1" name="A &amp; B" Name="C"/>', "junk <x uid='9'>text name=\"no\"</x> ", 'uid= "7" dob ="x" broken <a',
        'nothing here x="1"', "<x name=\"root\"><y name=\"child\"/></x>",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(barcodes.qr_attributes(F.col("p"))).collect()]
    assert got == [{"uid": "1", "name": "C"}, {"uid": "9"}, {"uid": "7", "dob": "x"}, None, {"name": "root"}]


def test_filters_on_derived_fields_plan_quickly(spark):
    """A filter on a late column must not unfold the whole chain of columns."""
    df = spark.createDataFrame([(1, ["INCOME TAX DEPARTMENT", "Name: David Kim", "ABCPX1234K"])], "doc_id int, lines array<string>")
    rows = validation.validate_numbers(fields.extract_fields(df)).filter("pan_status = 'VERIFIED' AND name LIKE 'Dav%'")
    assert rows.select("doc_number").first()[0] == "ABCPX1234K"


def test_lookup_and_tenants(spark):
    df = spark.createDataFrame([("A1", "u1", 1, "2024-01-01"), ("A1", "u2", 2, "2024-01-02")], "case_id string, owner_id string, version int, timestamp string")
    assert history.lookup_case(df, "A1", "u2").first().version == 2
    assert history.lookup_case(df, "A1", "u3").count() == 0 and history.tenant_history(df, None).count() == 0
    assert history.lookup_case(df, "A1", None, "ADMIN").count() == 1
    batch = spark.createDataFrame([("A1", "u1", 9, "2024-02-01")], df.schema)
    assert sorted(tuple(r) for r in history.upsert(df, batch).select("owner_id", "version").collect()) == [("u1", 9), ("u2", 2)]


def test_exact_percentiles_of_a_hot_group(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), (F.col("id") % 7).cast("decimal(9,1)").alias("v"))
    row = quality.exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (row.n, row.p50, row.p95) == (1000, 3.0, 6.0)


def test_cross_field_codes(spark):
    row = {"name": "ANNA KIM", "dob": "1990-01-01", "gender": "FEMALE", "doc_number": "AB12", "document_type": fixed.PAN, "issue_date": "2024-05-01",
           "expiry_date": "2020-01-01", "mrz_status": "VERIFIED", "mrz_surname": "SMITH", "mrz_given_names": "JOHN", "mrz_dob": "1991-01-01",
           "mrz_number": "AB12", "mrz_sex": "MALE", "barcode_status": "MATCH"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    codes = df.select(evaluation.cross_field_findings(F.lit("2026-01-01").cast("date"))).first()[0]
    assert codes == ["NAME_MRZ", "DOB_MRZ", "GENDER_MRZ", "ISSUE_AFTER_EXPIRY", "EXPIRED", "NUMBER_FORMAT"]


def test_learned_fusion_finds_the_signal(spark):
    """Held-out cases: the probability of fraud is higher where the module that tells fraud has failed."""
    rows = [(i, float(i % 7), i % 3 == 0, i % 3 == 0 or i % 50 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "case_id long, noise double, failed boolean, is_fraud boolean").withColumn("failed", F.col("failed").cast("int"))
    scored = anomaly.learned_fusion(df.filter("case_id % 4 = 0"), df.filter("case_id % 4 <> 0"), ("noise", "failed"), "is_fraud")
    assert scored.columns == [*df.columns, "fraud_probability"]
    right = [(r.fraud_probability > 0.5) == r.is_fraud for r in scored.collect()]
    assert len(right) == 150 and sum(right) >= 0.95 * len(right)


def test_contributions_add_up(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(5, 3), rng.random()) for _ in range(300)] + [(None, 1.0, 1.0)], "a double, b double, c double")
    model = anomaly.fit_genuine(df.na.drop(), ("a", "b", "c"))
    parts = anomaly.contributions(model)
    got = df.select(anomaly.anomaly_distance(model).alias("d"), sum(parts[1:], parts[0]).alias("s")).collect()
    assert all((r.d is None) if r.s is None else abs(r.d**2 - r.s) < 1e-9 for r in got) and got[-1].d is None
    assert abs(sum(r.s for r in got[:-1]) / 299 - 3) < 1e-6
