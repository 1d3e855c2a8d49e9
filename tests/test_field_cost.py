"""Searches of the identity fields are spared where they cannot find anything, and find the same."""

import random
import re

from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions import text
from docuvet.operators import fields

PIECES = ["DOB: 01/02/1990", "d0b 3 mar 1985", "Date of Birth", "YOB: 1977", "जन्म तिथि: 04/05/1966", "जन्म वर्ष 1955", "born 1.2.2001", "12/11/1999", "7 June 2003", "x12/11/1999",
          "Expiry: 01/02/2029", "valid till 3 mar 2030", "EXP. DATE 5-6-2031", "VALID UPTO 2031", "Issue Date: 01/02/2019", "issued 3-4-2018", "DATE OF ISSUE 5 may 2017", "DOI 1/1/2016",
          "Name: Ravi Kumar DOB", "Surname Lopez", "PRENOMS: Anna", "given name: Eva", "Nom: Li Wei", "नाम: Asha", "Sex: f", "GENDER transgender", "लिंग M", "Nationality: Utopian", "citizenship INDIAN",
          "s/o Ram Das, 12 Station Road", "ADDRESS: H NO 4, MG Road,", "पता: Lake View Road 12", "PUNE 411001", "411001a", "2345 6789 0123", "2345 6789", "0123", "A2345 6789 0123", "2345 6789 01234",
          "ABCPX1234K", "abcpx1234k", "ABCPX1234KL", "ſBCPX1234K", "MH12 20110000001", "MH-12-20110000001", "MH1220110000001", "mh 12 1999 0000001", "PASSPORT NO: CY1234567", "٣٤٥٦ 2345 6789 0123", "", "desk"]


def test_spared_searches_lose_nothing(spark):
    rng = random.Random(5)
    rows = [(n, [rng.choice(PIECES) if rng.random() < 0.7 else " ".join(rng.sample(PIECES, 2)) for _ in range(rng.randrange(6))]) for n in range(1500)] + [(-1, None)]
    df = spark.createDataFrame(rows, "doc_id long, lines array<string>").withColumn("raw_text", F.array_join("lines", "\n")).withColumn("upper_text", F.upper("raw_text"))
    for searches in fields._searches():
        df = df.withColumns(searches)
    plain = lambda patterns, column="raw_text": F.coalesce(*[text.match(F.col(column), p) for p in patterns])
    found = lambda prefix, count: fields._found(prefix, count)
    pairs = {
        "dob": (found("dob", 5), plain(fixed.DOB_PATTERNS)), "exp": (found("exp", 2), plain(fixed.EXPIRY_PATTERNS)), "iss": (found("iss", 2), plain(fixed.ISSUE_PATTERNS)),
        **{f"name_{i}": (text.non_empty(F.col(f"name_{i}")), plain([p])) for i, p in enumerate(fixed.NAME_PATTERNS)},
        "sex": (found("sex", 1), plain([fixed.GENDER_PATTERN])), "nat": (found("nat", 1), plain([fixed.NATIONALITY_PATTERN])), "adr": (found("adr", 1), plain([fixed.ADDRESS_PATTERN])),
        "pin": (found("pin", 1), plain([fixed.PIN_CODE])), "num_0": (text.non_empty(F.col("num_0")), plain([fixed.AADHAAR_SPACED])),
        "num_1": (text.non_empty(F.col("num_1")), plain([fixed.PAN_NUMBER], "upper_text")), "num_3": (text.non_empty(F.col("num_3")), plain([fixed.LICENSE_NUMBER], "upper_text")),
    }
    wrong = df.select(*[F.count_if(~a.eqNullSafe(b)).alias(k) for k, (a, b) in pairs.items()], *[F.count(b).alias(f"{k}_hits") for k, (_, b) in pairs.items()]).first().asDict()
    assert {k: wrong[k] for k in pairs if wrong[k]} == {}
    assert all(wrong[f"{k}_hits"] > 0 for k in pairs)


def test_strip_knows_all_white_space(spark):
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"{c}a{c}b{c}{c}",) for c in every] + [(None,), ("",), (" \n",), ("a\n",)], "s string")
    old = F.regexp_replace("s", rf"^[{fixed.WS}]+|[{fixed.WS}]+$", "")
    assert df.filter(~text.strip(F.col("s")).eqNullSafe(old)).count() == 0


def test_a_row_compiles_no_pattern_and_leaves_no_loop_by_an_exception(spark):
    docs = spark.createDataFrame([(1, ["x"])], "doc_id long, lines array<string>")
    plan = fields.extract_fields(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position(" not in plan
    assert not re.search(r"(?<!_)split\(", plan)


def test_text_before_a_match(one):
    cut = fixed.NAME_CUT
    assert one({"a": "Ravi dob 1", "b": "Ravi", "c": "ID x", "d": "a\nSEX b\nDOB", "e": None}, *[text.before(F.col(c), cut) for c in "abcde"]) == ("Ravi ", "Ravi", "", "a\n", None)
