"""What a document costs: searches that many tests of a line share run once a line, and odd lines keep their results."""

import re

import pytest
from pyspark.sql import functions as F

from docuvet.functions import text
from docuvet.operators import mrz, validation


def searches(spark, column):
    df = spark.createDataFrame([("x", ["x"])], "s string, lines array<string>").select(column.alias("c"))
    return len(re.findall(r"regexp_replace\(", df._jdf.queryExecution().optimizedPlan().toString()))


@pytest.mark.parametrize("compat", [False, True])
def test_a_line_is_cleaned_once_for_all_stop_words(spark, compat):
    assert searches(spark, F.filter("lines", lambda line: text.stop_word_line(line, compat))) == 1


def test_candidates_are_searched_once(spark):
    column = validation.pick_aadhaar(validation.aadhaar_candidates(F.col("s")))
    plan = spark.createDataFrame([("x",)], "s string").select(column.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1


def test_stop_words_of_odd_lines(spark):
    lines = [None, "", "ab", "A1B2C", "Ravi Kumar", "OFFICE OF GOVERNMENTS", "governmentofindia", "Davidson", "date", "Vid", "Ramdate"]
    df = spark.createDataFrame([(x,) for x in lines], "s string")
    found = [r[0] for r in df.select(text.stop_word_line(F.col("s"))).collect()]
    assert found == [None, True, True, False, False, True, True, False, True, True, False]


def test_zone_lines_of_odd_readings(spark):
    zone = "P<UTOSTRASSE<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<<"
    lines = [None, "", "<<<", "no filler but long enough for a zone line", zone, zone, zone.lower(), "P<" + "ß" * 13 + "<<", "  " + zone + " \t"]
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    found = df.select(mrz.mrz_candidates(F.col("lines"))).first()[0]
    assert found == [zone, "P<" + "SS" * 13 + "<<"]


def test_dates_that_hold_several_forms(one):
    parsed = one(
        {"a": "31/13/1999", "b": "1999-2-3 or 04/05/1980", "c": "32 foo 1999", "d": "", "e": "n/a"},
        *[text.parse_date(F.col(c)) for c in "abcde"],
    )
    assert [tuple(p) for p in parsed] == [("1999-01-01", "YEAR"), ("1980-05-04", "DAY"), ("1999-01-01", "YEAR"), (None, None), (None, "NONE")]
