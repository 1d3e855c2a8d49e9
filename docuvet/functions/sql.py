"""Check digits and masks for ``spark.sql``: SQL functions, which the optimizer inlines like any other expression."""

from pyspark.sql import SparkSession

from docuvet import fixed
from docuvet.functions.checksums import PRODUCT, _permuted


def _array(values) -> str:
    return f"array({', '.join(map(str, values))})"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Digits permuted by their place from the right, then joined by group products.
_VERHOEFF = (
    f"aggregate(sequence(1, 12), 0, (state, i) -> element_at({_array(PRODUCT)}, state * 10 + "
    f"element_at({_array(_permuted(d, n) for n in range(8) for d in range(10))}, (i - 1) % 8 * 10 + CAST(substr(d, 13 - i, 1) AS INT) + 1) + 1)) = 0"
)
_DIGITS = f"regexp_replace(s, {_quoted(fixed.NOT_DIGIT)}, '')"
_ICAO = f"translate(regexp_replace(upper(coalesce(s, '')), {_quoted(fixed.MRZ_KEEP)}, '<'), '{fixed.ICAO_LETTERS}', '{fixed.ICAO_VALUES_MOD_10}')"

FUNCTIONS = {
    "digits_only": f"(s STRING) RETURNS STRING RETURN {_DIGITS}",
    "icao_check_digit": (
        f"(s STRING) RETURNS INT RETURN aggregate(transform(filter(split({_ICAO}, ''), c -> c <> ''), (c, i) -> CAST(c AS INT) * "
        "element_at(array(7, 3, 1), i % 3 + 1)), 0, (total, weighted) -> total + weighted) % 10"
    ),
    "verhoeff_valid": (
        "(s STRING) RETURNS BOOLEAN RETURN coalesce(try_element_at(transform(filter(array(digits_only(s)), d -> d RLIKE '^[0-9]{12}$'), "
        f"d -> {_VERHOEFF}), 1), false)"
    ),
    "mask_id": (
        "(s STRING) RETURNS STRING RETURN CASE WHEN length(digits_only(s)) = 12 THEN concat('XXXX XXXX ', right(digits_only(s), 4)) "
        "WHEN length(digits_only(s)) >= 6 THEN concat('XXXX ', right(digits_only(s), 4)) ELSE s END"
    ),
}


def register(spark: SparkSession) -> None:
    """Create the functions of this session; a second call changes nothing."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
