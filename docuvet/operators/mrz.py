"""Machine readable zones: finding the lines, cutting the fields, checking the digits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.checksums import verify_check_digit
from docuvet.functions.stages import compute_once
from docuvet.functions.text import contains_any, non_empty

FORMATS = ("TD3", "TD1", "TD2")
MRZ_FIELDS = ("mrz_status", "mrz_format", "mrz_code", "mrz_country", "mrz_surname", "mrz_given_names", "mrz_number",
              "mrz_nationality", "mrz_dob", "mrz_sex", "mrz_expiry", "mrz_optional", "mrz_checks")


def mrz_applicable(document_type: Column) -> Column:
    return ~contains_any(F.upper(F.coalesce(document_type, F.lit(fixed.UNKNOWN))), fixed.MRZ_EXCLUDED_TYPES)


def mrz_candidates(lines: Column, compat: bool = False) -> Column:
    """Distinct cleaned lines in reading order that could belong to a machine readable zone.

    The second and third line of a zone start with any character. ``compat`` wants one of
    five letters at the start of every line and one filler more.
    """
    fillers = 3 if compat else 2

    def possible(line: Column) -> Column:
        count = F.length(line) - F.length(F.replace(line, F.lit("<"), F.lit("")))
        ok = (F.length(line) >= 28) & (count >= fillers)
        return ok & F.substring(line, 1, 1).isin(*fixed.MRZ_FIRST_LETTERS) if compat else ok

    # Cleaning adds no filler, so only lines that have one are cleaned, and equal lines once.
    filled = F.filter(F.array_distinct(lines), lambda line: F.contains(line, F.lit("<")))
    cleaned = F.transform(filled, lambda line: F.regexp_replace(F.upper(line), fixed.MRZ_KEEP, ""))
    return F.array_distinct(F.filter(cleaned, possible))


def _lines_of(kind: str, compat: bool) -> Column:
    _, _, low, high, letters = fixed.MRZ_SIZES[kind]

    def fits(line: Column) -> Column:
        ok = F.length(line).between(low, high)
        return ok & F.substring(line, 1, 1).isin(*letters) if compat else ok

    return F.filter("mrz_candidates", fits)


def find_mrz(docs: DataFrame, compat: bool = False) -> DataFrame:
    """Add format and padded lines; needs ``lines``, ``raw_text`` and ``document_type``."""
    applicable = mrz_applicable(F.col("document_type"))
    # Other columns named lines or raw_text may hold different readings of the same document.
    every = F.concat("lines", F.split(F.coalesce("raw_text", F.lit("")), "\n"))
    df = docs.withColumn("mrz_candidates", F.when(applicable, mrz_candidates(every, compat)))
    df = df.withColumns({f"_{kind}": _lines_of(kind, compat) for kind in FORMATS})
    kind = None
    for name in FORMATS:
        hit = F.size(f"_{name}") >= fixed.MRZ_SIZES[name][1]
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    joined = F.upper(F.replace("raw_text", F.lit(" "), F.lit("")))
    df = df.withColumn("_kind", kind).withColumns(
        {
            f"_joined{i}": F.when(applicable & F.col("_kind").isNull() & joined.contains("P<"),
                                  non_empty(F.regexp_extract(joined, fixed.MRZ_JOINED, i)))
            for i in (1, 2)
        }
    )
    df = df.withColumn("mrz_kind", F.coalesce("_kind", F.when(F.col("_joined1").isNotNull(), "TD3")))

    def line(i: int) -> Column:
        found = F.when(F.col("_kind").isNull(), F.col(f"_joined{i}") if i < 3 else F.lit(None).cast("string"))
        for name in FORMATS:
            found = found.when(F.col("_kind") == name, F.get(f"_{name}", i - 1)) if i <= fixed.MRZ_SIZES[name][1] else found
        width = F.when(F.col("mrz_kind") == "TD3", 44).when(F.col("mrz_kind") == "TD1", 30).otherwise(36)
        return F.rpad(F.substring(found, F.lit(1), width), width, F.lit("<"))

    df = df.withColumns({f"mrz_line{i}": line(i) for i in (1, 2, 3)})
    dropped = ["mrz_candidates", "_kind", "_joined1", "_joined2", *[f"_{k}" for k in FORMATS]]
    return compute_once(df.drop(*dropped))


def _cut(place) -> Column:
    line, first, last = place
    return F.substring(F.col(f"mrz_line{line}"), first, last - first + 1)


def _by_format(values: dict[str, Column]) -> Column:
    chosen = None
    for kind, value in values.items():
        hit = F.col("mrz_kind") == kind
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return chosen


def _field(name: str) -> Column:
    return _by_format({kind: _cut(places[name]) for kind, places in fixed.MRZ_LAYOUT.items() if name in places})


def _plain(s: Column) -> Column:
    return F.replace(s, F.lit("<"), F.lit(""))


def mrz_date(raw: Column, birth: bool) -> Column:
    """YYMMDD as an ISO date; birth years above 30 belong to the last century."""
    yy, mm, dd = F.substring(raw, 1, 2), F.substring(raw, 3, 2), F.substring(raw, 5, 2)
    number = yy.try_cast("int")
    century = F.when(number.isNull(), "").when((number > 30) & F.lit(birth), "19").otherwise("20")
    short = F.coalesce(F.length(raw), F.lit(0)) < 6
    return F.when(short, F.coalesce(non_empty(raw), F.lit("N/A"))).otherwise(
        F.concat(century, yy, F.lit("-"), mm, F.lit("-"), dd)
    )


def _check(field: str, shown: Column, result: Column) -> Column:
    return F.struct(
        F.lit(fixed.MRZ_CHECK_NAMES[field]).alias("name"), F.lit(field).alias("field"), shown.alias("data"),
        result["expected"].alias("expected"), result["calculated"].alias("calculated"), result["valid"].alias("valid"),
    )


def parse_mrz(found: DataFrame) -> DataFrame:
    """Cut the fields of the lines added by ``find_mrz`` and verify all check digits."""
    names = ("names", "number", "number_cd", "nationality", "dob", "dob_cd", "sex", "expiry", "expiry_cd", "optional",
             "composite_cd")
    composite = _by_format({k: F.concat(*[_cut(p) for p in parts]) for k, parts in fixed.MRZ_COMPOSITE.items()})
    df = found.withColumns({f"_{n}": _field(n) for n in names} | {"_composite": composite})
    # Trailing fillers count nothing, so both composites can share one width.
    df = compute_once(df).withColumns(
        {
            "_v_number": verify_check_digit(F.col("_number"), F.col("_number_cd"), 9),
            "_v_dob": verify_check_digit(F.col("_dob"), F.col("_dob_cd"), 6),
            "_v_expiry": verify_check_digit(F.col("_expiry"), F.col("_expiry_cd"), 6),
            "_v_composite": verify_check_digit(F.rpad(F.col("_composite"), 51, "<"), F.col("_composite_cd"), 51),
        }
    )
    tokens = F.split("_names", "<<")
    code = _plain(F.substring("mrz_line1", 1, 2))
    default_code = _by_format({k: F.lit(v) for k, v in fixed.MRZ_DEFAULT_CODE.items()})
    always = F.array(
        _check("document_number", _plain(F.col("_number")), F.col("_v_number")),
        _check("dob", F.col("_dob"), F.col("_v_dob")),
        _check("expiry_date", F.col("_expiry"), F.col("_v_expiry")),
    )
    whole = F.array(_check("composite", F.lit("Composite String"), F.col("_v_composite")))
    checks = F.when(F.col("mrz_kind") == "TD2", always).otherwise(F.concat(always, whole))
    spaced = lambda s: F.trim(F.replace(s, F.lit("<"), F.lit(" ")))
    df = df.withColumns(
        {
            "mrz_format": F.coalesce("mrz_kind", F.lit("NONE")),
            "mrz_code": F.coalesce(non_empty(code), default_code, code),
            "mrz_country": _plain(F.substring("mrz_line1", 3, 3)),
            "mrz_surname": spaced(F.get(tokens, 0)),
            "mrz_given_names": F.when(F.col("_names").isNotNull(), F.coalesce(spaced(F.get(tokens, 1)), F.lit(""))),
            "mrz_number": _plain(F.col("_number")),
            "mrz_nationality": _plain(F.col("_nationality")),
            "mrz_dob": F.when(F.col("_dob").isNotNull(), mrz_date(F.col("_dob"), True)),
            "mrz_sex": F.when(F.col("_sex") == "M", "MALE").when(F.col("_sex") == "F", "FEMALE")
            .when(F.col("_sex").isNotNull(), "UNSPECIFIED"),
            "mrz_expiry": F.when(F.col("_expiry").isNotNull(), mrz_date(F.col("_expiry"), False)),
            "mrz_optional": non_empty(_plain(F.col("_optional"))),
            "mrz_checks": F.when(F.col("mrz_kind").isNotNull(), checks),
        }
    )
    df = compute_once(df).withColumn(
        "mrz_status",
        F.when(F.col("mrz_kind").isNull(), "NOT_APPLICABLE")
        .when(F.forall("mrz_checks", lambda c: c["valid"]), "VERIFIED")
        .otherwise("FAILED"),
    )
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in found.columns])


def with_mrz(docs: DataFrame, compat: bool = False) -> DataFrame:
    return parse_mrz(find_mrz(docs, compat))
