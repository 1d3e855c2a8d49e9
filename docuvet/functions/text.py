"""Text normalisation, dates, masking and small string helpers."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.checksums import digits_only
from docuvet.functions.stages import let


def non_empty(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[non_empty(c) for c in columns])


def strip(s: Column) -> Column:
    """Unicode-wide trim; no search, as a pattern would try every character."""
    return F.btrim(s, F.lit(fixed.WS_CHARACTERS))


def normalize_text(s: Column) -> Column:
    """Runs of white space become one blank; NULL becomes the empty string."""
    return F.coalesce(F.trim(F.regexp_replace(s, rf"[{fixed.WS}]+", " ")), F.lit(""))


def fix_ocr_digits(s: Column) -> Column:
    """Letters that are commonly misread digits: O o D, I l | !, S s, B, Z z."""
    return F.translate(s, "OoDIl|!SsBZz", "000111155822")


def before(s: Column, pattern: str) -> Column:
    """The text before the first match; a split would compile the pattern for every row."""
    return F.regexp_replace(s, rf"(?s)(?:{pattern}).*", "")


def contains_any(s: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(w) for w in words])


def match(s: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, or NULL."""
    return non_empty(F.regexp_extract(s, pattern, group))


def _checked(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a date whose parts lie in their ranges; months are not matched with days."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.when(
        day.between(1, 31) & month.between(1, 12) & year.between(fixed.MIN_YEAR, fixed.MAX_YEAR),
        F.concat(year.cast("string"), F.lit("-"), two(month), F.lit("-"), two(day)),
    )


def _dated(d: Column, pattern: str, year: int, month: int, day: int) -> Column:
    """Search once; the parts are then read from the short match."""

    def parts(found: Column) -> Column:
        if pattern == fixed.DATE_D_MON_Y:
            place = F.instr(F.lit(" ".join(fixed.MONTHS)), F.regexp_extract(found, "[A-Z]{3}", 0))
            number = F.floor((place + 3) / 4).cast("int")
            texts = {year: F.right(found, F.lit(4)), day: F.regexp_extract(found, "^[0-9]+", 0)}
        else:
            one = F.translate(found, "-.", "//")
            texts = {1: F.substring_index(one, "/", 1), 2: F.substring_index(F.substring_index(one, "/", 2), "/", -1), 3: F.substring_index(one, "/", -1)}
            number = texts[month].try_cast("int")
        return F.struct(texts[year].try_cast("int").alias("y"), number.alias("m"), texts[day].try_cast("int").alias("d"))

    return let(
        F.regexp_extract(d, pattern, 0),
        lambda found: F.when(found != "", let(parts(found), lambda p: _checked(p["y"], p["m"], p["d"]))),
    )


def parse_date(s: Column) -> Column:
    """ISO form and precision (DAY, YEAR or NONE) of a printed date.

    Tries D/M/Y, Y/M/D, D Mon Y and a bare year; any other text is kept as it is.
    """

    def build(d: Column) -> Column:
        exact = F.coalesce(
            _dated(d, fixed.DATE_DMY, 3, 2, 1), _dated(d, fixed.DATE_YMD, 1, 2, 3), _dated(d, fixed.DATE_D_MON_Y, 3, 2, 1)
        )
        bare = let(
            F.regexp_extract(d, fixed.DATE_YEAR, 1).try_cast("int"),
            lambda y: F.when(y.between(fixed.MIN_YEAR, fixed.MAX_YEAR), F.concat(y.cast("string"), F.lit("-01-01"))),
        )
        result = lambda iso, precision: F.struct(iso.alias("iso"), precision.alias("precision"))
        without_day = let(bare, lambda year: result(year, F.when(year.isNotNull(), "YEAR").when(d != "", "NONE")))
        return let(exact, lambda day: F.when(day.isNotNull(), result(day, F.lit("DAY"))).otherwise(without_day))

    return let(F.upper(strip(s)), build)


def normalize_date(s: Column) -> Column:
    return F.when(s.isNotNull(), F.coalesce(parse_date(s)["iso"], non_empty(s)))


def date_precision(s: Column) -> Column:
    return parse_date(s)["precision"]


def mask_doc_number(s: Column) -> Column:
    digits = digits_only(s)
    tail = F.right(digits, F.lit(4))
    return (
        F.when(F.length(digits) == 12, F.concat(F.lit("XXXX XXXX "), tail))
        .when(F.length(digits) >= 6, F.concat(F.lit("XXXX "), tail))
        .otherwise(s)
    )


def mask_sensitive_id(s: Column) -> Column:
    clean = F.regexp_replace(s, rf"[{fixed.WS}]+", "")
    tail = F.right(clean, F.lit(4))
    return (
        F.when(non_empty(s).isNull(), "N/A")
        .when(clean.rlike(r"^\p{Nd}{12}$"), F.concat(F.lit("XXXX-XXXX-"), tail))
        .when(F.length(clean) > 6, F.concat(F.substring(clean, 1, 2), F.lit("***"), tail))
        .otherwise(s)
    )


def payload_summary(s: Column, length: int = 120) -> Column:
    return F.when(F.length(s) > length, F.concat(F.substring(s, 1, length), F.lit("..."))).otherwise(s)


def stop_word_line(s: Column, compat: bool = False) -> Column:
    """True where a line is a heading or a label and cannot be a person's name.

    A heading holds one of the stop words as a word of its own, or a long one anywhere, as recognition glues words together.
    ``compat`` asks for containment of all in either direction instead (which also rejects names such as DAVID).
    """
    words = "|".join(fixed.NAME_STOP_WORDS)
    long = [w for w in fixed.NAME_STOP_WORDS if len(w) >= fixed.GLUED_STOP_WORD_LENGTH]
    # A word that lies inside a stop word lies inside the list joined by a separator.
    joined = F.lit("|" + words + "|")

    def rejected(letters: Column) -> Column:
        if compat:
            hit = contains_any(letters, fixed.NAME_STOP_WORDS) | F.contains(joined, letters)
        else:
            hit = contains_any(letters, long) | s.rlike(rf"(?i){fixed.B0}(?:{words}){fixed.B1}")
        return (F.length(letters) < 3) | hit

    # Inside a lambda nothing is shared: without the binding, every word would clean the line anew.
    return let(F.upper(F.regexp_replace(s, "[^A-Za-z]", "")), rejected)
