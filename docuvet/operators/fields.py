"""Identity fields from the text lines of each document, one row per document.

The input carries a document's lines as an array, the shape in which text recognition
delivers them, so extraction needs no shuffle and no grouping. Columns are added in
stages: every pattern is searched at most once per document, and a labelled pattern only
where its label occurs at all.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.stages import compute_once, let
from docuvet.functions.text import (
    before, contains_any, mask_doc_number, non_empty, normalize_date, normalize_text, parse_date, stop_word_line, strip,
)

FIELDS = ("document_type", "name", "dob", "doc_number", "expiry_date", "issue_date", "address", "gender",
          "nationality", "pin_code", "masked_doc_number")
KEY_FIELDS = ("name", "dob", "doc_number", "expiry_date", "address", "gender")


def text_lines(text: Column) -> Column:
    """Non-blank, stripped lines of a text."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def classify_document(upper: Column) -> Column:
    """First keyword group that occurs in the upper-cased text."""
    kind = None
    for name, words in fixed.DOCUMENT_KEYWORDS:
        hit = contains_any(upper, words)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.otherwise(fixed.UNKNOWN)


def _missing(prefix: str, before: int) -> Column:
    """True where the patterns before this one found nothing."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{prefix}_{i}"), F.lit("")) == "" for i in range(before)])


def _searches() -> list[dict[str, Column]]:
    """Searches in rounds: those of a later round need what the earlier ones found.

    A pattern is searched only where a label of its own occurs in the upper-cased text, or digits in the number that it asks for, and
    nothing of the same field was found before. A look at the next character (``first``) spares the alternatives, and the
    look back for a word boundary, at most places.
    """
    text, upper, runs = F.col("raw_text"), F.col("upper_text"), F.col("digit_runs")
    found = lambda column, pattern, first: F.regexp_extract(column, f"(?={first}){pattern}", 1)
    labelled = lambda labels, pattern, first: F.when(contains_any(upper, labels), found(text, pattern, first))
    # Runs of digits say exactly enough: a bounded number is a run, and only white space lies between the parts of a spaced one.
    numbered = lambda form, column, pattern, first="[0-9]": F.when(runs.rlike(form), found(column, pattern, first))
    year = "(?:19|20)[0-9]{2}(?: |$)"
    birth, dated = ("DOB", "D.O.B", "D0B", "BIRTH", "BORN", "जन्म"), lambda i, search: F.when(_missing("dob", i), search)
    return [
        {
            "dob_0": labelled(birth, fixed.DOB_PATTERNS[0], "[DdBbज]"),
            "exp_0": labelled(("EXP", "VALID"), fixed.EXPIRY_PATTERNS[0], "[EeVv]"),
            "iss_0": labelled(("ISSUE", "DOI"), fixed.ISSUE_PATTERNS[0], "[IiDd]"),
            "sex_0": labelled(("SEX", "GENDER", "लिंग"), fixed.GENDER_PATTERN, "[SsGgल]"),
            "nat_0": labelled(("NATIONALITY", "CITIZENSHIP", "राष्ट्रीयता"), fixed.NATIONALITY_PATTERN, "[NnCcर]"),
        },
        {
            "dob_1": dated(1, labelled(("DOB", "D.O.B", "D0B", "DATE OF BIRTH"), fixed.DOB_PATTERNS[1], "[Dd]")),
            "exp_1": F.when(_missing("exp", 1), labelled(("EXPIR", "VALID TILL", "VALID UPTO"), fixed.EXPIRY_PATTERNS[1], "[EeVv]")),
            "iss_1": F.when(_missing("iss", 1), labelled(("ISSUE",), fixed.ISSUE_PATTERNS[1], "[IiDd]")),
            "name_0": labelled(("NAME", "नाम"), fixed.NAME_PATTERNS[0], "[NnFfAaCcन]"),
        },
        {
            "dob_2": dated(2, labelled(("YEAR OF BIRTH", "YOB", "जन्म"), fixed.DOB_PATTERNS[2], "[Yyज]")),
            "name_1": labelled(("SURNAME", "NOM"), fixed.NAME_PATTERNS[1], "[SsNn]"),
            "name_2": labelled(("GIVEN NAME", "PRENOMS"), fixed.NAME_PATTERNS[2], "[GgPp]"),
            "adr_0": labelled(("ADDR", "RESIDENCE", "पता", "/O"), fixed.ADDRESS_PATTERN, "[AaRrCcSsWwDdप]"),
            # A lambda ends the generated method here; all rounds in one would be too large for the JVM to compile.
            "digit_runs": let(F.regexp_extract_all("upper_text", F.lit("[0-9]{4,}[A-Z]?"), F.lit(0)), lambda found: F.array_join(found, " ")),
        },
        {
            "dob_3": dated(3, numbered(year, text, fixed.DOB_PATTERNS[3], "[0-3]")),
            "pin_0": numbered("(?:^| )[1-9][0-9]{5}(?: |$)", text, fixed.PIN_CODE, "[1-9]"),
            "num_0": numbered("[2-9][0-9]{3} [0-9]{4} [0-9]{4}", text, fixed.AADHAAR_SPACED, "[2-9]"),
        },
        {
            "dob_4": dated(4, numbered(year, text, fixed.DOB_PATTERNS[4], "[0-9]")),
            "num_1": numbered("[0-9]{4}[A-Z]", upper, fixed.PAN_NUMBER, "[A-Z]{5}[0-9]"),
            "num_2": F.when(upper.contains("PASSPORT"), F.regexp_extract(upper, fixed.PASSPORT_NUMBER, 1)),
            "num_3": numbered("[0-9]{11}", upper, fixed.LICENSE_NUMBER, "[A-Z]{2}"),
        },
    ]


def _found(prefix: str, count: int) -> Column:
    return F.coalesce(*[non_empty(F.col(f"{prefix}_{i}")) for i in range(count)])


def _labelled_passport_number() -> Column:
    """Value after the label on the first line that has a passport-number label and a value."""
    values = F.transform(
        F.filter("lines", lambda line: line.rlike(fixed.PASSPORT_LABEL)),
        lambda line: F.regexp_extract(line, fixed.PASSPORT_LABEL_VALUE, 1),
    )
    return F.get(F.filter(values, lambda v: v != ""), 0)


def _doc_number(older: bool) -> Column:
    passport = F.col("upper_text").contains("PASSPORT") | (F.col("document_type") == fixed.PASSPORT)
    # A PASSEPORT or REPUBLIC OF document may lack the word that gates the cheap search above.
    bare = F.coalesce(non_empty(F.col("num_2")), non_empty(F.regexp_extract("upper_text", fixed.PASSPORT_NUMBER, 1)))
    steps = [
        non_empty(F.col("num_0")),
        non_empty(F.col("num_1")),
        F.when(passport, F.coalesce(_labelled_passport_number(), bare)),
    ]
    if older:
        steps += [non_empty(F.regexp_extract("raw_text", p, 1)) for p in (fixed.LABELLED_NUMBER, fixed.COMPACT_NUMBER)]
    else:
        steps.append(non_empty(F.col("num_3")))
    return strip(F.coalesce(*steps))


def _type_from_number(older: bool) -> Column:
    """Documents without a known heading take the type of the first number that matched."""
    unknown = F.col("document_type") == fixed.UNKNOWN
    kind = F.when(unknown & (F.col("num_0") != ""), fixed.AADHAAR).when(unknown & (F.col("num_1") != ""), fixed.PAN)
    if not older:
        kind = kind.when(unknown & (F.col("num_3") != ""), fixed.DRIVER_LICENSE)
    return kind.otherwise(F.col("document_type"))


def _name_candidate(raw: Column) -> Column:
    return strip(before(strip(F.substring_index(raw, "\n", 1)), fixed.NAME_CUT))


def extract_name(compat: bool = False) -> Column:
    """Labelled name, else the nearest plausible line above the birth date, else one of the first lines."""

    def plausible(line: Column, pattern: str | None = None) -> Column:
        # The cheap test of the line's form comes first; few lines go on to the search for stop words.
        return (line.rlike(pattern) if pattern else F.length(line) >= 3) & ~stop_word_line(line, compat)

    def first_of(lines: Column, pattern: str | None = None) -> Column:
        # Lines after the first plausible one are not tested.
        return F.aggregate(lines, F.lit(None).cast("string"), lambda found, line: F.coalesce(found, F.when(plausible(line, pattern), line)))

    raw = F.array_compact(F.array(*[non_empty(F.col(f"name_{i}")) for i in range(3)]))
    labelled = first_of(F.transform(raw, _name_candidate))
    # The least place, not array_position: outside generated code that leaves its loop by an exception, the costliest step of a name.
    dob_places = F.transform("lines", lambda line, i: F.when(let(F.upper(line), lambda upper: contains_any(upper, fixed.DOB_LINE_WORDS)), i + 1))
    anchored = F.when(contains_any(F.col("upper_text"), fixed.DOB_LINE_WORDS), F.array_min(dob_places))
    anchor = F.coalesce(anchored, F.lit(0)).cast("int")
    above = F.reverse(F.slice("lines", F.lit(1), F.greatest(anchor - 1, F.lit(0))))
    nearest = first_of(above, fixed.NAME_LINE_ABOVE)
    top = F.slice("lines", 1, fixed.NAME_SEARCH_LINES)
    first = first_of(top, fixed.NAME_LINE_TOP)
    return non_empty(normalize_text(F.coalesce(labelled, nearest, first)))


def _gender() -> Column:
    return let(
        F.upper(non_empty(F.col("sex_0"))),
        lambda g: F.when(g.isin(*fixed.MALE_WORDS), "MALE").when(g.isin(*fixed.FEMALE_WORDS), "FEMALE").otherwise(g),
    )


def _labelled_address() -> Column:
    address = F.replace(F.col("adr_0"), F.lit("\n"), F.lit(", "))
    for phrase in fixed.ADDRESS_BANNED_PHRASES:
        address = F.regexp_replace(address, "(?i)" + phrase.replace(".", r"\."), "")
    return normalize_text(before(address, fixed.ADDRESS_CUT))


def _address(compat: bool) -> Column:
    """A labelled address wins even when cleaning leaves too little of it."""
    found = non_empty(F.col("adr_0")).isNotNull()

    def has_pin(line: Column) -> Column:
        heading = let(F.upper(line), lambda upper: contains_any(upper, fixed.ADDRESS_HEADING_WORDS))
        return (
            line.rlike(fixed.PIN_CODE) & ~heading & ~stop_word_line(line, compat)
            & (F.length(normalize_text(line)) >= fixed.MIN_ADDRESS_LENGTH)
        )

    by_pin = F.when(non_empty(F.col("pin_0")).isNotNull(), normalize_text(F.get(F.filter("lines", has_pin), 0)))
    labelled = let(_labelled_address(), lambda a: F.when(F.length(a) >= fixed.MIN_ADDRESS_LENGTH, a))
    return F.when(found, labelled).otherwise(let(by_pin, non_empty))


def extract_fields(docs: DataFrame, compat: bool = False, older_numbers: bool = False) -> DataFrame:
    """Add the identity fields to a table that has an array column ``lines``.

    ``compat`` rejects names by substring instead of by word; ``older_numbers`` uses the
    earlier number rules (a labelled number, then two letters and 9 to 13 digits).
    """
    keep = docs.columns
    df = docs.withColumn("raw_text", F.array_join("lines", "\n")).withColumns(
        {"upper_text": F.upper("raw_text")}
    )
    for searches in _searches():
        df = df.withColumns(searches)
    df = compute_once(df.withColumn("document_type", classify_document(F.col("upper_text"))))
    df = df.withColumns(
        {
            "doc_number": _doc_number(older_numbers),
            "dob_raw": strip(_found("dob", 5)),
            "expiry_raw": strip(_found("exp", 2)),
            "issue_raw": strip(_found("iss", 2)),
        }
    )
    df = df.withColumns(
        {
            "document_type": _type_from_number(older_numbers),
            "dob_parsed": parse_date(F.col("dob_raw")),
            "expiry_date": normalize_date(F.col("expiry_raw")),
            "issue_date": normalize_date(F.col("issue_raw")),
        }
    )
    df = df.withColumns({"name": extract_name(compat), "address": _address(compat)})
    df = df.withColumns(
        {
            "dob": F.coalesce("dob_parsed.iso", non_empty(F.col("dob_raw"))),
            "dob_precision": F.col("dob_parsed.precision"),
        }
    )
    df = df.withColumns(
        {
            "gender": _gender(),
            "nationality": F.upper(non_empty(F.col("nat_0"))),
            "pin_code": non_empty(F.col("pin_0")),
            "masked_doc_number": mask_doc_number(F.col("doc_number")),
        }
    )
    passed_through = [c for c in keep if c not in FIELDS and c not in ("raw_text", "upper_text", "digit_runs", "dob_precision")]
    return compute_once(df.select(*passed_through, "raw_text", "upper_text", *FIELDS, "dob_precision"))


def detected_field_count() -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in KEY_FIELDS), F.lit(0))
