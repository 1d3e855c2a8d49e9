"""Check digits and digests as native column expressions.

Fixed-length inputs are unrolled, so the whole check stays inside generated code;
only the variable-length ICAO check uses an array fold.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.stages import let


def _dihedral(a: int, b: int) -> int:
    """Product in the dihedral group of order ten: 0-4 rotations, 5-9 reflections."""
    turn = (a + b) if a < 5 else (a - b)
    return turn % 5 + (0 if (a < 5) == (b < 5) else 5)


def _permuted(digit: int, times: int) -> int:
    for _ in range(times % 8):
        digit = fixed.VERHOEFF_PERMUTATION[digit]
    return digit


def _block_products(first: int) -> list[int]:
    """Group product of three neighbouring digits abc, read from the right at ``first``."""
    return [
        _dihedral(_dihedral(_permuted(n % 10, first), _permuted(n // 10 % 10, first + 1)), _permuted(n // 100, first + 2))
        for n in range(1000)
    ]


PRODUCT = [_dihedral(a, b) for a in range(10) for b in range(10)]
INVERSE = [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)]


def _lookup(values: list[int], index: Column) -> Column:
    """Array lookup; the array is folded to one constant by the optimizer."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), index)


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, fixed.NOT_DIGIT, "")


def _verhoeff_state(digits: Column, shift: int) -> Column:
    """State after twelve digits: four block lookups joined by three group products.

    One lookup per block of three keeps the generated code small enough to be compiled.
    """
    state = None
    for block in range(4):
        number = F.substring(digits, 10 - 3 * block, 3).try_cast("int")
        product = _lookup(_block_products(3 * block + shift), number)
        state = product if state is None else _lookup(PRODUCT, state * 10 + product)
    return state


def verhoeff_valid_digits(digits: Column) -> Column:
    """Verhoeff test of a string already known to be twelve ASCII digits."""
    return _verhoeff_state(digits, 0) == 0


def verhoeff_valid(s: Column) -> Column:
    digits = digits_only(s)
    return F.coalesce(F.when(digits.rlike("^[0-9]{12}$"), verhoeff_valid_digits(digits)), F.lit(False))


def verhoeff_digit(prefix: Column) -> Column:
    """Check digit that completes an eleven-digit prefix; NULL for any other input."""
    digits = digits_only(prefix)
    # A leading zero would be one digit too many, so the block starts with the neutral state.
    tail = _verhoeff_state(F.concat(F.lit("0"), digits), 1)
    neutral = _permuted(0, 12)
    undo = [_dihedral(state, INVERSE[neutral]) for state in range(10)]
    return F.when(digits.rlike("^[0-9]{11}$"), _lookup([INVERSE[s] for s in undo], tail))


def icao_check_digit(s: Column, length: int | None = None) -> Column:
    """7-3-1 weighted sum modulo 10. Pass ``length`` for fixed-width MRZ fields.

    Modulo 10, a block abc weighs 7a + 3b + c = 7(abc div 100) + 3(abc div 10) + abc, so the
    fixed-width form takes three characters at a time.
    """
    clean = s if length is not None else F.regexp_replace(F.upper(s), fixed.MRZ_KEEP, "<")
    values = F.translate(clean, fixed.ICAO_LETTERS, fixed.ICAO_VALUES_MOD_10)
    if length is not None:
        total = F.lit(0)
        padded = F.rpad(values, (length + 2) // 3 * 3, "0")
        for start in range(1, length + 1, 3):
            total = total + _block_weight(F.substring(padded, start, 3))
        return total % 10
    blocks = F.ceil(F.length(values) / 3).cast("int")
    padded = F.rpad(values, blocks * 3, F.lit("0"))

    def total_of(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1)), F.lit(3))
        block = lambda i: F.coalesce(_block_weight(F.substring(v, i, F.lit(3))), F.lit(0))
        return F.aggregate(starts, F.lit(0), lambda acc, i: acc + block(i))

    return let(padded, total_of) % 10


def _block_weight(block: Column) -> Column:
    n = block.try_cast("int")
    tens, hundreds = (n / 10).cast("int"), (n / 100).cast("int")
    return n % 10 + tens % 10 * 3 + hundreds * 7


def verify_check_digit(data: Column, expected: Column, length: int | None = None) -> Column:
    """Struct of validity, calculated digit and the digit that was expected."""
    shown = F.trim(expected)
    number = F.when(shown == "<", 0).otherwise(shown.try_cast("int"))
    calculated = icao_check_digit(data, length)
    return F.struct(
        F.coalesce(calculated == number, F.lit(False)).alias("valid"),
        calculated.alias("calculated"),
        F.coalesce(number.cast("string"), shown).alias("expected"),
    )


def evidence_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def short_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


def evidence_hash(stored: Column, case_id: Column) -> Column:
    """Stored digest, or a digest of the case id where none was recorded."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.sha2(case_id.cast("string").cast("binary"), 256))


def case_id(day: Column, natural_key: Column, prefix: str = "CYBER") -> Column:
    """Repeatable case number: prefix, day and six hex digits of the natural key."""
    suffix = F.upper(F.substring(F.md5(natural_key.cast("string").cast("binary")), 1, 6))
    return F.concat(F.lit(prefix + "-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), suffix)
