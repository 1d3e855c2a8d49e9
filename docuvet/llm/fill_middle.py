"""Fill-in-middle training texts from document records: lines are found by one match with repeated captures."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet.llm.textops import portions

#: One line of a document with its line feed, or a last line without one. Possessive, so that no match is ever taken back.
LINES = regex.compile(r"([^\n]*+\n|[^\n]++)*+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def line_ends(raw_text: str) -> list[int]:
    """Ends of all lines in code points. The pattern matches any text as a whole, and the match keeps every repetition."""
    return LINES.fullmatch(raw_text).ends(1)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers that depend on the document's number and the seed alone; a missing number counts as none."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id: int | None, raw_text: str, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Lines, form, lengths of prefix and middle, and output of one text."""
    ends = line_ends(raw_text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw_text or any(mark in raw_text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, PLAIN, None, None, raw_text
    ends = [0, *ends]
    a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = raw_text[:a], raw_text[a:b], raw_text[b:]
    if h4 % 100 < spm_rate:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(documents: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """Rearrange the lines of document records (``doc_id``, ``raw_text``) for learning to fill in their middle.

    A whole text is cut into its n recognised lines; two draws of a document's number choose how many lines end before the
    middle and with it. ``rate`` per cent of the documents are rearranged, of them ``spm_rate`` per cent with the suffix first.
    Texts that are empty or hold a mark stay plain. Returns doc_id, n (lines), form, prefix_chars and middle_chars (code points;
    null if plain) and output.
    Null text: as an empty one (n = 0, plain). Null doc_id: drawn as the number ''. Repeated rows give equal results; other
    columns are not used; no rows in, none out. Every row is on its own: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1):
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                found = [rearranged(k, t or "", seed, rate, spm_rate) for k, t in zip(keys.to_pylist(), texts, strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return documents.select(F.col("doc_id").cast("long"), F.col("raw_text").cast("string")).mapInArrow(run, SCHEMA)


def restored_text(form: Column, output: Column) -> Column:
    """The exact text of an output. A rearranged text holds no mark, so the marks of the output are its only ones."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    in_order = {PSM: (1, 3, 2), SPM: (2, 3, 1)}
    rebuilt = {name: F.concat(*[F.get(parts, n) for n in order]) for name, order in in_order.items()}
    return F.when(form == PSM, rebuilt[PSM]).when(form == SPM, rebuilt[SPM]).otherwise(output)
