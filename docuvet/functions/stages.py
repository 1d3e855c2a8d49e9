"""Stage boundaries inside long chains of derived columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KEYS = ("doc_id", "case_id", "image_id", "session_id", "owner_id")


def compute_once(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Same rows, with every column computed before any later filter or projection.

    The optimizer moves filters below projections and replaces each column by its defining
    expression. In a chain of many derived columns that repeats expensive searches and makes
    the plan grow without bound. A generator is not crossed by that rewrite; this one yields
    exactly one row per row and needs no shuffle. Columns named in ``keys`` pass beside it, so
    filters on them still reach the scan.
    """
    beside = [c for c in df.columns if c in keys]
    inside = [c for c in df.columns if c not in keys]
    if not inside:
        return df
    return df.select(*beside, F.inline_outer(F.array(F.struct(*inside)))).select(*df.columns)


def let(value: Column, body) -> Column:
    """Bind a value that ``body`` uses many times, so that it is computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)
