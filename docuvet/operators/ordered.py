"""Order-dependent columns that do not gather a key in one task.

Camera sessions are bounded by their clock, not by their key: a default session id can hold
a third of all frames. Rows are therefore ordered inside (key, time chunk) groups, and only
one summary row per chunk is carried along the key.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_chunk(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / F.lit(seconds)).cast("long")


def with_carried(
    df: DataFrame, key: str, order: list[str], latest: dict[str, str], running: dict[str, Column] | None = None
) -> DataFrame:
    """Latest known earlier value of columns, and running sums up to the row; needs a ``chunk`` column.

    ``latest`` maps new names to columns, whose NULLs are skipped; ``running`` maps names to
    flags or counts. One pass serves all of them.
    """
    running = running or {}
    inside = Window.partitionBy(key, "chunk").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({f"_add_{n}": c.cast("long") for n, c in running.items()})
    position = F.struct(*order)
    ends = [F.max_by(old, F.when(F.col(old).isNotNull(), position)).alias(f"_end_{new}") for new, old in latest.items()]
    sums = [F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in running]
    carried = rows.groupBy(key, "chunk").agg(*ends, *sums).select(
        F.col(key).alias("_key"), F.col("chunk").alias("_chunk"),
        *[F.last(f"_end_{new}", ignorenulls=True).over(earlier).alias(f"_from_{new}") for new in latest],
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_from_{n}") for n in running],
    )
    seen = rows.withColumns(
        {new: F.last(old, ignorenulls=True).over(before) for new, old in latest.items()}
        | {n: F.sum(f"_add_{n}").over(upto) for n in running}
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("chunk").eqNullSafe(F.col("_chunk"))
    joined = seen.join(carried, same, "left").drop("_key", "_chunk").withColumns(
        {new: F.coalesce(new, f"_from_{new}") for new in latest} | {n: F.col(n) + F.col(f"_from_{n}") for n in running}
    )
    return joined.drop(*[f"_from_{n}" for n in (*latest, *running)], *[f"_add_{n}" for n in running])
